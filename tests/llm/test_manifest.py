"""The Merkle manifest against a plain re-computation: odd sizes, many sources, nulls, ties, repeats, clashing columns, no rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def claim(d, s, g, n, t):
    even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
    return leaf(d, s, g, n, t.replace("\n", "") if even and t is not None else t)


def climb(level, i, fold):
    proof = []
    while len(level) > 1:
        run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
        proof += [level[k] for k in run if k != i]
        fold = h(*(fold if k == i else level[k] for k in run))
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
        i //= 3
    return level[0], proof, fold


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted((r[0] is not None, r[0] or 0, leaf(*r), claim(*r)) for r in rows if r[1] == s) for s in sources]
    subroots = [climb([x[2] for x in t], 0, "")[0] for t in trees]
    out = []
    for k, t in enumerate(trees):
        for i, (known, d, own, claimed) in enumerate(t):
            subroot, low, fold = climb([x[2] for x in t], i, claimed)
            root, high, fold = climb(subroots, k, fold)
            out.append((d if known else None, own, subroot, root, h(*low, *high), fold, fold == root))
    return out


def rows(n, n_sources):
    r = random.Random(n)
    source = lambda: "a" if n_sources == 1 else r.choice([None, "", *(f"s{i}é" for i in range(n_sources))])
    out = [(None if r.random() < 0.02 else r.randrange(2 * n), source(), r.choice(["en", None, ""]), r.choice([None, r.randrange(9)]), r.choice([None, "", "a\nb", "é\n\n", "x\n" * 5000, "-"])) for _ in range(n)]
    return out + out[: n // 10]


def plain(rs):
    return sorted((tuple(r) for r in rs), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("n, n_sources", [(0, 1), (1, 1), (29, 1), (2600, 4), (400, 300)])
def test_manifest(spark, n, n_sources):
    r = rows(n, n_sources)
    docs = spark.createDataFrame([(*x, 5, "k", 1, "p") for x in r], "doc_id long, source string, lang string, n_chars long, text string, tree int, key string, n int, proof string").repartition(3)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = manifest.manifest(docs, FIELDS, {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert plain(out.collect()) == plain(brute(r))


def test_no_lane_is_hot(spark):
    """A source of many families is spread over lanes: no key of the climb has more than LANE of them."""
    docs = spark.range(27 * 81 * 4 + 5).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    own = docs.select("source", F.col("doc_id").alias("key"), manifest.digest(F.col("doc_id")).alias("leaf"), F.lit("").alias("claim"))
    places, _ = manifest._places(own)
    links, _ = manifest.trees(manifest.stored(manifest._families(places, ("key", "claim"))))
    assert links.select("lane").distinct().count() == 5
    assert links.groupBy("lane", "tree", "level", "idx").count().where("count > 1").isEmpty()
    assert links.where("ended").count() == 5  # every lane passes one node below the root
