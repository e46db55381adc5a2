"""Each operator against brute force on small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat, decontaminate, embeddings, jaccard, mixing, packing, quality, rlz, sharding, tokencount, urls
from ledgerlens.llm import wordhash as W

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, bucket int, node long, shard int, spans string, taken long, kind string, score double"


def low(s):
    return (s or "").translate({c: c + 32 for c in range(65, 91)})


def rows():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(60), text(30)
    out = [None, "", "   \n\t", "one", "Two words", "a b c", base, base, base.upper(), "x " * 400, "x " * 30]
    for i in range(25):
        w = base.split()
        for _ in range(i % 6):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += [text(40) + " " + passage + "\n" + text(20) for _ in range(12)]
    out += [text(r.randint(1, 80)) for _ in range(40)]
    out.append(text(6000))
    docs = [(i * 3 % 101, t, ["s1", "s2", None, "s3"][i % 4]) for i, t in enumerate(out)]
    docs += [(7000, base, "s1"), (7000, base, "s1"), (7001, passage, "s2"), (7001, text(20), "s2"), (None, base, None), (None, None, None)]
    return [(d, t, s, "en", 1, 5, 6, 7, 8, "z", 9, "k", 0.5) for d, t, s in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def bag(rs):
    return Counter(tuple(r) for r in rs)


def test_rlz(docs):
    rows_ = rows()
    known = sorted((r[0], r[1]) for r in rows_ if r[0] is not None and r[1] is not None)
    first = {}
    for d, t in known:
        w = re.findall(SPACE, t)
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(d, first.get(tuple(w[i : i + 13]), d))
    want = []
    for d, t, *_ in rows_:
        w = re.findall(SPACE, t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    out = rlz.repeated_spans(docs, 13, buckets=7)
    assert bag(out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == bag(want)
    texts = defaultdict(list)
    for d, t, *_ in rows_:
        texts[d].append(re.findall(SPACE, t or ""))
    for r in out.collect():
        for s in r.spans:  # each factor stands in its reference
            assert any(w[s.start : s.start + s.length] == v[s.ref_start : s.ref_start + s.length] for w in texts[r.doc_id] for v in texts[s.ref_doc])
            assert s.ref_doc < r.doc_id and s.length >= 13


def test_rlz_texts_that_share_an_id(spark):
    """Each text is judged by its own windows; an exact copy says nothing of the other texts of its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 13), ("b", 20), ("c", 30)))
    table = [(1, a), (2, a), (2, b), (2, f"{c} {a}"), (3, b), (3, c), (3, f"{b} x {c}")]
    out = rlz.repeated_spans(spark.createDataFrame(table, "doc_id long, text string").repartition(3), 13, buckets=5)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in out.collect())
    assert got == Counter([(1, 13, 0), (2, 13, 13), (2, 20, 0), (2, 43, 13), (3, 20, 20), (3, 30, 30), (3, 51, 50)])


def test_jaccard_hot_region(spark):
    """20,000 sets that share half of their shingles and link with nothing, and families among them: regions far above REGION."""
    r = random.Random(8)
    half = " ".join(f"t{i}" for i in range(40))
    data = [(i, half + " " + " ".join(f"u{i}x{j}" for j in range(40))) for i in range(20_000)]
    for f in range(40):  # families of near copies of one of them
        words = data[f * 7][1].split()
        for j in range(3):
            w = list(words)
            w[r.randrange(2, len(w))] = f"z{f}y{j}"
            data.append((30_000 + f * 10 + j, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(docs, 4, 85).collect()}
    want = {i: i for i in range(20_000)}
    shingles = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    for f in range(40):
        ids = [f * 7, *(30_000 + f * 10 + j for j in range(3))]
        sets = {i: shingles(tuple((data[i] if i < 20_000 else data[20_000 + f * 3 + i % 10])[1].split())) for i in ids}
        name = {i: i for i in ids}
        for i in ids:
            for j in ids:
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    name = {x: min(name[i], name[j]) if y in (name[i], name[j]) else y for x, y in name.items()}
        want |= name
    assert got == want and len({got[i] for i in got if i >= 30_000} & set(range(20_000))) > 30


def test_jaccard_cells(spark, monkeypatch):
    """Families around several centres in one region: pivots split it, into few rows for each set, and no pair is lost."""
    monkeypatch.setattr(jaccard, "REGION", 40)
    r = random.Random(3)
    data, centres = [], [[f"c{c}w{j}" for j in range(60)] for c in range(12)]
    for i in range(600):
        w = list(centres[i % 12])
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = f"m{r.randrange(40)}"
        data.append((i, " ".join(w)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets = jaccard.shingle_sets(docs, 4).where("node is not null")
    info = sets.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    big = info.select(F.lit(1).cast("long").alias("region"), "node", "n", F.lit(0).cast("long").alias("own"), F.col("node").alias("comp"))
    big = jaccard._sized(big)
    split, stuck = jaccard._cells(big, info, 85)
    assert stuck.count() == 0 and split.count() <= jaccard.SPREAD * big.count()
    cells = defaultdict(set)
    for x in split.collect():
        cells[x.region].add(x.node)
    byid = {x.doc_id: x.node for x in sets.collect()}
    words = {byid[d]: t.split() for d, t in data}
    shingles = {n: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for n, w in words.items()}
    nodes = list(shingles)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if 100 * len(shingles[a] & shingles[b]) >= 85 * len(shingles[a] | shingles[b]):
                assert any(a in c and b in c for c in cells.values())


@pytest.mark.parametrize("k,percent,region,partners", [(4, 85, 512, 4), (5, 80, 2, 1), (2, 50, 3, 2)])
def test_jaccard(docs, k, percent, region, partners, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    sets, ids = [], []
    for d, t, *_ in rows():
        w = re.findall(SPACE, low(t))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
        ids.append(d)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    # rows that share a doc_id are connected through it only in the answer's naming, not by links
    want = [(d, len(sets[i]), None if d is None else least[find(i)]) for i, d in enumerate(ids)]
    assert bag(jaccard.jaccard_components(docs, k, percent, buckets=5).collect()) == bag(want)


def item_hits(rows_, items, k):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row, by brute force."""
    wins = defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, low(t))
        if i is None or not w:
            continue
        for a in range(max(1, len(w) - k + 1)):
            wins[tuple(w[a : a + k])].add(i)
    want = []
    for d, t in rows_:
        w = re.findall(ALNUM, low(t))
        hit, got = [0] * len(w), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    got |= wins[tuple(w[a : a + n])]
                    hit[a : a + n] = [1] * n
        want.append((d, len(w), sum(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), sum(hit) > 0))
    return want


@pytest.mark.parametrize("most_bits", [28, 5])
def test_decontamination(spark, docs, most_bits, monkeypatch):
    """With an ample filter, and with one so small that it lets nearly everything through."""
    monkeypatch.setattr(decontaminate, "MOST_BITS", most_bits)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 5)
    items = [(1, " ".join((rows()[6][1]).split()[5:30])), (2, "two, WORDS!"), (2, rows()[40][1]), (10, ""), (11, None), (None, "one"), (12, "a b c"), (13, "..")]
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    got = spark.createDataFrame(found, decontaminate_schema())
    assert bag(decontaminate.digest(got).collect()) == bag(item_hits([r[:2] for r in rows()], items, 10))
    assert all(sum(s.length for s in r.spans) == r.n_hit and [s.start for s in r.spans] == sorted(s.start for s in r.spans) for r in found)


def decontaminate_schema():
    return "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:int,length:int>>"


def test_decontamination_by_row(spark):
    """Rows of one doc_id and as many words, or of none, are judged each by its own text."""
    data = [(7, "a b c d"), (7, "p q r s"), (None, "x a b c"), (None, "q q q q"), (7, "a b c d"), (8, None)]
    items = [(1, "a b c"), (2, "a b c"), (3, "never seen words here")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, a int, token int").repartition(3)
    got = decontaminate.digest(decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), 10))
    assert bag(got.collect()) == bag(item_hits(data, items, 10))
    long = [(1, " ".join(f"w{i % 50}" for i in range(3000)))]
    items = [(5, " ".join(f"w{i % 50}" for i in range(7, 400)))]
    got = decontaminate.digest(decontaminate.contaminated(spark.createDataFrame(long, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10))
    assert bag(got.collect()) == bag(item_hits(long, items, 10))


def test_mixing(docs):
    out = mixing.mix(docs, (3, 1, 2), 1.5, 2.0, per_bucket=5)
    again = mixing.mix(docs.repartition(5), (3, 1, 2), 1.5, 2.0, per_bucket=5)
    cols = ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    got = out.select(cols).collect()
    assert bag(got) == bag(again.select(cols).collect())
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(re.findall(SPACE, r.text or "")) and 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 2 * sizes[s] + 1e-6 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    order = sorted((s for s in target if s is not None), key=lambda s: s.encode()) + [None]
    free = {s: target[s] / [3, 1, 2][i % 3] for i, s in enumerate(order) if target[s] < 2 * sizes[s] - 1e-6}
    assert len({round(x, 6) for x in free.values()}) <= 1  # the rest is shared by weight


def test_sharding(spark, docs):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows())
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32(t.encode()) if t is not None else None) for d, t, *_ in rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text here").otherwise(F.concat(F.lit("text "), (F.col("id") % 1500).cast("string"))).alias("text"))
    load, rows_, where = Counter(), Counter(), defaultdict(set)
    for r in sharding.shard(hot, 16).join(hot, "doc_id").collect():
        load[r.shard] += r["size"]
        rows_[r.shard] += 1
        where[r.text].add(r.shard)
    assert max(load.values()) / min(load.values()) < 1.03 and max(rows_.values()) / min(rows_.values()) < 1.05
    assert all(len(s) == 1 for t, s in where.items() if t != "same text here")


def packed(rows_, shards, hashes):
    """Shards of rows (doc_id, size, tokens, group): a plain packer. hashes: group -> hash, doc_id -> piece hash, (group, piece) -> cell hash."""
    total = [max(1, sum(r[1] for r in rows_)), max(1, sum(r[2] for r in rows_)), max(1, len(rows_))]
    groups = defaultdict(lambda: [0, 0, 0])
    for d, size, tokens, g in rows_:
        groups[g] = [x + y for x, y in zip(groups[g], (size, tokens, 1))]
    share = lambda v: max(x / t for x, t in zip(v, total))
    pieces = {g: math.ceil(share(v) * shards * sharding.PIECE) if share(v) * shards > 1 else 1 for g, v in groups.items()}
    units, member = defaultdict(lambda: [0, 0, 0]), []
    for d, size, tokens, g in rows_:
        u = (g, hashes["piece"](d, pieces[g]) if pieces[g] > 1 else 0)
        member.append(u)
        units[u] = [x + y for x, y in zip(units[u], (size, tokens, 1))]
    vec = {u: np.array([x / t for x, t in zip(v, total)]) for u, v in units.items()}
    order = lambda us: sorted(us, key=lambda u: (-vec[u].max(), u[0], u[1]))
    heavy = [u for u in units if vec[u].max() * shards * sharding.HEAVY >= 1]
    room, to = np.full((shards, 3), 1 / shards), {}
    for u in order(heavy):
        to[u] = int(np.argmax(room @ vec[u]))
        room[to[u]] -= vec[u]
    room = np.maximum(1 / shards - (1 / shards - room), 1e-12)  # as the loads are summed up
    room /= room.sum(0)
    cells = defaultdict(list)
    for u in set(units) - set(heavy):
        cells[hashes["cell"](u, max(1, len(rows_) // sharding.CELL))].append(u)
    for us in cells.values():
        left = room * np.array([vec[u] for u in order(us)]).sum(0)
        for u in order(us):
            to[u] = int(np.argmax(left @ vec[u]))
            left[to[u]] -= vec[u]
    return [to[u] for u in member]


def test_sharding_brute_force(spark, monkeypatch):
    """Row by row against a plain packer: many small groups, two hot ones, several cells."""
    monkeypatch.setattr(sharding, "CELL", 100)
    monkeypatch.setattr(sharding, "HEAVY", 8)
    r = random.Random(11)
    texts = [" ".join("xyz"[: r.randrange(4)] for _ in range(r.randrange(30))) for _ in range(150)] + [None, "", "hot " * 40]
    data = [(i, texts[-1] if i % 3 == 0 else texts[r.randrange(len(texts))]) for i in range(900)] + [(5, "twice"), (5, "twice"), (None, "null")]
    t = spark.createDataFrame(data, "doc_id long, text string")
    h = t.select("doc_id", F.xxhash64("text", F.lit(1)).alias("g"), F.xxhash64("doc_id", F.lit(2)).alias("p")).collect()
    piece = {x.doc_id: x.p for x in h}
    pairs = spark.createDataFrame(sorted({(x.g, p) for x in h for p in range(64)}), "g long, p int")
    cell = {(x.g, x.p): x.c for x in pairs.select("g", "p", F.xxhash64("g", "p", F.lit(3)).alias("c")).collect()}
    rows_ = [(d, len((x or "").encode()) + 1, len(re.findall(SPACE, x or "")), y.g) for (d, x), y in zip(data, h)]
    want = packed(rows_, 4, {"piece": lambda d, n: piece[d] % n, "cell": lambda u, n: cell[u] % n})
    got = sharding.shard(t.repartition(3), 4, ("text",)).collect()
    assert Counter((x.doc_id, x.text, x.shard) for x in got) == Counter((d, x, s) for (d, x), s in zip(data, want))
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_mixing_brute_force(docs):
    """Row by row against a plain mixer that gets nothing from Spark but the random keys."""
    plain = docs.select("doc_id", "text", "source", F.col("lang").alias("_offset"), F.col("size").alias("_s"), F.col("kind").alias("__r"))
    out = mixing.mix(plain, (3, 1, 2), 1.5, 2.0, per_bucket=5).collect()
    keys = plain.select("doc_id", "text", "source", F.xxhash64(F.lit(0), "doc_id", "text").alias("k")).collect()
    sizes = Counter()
    for x in keys:
        sizes[x.source] += len(re.findall(SPACE, x.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        w = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        free -= full
    want = []
    for s in order:
        budget = round(target[s])
        epochs, before = (int(target[s] // sizes[s]) if sizes[s] else 0), 0
        for x in sorted((x for x in keys if x.source == s), key=lambda x: (x.k & (2**64 - 1), x.doc_id is not None, x.doc_id or 0)):
            n = len(re.findall(SPACE, x.text or ""))
            want.append((x.doc_id, x.text, s, n, sizes[s], epochs * n + max(0, min(n, budget - epochs * sizes[s] - before))))
            before += n
    assert Counter((x.doc_id, x.text, x.source, x["size"], x.source_size, x.taken) for x in out) == Counter(want)
    assert all(x.target == pytest.approx(target[x.source]) and x._offset == "en" and x._s == 5 and x["__r"] == "k" for x in out)


def test_quality_brute_force(spark):
    """Scores against a plain trainer: dictionaries of features instead of arrays, the same order of rows."""
    r = random.Random(5)
    pool = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(r.choice(pool[: 40 if i % 2 else 60]) for _ in range(r.randrange(1, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "Å ß")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(120)] + [(7, 1), (700, 1)]
    got = {x.doc_id: x.score for x in quality.score(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    keys = {x.doc_id: x.h for x in table.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    size = 1 << quality.BITS

    def number(words, raw):
        w = next(iter(W.slices(pa.array([raw]), W.FOLDED)))
        return int(w.span_hash(np.array([0]), 2)[0]) % size if words == 2 else int(w.hash[0]) % size

    def features(text):
        out, b = set(), (text or "").encode()
        words = re.findall(SPACE, low(text))
        out |= {number(1, x) for x in words} | {number(2, f"{x} {y}") for x, y in zip(words, words[1:])}
        return sorted(out | {int(W.mix(np.array([b[i] | b[i + 1] << 8 | b[i + 2] << 16], np.uint64))[0]) % size for i in range(len(b) - 2)})

    rows_ = [(keys[d], y, features(t)) for d, y in labels for e, t in data if d == e and zlib.crc32(str(d).encode()) % 5]
    tie = {tuple(f): x for f, x in zip([r_[2] for r_ in rows_], [x.t for x in spark.createDataFrame([(bytearray(np.array(r_[2], np.int32).tobytes()),) for r_ in rows_], "f binary").select(F.xxhash64("f").alias("t")).collect()])}
    rows_.sort(key=lambda x: (x[0], x[1], tie[tuple(x[2])]))

    def train(some):
        count = {y: Counter(f for _, z, fs in some if z == y for f in fs) for y in (0, 1)}
        n = {y: sum(count[y].values()) + size for y in (0, 1)}
        ratio = lambda f: math.log((1 + count[1][f]) / n[1] / ((1 + count[0][f]) / n[0]))
        norm = lambda fs: max(math.sqrt(sum(ratio(f) ** 2 for f in fs)), 1e-12)
        x = [{f: ratio(f) / norm(fs) for f in fs} for _, _, fs in some]
        y, alpha, w, bias, rng = [2 * z - 1 for _, z, _ in some], [0.0] * len(some), Counter(), 0.0, np.random.default_rng(0)
        for _ in range(12):
            moved = 0.0
            for i in rng.permutation(len(some)):
                g = y[i] * (sum(w[f] * v for f, v in x[i].items()) + bias) - 1
                old, alpha[i] = alpha[i], min(max(alpha[i] - g / 2, 0.0), 1.0)
                step = (alpha[i] - old) * y[i]
                for f, v in x[i].items():
                    w[f] += step * v
                bias, moved = bias + step, max(moved, abs(step))
            if moved < 1e-3:
                break
        return lambda fs: sum(w[f] * ratio(f) for f in fs) / norm(fs) + bias

    part = train([x for i, x in enumerate(rows_) if i % 4])
    fold = [x for i, x in enumerate(rows_) if i % 4 == 0]
    a, b = quality.logistic(np.array([part(fs) for _, _, fs in fold]), np.array([y for _, y, _ in fold]))
    whole = train(rows_)
    for d, t in data:
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(a * whole(features(t)) + b))), abs=2e-4), d


def test_quality(spark, docs):
    r = random.Random(3)
    good = [(1000 + i, " ".join(r.choice(["tree", "house", "river", "stone"]) + r.choice("abc") for _ in range(30))) for i in range(300)]
    bad = [(3000 + i, " ".join(r.choice(["buy$$$", "click###", "win%%%"]) + r.choice("abc") for _ in range(30))) for i in range(300)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 3000)) for d, _ in good + bad] + [(5, None), (6, 7), (None, 1)], "doc_id long, quality int")
    got = quality.score(table, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([(r.score > 0.5) == (r.doc_id < 3000) for r in held]) > 0.97
    assert bag(got) == bag(quality.score(table.repartition(7), labels).collect())
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert bag(got) == bag(quality.score(table, flipped).collect())  # held-out labels are never looked at
    edge = quality.score(docs, labels).collect()
    assert len(edge) == len(rows()) and all(0 <= r.score <= 1 for r in edge)
    one = quality.score(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1


def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/e", "block"), ("net", "/e", "allow"), (None, "/", "block"), ("a.net", "", "allow")]
    some = [None, "", "no scheme", "http://com/", "http://x.example.com/en/a?b#c", "https://WWW.EXAMPLE.com/en/", "http://example.com", "http://example.com:80/en/", "a://b.net/english", "ftp://a.net", "http://a.net/e/://x", "://net/e", "http://notexample.com/en/", "http://x\n.com/é"]
    want = []
    for i, u in enumerate(some):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), a, h + p) for h, p, a in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        want.append((i, host, path, best and best[3], best[2] if best else "deny"))
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(some)] + [(1, "", "y"), (None, "http://com/", "z")], "page_id long, url string, rule string")
    got = urls.judged(pages, spark.createDataFrame(rules, "host string, path string, action string"), "deny").collect()
    assert bag(got) == bag([*want, want[1], (None, "com", "/", "com/", "allow")])
    assert urls.judged(pages, spark.createDataFrame([], "host string, path string, action string")).where("verdict = 'allow'").count() == len(got)


def test_urls_empty_long_and_many_lengths(spark, monkeypatch):
    """No pages, no rules, hosts of hundreds of labels, very long paths, and rules of more path lengths than are listed."""
    rules = [("b.com", "/" + "x" * n, "block" if n % 2 else "allow") for n in range(20)]
    some = ["http://" + "a." * 300 + "b.com/" + "x" * 1000, "http://b.com/", "http://b.com/xxxy", "http://a.b.com", "x" * 70_000, None]
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    want = {0: "block", 1: "allow", 2: "block", 3: "deny", 4: "deny", 5: "deny"}
    for most in (4096, 3):
        monkeypatch.setattr(urls, "MAX_LENGTHS", most)
        assert {r.page_id: r.verdict for r in urls.judged(pages, table, "deny").collect()} == want
    assert urls.judged(pages.limit(0), table).count() == 0 and urls.judged(pages, table.limit(0), "deny").where("verdict = 'deny'").count() == 6


def test_chat_repeats_clashes_and_long_texts(spark):
    """Rows that repeat, columns named like those used on the way, schemas that name an argument twice, a long text."""
    call = ("a", "sum", {"x": "1", "y": "z"})
    row = lambda t, r, text, c, result, after: (1, t, r, text, c, result, after, "k", 5, "z", True, 9)
    m = [row(0, "assistant", "w " * 50_000, call, None, None)] * 2 + [row(1, "tool", "ok", None, "a", None)]
    messages = spark.createDataFrame(m, chat.MESSAGE + ", kind string, level int, json string, linked boolean, call_id int")
    s = [("sum", "x", "integer", False), ("sum", "x", "string", True), ("sum", "y", None, None), ("sum", "x", "integer", False)]
    got = chat.format_messages(messages, spark.createDataFrame(s, "name string, argument string, type string, required boolean")).collect()
    assert [(r.turn, r.level, r.linked, r.error) for r in sorted(got, key=lambda r: r.turn)] == [(0, 0, True, "wrong type of y")] * 2 + [(1, 1, True, None)]
    assert all('"x":1,"y":"z"' in r.json for r in got if r.turn == 0)


def test_quality_bounds(spark, monkeypatch):
    """Repeated labels and rows count as often as they stand, and both bounds hold."""
    data = [(i, " ".join(f"g{(i * 7 + j) % 30}" if i % 2 else f"b{(i * 5 + j) % 30}" for j in range(20))) for i in range(200)] * 2
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2, "doc_id long, quality int")
    few = quality.score(table, labels, max_train_rows=40).collect()
    monkeypatch.setattr(quality, "MAX_TRAIN_FEATURES", 3000)
    fewer = quality.score(table, labels).collect()
    for got in (few, fewer):
        assert len(got) == 400 and np.mean([(r.score > 0.5) == (r.doc_id % 2 == 1) for r in got]) > 0.8


def test_chat(spark):
    call = lambda i, n="sum", **a: (i, n, a)
    m = [
        (1, 0, "user", "hi \"there\"\n", None, None, None),
        (1, 1, "assistant", None, call("a", x="1", y="2.5"), None, None),
        (1, 2, "tool", "3.5", None, "a", None),
        (1, 3, "assistant", "", call("b", x="one"), None, ["result:a"]),
        (1, 4, "tool", "?", None, "zz", None),
        (1, 5, "assistant", "", call("a", x="1"), None, None),
        (2, 0, "assistant", "", call("p", x="1", q="2"), None, ["q"]),
        (2, 1, "assistant", "", call("q", "nope"), None, ["p"]),
        (2, 2, "assistant", "", call(None), None, None),
        (None, 0, "assistant", "", call("n", x="7"), None, None),
    ]
    s = [("sum", "x", "integer", True), ("sum", "y", "number", False)]
    f = lambda r: chat.format_messages(spark.createDataFrame(r, chat.MESSAGE), spark.createDataFrame(s, "name string, argument string, type string, required boolean"))
    got = {(r.conv_id, r.turn): r for r in f(m).collect()}
    assert got[1, 1].json == '{"call":{"arguments":{"x":1,"y":2.5},"id":"a","name":"sum"},"content":"","role":"assistant"}'
    assert got[1, 0].json == '{"content":"hi \\"there\\"\\n","role":"user"}'
    assert (got[1, 1].linked, got[1, 1].valid, got[1, 1].level) == (True, True, 0)
    assert (got[1, 2].linked, got[1, 2].level) == (True, 1)
    assert (got[1, 3].level, got[1, 3].error) == (2, "wrong type of x")
    assert (got[1, 4].linked, got[1, 4].error) == (False, "orphan")
    assert got[1, 5].error == "repeated id" and got[1, 5].linked is False
    assert got[2, 0].level is None and got[2, 1].level is None  # a cycle
    assert (got[2, 0].error, got[2, 1].error, got[2, 2].error) == ("unknown argument q", "unknown tool", "no id")
    assert got[None, 0].linked is False
    assert f([]).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 24))
    centre = rng.standard_normal(24)
    hot = centre + 0.05 * rng.standard_normal((200, 24))
    near = v[:40] + 0.25 * rng.standard_normal((40, 24))
    allv = np.concatenate([v, hot, near, v[:5]]).astype(np.float32)
    data = [(int(i * 7 % 1009), x.tolist(), 1) for i, x in enumerate(allv)]
    odd = [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] + [1.0] * 23, 0), (5003, [None] + [1.0] * 23, 0), (5004, [1.0], 0), (None, data[0][1], 0), (5005, [], 0), (5006, [float("inf")] * 24, 0)]
    t = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, node int")
    u = allv.astype(float) / np.linalg.norm(allv.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    got = embeddings.linked(t, 0.9).collect()
    assert len(got) == len(data) + len(odd)
    by = {r.vec_id: r for r in got}
    want = {d[0]: int(n) for d, n in zip(data, g.sum(1))}
    assert all(by[d].n_links <= n for d, n in want.items())
    assert sum(by[d].n_links for d in want) >= 0.97 * sum(want.values())
    assert all(by[d].n_links == 0 and by[d].component_id == d for d in (5000, 5001, 5002, 5003, 5004, 5005, 5006))
    assert by[None].n_links == 0 and by[None].kept is False
    hot_ids = [d[0] for d in data[300:500]]
    assert len({by[d].component_id for d in hot_ids}) == 1 and all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embeddings.linked(t.where("vec_id = 5000")).collect()[0].n_links == 0
    assert embeddings.linked(t.limit(0)).count() == 0


def test_chat_levels(spark):
    """A chain longer than 64 levels, branches that meet again, a tail behind them, and nodes behind a cycle."""
    edges = [(1, f"c{i}", f"c{i + 1}") for i in range(100)]
    edges += [(2, "a", "b"), (2, "b", "c"), (2, "a", "d"), (2, "c", "e"), (2, "d", "e"), (2, "e", "f"), (2, "f", "g")]
    edges += [(3, "p", "q"), (3, "q", "p"), (3, "q", "r"), (3, "r", "s"), (4, "x", "y"), (4, "y", "x"), (5, "z", "z")]
    nodes = sorted({(c, x) for c, a, b in edges for x in (a, b)} | {(5, "alone")})
    want = {n: 0 for n in nodes}
    for _ in range(101):
        for c, a, b in edges:
            want[c, b] = max(want[c, b], want[c, a] + 1)
    want = {n: None if n[0] in (3, 4) or n[1] == "z" else v for n, v in want.items()}
    got = chat._levels(spark.createDataFrame(nodes, "conv_id long, id string"), spark.createDataFrame(edges, "conv_id long, from string, to string")).collect()
    assert {(r.conv_id, r.id): r.level for r in got} == want and want[1, "c100"] == 100


def links(v):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    return g.sum(1)


def around(centre, cosine, n, rng):
    z = rng.standard_normal((n, len(centre)))
    z -= np.outer(z @ centre, centre)
    return cosine * centre + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def test_embeddings_shared_direction(spark):
    """Pairs just above the threshold among vectors with a common mean, and in a hot cluster of pairwise cosine 0.90 to 0.93."""
    rng = np.random.default_rng(4)
    centre = np.eye(32)[0]
    x = around(centre, 0.83, 2000, rng)
    pairs = np.stack([around(a, 0.903, 1, rng)[0] for a in x[:1000]])
    table = lambda v: spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], "vec_id long, embedding array<float>")
    for v in (np.concatenate([x, pairs]), np.concatenate([around(centre, 0.956, 700, rng), around(centre, 0.0, 1400, rng)])):
        v = v.astype(np.float32)
        got = {r.vec_id: r.n_links for r in embeddings.linked(table(v), 0.9).collect()}
        want = links(v)
        assert want.sum() > 1500 and all(got[i] <= n for i, n in enumerate(want))
        assert sum(got.values()) >= 0.96 * want.sum()


def test_embeddings_tie_at_the_threshold_in_doubles(spark):
    """A pair at the threshold links and one just below it does not; floats could not tell them apart."""
    a, b = [1.0, 0.0], lambda c: [c, math.sqrt(1 - c * c)]
    data = [(1, a), (2, b(0.9 + 1e-12)), (3, [0.0, 0.0, 1.0]), (4, [0.0, math.sqrt(1 - (0.9 - 1e-10) ** 2), 0.9 - 1e-10])]
    got = {r.vec_id: r.n_links for r in embeddings.linked(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_embeddings_salted_and_lengths(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = np.eye(16)[0]
    v = np.concatenate([around(centre, 0.956, 300, rng), around(centre, 0.999, 300, rng), rng.standard_normal((100, 16))]).astype(np.float32)
    short = rng.standard_normal((20, 3)).astype(np.float32)
    short[5] = short[6] * 2
    data = [(i, x.tolist()) for i, x in enumerate([*v, *short])]
    t = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    plain = sorted(map(tuple, embeddings.linked(t, 0.9).collect()))
    monkeypatch.setattr(embeddings, "PART", 20)
    assert plain == sorted(map(tuple, embeddings.linked(t, 0.9).collect()))
    want = [*links(v), *links(short)]
    assert sum(r[1] for r in plain) >= 0.97 * sum(want) and all(r[1] <= n for r, n in zip(plain, want))
    assert plain[705][1] > 0 and plain[705][2] >= 700


def test_edit_counts(spark):
    """Counts after each of three rounds of edits on the stored trees against encoding the whole edited texts."""
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    counter = tokencount.Counter(tokencount.load_ranks(path))
    r = random.Random(2)
    pool = [" ", "  ", "\n", "'", "'ve", "l", " a", "ab", "1", "!", "'s ", "\t\n x", "é", "", " longer words here"]
    texts = [None, "", "a", "'", "hello world, it's 2024!  \n\n ok", " ".join(r.choice(["alpha", "it's", "42", "x  y"]) for _ in range(3000)), "nospace" * 3000] + ["".join(r.choice(pool) for _ in range(200)) for _ in range(30)]
    t = spark.createDataFrame([(i, x, 1, "z") for i, x in enumerate(texts)] + [(5, "second of an id", 1, "z"), (None, "no id", 1, "z")], "doc_id long, text string, n_tokens int, cuts string")
    trees = tokencount.build_trees(t, path)
    now = [(d, x or "") for d, x, *_ in ((row.doc_id, row.text) for row in t.collect())]
    first = [len(counter.encode(x)) for _, x in now]
    for turn in range(3):
        trees = packing.stored(trees)
        edits = []
        for i in range(len(texts)):
            if i % 7 == turn:
                continue  # not edited in this round
            size = len(dict(now)[i])
            edits += [(i, k, r.choice([None, r.randint(-1, size + 9)]), r.choice([None, 0, 0, 1, 3, 40, 1000]), "".join(r.choice(pool) for _ in range(r.choice([0, 1, 3]))) or None) for k in range(4)]
        for d, _, pos, cut, ins in edits:
            for j, (e, x) in enumerate(now):
                if e == d:
                    p = min(max(pos or 0, 0), len(x))
                    now[j] = (d, x[:p] + (ins or "") + x[p + max(0, cut or 0) :])
        r.shuffle(edits)
        more = [edits[0], (None, 1, 0, 0, "x"), (12345, 1, 0, 0, "x")]  # a repeated one, and some for no tree
        trees = tokencount.edit_trees(trees, spark.createDataFrame(edits + more, tokencount.EDITS), path)
        got = trees.select("doc_id", "text", "n_tokens", F.get("tokens", F.lit(1)).alias("now")).collect()
        assert bag(got) == bag((d, x, n, len(counter.encode(x))) for (d, x), n in zip(now, first))
    counts = {(x.doc_id, x.n_tokens): x for x in tokencount.tree_counts(trees).collect()}
    long = counts[5, first[5]]
    assert long.n_edits == 12 and long.n_reencoded < 12 * 200  # not the whole text
    assert counts[None, first[-1]].n_edits == 0
    assert tokencount.edit_trees(trees, spark.createDataFrame([], tokencount.EDITS), path).count() == len(now)
    assert tokencount.build_trees(t.limit(0), path).count() == 0


def test_edits_that_rows_bring_along(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    counter = tokencount.Counter(tokencount.load_ranks(path))
    data = [(1, "one two  three\n\n four's " * 60, "x"), (2, None, "y"), (2, "é" * 700, "y"), (None, "", None)]
    trees = tokencount.build_trees(spark.createDataFrame(data, "doc_id long, text string, todo string"), path)
    edits = tokencount.sample_edits(F.col("text"), F.col("doc_id"))
    once = tokencount.edit_in_place(trees.withColumn("todo", F.array(edits[0], edits[1], F.lit(None))), "todo", path).collect()
    spots = {(r.doc_id, r.text): [r[f"p{k}"] for k in (1, 2)] for r in trees.select("doc_id", "text", *(e["pos"].alias(f"p{k + 1}") for k, e in enumerate(edits))).collect()}
    want = []
    for d, t, _ in data:
        (p, q), x = spots[d, t or ""], t or ""
        x = x[:p] + f" revised {'' if d is None else d}" + x[p:]
        x = x[:q] + x[q + 11 :]
        want.append((d, x, len(counter.encode(x)), 2))
    assert bag((r.doc_id, r.text, r.tokens[1], r.n_edits) for r in once) == bag(want)
    same = tokencount.edit_in_place(trees.withColumn("todo", F.lit(None).cast("array<struct<pos:int,del:int,ins:string>>")), "todo", path)
    assert bag(map(str, same.collect())) == bag(map(str, trees.collect()))


def test_packed_hash_is_sparks(spark):
    x = np.array([0, 1, -1, 2**62, -(2**63), 12345678901], np.int64)
    got = [r.h for r in spark.createDataFrame([(int(v),) for v in x], "v long").select(F.xxhash64("v").alias("h")).collect()]
    assert packing.xxhash64(x).tolist() == got


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rlz.repeated_spans(none).count() == 0
    assert jaccard.jaccard_components(none).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(docs, items).where("n_hit > 0").count() == 0
    assert mixing.mix(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert quality.score(none, labels).count() == 0
    assert quality.score(docs, labels).count() == len(rows())


def test_size_classes_cover_all_pairs():
    for percent in (50, 80, 85, 99):
        classes = jaccard.size_classes(percent, 700)
        assert [c[0] for c in classes][1:] == [c[1] + 1 for c in classes][:-1]
        for a in range(1, 300):
            i = next(i for i, c in enumerate(classes) if c[0] <= a <= c[1])
            for b in range(a, a * 100 // percent + 1):
                j = next(j for j, c in enumerate(classes) if c[0] <= b <= c[1])
                assert j - i in (0, 1) and b <= classes[i][2]
                h = (100 - percent) * (a + b) // (100 + percent)
                assert classes[i][3] > h or (h == 0 and classes[i][3] == 1)


def test_plan_reaches_recall():
    for n in (500, 50_000, 10**8):
        bits, tables = embeddings.plan(n, 0.9, 0.97)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.97
