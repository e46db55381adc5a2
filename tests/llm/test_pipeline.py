"""The corpus pipeline on the smallest tables: what each stage keeps, and the decisions of its operators."""

import re
from collections import Counter

import corpus_pipeline as P
from ledgerlens.llm import decontaminate, jaccard, mixing, quality
from ledgerlens.llm.packing import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in P.STAGES[:-1]:
        after = materialize(stage(spark, before, SF))
        assert after.columns == P.COLUMNS, name
        kept[name] = (before, after)
        before = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a, b = kept["quality classifier"]
    scores = {r.doc_id: r.predicted for r in quality.score(a, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert ids(b) == {d for d, p in scores.items() if p == 1}
    a, b = kept["near duplicates"]
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_components(a, 5, 80).collect()}
    assert ids(b) == set(groups.values()) and b.count() == len(set(groups.values()))
    a, b = kept["decontamination"]
    hits = {r.doc_id for r in decontaminate.contaminated(a, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert ids(b) == ids(a) - hits
    a, b = kept["mixture"]
    assert ids(b) <= ids(a)
    out = P.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count()
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near duplicates", "decontamination", "mixture", "shards"]


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def odd_ids():
    words = [f"w{i}" for i in range(400)]
    text = lambda i, n=40: " ".join(words[(i * 7 + j * (i + 3)) % 400] for j in range(n))
    near = lambda i: text(i) + " end"
    passage = " ".join(f"leak{i}" for i in range(12))
    rows = [
        (None, text(0)),  # alone, null id
        (None, text(1)),
        (9, near(1)),  # near copy of a null id: 9 stays
        (5, text(2)),
        (5, text(3)),  # one id, two texts
        (3, near(3)),  # 3 stays instead of the second 5
        (7, text(4)),
        (7, text(4)),  # equal rows
        (None, text(5)),
        (None, text(5)),
        (None, None),
        (8, ""),
        (8, ""),
        (11, text(6) + " " + passage),
        (11, text(7)),  # namesake of a contaminated one
        (None, text(8) + " " + passage),
    ]
    return [(d, t, "en", "s", 1) for d, t in rows], passage


def test_null_and_repeated_ids(spark, tmp_path):
    rows, passage = odd_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = Counter(min((rows[i][:2] for i in range(len(rows)) if group[i] == g), key=lambda r: (r[0] is None, r[0] or 0)) for g in set(group))
    got = Counter((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect())
    assert got == want

    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r.doc_id, r.text) for r in P.decontamination(spark, docs, str(tmp_path)).collect())
    assert got == Counter(r[:2] for r in rows if passage not in (r[1] or ""))


LIKE = "doc_id long, text string, lang string, source string, n_chars long, key long, component long, repeated boolean, a long, shard int, taken long"


def odd_table(spark):
    """odd_ids with null, empty, very long and repeated texts, null sources, and columns named like those used on the way."""
    rows = [(*r[:3], s, r[4], 7, 8, True, 9, 10, 11) for r, s in zip(odd_ids()[0], ["s", None, "t"] * 9)]
    rows += [(70, "long " + " ".join(f"v{i % 997}" for i in range(20_000)), None, "s", None, 7, 8, True, 9, 10, 11), (71, "  \n ", "en", "t", 1, 7, 8, True, 9, 10, 11)]
    return rows, spark.createDataFrame(rows, LIKE).repartition(3)


def test_stages_on_odd_rows(spark, tmp_path):
    rows, docs = odd_table(spark)
    spark.createDataFrame([(5, 1), (3, 0), (7, 1), (None, 1), (70, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = Counter(r[:5] for r in rows)

    # classifier: every row is judged by its own text, and nothing else decides
    judged = quality.score(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).select("doc_id", "predicted").collect()
    got = P.classifier(spark, docs, str(tmp_path))
    assert got.columns == P.COLUMNS and not Counter(map(tuple, got.collect())) - plain
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in judged if r.predicted)

    # an empty benchmark keeps all
    assert Counter(map(tuple, P.decontamination(spark, docs, str(tmp_path)).collect())) == plain

    # mixture: as often as the mix takes each row, with hash keys as the only thing from Spark
    mixed = mixing.mix(docs.select(P.COLUMNS), (3, 1, 2), 1.5, 2.0).collect()
    want = Counter()
    for r in mixed:
        want[tuple(r[c] for c in P.COLUMNS)] += -(-r.taken // r["size"]) if r.taken else 0
    assert Counter(map(tuple, P.mixture(spark, docs, str(tmp_path)).collect())) == +want
    words = Counter()
    for r in rows:
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert all(sum(n * len(re.findall(r"[^\x20\x09-\x0D]+", k[1] or "")) for k, n in want.items() if k[3] == s) <= 2 * w + 20_001 for s, w in words.items())

    # shards: every row once, with its text and a slot of its own
    out = P.shards(spark, docs, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in P.COLUMNS) for r in out) == plain
    slots = {s: sorted(r.slot for r in out if r.shard == s) for s in {r.shard for r in out}}
    assert all(v == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))


def test_stages_on_empty_tables(spark, tmp_path):
    _, docs = odd_table(spark)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
