"""Running medians and interval look-ups against plain loops: ties, nulls, overlaps, hot keys."""

import random
from collections import defaultdict
from statistics import median

from ledgerlens.operators import joins as J
from ledgerlens.operators import windows as W


def test_running_median(spark):
    r = random.Random(2)
    rows = [(k, i, r.choice([None, float(r.randrange(40)), r.random() * 100]), "x") for i in range(900) for k in [r.choice([1, 1, 1, 1, 1, 2, 3, None])]]
    rows += [(4, 1, None, "y"), (4, 2, None, "y"), (5, 1, 3.0, "z")]
    out = W.running_median(spark.createDataFrame(rows, "k int, i int, v double, kind string").repartition(3), "k", ["i"], "v", "mid")
    seen, want = defaultdict(list), {}
    for k, i, v, _ in sorted(rows, key=lambda x: x[1]):
        want[k, i] = median(seen[k]) if seen[k] and k is not None else None
        if v is not None:
            seen[k].append(v)
    got = {(x.k, x.i): x.mid for x in out.collect()}
    assert len(got) == len(rows) and all(got[k] == v or abs(got[k] - v) < 1e-9 for k, v in want.items() if k[0] is not None)


def test_running_median_holds_no_arrays(spark):
    """Nothing is collected: the plan has no aggregate that gathers a key's values."""
    df = W.running_median(spark.range(50).selectExpr("id % 2 as k", "id as i", "id * 1.0D as v"), "k", ["i"], "v", "mid")
    assert "collect_" not in df._jdf.queryExecution().executedPlan().toString()


def test_flag_at(spark):
    r = random.Random(3)
    spans = []
    for n in range(600):
        a = r.randrange(400) / 2
        spans.append((r.choice(["a", "a", "a", "b", None]), f"f{n}", a, r.choice([None, a, a - 1, a + r.randrange(1, 9), a + r.randrange(1, 200)])))
    spans = list({(k, a): (k, f, a, b) for k, f, a, b in spans}.values())
    probes = [(r.choice(["a", "a", "b", "c", None]), r.randrange(-10, 900) / 4, i // 2) for i in range(800)]
    out = J.flag_at(spark.createDataFrame(probes, "k string, ts double, i int"), spark.createDataFrame(spans, "k string, flag string, valid_from double, valid_to double"), "k")
    want = []
    for k, t, i in probes:
        held = [(a, f) for g, f, a, b in spans if k is not None and g == k and a <= t and (b is None or b > t)]
        want.append((k, t, i, max(held)[1] if held else None))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    none = spark.createDataFrame([], "k string, flag string, valid_from double, valid_to double")
    assert [x.flag for x in J.flag_at(spark.createDataFrame(probes[:3], "k string, ts double, i int"), none, "k").collect()] == [None] * 3


def test_flag_at_numbers_no_rows(spark):
    """Rows that a shuffle brings in another order when they are read again must not get another's flag, so no row number is a key."""
    probes = spark.createDataFrame([("a", 3.0, 1), ("a", 3.0, 2), ("a", 9.0, 3), (None, 3.0, 4), ("a", None, 5)], "k string, ts double, i int").repartition(3, "i")
    spans = spark.createDataFrame([("a", "f", 1.0, 5.0)], "k string, flag string, valid_from double, valid_to double")
    out = J.flag_at(probes, spans, "k")
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().toString()
    assert sorted((r.i, r.flag) for r in out.collect()) == [(1, "f"), (2, "f"), (3, None), (4, None), (5, None)]
