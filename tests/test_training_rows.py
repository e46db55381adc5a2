"""What models train on is written once; ranges of values are found by halves."""

from bisect import bisect_left
from math import isnan, nan

from pyspark.sql import functions as F

from ledgerlens.operators.exits import hazard_rows
from ledgerlens.operators.windows import average_rank, ranged
from ledgerlens.plans import stats

SF = "/root/testdata/sf0.001"


def test_parts_are_written_once(spark):
    parts = stats._parts(stats.labelled(spark, SF), keep=("pnl_pct",))
    assert [p.count() for p in parts] == [630, 135, 135]
    for p in parts:
        assert not p.inputFiles() and {"id", "label", "weight", "features", "pnl_pct"} <= {*p.columns}  # no longer a plan over the events


def test_ranges_by_halves(spark):
    values = [i % 997 / 7 for i in range(5000)] + [None] * 30 + [nan] * 600
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    for least in (1, 2, 3, 64, 1000):
        d, r = ranged(df, "v", len(values), least)
        rows = d.select("v", F.col(r).alias("r")).collect()
        assert "filter(" not in d._jdf.queryExecution().optimizedPlan().toString()  # which looks at every bound for every row
        last = max(x.r for x in rows)
        assert all(x.r == last for x in rows if x.v is None)
        known = sorted((x for x in rows if x.v is not None), key=lambda x: (isnan(x.v), 0.0 if isnan(x.v) else x.v))
        assert [x.r for x in known] == sorted(x.r for x in known)  # grows with the value, NaN as the largest one
        cuts = [known[i].v for i in range(len(known) - 1) if known[i].r < known[i + 1].r and not isnan(known[i].v)]
        assert all(x.r == bisect_left(cuts, x.v) for x in known if not isnan(x.v))


def test_hazard_rows_keep_columns(spark):
    b = spark.createDataFrame([(1, 12.0, "closed", -5.0, 7.0), (2, 3.0, "open", 1.0, 8.0)], "id long, hold_seconds double, status string, pnl_pct double, score double")
    rows = hazard_rows(b, 5.0, 50.0, -3.0, ("score",)).orderBy("id", "bucket").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 7.0), (1, 1, 0, 7.0), (1, 2, 1, 7.0), (2, 0, 0, 8.0)]


def test_ranks_of_nan(spark):
    df = spark.createDataFrame([(float(i % 50),) for i in range(400)] + [(nan,)] * 200, "v double")
    got = {str(r.v): r.avg_rank for r in average_rank(df, "v").distinct().collect()}
    assert got["nan"] == 500.5 and got["0.0"] == 4.5 and got["49.0"] == 396.5
