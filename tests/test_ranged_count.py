"""Counts of earlier creations within a span against a plain loop: ties of time and order, nulls, every row in one span; no pairs are joined."""

import random

import pytest

from ledgerlens.operators import joins as J


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, insert_order long, created_at double").repartition(3)


@pytest.mark.parametrize("whole", [1 << 16, 20])
@pytest.mark.parametrize("open_start", [True, False])
def test_ranged_count(spark, monkeypatch, whole, open_start):
    monkeypatch.setattr(J, "WHOLE", whole, raising=False)
    r = random.Random(8)
    rows = [(i, r.randrange(-300, 300), r.choice([float(r.randrange(12)), r.random() * 40])) for i in range(700)] + [(800, None, 3.0), (801, 5, None)]
    want = {i: sum(o is not None and c is not None and o2 is not None and c2 is not None and o2 < o and c2 < c and (c2 > c - 3 if open_start else c2 >= c - 3) for _, o2, c2 in rows) for i, o, c in rows}
    assert {x.entity_id: x.n for x in J.ranged_count(frame(spark, rows), 3.0, open_start).collect()} == want
    assert J.ranged_count(frame(spark, rows[:0]), 3.0, open_start).count() == 0


def test_many_in_one_span(spark):
    """A join of all pairs of a span would make 1.8 thousand million rows here."""
    t = spark.range(60_000).selectExpr("id as entity_id", "id as insert_order", "cast(id % 10 as double) as created_at")
    got = J.ranged_count(t, 100.0, False)
    assert "Inner, (" not in got._jdf.queryExecution().executedPlan().toString()  # no condition on pairs
    assert got.selectExpr("sum(n)").first()[0] == sum((i // 10) * (i % 10) + (i % 10) for i in range(60_000) if i % 10)
