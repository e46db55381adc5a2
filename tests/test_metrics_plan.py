"""Metrics of an entity: counts of actors against a plain loop, with unknown actors; no row is repeated for a count, and a kept ledger is not shuffled again."""

import random

from ledgerlens.operators import metrics as M
from ledgerlens.plans.metrics import AGES, ATTENTION, EARLY, window
from ledgerlens.sources.tables import kept

SF = "/root/testdata/sf0.001"


def test_actor_counts(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(3), r.choice([None, *range(6)]), r.choice(["buy", "sell"]), float(r.randrange(9)), 1.0, float(r.randrange(80)), float(i), 1.0, 0.0, 1) for i in range(90)]
    e = spark.createDataFrame(rows, "event_id long, entity_id long, actor_id long, side string, amount double, qty double, ts double, reserve double, mcap double, created_at double, creator_id long")
    for m in M.event_metrics(e, 10.0, 30.0, (20.0, 40.0, 60.0)).collect():
        mine = sorted((x for x in rows if x[1] == m.entity_id), key=lambda x: (x[6], x[0]))
        buys, end = [x for x in mine if x[3] == "buy"], mine[-1][6]
        count = lambda xs: len({x[2] for x in xs} - {None})
        assert (m.unique_buyers, m.unique_sellers) == (count(buys), count(x for x in mine if x[3] == "sell"))
        assert (m.unique_buyers_first, m.unique_buyers_last) == (count(x for x in buys if x[6] <= 30), count(x for x in buys if x[6] >= end - 30))
        assert [m[f"unique_buyers_at_{i}"] for i in (1, 2, 3)] == [count(x for x in buys if x[6] <= a) for a in (20, 40, 60)]
        assert [m[f"reserve_at_{i}"] for i in (1, 2, 3)] == [max([x for x in mine if x[6] <= a], key=lambda x: (x[6], x[0]))[7] for a in (20, 40, 60)]
        assert m.buy_diversity == len({x[4] for x in buys}) and m.last_price == [x for x in buys if x[4] > 0][-1][4]


def test_plan(spark):
    df = M.entity_metrics(window(spark, kept(spark, SF)), EARLY, ATTENTION, AGES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Exchange hashpartitioning" not in plan
