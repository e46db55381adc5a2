"""Timers and initial state: silent entities, late and early events, silent sources, and runs that go on where another stopped."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import live as L
from ledgerlens.streaming import timers as T

MESSAGE = "entity_id long, kind string, ts double, side string, amount double"
TRADE = "entity_id long, event_id long, ts double, side string, price double"


def stream(spark, batches, schema):
    """A stream of lists of rows in their order, from 1970 on: the watermark starts at 0 and what is not later than that is late."""
    where = L.folder(spark)
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        L.land(df.withColumn("event_time", F.timestamp_seconds("ts")), where)
    return L.file_stream(spark, where, spark.createDataFrame([], schema).withColumn("event_time", F.timestamp_seconds("ts")).schema, L.FILES)


def buy(e, ts, x):
    return (e, "trade", ts, "buy", x)


def test_windows_of_silent_entities_close(spark):
    batches = [
        [(1, "create", 0.0, None, 0.0), buy(1, 1.0, 5.0), (1, "trade", 2.0, "sell", 9.0), (2, "create", 3.0, None, 0.0), buy(4, 20.5, 2.0)],
        [(3, "create", 20.0, None, 0.0), buy(3, 21.0, 1.0), (4, "create", 20.0, None, 0.0), buy(3, 22.0, 4.0)],
        [buy(3, 40.0, 7.0), buy(3, 19.5, 7.0)],  # the second is late by less than the delay, and before its entity's creation by the clock
        [buy(3, 38.0, 3.0), buy(3, 300.0, 1.0), buy(5, 301.0, 1.0)],
        [buy(3, 330.0, 1.0)],
    ]
    batches = [[(e, k, t + 1000, *x) for e, k, t, *x in b] for b in batches]
    out = T.timed(T.entity_windows(stream(spark, batches, MESSAGE), (10.0, 30.0, 290.0), "30 seconds"))
    got = sorted(map(tuple, out.collect()))
    assert got == [
        (1, 10.0, 2, 1, 5.0), (1, 30.0, 2, 1, 5.0), (1, 290.0, 2, 1, 5.0),
        (2, 10.0, 0, 0, 0.0), (2, 30.0, 0, 0, 0.0), (2, 290.0, 0, 0, 0.0),
        (3, 10.0, 3, 3, 12.0), (3, 30.0, 5, 5, 22.0),
        (4, 10.0, 1, 1, 2.0), (4, 30.0, 1, 1, 2.0),
    ]


def test_a_source_that_stops_is_told(spark):
    batches = [
        [("a", 0.0), ("b", 0.0), ("a", 5.0), ("b", 30.0)],
        [("a", 60.0), ("a", 75.0)],
        [("a", 90.0)],
        [("b", 200.0), ("a", 95.0)],
        [("a", 400.0), ("b", 401.0)],
    ]
    batches = [[(a, t + 1000) for a, t in b] for b in batches]
    out = T.timed(T.silent_sources(stream(spark, batches, "source string, ts double"), 25.0, "5 seconds"))
    assert sorted((a, x - 1000, y - 1000) for a, x, y in out.collect()) == [("a", 5.0, 30.0), ("a", 95.0, 120.0), ("b", 0.0, 25.0), ("b", 30.0, 55.0), ("b", 200.0, 225.0)]


CONFIGS = [("tight", 20.0, 50.0, 1000.0), ("wide", 90.0, 500.0, 60.0)]


def trades():
    out, n = [], 0
    for e, steps in {1: [(0, 10), (5, 10), (12, 9), (40, 16), (70, 12)], 2: [(0, 4), (6, 4), (80, 4.1)], 3: [(1, 2), (50, 2), (55, 2.2), (64, 0.1)], 4: [(30, 1), (44, 1), (49, 1.1), (60, 1.2)], 5: [(0, 3)], 6: [(58, 8), (150, 8)]}.items():
        for ts, price in steps:
            n += 1
            out.append((e, n, float(ts + 1000), "buy", float(price)))
    return sorted(out, key=lambda r: r[2])


@pytest.mark.parametrize("cut", [1046.0, 1062.0])
def test_positions_go_on(spark, cut):
    configs = spark.createDataFrame(CONFIGS, "config_id string, stop double, take double, max_hold double")
    every = [[r for r in trades() if r[2] < cut], [r for r in trades() if r[2] >= cut]]
    run = lambda batches, held, where: T.timed(T.positions(stream(spark, batches, TRADE), configs, 3.0, 30.0, "1 second", held), where)
    whole = run(every, None, L.folder(spark))
    where = L.folder(spark)
    first = run(every[:1], None, where)
    held = T.held_positions(spark, where)
    rest = run(every[1:], held, L.folder(spark))
    assert sorted(map(tuple, first.unionByName(rest).collect())) == sorted(map(tuple, whole.collect()))
    assert not rest.isEmpty() and not first.isEmpty()
    counts = {r.config_id: r.n for r in held.where("entry is not null and not closed").groupBy("config_id").agg(F.count("*").alias("n")).collect()}
    done = {(r.config_id, r.entity_id) for r in first.collect()}
    begun = {e for e in range(1, 7) for t in [sorted(r[2] for r in every[0] if r[0] == e)] if any(x >= t[0] + 3 for x in t)}
    assert counts == {c: sum((c, e) not in done for e in begun) for c, *_ in CONFIGS if any((c, e) not in done for e in begun)}


def test_events_after_the_last_window_need_no_state(spark, monkeypatch):
    """Once an entity's windows are closed, its events are over: they don't wait for a creation."""
    where = L.folder(spark)
    batches = [[(1, "create", 1000.0, None, 0.0), buy(1, 1001.0, 5.0)], [buy(1, 1100.0, 1.0)], [buy(1, 1200.0, 1.0)], [buy(1, 1300.0, 2.0), buy(1, 1301.0, 2.0)]]
    out = T.timed(T.entity_windows(stream(spark, batches, MESSAGE), (10.0,), "5 seconds"), where)
    assert [tuple(r) for r in out.collect()] == [(1, 10.0, 1, 1, 5.0)]
    early = spark.read.format("statestore").option("stateVarName", "early").load(f"{where}/state")
    assert early.count() == 0
