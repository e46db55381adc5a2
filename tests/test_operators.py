"""Operators whose results SQL cannot express, against folds written out row by row, and edge cases of the windows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import exits as E
from ledgerlens.operators import features as X
from ledgerlens.operators import joins as J
from ledgerlens.operators import metrics as M
from ledgerlens.operators import stats as S
from ledgerlens.operators import windows as W
from ledgerlens.streaming import live as L

TRADE = "event_id long, entity_id long, actor_id long, side string, amount double, qty double, ts double, price double, reserve double, mcap double"


def trades(spark, n=120, entities=3, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        amount, qty = r.randint(1, 100) / 10, r.randint(1, 5)
        rows.append((i, i % entities, r.randint(1, 12), r.choice(["buy", "buy", "sell"]), amount, float(qty), float(i * 3 + r.randint(0, 2)), amount / qty, float(r.randint(0, 90)), 1.0))
    return spark.createDataFrame(rows, TRADE)


def test_entity_metrics_edges(spark):
    rows = [(1, 1, 7, "sell", 1.0, 1.0, 5.0, 1.0, 0.0, 1.0)]  # sells only
    rows += [(10 + i, 2, i, "buy", 0.5, 1000.0, float(t), 0.0005, 10.0, 42.0) for i, t in enumerate((5, 20, 35, 70), 1)]
    t = spark.createDataFrame(rows, TRADE)
    tokens = spark.createDataFrame([(1, 0.0, 7), (2, 0.0, 1), (3, 0.0, 1)], "entity_id long, created_at double, creator_id long")
    e = t.join(tokens, "entity_id")
    m = {r.entity_id: r for r in M.entity_metrics(e).collect()}
    assert set(m) == {1, 2}
    assert m[1].creator_sold and m[1].buy_count == 0 and m[1].top3_share == 0 and m[1].sell_ratio == 1
    assert (m[2].unique_buyers_at_1, m[2].unique_buyers_at_2, m[2].unique_buyers_at_3) == (2, 3, 4)
    assert m[2].creator_buy_position == 1 and m[2].median_gap == 15 and m[2].buyer_entropy == 1.0
    assert m[2].top3_share == 75.0


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 10.0, "p"), (1, 5.0, "q"), (2, 1.0, "r")], "k long, t double, id string")
    right = spark.createDataFrame([(1, 10.0, 1, "a"), (1, 10.0, 2, "b"), (1, 4.0, 3, "c")], "k long, s double, o long, v string")
    get = lambda strict: {r.id: r.v for r in J.asof(left, right, "k", "t", "s", ["v"], strict, tie="o").collect()}
    assert get(False) == {"p": "b", "q": "c", "r": None}
    assert get(True) == {"p": "c", "q": "c", "r": None}


def test_replayed_reserve_is_a_clamped_fold(spark):
    t = trades(spark, 200, 4, 9)
    got = {r.event_id: r.reserve_sim for r in W.replayed_reserve(t, 3.0, 100.0, 10.0).collect()}
    for e in range(4):
        v = 3.0
        for r in sorted((r for r in t.collect() if r.entity_id == e), key=lambda r: (r.ts, r.event_id)):
            v = max(v + (r.amount if r.side == "buy" else -r.amount), 1e-9)
            assert abs(got[r.event_id] - v) < 1e-6


def test_partial_exits_fold(spark):
    t = trades(spark, 150, 3, 4).withColumn("creator_id", F.lit(99).cast("long"))
    entries = spark.createDataFrame([(e, 99, 0.0, 2.0) for e in range(3)], "entity_id long, creator_id long, entry_ts double, entry_price double")
    config = spark.createDataFrame([("a", 99.0, 1e9, 1e9, 1e9, 1e9, 0.0, 99.0, 99.0, 0.0, 0.3, 99.0, 500.0)], E.PARAMS)
    sig = E.signals(E.states(t.drop("creator_id"), entries, 1e9, 1e9), config)
    got = {r.entity_id: (round(r.pnl, 6), round(r.remaining, 6), r.reason) for r in E.partial_exits(sig, 200.0, 0.3, 0.6, 50.0, 0.5, 0.1).collect()}
    for e in range(3):
        left, gain, took, why, last = 1.0, 0.0, False, None, 0.0
        for r in sorted((r for r in sig.collect() if r.entity_id == e), key=lambda r: r.order):
            if why:
                break
            sold, free = 0.0, left - 0.1
            if r.reason:
                sold, why = left, r.reason
            elif r.warm and free > 0.01:
                if r.pnl > 200 and not took:
                    sold, took = min(0.3, free), True
                elif r.buy_rate < 0.6 and r.pnl > 50:
                    sold = min(0.5, free)
            left, gain, last = left - sold, gain + sold * r.pnl, r.pnl
        assert got[e] == (round(gain + left * last, 6), round(left, 6), why or "timeout")


def test_portfolio_admission(spark):
    rows = [("a", 1, 0.0, 10.0, 0.5, False), ("a", 2, 5.0, 20.0, 0.0, False), ("a", 3, 10.0, 30.0, 0.0, False), ("a", 4, 20.0, 25.0, 0.0, False), ("a", 5, 21.0, 25.0, 0.0, False), ("b", 6, 0.0, 5.0, 0.0, True), ("b", 7, 5.0, 6.0, 0.0, True)]
    t = spark.createDataFrame(rows, "config_id string, id long, entry_ts double, exit_ts double, pnl double, by_tick boolean")
    got = {r.id: r.admitted for r in E.portfolio_admission(t, 1, 1.0, 0.5).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: True}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_files(spark, tmp_path, batches):
    """Batches of (event_id, seconds, user, type, value, key), each the one file of a micro-batch."""
    import datetime

    start = datetime.datetime(2024, 1, 1)
    for rows in batches:
        data = [(i, start + datetime.timedelta(seconds=s), u, t, v, f'{{"k": {k}}}') for i, s, u, t, v, k in rows]
        spark.createDataFrame(data, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return L.as_trades(spark, L.file_stream(spark, f"{tmp_path}/events", spark.createDataFrame([], EVENTS).schema))


def test_stream_exit_matches_a_fold(spark):
    """The state machine over four micro-batches against one loop over all events."""
    day = 86400.0
    s = L.appended(L.exits(L.sliced_stream(spark, "/root/testdata/sf0.001"), day, 90.0, 400.0, 10 * day, 2 * day))
    got = {r.entity_id: (r.exit_ts, r.reason, round(r.pnl, 6)) for r in s.collect()}
    rows = sorted(L.as_trades(spark, spark.read.parquet("/root/testdata/sf0.001/events.parquet")).collect(), key=lambda r: (r.ts, r.event_id))
    end, want = rows[-1].ts - 3600, {}
    for e in {r.entity_id for r in rows}:
        mine = [r for r in rows if r.entity_id == e]
        entry = last = None
        for r in mine:
            if entry is None:
                if r.side == "buy" and r.ts >= mine[0].ts + day:
                    entry = r
            else:
                gain = (r.price - entry.price) / entry.price * 100
                if r.ts - last.ts > 2 * day:
                    want[e] = (last.ts + 2 * day, "dead_token", (last.price - entry.price) / entry.price * 100)
                elif gain < -90 or gain >= 400 or r.ts - entry.ts > 10 * day:
                    want[e] = (r.ts, "hard_stop" if gain < -90 else "take_profit" if gain >= 400 else "timeout", gain)
                if e in want:
                    break
            last = r
        if entry and e not in want and last.ts + 2 * day < end:
            want[e] = (last.ts + 2 * day, "dead_token", (last.price - entry.price) / entry.price * 100)
    assert got == {e: (t, why, round(p, 6)) for e, (t, why, p) in want.items()} and len({w for _, w, _ in want.values()}) >= 2


def test_stream_dedup_over_batches(spark, tmp_path):
    """Either key drops an event, keys of dropped events count too, state lasts over batches, and only `keep` keys are remembered."""
    b1 = [(1, 10, 1, "click", 1.0, 1), (2, 20, 1, "click", 1.0, 1), (3, 15, 2, "click", 2.0, 1), (4, 15, 2, "click", 2.0, 2)]
    b2 = [(5, 5, 1, "click", 1.0, 1), (6, 30, 3, "click", 2.0, 1), (7, 40, 4, "click", 9.0, 1)]
    s = event_files(spark, tmp_path, [b1, [], b2])
    keyed = s.withColumn("syn_key", F.col("actor_id").cast("string")).withColumn("sig_key", F.col("amount").cast("string"))
    assert {r.event_id for r in L.appended(L.deduplicated(keyed)).collect()} == {1, 3, 4, 7}
    few = {r.event_id for r in L.appended(L.deduplicated(keyed, keep=1)).collect()}
    assert few == {1, 3, 4, 5, 7}  # the first actor's keys were forgotten, event 6 shares the remembered amount


def test_stream_late_and_empty(spark, tmp_path):
    """Late rows behind the watermark are cut, those within it count; an empty stream gives empty tables."""
    hour = 3600
    b1 = [(1, 0, 1, "click", 1.0, 1), (2, 10 * hour, 1, "click", 1.0, 1)]
    b2 = [(3, 9.5 * hour, 1, "click", 1.0, 1), (4, 60, 1, "click", 1.0, 1), (5, 30 * hour, 1, "click", 1.0, 1)]
    between = [(6, 10.5 * hour, 1, "click", 1.0, 1)]  # rows are cut by the watermark that the batch before started with
    s = event_files(spark, tmp_path, [b1, between, b2])
    got = {(r.start - 1704067200, r.n) for r in L.appended(L.windowed(s, "1 hour", "1 hour")).collect()}
    assert got == {(0, 1), (9 * hour, 1), (10 * hour, 2)}
    none = event_files(spark, tmp_path / "none", [[]])
    assert L.activity_upsert(none).count() == 0
    tokens = spark.createDataFrame([], "entity_id long, created_at double, creator_id long, insert_order long")
    assert L.enriched(none, tokens, spark.createDataFrame([], "entity_id long, holder_top1 double"), spark.createDataFrame([], "actor_id long, n_entities long, is_flagged boolean")).count() == 0


def test_average_rank_and_row_number(spark):
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 5, 3, 3, 3, 9])], "id long, v double")
    got = {r.id: r.avg_rank for r in W.average_rank(d, "v").collect()}
    assert got == {1: 1.0, 3: 3.0, 4: 3.0, 5: 3.0, 0: 5.5, 2: 5.5, 6: 7.0}
    n = {r.id: r.row for r in W.global_row_number(d.withColumn("v", F.col("id").cast("double")), "v").collect()}
    assert n == {i: i + 1 for i in range(7)}
    assert W.average_rank(d.limit(0), "v").count() == 0


def test_bootstrap_brackets_the_exact_figures(spark):
    r = random.Random(4)
    rows = [(i, r.gauss(1.0 if i % 4 == 0 else 0.0, 1.0), int(i % 4 == 0)) for i in range(800)]
    got = {x.metric: x for x in S.bootstrap_ci(spark.createDataFrame(rows, "id long, score double, label int"), "id", "score", "label", 200, 3).collect()}
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    top = sorted(rows, key=lambda x: -x[1])[:80]
    for name, exact in (("base_rate", 0.25), ("auc", auc), ("precision", sum(y for *_, y in top) / 80)):
        assert got[name].lo < exact < got[name].hi and abs(got[name]["mean"] - exact) < 0.03, name
        assert 0.01 < got[name].hi - got[name].lo < 0.3


def test_permuted_labels_are_the_same_labels(spark):
    d = spark.range(300).select("id", (F.col("id") % 5 == 0).cast("int").alias("label"))
    got = {r.id: r.label for r in S.permuted(d, "id", "label", 7).collect()}
    assert len(got) == 300 and sum(got.values()) == 60
    assert 120 < sum(v != int(k % 5 == 0) for k, v in got.items()) + 60 < 240  # not where they were


def test_splits_with_ties_nulls_and_no_rows(spark):
    d = spark.createDataFrame([(i, None if i == 3 else float(i // 4)) for i in range(20)], "id long, t double")
    rows = {r.id: r.split for r in W.chrono_parts(d, "t", {"a": 0.5, "b": 0.25, "c": 0.25}, ("id",)).collect()}
    order = sorted((i for i in range(20) if i != 3), key=lambda i: (i // 4, i)) + [3]
    assert [rows[i] for i in order] == ["a"] * 10 + ["b"] * 5 + ["c"] * 5
    one_value = spark.createDataFrame([(i, 1.0) for i in range(9)] + [(9, 1e18)], "id long, t double")
    assert {r.id: r.row for r in W.global_row_number(one_value, "t", ("id",)).collect()} == {i: i + 1 for i in range(10)}
    assert W.time_folds(d.limit(0), "t", 3).count() == 0 and W.chrono_split(d.limit(0), "t", 0.5).count() == 0


def test_features_in_order(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0)], "entity_id long, b double, a double")
    assert X.in_order(d, ["a", "b"], "entity_id").columns == ["entity_id", "a", "b"]
    with pytest.raises(ValueError):
        X.in_order(d, ["a", "c"])
    assert len(X.FEATURE_ORDER) == len(set(X.FEATURE_ORDER)) == 82
