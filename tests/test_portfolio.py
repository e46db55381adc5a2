"""Admission folded in ranges of time against one plain fold."""

import random

import pytest

from ledgerlens.operators import portfolio as P

SCHEMA = "config_id string, id long, entry_ts double, exit_ts double, pnl double, by_tick boolean, open string"


def plain(rows, slots, cash, stake):
    out = {}
    for config in {r[0] for r in rows}:
        held, money = [], round(cash * 1e9)
        for _, i, t, x, pnl, tick, _ in sorted((r for r in rows if r[0] == config and r[2] is not None), key=lambda r: (r[2], r[1])):
            gone = [h for h in held if h[0] < t or (h[0] == t and h[2])]
            held = [h for h in held if h not in gone]
            money += sum(round(stake * 1e9) + h[1] for h in gone)
            out[i] = len(held) < slots and money >= round(stake * 1e9)
            if out[i]:
                money -= round(stake * 1e9)
                held.append((float("inf") if x is None else x, round((pnl or 0.0) * stake * 1e9), bool(tick), i))
    return out


@pytest.mark.parametrize("slots,cash,stake", [(3, 1.0, 0.1), (4, 1.0, 0.4)])
def test_ranges_equal_one_fold(spark, monkeypatch, slots, cash, stake):
    monkeypatch.setattr(P, "PER", 100)
    r = random.Random(slots)
    rows = [(r.choice(["a", "a", "b", None]), i, float(r.randrange(900)), None, round(r.uniform(-0.9, 0.8), 3), r.random() < 0.5, "x") for i in range(900)]
    rows = [(c, i, t, t + r.randrange(40), p, k, o) for c, i, t, _, p, k, o in rows]
    rows += [("a", 1000, None, 5.0, 0.1, True, "x"), ("b", 1001, 890.0, None, None, None, "x")]
    want = plain(rows, slots, cash, stake) | {1000: False}
    df = spark.createDataFrame(rows, SCHEMA)
    out = P.portfolio_admission(df.repartition(5), slots, cash, stake)
    got = out.collect()
    assert {x.id: x.admitted for x in got} == want and len(got) == len(want)
    assert 0 < sum(want.values()) < len(want)


def test_one_instant_and_nothing(spark):
    rows = [("a", i, 7.0, 7.0, 0.0, i == 1, "x") for i in range(1, 40)]
    got = {x.id: x.admitted for x in P.portfolio_admission(spark.createDataFrame(rows, SCHEMA), 2, 5.0, 1.0).collect()}
    assert got == plain(rows, 2, 5.0, 1.0) and sum(got.values()) == 3
    assert P.portfolio_admission(spark.createDataFrame([], SCHEMA), 2, 5.0, 1.0).count() == 0


def test_hardly_any_range_runs_again(spark, monkeypatch):
    """Books forget: a second turn folds what the first one started wrongly, and few follow."""
    monkeypatch.setattr(P, "PER", 400)
    turns, run = [], P._run
    monkeypatch.setattr(P, "_run", lambda rows, starts, *a: (turns.append(starts.count()), run(rows, starts, *a))[1])
    r = random.Random(5)
    rows = [("a", i, float(i), i + r.expovariate(0.2), 0.0, False, "x") for i in range(4000)]
    got = {x.id: x.admitted for x in P.portfolio_admission(spark.createDataFrame(rows, SCHEMA), 3, 1.0, 0.1).collect()}
    assert got == plain(rows, 3, 1.0, 0.1)
    assert turns[0] == 10 and turns[1] == 9 and len(turns) <= 5, turns


def test_books_that_never_forget(spark, monkeypatch):
    """Positions outlive ranges, so that a range's start depends on all before it: ranges, and with them turns, are few whatever the rows, and turns keep no decisions."""
    monkeypatch.setattr(P, "PER", 10)
    starts, run = [], P._run
    monkeypatch.setattr(P, "_run", lambda rows, todo, *a: (starts.append(todo.count()), run(rows, todo, *a))[1])
    r = random.Random(6)
    rows = [("a", i, float(i), i + 60.0 + r.randrange(7), r.uniform(-0.01, 0.01), False, "x") for i in range(1200)]
    out = P.portfolio_admission(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 1.0, 0.1)
    assert {x.id: x.admitted for x in out.collect()} == plain(rows, 3, 1.0, 0.1)
    assert max(starts) <= 32 and len(starts) <= 34
