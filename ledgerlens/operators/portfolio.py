"""Admission of candidates into a book of limited slots and cash, folded in ranges of time side by side."""

from __future__ import annotations

from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .actors import _shared
from .windows import ranged

UNIT = 1e9  # money is counted in whole billionths, so that sums don't depend on their order
PER = 10_000  # candidates in a range, about, at least where there are several ranges
PARTS = 32  # ranges at most: so many turns it takes at most, if books never forget their start
_OPEN = "array<struct<exit_ts: double, gain: bigint, by_tick: boolean>>"
#: What a range's fold was started with and came to. Its decisions hold for any cash from cash - slack on, below cash + need.
_SUMMARY = f"open {_OPEN}, cash long, first_ts double, end_open {_OPEN}, delta long, slack long, need long"


def _free(open_: list, cash: int, ts: float, stake: int) -> tuple[list, int]:
    """Positions still open at an entry at ts, and the cash with what the others came back with."""
    still = []
    for x in open_:
        if x["exit_ts"] < ts or (x["exit_ts"] == ts and x["by_tick"]):
            cash += stake + x["gain"]
        else:
            still.append(x)
    return still, cash


def _run(rows: DataFrame, starts: DataFrame, turn: int, slots: int, stake: int, decide: bool) -> DataFrame:
    """The fold over every range of `starts` (config_id, part, open, cash) from its own start: a summary for each, or, to decide, a row for each candidate.

    rows lie in order where `_dealt` put them, and a range's start comes with its first row, so nothing is shuffled. They stream through a task, which
    holds open positions only, `slots` at most, however many candidates a range has.
    """
    op = pa.list_(pa.struct([("exit_ts", pa.float64()), ("gain", pa.int64()), ("by_tick", pa.bool_())]))
    if decide:
        schema, shape = "config_id string, id long, admitted boolean", pa.schema([("config_id", pa.string()), ("id", pa.int64()), ("admitted", pa.bool_())])
    else:
        schema = f"config_id string, part int, turn int, {_SUMMARY}"
        arrow = [("config_id", pa.string()), ("part", pa.int32()), ("turn", pa.int32())]
        shape = pa.schema([*arrow, ("open", op), ("cash", pa.int64()), ("first_ts", pa.float64()), ("end_open", op), ("delta", pa.int64()), ("slack", pa.int64()), ("need", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []

        def close() -> None:
            if at is not None and not decide:
                out.append({**at, "end_open": held, "delta": money - at["cash"], "slack": slack, "need": need})

        held, money, slack, need = [], 0, None, None
        for b in batches:
            for r in b.to_pylist():
                if r["first"]:
                    close()
                    at = {"config_id": r["config_id"], "part": r["part"], "turn": turn, "open": r["open"], "cash": r["cash"], "first_ts": r["entry_ts"]}
                    held, money, slack, need = r["open"], r["cash"], None, None
                held, money = _free(held, money, r["entry_ts"], stake)
                ok = False
                if len(held) < slots:
                    ok, left = money >= stake, money - stake
                    if ok:
                        slack, money = left if slack is None else min(slack, left), left
                        held = [*held, {k: r[k] for k in ("exit_ts", "gain", "by_tick")}]
                    else:
                        need = -left if need is None else min(need, -left)
                if decide:
                    out.append({"config_id": r["config_id"], "id": r["id"], "admitted": ok})
            yield pa.RecordBatch.from_pylist(out, shape)
            out = []
        close()
        yield pa.RecordBatch.from_pylist(out, shape)

    c = F.col
    todo = starts.select(c("config_id").alias("_c"), c("part").alias("_p"), "open", "cash")
    mine = rows.join(F.broadcast(todo), c("config_id").eqNullSafe(c("_c")) & (c("part") == c("_p")))  # a row for each range
    return mine.select(*rows.columns, F.when(c("first"), c("open")).alias("open"), F.when(c("first"), c("cash")).alias("cash")).mapInArrow(fold, schema)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows with `part`, a range of time, and whether they are its first, each range of a configuration in order in one task; written once."""
    known, part = ranged(rows, "entry_ts", n, max(1, n // PER), PARTS)
    known = known.withColumn("part", F.col(part).cast("int"))
    w = Window.partitionBy("config_id", "part").orderBy("entry_ts", "id")
    known = known.withColumn("first", F.row_number().over(w) == 1)
    return _shared(known.select("config_id", "part", "entry_ts", "id", "exit_ts", "gain", "by_tick", "first"))


def _chain(runs: DataFrame, cash: int, stake: int) -> DataFrame:
    """(config_id, part, turn, open, cash, todo): how each range would start after those before it, and whether its last fold started otherwise.

    A group is a configuration's summaries, a row for each range.
    """

    def follow(rows: pa.Table) -> pa.Table:
        held, money, out = [], cash, []
        for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
            held, money = _free(held, money, r["first_ts"], stake)
            held = sorted(held, key=lambda x: (x["exit_ts"], x["gain"], x["by_tick"]))
            d = money - r["cash"]
            same = held == r["open"] and (r["slack"] is None or -d <= r["slack"]) and (r["need"] is None or d < r["need"])
            out.append({"config_id": r["config_id"], "part": r["part"], "turn": r["turn"], "open": held, "cash": money, "todo": not same})
            held, money = r["end_open"], money + r["delta"]
        op = rows.schema.field("open").type
        return pa.Table.from_pylist(out, pa.schema([("config_id", pa.string()), ("part", pa.int32()), ("turn", pa.int32()), ("open", op), ("cash", pa.int64()), ("todo", pa.bool_())]))

    return runs.groupBy("config_id").applyInArrow(follow, f"config_id string, part int, turn int, open {_OPEN}, cash long, todo boolean")


def portfolio_admission(candidates: DataFrame, slots: int, cash: float, stake: float) -> DataFrame:
    """(config_id, id, admitted): candidates (config_id, id, entry_ts, exit_ts, pnl, by_tick) in order of time, ties by id, as slots and cash allow.

    A position comes back with stake * (1 + pnl) at its exit; one that closes at the instant of an entry makes room for it if its exit came from a tick.
    The book depends on its own past, but soon forgets it: ranges of time are folded side by side, first from an empty book and then from what the
    ranges before came to, and only ranges whose start turned out other than assumed are folded again. A fold says for which cash
    its decisions hold, so another balance alone is no reason. Each turn settles at least the first range that was wrong, as a rule nearly all; turns
    write a row for each range, and what is decided comes from one more fold, from the starts that hold.
    A candidate without an entry time or id is not admitted; one without an exit never leaves; no pnl is 0. A null configuration is one like others.
    """
    c = F.col
    rows = candidates.select("config_id", c("entry_ts").cast("double").alias("entry_ts"), c("id").cast("long").alias("id"), F.coalesce(c("exit_ts").cast("double"), F.lit(inf)).alias("exit_ts"), F.coalesce(F.round(c("pnl") * stake * UNIT).cast("long"), F.lit(0)).alias("gain"), F.coalesce("by_tick", F.lit(False)).alias("by_tick"))
    never = rows.where("entry_ts is null or id is null").select("config_id", "id", F.lit(False).alias("admitted"))
    known = rows.where("entry_ts is not null and id is not null")
    n = known.count()
    known = _dealt(known, n)
    money, each, turn = round(cash * UNIT), round(stake * UNIT), 0
    starts = known.where("first").select("config_id", "part", F.array().cast(_OPEN).alias("open"), F.lit(money).cast("long").alias("cash"))
    last = None
    while True:
        ran = _run(known, starts, turn, slots, each, False)
        ran = ran if last is None else last.unionByName(ran)
        last = _shared(ran.groupBy("config_id", "part").agg(F.max_by(F.struct("*"), "turn").alias("s")).select("s.*"))  # a row for each range
        chain = _shared(_chain(last, money, each))
        starts = chain.where("todo").select("config_id", "part", "open", "cash")
        if starts.isEmpty():
            break
        turn += 1
    return _run(known, chain, turn, slots, each, True).unionByName(never)
