"""Stateful operators with event-time timers and initial state.

They run on `transformWithState`: a key may have many timers, which fire when the watermark passes them although nothing arrives for
the key, and a query may start from a table of states. State is kept by RocksDB and is of fixed size for each key, but for
events that are ahead of their entity's creation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import appended, folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(df: DataFrame, where: str | None = None) -> DataFrame:
    """`appended` with the state store that timers need."""
    conf, key = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        return appended(df, where)
    finally:
        conf.set(key, before)


def _ms(seconds: float) -> int:
    return int(round(seconds * 1000))


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by))


class AnchoredWindows(StatefulProcessor):
    """Counts of an entity's events up to each age after its creation, given out when the watermark passes that age.

    An entity whose windows are all closed keeps its start, so that its later events are known to be over and need no state.
    """

    def __init__(self, ages: tuple):
        self.ages = ages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "created_at double, over boolean")
        self.tally = handle.getMapState("tally", "age int", "n long, b long, v double")
        self.early = handle.getListState("early", "ts double, buy boolean, amount double")

    def _count(self, start: float, ts: np.ndarray, bought: np.ndarray, amount: np.ndarray) -> None:
        for i, age in enumerate(self.ages):
            if not self.tally.containsKey((i,)):  # closed
                continue
            n, b, v = self.tally.getValue((i,))
            here = ts <= start + age
            buys = here & bought
            # one sum in order of time, as if each event were added by itself
            v = float(np.add.accumulate(np.concatenate([[v], amount[buys]]))[-1])
            self.tally.updateValue((i,), (int(n + here.sum()), int(b + buys.sum()), v))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, over = self.start.get() if self.start.exists() else (None, False)
        all_rows = _in_order(rows, "ts", "kind")
        created = all_rows["kind"] == "create"
        if start is None and created.any():
            start = float(all_rows.loc[created, "ts"].iloc[0])
            self.start.update((start, False))
            for i, age in enumerate(self.ages):
                self.tally.updateValue((i,), (0, 0, 0.0))
                self.handle.registerTimer(_ms(start + age))
        events = all_rows[~created]
        if start is not None and not over:
            early = [tuple(x) for x in self.early.get()] if self.early.exists() else []
            self.early.clear()
            columns = [np.concatenate([events[c].to_numpy(t), np.array([x[i] for x in early], t)]) for i, (c, t) in enumerate((("ts", float), ("bought", bool), ("amount", float)))]
            self._count(start, *columns)
        elif start is None and len(events):
            # its creation is late: what waits is dropped once no window could be open
            self.early.appendList([(float(t), bool(b), float(x)) for t, b, x in zip(events["ts"], events["bought"], events["amount"])])
            self.handle.registerTimer(_ms(float(events["ts"].max()) + max(self.ages)))
        yield pd.DataFrame({"entity_id": [], "age": [], "n_events": [], "n_buys": [], "buy_volume": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.start.exists():
            start = self.start.get()[0]
            for i, age in enumerate(self.ages):
                if _ms(start + age) == at and self.tally.containsKey((i,)):
                    n, b, v = self.tally.getValue((i,))
                    out.append((key[0], float(age), n, b, v))
                    self.tally.removeKey((i,))
            if not any(self.tally.containsKey((i,)) for i in range(len(self.ages))):
                self.start.update((start, True))
        elif self.early.exists():
            self.early.clear()
        yield pd.DataFrame(out, columns=["entity_id", "age", "n_events", "n_buys", "buy_volume"])

    def close(self) -> None:
        pass


def entity_windows(messages: DataFrame, ages: tuple, delay: str) -> DataFrame:
    """(entity_id, age, n_events, n_buys, buy_volume): one row for every entity and age, anchored at the entity's creation.

    messages (entity_id, kind, ts, side, amount, event_time): a stream of creations (kind `create`) and trades. A window closes
    when the watermark passes its end, so the windows of an entity that falls silent close too, and events that come late
    by less than `delay` still count. Trades ahead of their entity's creation wait for it.
    """
    rows = messages.withWatermark("event_time", delay).select("entity_id", "kind", "ts", F.coalesce(F.col("side") == "buy", F.lit(False)).alias("bought"), "amount", "event_time")
    schema = "entity_id long, age double, n_events long, n_buys long, buy_volume double"
    return rows.groupBy("entity_id").transformWithStateInPandas(AnchoredWindows(ages), schema, "append", "eventTime")


class SilentSources(StatefulProcessor):
    """A source's silences of more than `patience` seconds."""

    def __init__(self, patience: float):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ts double, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, told = self.latest.get() if self.latest.exists() else (None, False)
        latest, out = known, []
        for ts in _in_order(rows, "ts")["ts"]:
            if latest is not None and ts - latest > self.patience and not (told and latest == known):
                out.append((key[0], latest, latest + self.patience))  # a silence that this batch ends
            latest = ts if latest is None else max(latest, ts)
        if known is None or latest > known:
            if known is not None:
                self.handle.deleteTimer(_ms(known + self.patience))
            self.handle.registerTimer(_ms(latest + self.patience))
            self.latest.update((float(latest), False))
        yield pd.DataFrame(out, columns=["source", "latest", "stale_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        latest, told = self.latest.get()
        now = not told and _ms(latest + self.patience) == expiredTimerInfo.getExpiryTimeInMs()
        if now:
            self.latest.update((latest, True))
        yield pd.DataFrame([(key[0], latest, latest + self.patience)] if now else [], columns=["source", "latest", "stale_at"])

    def close(self) -> None:
        pass


def silent_sources(events: DataFrame, patience: float, delay: str) -> DataFrame:
    """(source, latest, stale_at): every time that a source of events (source, ts, event_time) sends nothing for `patience` seconds.

    A source that stops is told by the watermark, which the other sources move; it need not send anything.
    """
    rows = events.withWatermark("event_time", delay).select("source", "ts", "event_time")
    return rows.groupBy("source").transformWithStateInPandas(SilentSources(patience), "source string, latest double, stale_at double", "append", "eventTime")


class Positions(StatefulProcessor):
    """One position of an entity under a configuration: opened by a buy after the wait, closed by its rules or by silence."""

    STATE = "first double, entry double, price double, last double, now double, closed boolean"

    def __init__(self, wait: float, gap: float):
        self.wait, self.gap = wait, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", self.STATE)

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["config_id", "entity_id", "entry_ts", "exit_ts", "reason", "pnl"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, entry, price, last, now, closed = self.position.get() if self.position.exists() else (None, None, None, None, None, False)
        if last is not None:
            self.handle.deleteTimer(_ms(last + self.gap))
        out = []
        for r in _in_order(rows, "ts", "event_id").itertuples():
            first = r.ts if first is None else first
            if entry is not None and not closed:
                gain = (r.price - price) / price * 100
                why = "dead_token" if r.ts - last > self.gap else "hard_stop" if gain < -r.stop else "take_profit" if gain >= r.take else "timeout" if r.ts - entry > r.max_hold else None
                if why == "dead_token":
                    out.append((*key, entry, last + self.gap, why, (now - price) / price * 100))
                elif why:
                    out.append((*key, entry, r.ts, why, gain))
                closed = why is not None
            elif entry is None and r.side == "buy" and r.ts >= first + self.wait:
                entry, price = r.ts, r.price
            last, now = r.ts, r.price
        self._keep(first, entry, price, last, now, closed)
        yield self._out(out)

    def _keep(self, first, entry, price, last, now, closed) -> None:
        f = lambda x: None if x is None else float(x)
        self.position.update((f(first), f(entry), f(price), f(last), f(now), bool(closed)))
        if entry is not None and not closed:
            self.handle.registerTimer(_ms(last + self.gap))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, entry, price, last, now, closed = self.position.get()
        out = []
        if entry is not None and not closed and _ms(last + self.gap) == expiredTimerInfo.getExpiryTimeInMs():
            out.append((*key, entry, last + self.gap, "dead_token", (now - price) / price * 100))
            self.position.update((first, entry, price, last, now, True))
        yield self._out(out)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        r = initialState.iloc[0]
        f = lambda x: None if pd.isna(x) else float(x)
        self._keep(f(r["first"]), f(r["entry"]), f(r["price"]), f(r["last"]), f(r["now"]), bool(r["closed"]))

    def close(self) -> None:
        pass


def positions(events: DataFrame, configs: DataFrame, wait: float, gap: float, delay: str, resumed: DataFrame | None = None) -> DataFrame:
    """(config_id, entity_id, entry_ts, exit_ts, reason, pnl): exits of every configuration's positions on a stream of trades.

    configs (config_id, stop, take, max_hold) is a parameter table. resumed (config_id, entity_id, Positions.STATE), as `held_positions` reads it, is
    where positions go on: with their own entry, their last event and so their silence, and none that was closed opens again.
    """
    rows = events.withWatermark("event_time", delay).crossJoin(F.broadcast(configs))  # a few rows
    rows = rows.select("config_id", "entity_id", "event_id", "ts", "side", "price", "event_time", "stop", "take", "max_hold")
    schema = "config_id string, entity_id long, entry_ts double, exit_ts double, reason string, pnl double"
    state = None if resumed is None else resumed.groupBy("config_id", "entity_id")
    return rows.groupBy("config_id", "entity_id").transformWithStateInPandas(Positions(wait, gap), schema, "append", "eventTime", state)


def held_positions(spark, where: str) -> DataFrame:
    """(config_id, entity_id, Positions.STATE): what a stopped query of `positions` holds, from the state under `where`, written to a table."""
    state = spark.read.format("statestore").option("path", f"{where}/state").option("stateVarName", "position").load()
    out = folder(spark)
    state.select("key.*", "value.*").write.parquet(out)
    return spark.read.parquet(out)
