"""The live half: the same operators as streaming queries over a directory of event files.

Sources are files (a Kafka source has the same columns); a replay is the same query with an `availableNow` trigger, in as many
micro-batches as the source gives. Stateful operators see each micro-batch's events in order of event time. State per entity is
of fixed size, but for `pulse`, which has to know every actor it has seen, and `deduplicated`, which remembers `keep` keys.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import prior_by_order
from ..sources.tables import from_events, merge_activity


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of trades with an event time."""
    return as_trades(spark, file_stream(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, glob="events.parquet"))


def file_stream(spark: SparkSession, path: str, schema, per_batch: int = 1, glob: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, the oldest first, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).parquet(path)


def as_trades(spark: SparkSession, events: DataFrame) -> DataFrame:
    return from_events(events).withColumn("event_time", F.timestamp_seconds("ts"))


FILES = 2  # of a slice


def slices(events: DataFrame, n: int, time: str = "ts") -> list[DataFrame]:
    """events cut into n slices of equal duration, in order."""
    lo, hi = events.agg(F.min(F.col(time).cast("timestamp").cast("double")), F.max(F.col(time).cast("timestamp").cast("double"))).first()
    if lo is None:
        return [events.limit(0)] * n
    part = F.least(F.floor((F.col(time).cast("timestamp").cast("double") - lo) / ((hi - lo) / n or 1.0)), F.lit(n - 1))
    return [events.where(part == k) for k in range(n)]


def land(events: DataFrame, where: str) -> None:
    """Add a slice to the folder of a file stream, as FILES files that make one micro-batch."""
    events.repartition(FILES).write.mode("append").parquet(where)


def sliced_stream(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """The events as a stream that arrives in n slices, each a micro-batch of its own."""
    events, where = spark.read.parquet(f"{sf_dir}/events.parquet"), folder(spark)
    for part in slices(events, n):
        land(part, where)
    return as_trades(spark, file_stream(spark, where, events.schema, FILES))


def folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder. A local session without one gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="streams-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def appended(df: DataFrame, where: str | None = None) -> DataFrame:
    """Run the stream over what is there and return the rows it appended."""
    where = where or folder(df.sparkSession)
    q = df.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/rows")


def each_batch(df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write make(batch) of every micro-batch to a folder of its own and return all of them as one table.

    A batch that is run again replaces its own folder only, so that nothing is lost or doubled; earlier ones are not touched.
    """
    spark, where = df.sparkSession, folder(df.sparkSession)

    def one(batch: DataFrame, i: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{where}/rows/batch={i}")

    df.writeStream.foreachBatch(one).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    empty = make(spark.createDataFrame([], df.schema))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # nothing came
        return empty
    return spark.read.schema(empty.schema).parquet(f"{where}/rows").select(empty.columns)


def windowed(df: DataFrame, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts per entity and window behind a watermark: late events are cut by event time."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    g = df.withWatermark("event_time", delay).groupBy(w.alias("w"), "entity_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return g.select(F.col("w.start").cast("double").alias("start"), "entity_id", "n", "amount")


def sessions(df: DataFrame, delay: str, gap: str) -> DataFrame:
    """A stream of an entity ends when nothing comes for `gap`."""
    g = df.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("w"), "entity_id").agg(F.count("*").alias("n"))
    return g.select("entity_id", F.col("w.start").cast("double").alias("start"), F.col("w.end").cast("double").alias("stop"), "n")


def rate(df: DataFrame, delay: str, width: str, slide: str) -> DataFrame:
    g = df.withWatermark("event_time", delay).groupBy(F.window("event_time", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("double").alias("start"), "n")


def source_health(df: DataFrame, delay: str, width: str) -> DataFrame:
    """Events and the latest event time per source (here: side) and window."""
    g = df.withWatermark("event_time", delay).groupBy(F.window("event_time", width).alias("w"), "side").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return g.select(F.col("w.start").cast("double").alias("start"), "side", "n", "latest")


def deduplicated(df: DataFrame, keep: int = 20_000) -> DataFrame:
    """Drop an event if either of its keys (syn_key, sig_key) was seen in its entity; the last `keep` keys are remembered."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        syn, sig = (dict.fromkeys(x) for x in state.get) if state.exists else ({}, {})
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            if r.syn_key not in syn and r.sig_key not in sig:
                out.append((r.event_id, key[0], r.syn_key, r.sig_key))
            syn[r.syn_key] = sig[r.sig_key] = None
        state.update(([*syn][-keep:], [*sig][-keep:]))
        yield pd.DataFrame(out, columns=["event_id", "entity_id", "syn_key", "sig_key"])

    cols = df.select("event_id", "entity_id", "ts", "syn_key", "sig_key")
    return cols.groupBy("entity_id").applyInPandasWithState(step, "event_id long, entity_id long, syn_key string, sig_key string", "syn array<string>, sig array<string>", "append", GroupStateTimeout.NoTimeout)


def entity_windows(df: DataFrame, ages: tuple) -> DataFrame:
    """(entity_id, age, n_events, n_buys, buy_volume): windows anchored at an entity's first event, closed at each age.

    A window closes when an event passes its end; what is still open when the stream stops is not written.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, b, v, done = state.get if state.exists else (None, 0, 0, 0.0, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            start = r.ts if start is None else start
            while done < len(ages) and r.ts > start + ages[done]:
                out.append((key[0], float(ages[done]), n, b, v))
                done += 1
            n += 1
            if r.side == "buy":
                b, v = b + 1, v + r.amount
        state.update((start, n, b, v, done))
        yield pd.DataFrame(out, columns=["entity_id", "age", "n_events", "n_buys", "buy_volume"])

    cols = df.select("entity_id", "event_id", "ts", "side", "amount")
    return cols.groupBy("entity_id").applyInPandasWithState(step, "entity_id long, age double, n_events long, n_buys long, buy_volume double", "start double, n long, b long, v double, done int", "append", GroupStateTimeout.NoTimeout)


def pulse(df: DataFrame, size: int = 20, warm: int = 15) -> DataFrame:
    """(event_id, entity_id, buy_rate, max_sell, new_actor_rate, peak_rate): the last `size` events of each entity, kept as state."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sides, amounts, actors, seen, peak = state.get if state.exists else ([], [], [], [], 0.0)
        sides, amounts, actors, seen, out = [*sides], [*amounts], [*actors], set(seen), []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            sides, amounts, actors = [*sides, r.side][-size:], [*amounts, r.amount][-size:], [*actors, r.actor_id][-size:]
            if len(sides) < warm:
                continue
            buys = sides.count("buy")
            fresh = len({a for a, s in zip(actors, sides) if s == "buy" and a not in seen})
            seen.update(actors)
            peak = max(peak, buys / len(sides))
            out.append((r.event_id, key[0], buys / len(sides), max((a for a, s in zip(amounts, sides) if s == "sell"), default=0.0), fresh / max(buys, 1), peak))
        state.update((sides, [float(x) for x in amounts], [int(x) for x in actors], [int(x) for x in seen], float(peak)))
        yield pd.DataFrame(out, columns=["event_id", "entity_id", "buy_rate", "max_sell", "new_actor_rate", "peak_rate"])

    cols = df.select("entity_id", "event_id", "ts", "side", "amount", "actor_id")
    return cols.groupBy("entity_id").applyInPandasWithState(step, "event_id long, entity_id long, buy_rate double, max_sell double, new_actor_rate double, peak_rate double", "sides array<string>, amounts array<double>, actors array<long>, seen array<long>, peak double", "append", GroupStateTimeout.NoTimeout)


def exits(df: DataFrame, wait: float, stop: float, take: float, max_hold: float, gap: float) -> DataFrame:
    """(entity_id, exit_ts, reason, pnl): one position per entity as a state machine, closed by event or by event-time silence."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["entity_id", "exit_ts", "reason", "pnl"]
        if state.hasTimedOut:
            first, entry, price, last, now, closed = state.get
            state.update((first, entry, price, last, now, True))  # what comes later opens nothing, however the stream is cut
            yield pd.DataFrame([(key[0], last + gap, "dead_token", (now - price) / price * 100)] if entry is not None and not closed else [], columns=cols)
            return
        first, entry, price, last, now, closed = state.get if state.exists else (None, None, None, None, None, False)
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            first = r.ts if first is None else first
            if not closed and entry is not None:
                gain = (r.price - price) / price * 100
                why = "dead_token" if r.ts - last > gap else "hard_stop" if gain < -stop else "take_profit" if gain >= take else "timeout" if r.ts - entry > max_hold else None
                if why:
                    out.append((key[0], last + gap if why == "dead_token" else r.ts, why, (now - price) / price * 100 if why == "dead_token" else gain))
                    closed = True
            elif entry is None and r.side == "buy" and r.ts >= first + wait:
                entry, price = r.ts, r.price
            last, now = r.ts, r.price
        state.update((first, entry, price, last, now, closed))
        state.setTimeoutTimestamp(max(int((last + gap) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=cols)

    cols = df.withWatermark("event_time", "1 hour").select("entity_id", "event_id", "ts", "side", "price", "event_time")
    return cols.groupBy("entity_id").applyInPandasWithState(step, "entity_id long, exit_ts double, reason string, pnl double", "first double, entry double, price double, last double, now double, closed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def activity_upsert(df: DataFrame) -> DataFrame:
    """Activity per (actor, entity): partial aggregates are appended batch by batch and merged when they are read."""
    buy = F.col("side") == "buy"

    def partial(batch: DataFrame) -> DataFrame:
        return batch.groupBy("actor_id", "entity_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.coalesce(F.sum(F.when(buy, F.col("amount"))), F.lit(0.0)).alias("buy_amount"), F.coalesce(F.sum(F.when(~buy, F.col("amount"))), F.lit(0.0)).alias("sell_amount"))

    parts = each_batch(df, partial)
    return merge_activity(parts, parts.limit(0))


def enriched(df: DataFrame, tokens: DataFrame, holders: DataFrame, actors: DataFrame) -> DataFrame:
    """Events with what is known of their entity and actor, joined per micro-batch to static tables and appended.

    tokens: entities; holders (entity_id, holder_top1); actors (actor_id, n_entities, is_flagged).
    """
    info = tokens.select("entity_id", "created_at", "creator_id").join(prior_by_order(tokens), "entity_id", "left").join(holders, "entity_id", "left")

    def known(batch: DataFrame) -> DataFrame:
        j = batch.join(info, "entity_id", "left").join(actors, "actor_id", "left")
        return j.select("event_id", "entity_id", "creator_id", "n_prior", (F.col("ts") - F.col("created_at")).alias("age"), "holder_top1", "n_entities", "is_flagged")

    return each_batch(df, known)
