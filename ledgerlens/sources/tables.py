"""Reading tables, the two adapters that make entities and events of them, and store-level operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column):
    """Seconds since 1970 as double; the session time zone is UTC."""
    return F.col(column).cast("timestamp").cast("double") if isinstance(column, str) else column.cast("timestamp").cast("double")


def with_state(trades: DataFrame) -> DataFrame:
    """The running values an event carries: price, reserve and valuation, and the signature of every third event."""
    return (
        trades.withColumn("price", F.col("amount") / F.col("qty"))
        .withColumn("reserve", (F.pmod(F.col("event_id") * 37, F.lit(101))).cast("double"))
        .withColumn("mcap", F.col("amount") / F.col("qty") / 30.0)
    )


class Kept(str):
    """The folder of the tables, as ever; its ledger has been written once, as tables of these names, and the adapters read those: see `kept`."""

    trades: str | None = None
    tokens: str | None = None


PER_BUCKET = 250_000  # line items, about


def kept(spark: SparkSession, sf_dir: str) -> Kept:
    """sf_dir for plans that use the ledger several times: line items meet their orders once, and entities are made once.

    Both are bucketed by entity, so that what is joined, grouped or windowed by entity later needs no exchange; a bucket is one file, and buckets grow in number with the rows.
    """
    if isinstance(sf_dir, Kept):
        return sf_dir
    from ..streaming.live import folder

    out, where = Kept(sf_dir), folder(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf_dir, "lineitem").count() // PER_BUCKET)
    name = "ledger_" + where.rsplit("-", 1)[1]

    def bucketed(df: DataFrame, kind: str, *order: str) -> str:
        dealt = df.repartition(n, "entity_id").write.bucketBy(n, "entity_id").sortBy("entity_id", *order)
        dealt.option("compression", "zstd").format("parquet").option("path", f"{where}/{kind}").saveAsTable(f"{name}_{kind}")
        return f"{name}_{kind}"

    out.trades = bucketed(_ledger(spark, sf_dir), "trades", "ts", "event_id")
    out.tokens = bucketed(ledger_tokens(spark, out), "tokens")
    return out


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_partkey").alias("entity_id"),
        F.col("o_custkey").alias("actor_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("qty"),
        epoch("l_shipdate").alias("ts"),
    )


def ledger_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: line items with their orders; ordered by (ts, event_id) inside an entity."""
    return with_state(spark.table(sf_dir.trades) if isinstance(sf_dir, Kept) else _ledger(spark, sf_dir))


def ledger_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: parts, created with their first trade by its supplier."""
    if isinstance(sf_dir, Kept) and sf_dir.tokens:
        return spark.table(sf_dir.tokens)
    first = ledger_trades(spark, sf_dir).groupBy("entity_id").agg(F.min("ts").alias("created_at"), F.min_by("supplier_id", F.struct("ts", "event_id")).alias("creator_id"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("symbol"))
    return part.join(first, "entity_id").select("entity_id", F.col("entity_id").alias("insert_order"), "name", "symbol", "created_at", "creator_id")


def stream_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B: the event stream, keyed by the number in its props."""
    return from_events(table(spark, sf_dir, "events"))


def from_events(events: DataFrame) -> DataFrame:
    return with_state(
        events.select(
            "event_id",
            F.get_json_object("props", "$.k").cast("long").alias("entity_id"),
            F.col("user_id").alias("actor_id"),
            F.when(F.col("event_type").isin("purchase", "click", "view"), "buy").otherwise("sell").alias("side"),
            F.col("value").alias("amount"),
            (1 + F.col("event_id") % 7).cast("double").alias("qty"),
            epoch("ts").alias("ts"),
        )
    )


def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stream_trades(spark, sf_dir)
    return t.groupBy("entity_id").agg(F.min("ts").alias("created_at"), F.min_by("actor_id", "ts").alias("creator_id")).withColumn("insert_order", F.col("entity_id"))


# -- scans ------------------------------------------------------------------------------------------------------------


def scan_entities(tokens: DataFrame, newest: int | None = None) -> DataFrame:
    """Entities in order of creation; with `newest`, only that many of the latest."""
    if newest is not None:
        tokens = tokens.orderBy(F.desc("created_at"), F.desc("insert_order")).limit(newest)
    return tokens.orderBy("created_at", "insert_order")


def events_in_window(tokens: DataFrame, trades: DataFrame, start: float, stop: float) -> DataFrame:
    """Events of every entity from `start` to `stop` seconds after its creation, both included."""
    t = tokens.select("entity_id", "created_at", "creator_id")
    return trades.join(t, "entity_id").where(F.col("ts").between(F.col("created_at") + start, F.col("created_at") + stop))


def parse_create(raw: DataFrame) -> DataFrame:
    """Raw JSON of creation messages (value) as typed rows; pools get their public names."""
    schema = "mint string, name string, symbol string, traderPublicKey string, timestamp double, uri string, pool string, txType string"
    j = raw.select(F.from_json("value", schema).alias("j")).where("j.txType = 'create'")
    # a message without a pool comes from the first of these; fixed values: short names of pools in messages, and the names they are stored under
    pool = F.when(F.col("j.pool") == "pump", "pumpfun").when(F.col("j.pool") == "bonk", "letsbonk").otherwise(F.coalesce(F.nullif(F.col("j.pool"), F.lit("")), F.lit("pumpfun")))
    return j.select(F.col("j.mint").alias("entity_id"), "j.name", "j.symbol", F.col("j.traderPublicKey").alias("creator_id"), F.col("j.timestamp").alias("created_at"), "j.uri", pool.alias("source"))


def descaled(x):
    """Values above 1000 come in units of 1e-9."""
    return F.when(x > 1000, x / 1e9).otherwise(x)


def parse_trade(raw: DataFrame) -> DataFrame:
    """Raw JSON of trade messages (value), typed; amounts, reserves and valuations are brought to whole units.

    A message without a type is a buy, missing numbers are 0, missing names empty.
    """
    numbers = ["solAmount", "tokenAmount", "newTokenBalance", "vSolInBondingCurve", "vTokensInBondingCurve", "marketCapSol", "timestamp"]
    names = ["mint", "traderPublicKey", "creator", "txType", "bondingCurveKey", "signature"]
    j = raw.select(F.from_json("value", ", ".join([*(f"{n} double" for n in numbers), *(f"{n} string" for n in names)])).alias("j"))
    number = lambda n: F.coalesce(F.col(f"j.{n}"), F.lit(0.0))
    side = F.coalesce(F.col("j.txType"), F.lit("buy"))
    return j.where(side.isin("buy", "sell")).select(
        F.coalesce("j.mint", F.lit("")).alias("entity_id"),
        F.coalesce("j.traderPublicKey", F.lit("")).alias("actor_id"),
        side.alias("side"),
        descaled(number("solAmount")).alias("amount"),
        number("tokenAmount").alias("qty"),
        descaled(number("vSolInBondingCurve")).alias("reserve"),
        descaled(number("marketCapSol")).alias("mcap"),
        F.col("j.timestamp").alias("ts"),
        F.coalesce(F.col("j.traderPublicKey") == F.col("j.creator"), F.lit(False)).alias("is_creator"),
        "j.signature",
        number("newTokenBalance").alias("new_balance"),
        F.coalesce("j.bondingCurveKey", F.lit("")).alias("curve_key"),
        number("vTokensInBondingCurve").alias("token_reserve"),
    )


# -- store-level operators ----------------------------------------------------------------------------------------------


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of the rows of both tables, the one with the highest version per key; at equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    payload = F.struct(*[c for c in old.columns if c not in key])
    return both.groupBy(*key).agg(F.max_by(payload, F.struct(version, "_new")).alias("r")).select(*key, "r.*")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old, and the rows of new whose key it lacks; the first by `order` of those that share a key."""
    payload = F.struct(*[c for c in new.columns if c not in key])
    first = new.groupBy(*key).agg(F.min_by(payload, order).alias("r")).select(*key, "r.*")
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def merge_activity(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partial aggregates per (actor, entity), merged: least, greatest and sums."""
    return (
        old.unionByName(new)
        .groupBy("actor_id", "entity_id")
        .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("buy_amount").alias("buy_amount"), F.sum("sell_amount").alias("sell_amount"))
    )


def write_dataset(df: DataFrame, path: str) -> str:
    """Write as Parquet, or as CSV where a column cannot be stored there; the format used is returned."""
    plain = all(not isinstance(f.dataType, T.CalendarIntervalType) for f in df.schema.fields)
    (df.write.mode("overwrite").parquet if plain else df.write.mode("overwrite").option("header", True).csv)(path)
    return "parquet" if plain else "csv"


def copy_common(source: DataFrame, target_columns: list[str]) -> DataFrame:
    """The columns that both sides have, in the source's order."""
    return source.select([c for c in source.columns if c in target_columns])


def count_report(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table_name, n_source, n_target, equal_counts) for tables and their copies."""
    out = None
    for name, (a, b) in pairs.items():
        row = a.agg(F.count("*").alias("n_source")).crossJoin(b.agg(F.count("*").alias("n_target"))).select(F.lit(name).alias("table_name"), "n_source", "n_target", (F.col("n_source") == F.col("n_target")).alias("equal_counts"))
        out = row if out is None else out.unionByName(row)
    return out


def schema_diff(spark: SparkSession, old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, old_type, new_type, change): fields added, missing or of another type."""
    a, b = {f.name: f.dataType.simpleString() for f in old.schema}, {f.name: f.dataType.simpleString() for f in new.schema}
    rows = [(n, a.get(n), b.get(n), "added" if n not in a else "missing" if n not in b else "retyped") for n in sorted({*a, *b}) if a.get(n) != b.get(n)]
    return spark.createDataFrame(rows, "field string, old_type string, new_type string, change string")


def gate_counts(lines: DataFrame, gates: list[tuple[str, str]]) -> DataFrame:
    """Log lines (value) by the first gate whose pattern they hold: (gate, n, last_seen, state); gates without lines are DEAD."""
    hit = F.coalesce(*(F.when(F.col("value").rlike(p), F.lit(g)) for g, p in gates))
    seen = lines.withColumn("gate", hit).where("gate is not null").groupBy("gate").agg(F.count("*").alias("n"), F.max(F.regexp_extract("value", r"^(\d\d:\d\d:\d\d)", 1)).alias("last_seen"))
    names = lines.sparkSession.createDataFrame([(g,) for g, _ in gates], "gate string")
    return names.join(seen, "gate", "left").select("gate", F.coalesce("n", F.lit(0)).alias("n"), "last_seen", F.when(F.col("n").isNull(), "DEAD").otherwise("ALIVE").alias("state"))


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the highest `order` per key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
