"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The venue's fee per leg and the flat fee per transaction.
FEE, PRIORITY_FEE = 0.01, 0.0005


def text_features(name: str, symbol: str, uri: str) -> list[Column]:
    caps = (F.col(uri) == F.upper(uri)) & F.col(uri).rlike(r"^\p{L}+$")
    return [F.length(name).alias("name_length"), F.length(symbol).alias("symbol_length"), (F.col(uri) != "").alias("has_uri"), caps.alias("all_caps"), F.concat(name, symbol).rlike(r"\d").alias("has_digits")]


def hour_features(ts: str) -> list[Column]:
    """UTC hour, and its place on the circle."""
    h = F.hour(F.timestamp_seconds(ts))
    angle = h * (2 * math.pi / 24)
    return [h.alias("hour_utc"), F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos")]


def ratio(a: str, b: str, pad: float) -> Column:
    """a / (b + pad): defined for b = 0."""
    return F.col(a) / (F.col(b) + pad)


def between(a: str, b: str, at_a: float, at_b: float, at: float) -> Column:
    """Linear interpolation between the values a and b of two ages; NULL if either is."""
    return F.col(a) + (F.col(b) - F.col(a)) * ((at - at_a) / (at_b - at_a))


def pnl_pct(entry: Column, exit_: Column, size: float, buy_slip: float = 0.0, sell_slip: float = 0.0, legs: int = 1, fee: float = FEE, priority: float = PRIORITY_FEE) -> Column:
    """Result of a round trip in percent, after fees, slippage and flat fees of one buy and `legs` sells; 0 without an entry."""
    cost = entry * ((1 + fee) * (1 + buy_slip))
    got = exit_ * ((1 - fee) * (1 - sell_slip))
    flat = (1 + legs) * priority / size * 100 if size > 0 else 0.0
    return F.when(entry > 0, (got - cost) / cost * 100 - flat).otherwise(0.0)


def fills(trades: DataFrame, size: float, base: float, slope: float, most: float, last: int = 20) -> DataFrame:
    """Prices a trade of `size` would fill at, by the volume of the last events: slip = min(base + size / volume * slope, most)."""
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id").rowsBetween(-(last - 1), 0)
    t = trades.withColumn("_v", F.sum("amount").over(w)).where("_v > 0")
    t = t.withColumn("slip", F.least(F.lit(base) + F.lit(size) / F.col("_v") * slope, F.lit(most)))
    return t.withColumn("buy_fill", F.col("price") * (1 + F.col("slip"))).withColumn("sell_fill", F.col("price") * (1 - F.col("slip"))).drop("_v")


def encode_score(x: Column) -> Column:
    """A signed score as 1..999 around 500, in tenths."""
    return F.greatest(F.lit(1), F.least(F.lit(999), F.bround(x * 10) + 500)).cast("int")


def decode_score(code: Column) -> Column:
    return (code - 500) / 10


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of some columns: keys in order, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def config_diff(configs: DataFrame, name: str, version: str, fields: list[str]) -> DataFrame:
    """(version, field, old, new) for every field in which a version of `name` differs from the one before it; NULL is a value."""
    w = Window.partitionBy(name).orderBy(version)
    was = configs.withColumn("_was", F.lag(F.struct(*fields)).over(w)).where("_was is not null")
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_was.{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in fields))
    return was.select(version, F.inline(cells)).where(~F.col("old").eqNullSafe(F.col("new")))


def synthetic_key(amount: Column) -> Column:
    """What tells one event from another where there is no signature."""
    return F.concat_ws(":", "entity_id", "actor_id", F.floor("ts").cast("string"), amount.cast("string"), "side")


def null_if_solo(value: str, n: str) -> Column:
    """NULL, not 0, where there is no history."""
    return F.when(F.col(n) > 0, F.col(value))
