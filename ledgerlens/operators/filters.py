"""Predicates, labels and top-k reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_source_time(df: DataFrame, source: str, after: float, n: int) -> DataFrame:
    return df.where((F.col("source") == source) & (F.col("scored_at") > after)).orderBy(F.desc("scored_at")).limit(n)


def by_date(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of a UTC day, as a range of the raw column, so that files and row groups are pruned."""
    start = F.unix_timestamp(F.lit(day), "yyyy-MM-dd").cast("double")
    return df.where((F.col(ts) >= start) & (F.col(ts) < start + 86400.0))


def dates(df: DataFrame, ts: str, n: int) -> DataFrame:
    """The newest n days that occur."""
    return df.select(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd").alias("day")).distinct().orderBy(F.desc("day")).limit(n)


def real_positions(df: DataFrame, types: list[str], since: float) -> DataFrame:
    """Positions of a known entry type or with a buyer number, from `since` on."""
    known = F.lower(F.coalesce("entry_type", F.lit(""))).isin(types)
    return df.where((known | (F.coalesce("entry_buyer_number", F.lit(0)) > 0)) & (F.col("entry_time") >= since))


def mature(df: DataFrame, now: float, horizon: float, slack: float) -> DataFrame:
    """Rows old enough that their label is known."""
    return df.where(F.col("scored_at") <= now - horizon - slack)


def reached(tokens: DataFrame, trades: DataFrame, mcap: float) -> DataFrame:
    return tokens.join(trades.where(F.col("mcap") >= mcap).select("entity_id"), "entity_id", "left_semi")


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table lacks; NULL keys stay."""
    return df.join(other.select(key), key, "left_anti")


def entry_path(entry_type: Column) -> Column:
    t = F.lower(F.coalesce(entry_type, F.lit("")))
    return F.when(t == "fast", "FAST").when(t == "full", "FULL").when(t == "ml_override", "ML_OVERRIDE").otherwise("?")


def first_reason(reasons: Column, n: int) -> Column:
    """The first item of a list split at `,` or `;`, at most n characters, with an ellipsis where it was cut."""
    x = F.trim(F.element_at(F.split(reasons, "[,;]"), 1))
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def marked(df: DataFrame, wanted: DataFrame, key: str, marker: Column) -> DataFrame:
    return df.where(marker).select(key).distinct().join(wanted.select(key), key, "left_semi")


def active(events: DataFrame, least_events: int, least_volume: float) -> DataFrame:
    g = events.groupBy("entity_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("side") == "buy", F.col("amount"))), F.lit(0.0)).alias("v"))
    return g.where((F.col("n") >= least_events) & (F.col("v") >= least_volume)).select("entity_id")


def winners_losers(book: DataFrame, n: int) -> DataFrame:
    top = book.orderBy(F.desc("pnl_pct"), "id").limit(n).select(F.lit("winner").alias("side"), "id", "pnl_pct")
    return top.unionByName(book.orderBy("pnl_pct", "id").limit(n).select(F.lit("loser").alias("side"), "id", "pnl_pct"))


def topn_overlap(df: DataFrame, a: str, b: str, tie: str, ns: list[int]) -> DataFrame:
    """For each n: wins among the n best by either score, and how many rows both pick. Only the largest n rows are ranked."""
    most = max(ns)
    rank = lambda c: df.orderBy(F.desc(c), tie).limit(most).select(tie, "win", F.row_number().over(Window.orderBy(F.desc(c), tie)).alias(f"r_{c}"))
    j = rank(a).join(rank(b), [tie, "win"], "full")
    each = j.withColumn("n", F.explode(F.array(*map(F.lit, ns))))
    inside = lambda c: F.coalesce(F.col(f"r_{c}") <= F.col("n"), F.lit(False))
    return each.groupBy("n").agg(F.count_if(F.col("win") & inside(a)).alias("wins_a"), F.count_if(F.col("win") & inside(b)).alias("wins_b"), F.count_if(inside(a) & inside(b)).alias("overlap"))


def random_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in hash order: random, but the same in every run."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
