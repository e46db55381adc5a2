"""Set operations between sources of the same keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def set_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, part): only_old, only_new or shared."""
    both = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(key, F.lit(0).alias("o"), F.lit(1).alias("n")))
    g = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return g.select(key, F.when(F.col("n") == 0, "only_old").when(F.col("o") == 0, "only_new").otherwise("shared").alias("part"))


def dedupe_sources(live: DataFrame, backfill: DataFrame) -> DataFrame:
    """One event per (entity, side, actor, amount, quantity, second): one with a valuation if there is one, else the earliest."""
    key = ["entity_id", "side", "actor_id", F.round("amount", 9), F.round("qty", 3), F.floor("ts")]
    w = Window.partitionBy(*key).orderBy((F.col("mcap") > 0).desc(), "ts", "event_id", F.desc("src"))
    return live.unionByName(backfill).withColumn("_q", F.row_number().over(w)).where("_q = 1").drop("_q")


def new_only(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose (second, actor, side, rounded amount) the existing ones lack."""
    keys = {"_t": F.floor("ts"), "_a": F.round("amount", 6)}
    have = existing.withColumns(keys).select("_t", "_a", "actor_id", "side").distinct()
    return rows.withColumns(keys).join(have, ["_t", "_a", "actor_id", "side"], "left_anti").drop("_t", "_a")


def cell_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, field, a, b) of every cell that differs between two tables, as text."""
    fields = [c for c in a.columns if c != key and c in b.columns]
    j = a.select(key, *(F.col(c).cast("string").alias(f"a_{c}") for c in fields)).join(b.select(key, *(F.col(c).cast("string").alias(f"b_{c}") for c in fields)), key)
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in fields))
    return j.select(key, F.explode(F.filter(cells, lambda x: ~x["a"].eqNullSafe(x["b"]))).alias("x")).select(key, "x.field", "x.a", "x.b")


def match_rates(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, key)
    return j.agg(F.count("*").alias("n_keys"), *(F.avg(F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")).cast("int")).alias(f"{c}_rate") for c in fields))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
