"""Sharding by vector bin packing: shards of near equal bytes, tokens and rows, with equal texts kept together.

Each group of equal texts is a vector (bytes, tokens, rows), as shares of the totals; it goes to the shard where the dot
product of the vector with the residual capacity is highest. A group that exceeds a shard is cut into small pieces by a
hash of doc_id, any other stays whole. Heavy groups, of which there can only be a bounded number, are packed first, one by one
and largest first. Light groups are then dealt into cells by hash, and every cell packs its own groups, largest first, into
its share of what each shard has left, in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count
from .packing import materialize

CELL = 4096  # groups of a cell, about
PIECE = 16  # pieces for each shard that a group fills, where it has to be cut
HEAVY = 256  # a unit is heavy from 1 / (shards * HEAVY) of the bytes, tokens or rows: at most 3 * shards * HEAVY units


def _pack(vectors: np.ndarray, loads: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each vector, in the given order; loads is updated."""
    room = capacity - loads
    out = np.empty(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        s = int(np.argmax(room @ v))
        room[s] -= v
        out[i] = s
    loads[:] = capacity - room
    return out


def shard(docs: DataFrame, shards: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) and the columns `keep` of every row of docs (doc_id, text).

    size is the number of UTF-8 bytes plus 1 (null text: 1), tokens are words `[^\\x20\\x09-\\x0D]+`. The sizes of the
    shards come out near equal; equal texts share a shard unless their group has more than 1 / shards of all bytes, tokens or
    rows: it is then cut into PIECE pieces for each shard it fills, which level out like other groups.
    slot counts each shard's rows from 0 without gaps. text_crc32 is unsigned, of the UTF-8 bytes (null text: null).
    Nulls: null texts are one group; null doc_ids are rows like others. Repeated rows each get a slot. An empty table
    gives an empty one. Extra columns are ignored. Reruns agree up to the order of fully equal rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")) + 1
    whole = [x for c in ("doc_id", "text", *keep) for x in (F.col(c), F.col(c).isNull())]
    key = [F.xxhash64(F.lit(5), *whole).alias("a"), F.xxhash64(F.lit(6), *whole).alias("b")] if keep else []
    rows = docs.select(*key, F.col("doc_id").cast("long"), size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), word_count("text").alias("tokens"), F.xxhash64("text", F.lit(1)).alias("group"))
    rows = materialize(rows)
    dims = ["size", "tokens", "rows"]
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    n = total[2]
    total = [float(max(x or 0, 1)) for x in total]
    share = lambda c, i: F.col(c) / F.lit(total[i])

    def grouped(df, *keys):
        return df.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))

    largest = F.greatest(*(share(c, i) for i, c in enumerate(dims)))
    # at most 3 * shards groups are that large, so the table of pieces may be broadcast
    cut = grouped(rows, "group").where(largest * shards > 1).select("group", F.ceil(largest * shards * PIECE).cast("int").alias("pieces"))
    rows = rows.join(F.broadcast(cut), "group", "left")
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("pieces"))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("piece", piece).drop("pieces")
    units = materialize(grouped(rows, "group", "piece").withColumn("heavy", largest * shards * HEAVY >= 1))

    cells = max(1, n // CELL)
    cell = F.pmod(F.xxhash64("group", "piece", F.lit(3)), F.lit(cells)).cast("int").alias("cell")

    def ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        v = pdf[dims].to_numpy(float) / np.array(total)
        return v, np.lexsort((pdf["piece"], pdf["group"], -v.max(1)))

    heavy = units.where("heavy").select("group", "piece", *dims).toPandas()  # at most 3 * shards * HEAVY rows
    loads = np.zeros((shards, 3))
    v, order = ordered(heavy)
    to = np.empty(len(v), int)
    to[order] = _pack(v[order], loads, np.full((shards, 3), 1 / shards))
    room = np.maximum(1 / shards - loads, 1e-12)
    room /= room.sum(0)

    def pack_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        v, order = ordered(pdf)
        capacity = room * v[order].sum(0)  # in one order, so that reruns agree to the last bit
        to = np.empty(len(v), np.int32)
        to[order] = _pack(v[order], np.zeros_like(capacity), capacity)
        return pd.DataFrame({"group": pdf["group"], "piece": pdf["piece"], "shard": to})

    placed = units.where("not heavy").withColumn("cell", cell).groupBy("cell").applyInPandas(pack_cell, "group long, piece int, shard int")
    if len(heavy):
        placed = placed.unionByName(spark.createDataFrame([(int(g), int(p), int(s)) for g, p, s in zip(heavy["group"], heavy["piece"], to)], "group long, piece int, shard int"))
    placed = materialize(placed)
    names = [c for c in rows.columns if c in ("a", "b", "doc_id", "size", "text_crc32")]
    out = _slots(rows.join(placed, ["group", "piece"]).select(*names, "shard"), n)
    if not keep:
        return out
    texts = docs.select(*key, *(c for c in keep if c != "doc_id")).dropDuplicates(["a", "b"])  # rows that repeat have the same texts
    return out.join(texts, ["a", "b"]).drop("a", "b")


def _slots(rows: DataFrame, n: int, per_part: int = 2000) -> DataFrame:
    """Number the rows of each shard from 0: ranges of a hash give offsets, a window within a range the rest."""
    parts = max(1, n // per_part)
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(parts)).cast("int")))
    by_part = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("shard", "part").agg(F.count("*").alias("c")).select("shard", "part", F.coalesce(F.sum("c").over(by_part), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    out = rows.withColumn("n", F.row_number().over(inside)).join(offset, ["shard", "part"])
    return out.withColumn("slot", F.col("offset") + F.col("n") - 1).drop("part", "n", "offset")
