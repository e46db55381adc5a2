"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import discard, stored


def local_stars(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) with each partition's own replaced by stars around its components' smallest nodes."""

    def star(batches):
        u, v = ([], [])
        for b in batches:
            u.append(np.asarray(b.column(0))), v.append(np.asarray(b.column(1)))
        if not u:
            return
        node, at = np.unique(np.concatenate([*u, *v]), return_inverse=True)
        u, v = np.split(at, 2)
        label = np.arange(len(node))
        while (label[u] != label[v]).any():
            least = np.minimum(label[u], label[v])
            np.minimum.at(label, label[u], least)
            np.minimum.at(label, label[v], least)
            while (label != label[label]).any():
                label = label[label]
        out = label != np.arange(len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[label[out]])], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(star, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long) of every node of `edges` (a long, b long): the smallest node reachable.

    Nulls and loops are ignored; an empty table gives an empty one; repeated edges count once. Every step replaces
    the edges by a star-shaped set with the same components, first within each partition and then across them; hubs only ever
    meet in aggregations and equi-joins. Each round is written to the shared checkpoint folder and the one before deleted;
    rounds grow with the logarithm of the largest component, squared at most.
    """
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    big_small = edges.where(ok).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(local_stars(big_small))
    now = _state(e)
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stored(local_stars(pulled.unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
        discard(last)
        before, now = now, _state(e)
        if now["many"] == 0 and before == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame):
    """What two equal rounds agree in, and how many nodes have more than one edge to a smaller one."""
    return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"), (F.count("*") - F.count_distinct("u")).alias("many")).first()
