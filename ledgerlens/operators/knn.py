"""Exact nearest neighbours: balls and rings around sampled centres, searched only where the triangle inequality allows a nearer row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .actors import _shared

CENTRES, RINGS, BLOCK = 1024, 32, 512  # at most; the last one is the least size of a block
#: Where distances hardly differ a row goes to nearly every block, so blocks grow with the rows: what is sent then grows as the rows do, up to SHARES * LARGEST of them.
SHARES, LARGEST = 32, 1 << 16
CELLS = 1 << 22  # distances in memory at once
SLACK = 1e-6  # distances are rounded; bounds give way by so much


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def _homes(df: DataFrame, key: str, vector: str, label: str, block: int) -> tuple[DataFrame, np.ndarray]:
    """(id, label, v, d, cell, ring, sub): standardised vectors with their nearest centre, its distance, ring and block; and the centres.

    Centres are a sample of rows by least hash, a row for every `block` rows, CENTRES at most. Rings are quantiles of the
    distance within a cell, one for every `block` rows, RINGS at most; what is still larger is dealt into blocks by hash.
    """
    rows = df.where(F.col(vector).isNotNull())
    stats = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).orderBy("i").collect()  # a row per dimension
    mean, std = np.array([r["m"] for r in stats], float), np.array([r["s"] or 1.0 for r in stats], float)
    n = stats[0]["n"] if stats else 0
    sample = rows.select(vector, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(max(1, min(CENTRES, n // block))).collect()
    centres = (np.array([r[vector] for r in sample], float).reshape(len(sample), len(mean)) - mean) / std

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = (_matrix(b.column("v")) - mean) / std
            d = _between(v, centres)
            cell = d.argmin(1)
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), out, pa.array(d[np.arange(len(v)), cell]), pa.array(cell, pa.int32())], names=["id", "label", "v", "d", "cell"])

    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    at = _shared(plain.mapInArrow(place, "id long, label int, v array<double>, d double, cell int"))
    cells = at.groupBy("cell").agg(F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1000).alias("q"), F.count("*").alias("c"))
    rings = F.least(F.lit(RINGS), F.greatest(F.lit(1), F.floor(F.col("c") / block))).cast("int")
    bounds = F.transform(F.sequence(F.lit(0), rings - 1), lambda i: F.get("q", (i * RINGS / rings).cast("int") - 1))
    cells = cells.select("cell", F.filter(bounds, lambda x: x.isNotNull()).alias("bounds"))
    at = at.join(F.broadcast(cells), "cell")  # CENTRES rows at most
    at = at.withColumn("ring", F.size(F.filter("bounds", lambda x: x < F.col("d")))).drop("bounds")
    sizes = at.groupBy("cell", "ring").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("subs"))
    at = at.join(F.broadcast(sizes), ["cell", "ring"])  # CENTRES x RINGS rows at most
    return _shared(at.select("id", "label", "v", "d", "cell", "ring", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"))), centres


def _meet(dealt: DataFrame, by: list[str], k: int) -> DataFrame:
    """(id, label, near, near_label, d): for each asking row of a group its k nearest others of those that don't ask, no farther than its `reach`."""

    def meet(rows: pa.Table) -> pa.Table:
        ids, lab, asks, reach = (np.asarray(rows.column(c)) for c in ("id", "label", "asks", "reach"))
        v = _matrix(rows.column("v").combine_chunks())
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        r = r[np.argsort(ids[r], kind="stable")]  # ties by id
        found = []
        for q in np.array_split(q, max(1, -(-len(q) * max(1, len(r)) // CELLS))):
            d = np.round(_between(v[q], v[r]), 9)
            d[(ids[q][:, None] == ids[r][None, :]) | (d > reach[q][:, None])] = np.inf
            cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
            i, j = np.nonzero((d <= cut) & np.isfinite(d))
            order = np.lexsort((j, d[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k  # of those as far as the k-th, the first by id
            i, j = i[first], j[first]
            found.append((q[i], r[j], d[i, j]))
        a, b, d = (np.concatenate(x) for x in zip(*found))
        return pa.table({"id": ids[a], "label": pa.array(rows.column("label").combine_chunks().take(pa.array(a))), "near": ids[b], "near_label": rows.column("label").combine_chunks().take(pa.array(b)), "d": d})

    return dealt.groupBy(*by).applyInArrow(meet, "id long, label int, near long, near_label int, d double")


def _probes(homes: DataFrame, centres: np.ndarray, near: DataFrame, k: int) -> DataFrame:
    """(id, label, v, reach, cell, ring, sub): every block other than its own in which a row may have one of its k nearest.

    near has the neighbours found in the row's own block: the k-th of them bounds the reach. A row at distance x of a centre has nothing
    within reach in a ring from lo to hi if x - reach > hi or x + reach < lo.
    """
    blocks = homes.groupBy("cell", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("sub").alias("subs")).orderBy("cell", "ring").collect()  # CENTRES x RINGS rows at most
    cell, ring, lo, hi, subs = (np.array([b[c] for b in blocks]) for c in ("cell", "ring", "lo", "hi", "subs"))
    reach = near.groupBy("id").agg(F.when(F.count("*") >= k, F.max("d")).alias("reach"))
    asking = homes.join(reach, "id", "left").select("id", "label", "v", "cell", "ring", "sub", F.coalesce(F.col("reach") + SLACK, F.lit(float("inf"))).alias("reach"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = _between(_matrix(b.column("v")), centres)[:, cell]
                r = np.asarray(b.column("reach"))[:, None]
                i, j = np.nonzero((x - r <= hi + SLACK) & (x + r >= lo - SLACK))
                times = subs[j] + 1
                i, j, s = np.repeat(i, times), np.repeat(j, times), np.concatenate([np.arange(t) for t in times])
                own = (cell[j] == np.asarray(b.column("cell"))[i]) & (ring[j] == np.asarray(b.column("ring"))[i]) & (s == np.asarray(b.column("sub"))[i])
                i, j, s = i[~own], j[~own], s[~own]
                for p in range(0, len(i), 4096):
                    t = pa.array(i[p : p + 4096])
                    kept = [b.column(c).take(t) for c in ("id", "label", "v", "reach")]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(a[p : p + 4096], pa.int32()) for a in (cell[j], ring[j], s))], names=["id", "label", "v", "reach", "cell", "ring", "sub"])

    return asking.mapInArrow(search, "id long, label int, v array<double>, reach double, cell int, ring int, sub int")


def nearest(df: DataFrame, key: str, vector: str, label: str, k: int, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, label, near, near_label, d, place), the probes): the k nearest other rows of every row, exact, ties by id.

    Vectors are standardised by column, distances are Euclidean and rounded to 9 digits. A row first meets its own block, whose k-th neighbour
    bounds how far the others may lie; then it is sent to the blocks whose ring reaches within that bound, and to no other. A block asked by
    many meets them in parts. How many blocks that are depends on the data: few where rows cluster, nearly all where distances hardly differ.
    Without `block` blocks hold a SHARES-th of the rows, BLOCK at least. Rows without a vector take no part.
    """
    block = block or max(BLOCK, min(LARGEST, df.where(F.col(vector).isNotNull()).count() // SHARES))
    homes, centres = _homes(df, key, vector, label, block)
    where = ["cell", "ring", "sub"]
    both = homes.select("id", "label", "v", *where, F.explode(F.array(F.lit(True), F.lit(False))).alias("asks"), F.lit(float("inf")).alias("reach"))
    first = _shared(_meet(both, where, k))
    probes = _shared(_probes(homes, centres, first, k))
    load = probes.groupBy(*where).agg(F.ceil(F.count("*") / (8 * block)).cast("int").alias("parts"))
    asked = probes.join(load, where).select("id", "label", "v", "reach", *where, F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    there = homes.join(load, where).select("id", "label", "v", F.lit(float("inf")).alias("reach"), *where, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = first.unionByName(_meet(asked.unionByName(there), [*where, "part"], k))
    w = Window.partitionBy("id").orderBy("d", "near")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k), probes


def knn_label_noise(df: DataFrame, key: str, vector: str, label: str, k: int, block: int | None = None) -> DataFrame:
    """(key, label, noise): the share of the k nearest other rows, by Euclidean distance of standardised features, of another label."""
    best, _ = nearest(df, key, vector, label, k, block)
    return best.groupBy("id", "label").agg(F.avg((F.col("near_label") != F.col("label")).cast("int")).alias("noise")).withColumnRenamed("id", key)
