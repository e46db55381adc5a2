"""Packed exchange: many small (key, owner, value) entries travel as a few binary rows per bucket.

A row of PACKED holds the entries of one sender for one bucket. `kind` tells readers apart: INDEX rows are matched by
key in a bucket, REPLY rows go back to the bucket of their owners. Integers are stored as differences with their bytes
transposed, which shuffle compression then shrinks to one or two bytes an entry.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordhash import U, mix

INDEX, REPLY, NOTE = 0, 1, 2
PACKED = "bucket int, kind int, key binary, owner binary, value binary, ref binary, at binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("key", "owner", "value", "ref", "at"))])


def squeeze(x: np.ndarray) -> bytes:
    x = np.asarray(x, np.int64)
    d = x.copy()
    d[1:] -= x[:-1]
    d = ((d << 1) ^ (d >> 63)).view(np.uint8)  # small either way
    return np.ascontiguousarray(d.reshape(-1, 8).T).tobytes()


def unsqueeze(b: bytes) -> np.ndarray:
    z = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    d = (z >> U(1)).astype(np.int64) ^ -(z & U(1)).astype(np.int64)
    return np.cumsum(d)


def owner_bucket(owner: np.ndarray, n: int) -> np.ndarray:
    """The bucket of an owner; `bucket_of` is the same as a column."""
    return (xxhash64(owner) % n).astype(np.int32)


def bucket_of(owner, n: int):
    return F.pmod(F.xxhash64(owner), F.lit(n)).cast("int")


def xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of longs. The five constants and the seed 42 are fixed values of that hash."""
    p1, p2, p3, p4, p5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)
    turned = lambda v, k: (v << U(k)) | (v >> U(64 - k))
    h = (U(42) + p5 + U(8)) ^ (turned(np.asarray(x, np.int64).view(U) * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return (h ^ (h >> U(32))).view(np.int64)


def key_bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key ^ U(0x1F83D9ABFB41BD6B)) % U(n)).astype(np.int32)


def rows_of(kind: int, bucket: np.ndarray, key=None, owner=None, value=None, ref=None, at=None, key_bytes: int = 8) -> pa.RecordBatch:
    """PACKED rows: one for each bucket that has entries, in the order of owner and value.

    Keys that only propose candidates may be cut to fewer bytes; the bucket adds its own bits.
    """
    if key is not None and key_bytes < 8:
        key = np.ascontiguousarray(np.asarray(key, "<u8")).view(np.uint8).reshape(-1, 8)[:, :key_bytes]
    order = np.lexsort((value, owner, bucket)) if value is not None else np.lexsort((owner, bucket))
    b = bucket[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, int)
    cols = {"key": key, "owner": owner, "value": value, "ref": ref, "at": at}
    out = {c: [] for c in cols}
    for c, x in cols.items():
        if x is None:
            out[c] = [None] * (len(cuts) - 1)
            continue
        x = x[order]
        out[c] = [(x[i:j].tobytes() if c == "key" else squeeze(x[i:j])) for i, j in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(b[cuts[:-1]] if len(b) else [], pa.int32()), pa.array([kind] * (len(cuts) - 1), pa.int32()), *(pa.array(out[c], pa.binary()) for c in cols)],
        schema=ARROW,
    )


def _keys(b: memoryview, n: int) -> np.ndarray:
    if n == 8:
        return np.frombuffer(b, np.uint64)
    short = np.frombuffer(b, np.uint8).reshape(-1, n)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :n] = short
    return out.view("<u8").ravel().astype(U)


def read(rows: pa.Table, kind: int, *columns: str, key_bytes: int = 8) -> list[np.ndarray]:
    """The entries of all rows of a kind, column by column."""
    is_kind = np.asarray(rows.column("kind")) == kind
    chosen = rows.filter(pa.array(is_kind))
    out = []
    for c in columns:
        parts = [_keys(b.as_buffer(), key_bytes) if c == "key" else unsqueeze(b.as_buffer()) for b in chosen.column(c)]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64 if c == "key" else np.int64))
    return out


def pass_on(rows: pa.Table) -> pa.Table:
    """REPLY rows, as they are, addressed to the bucket that `at` of the first entry names."""
    return rows.filter(pa.array(np.asarray(rows.column("kind")) == REPLY))


def bucket_count(n_rows: int, per_bucket: int = 1000, least: int = 32) -> int:
    return max(least, -(-n_rows // per_bucket))


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder of spark.checkpoint.dir, eagerly, and cut its lineage."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Send texts to Python in batches of a few megabytes; a setting that the user changed stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "67108864", "64m"):  # Spark's default
        spark.conf.set(key, size)


def stored(df: DataFrame) -> DataFrame:
    """Like `materialize`, as a compressed Parquet table in the same folder: for tables with texts."""
    spark = df.sparkSession
    ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once nothing reads them any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._stored
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm.org.apache.hadoop.fs.Path(path), True)


def ready(spark: SparkSession) -> None:
    """The cluster names its shared folder in spark.checkpoint.dir. A local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
