"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking by the original vectors.

Rotations are learned on a bounded sample, less its mean; the signs of the rotated vectors themselves are the codes, since
taking the mean off them too would widen the angles of pairs that share a direction. The codes are cut
into substrings; each substring is the key of one table, and two vectors meet where a table gives them the same key.
The length of the keys follows the number of vectors (about `BUCKET` of them a key) and the number of tables follows
from the length, so that a pair at the threshold itself is missed with a chance of 1 - recall; tables are added until
pairs of the sample, and pairs made at the threshold around its vectors, are missed no more often. Whatever meets is
compared by exact cosines.

Pairs are never written out: a bucket returns counts and the edges of its local components. A pair that meets in several
tables counts in the first. Large clusters are found in the sample as balls of half the threshold's angle: by the
triangle inequality all of a ball's pairs are links, so that its members only have to meet vectors outside the ball. A
crowded key is salted: its vectors are dealt out to parts, and each two parts that have to meet are a group of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packing import materialize

SAMPLE = 4096  # vectors that the rotations are learned on
BUCKET = 48
PART = 2000  # vectors in one part of a salted key at least
PARTS, LARGEST = 16, 50_000  # parts of a key, unless they had more vectors than LARGEST
BALLS = 48  # balls at most, each of at least 1 / BALLS of the sample
ENTRY = "table int, key int, salt int, split int, node long, copies long, ball int, vec binary, keys binary"


def learn(sample: np.ndarray, rotations: int, rounds: int = 25, seed: int = 0, learned: int | None = None) -> np.ndarray:
    """Rotations as one matrix of d x (d * rotations): PCA, then alternate between codes and rotation.

    Beyond the first `learned` they stay random: in few dimensions learning always ends at the same one.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    _, _, axes = np.linalg.svd(sample - mean, full_matrices=True)
    v = (sample - mean) @ axes.T
    out = []
    for i in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((len(axes), len(axes))))
        for _ in range(rounds if learned is None or i < learned else 0):
            code = np.where(v @ r >= 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(code.T @ v)
            r = (a @ b).T
        out.append(axes.T @ r)
    return np.concatenate(out, axis=1)


def probes(sample: np.ndarray, threshold: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to measure recall on: partners at the threshold in random directions, and what the sample has just above it."""
    rng = np.random.default_rng(seed)
    out = []
    if sample.shape[1] > 1:
        w = rng.standard_normal(sample.shape)
        w -= (w * sample).sum(1, keepdims=True) * sample
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        out.append((sample, threshold * sample + math.sqrt(1 - threshold**2) * w))
    found = []
    for i in range(0, len(sample), 512):
        cos = sample[i : i + 512] @ sample.T
        p, q = np.nonzero((cos >= threshold) & (cos < threshold + (1 - threshold) / 5))
        some = rng.permutation(np.flatnonzero(p + i < q))[:2000]
        found.append(np.stack([p[some] + i, q[some]]))
    p, q = np.concatenate(found, axis=1)
    if len(p) >= 100:
        out.append((sample[p], sample[q]))
    return out


def fitted(sample: np.ndarray, bits: int, tables: int, threshold: float, recall: float) -> tuple[np.ndarray, int]:
    """(rotations, tables): the planned tables, and more until the probes are missed with a chance of 1 - recall at most."""
    pairs, dims = probes(sample, threshold), sample.shape[1]
    planned = -(-bits * tables // dims)
    while True:
        rotation = learn(sample, -(-bits * tables // dims), learned=planned)[:, : bits * tables]
        codes = lambda x: (x @ rotation >= 0).reshape(len(x), tables, bits)
        missed = max((1 - (codes(a) == codes(b)).all(2).any(1).mean() for a, b in pairs), default=0.0)
        if missed <= 1 - recall:
            return rotation, tables
        tables = max(tables + 1, min(2 * tables, math.ceil(tables * math.log(1 - recall) / math.log(min(missed, 0.99)))))


def balls(sample: np.ndarray, radius: float) -> np.ndarray:
    """Centres of balls (an angle around a sample vector) that hold at least 1 / BALLS of the sample, greedily."""
    left, out = np.ones(len(sample), bool), []
    near = np.cos(radius)
    while left.any() and len(out) < BALLS:
        rest = sample[left]
        inside = np.zeros(len(rest), np.int64)
        for i in range(0, len(rest), 512):
            inside[i : i + 512] = (rest[i : i + 512] @ rest.T >= near).sum(1)
        best = int(inside.argmax())
        if inside[best] < max(8, len(sample) / BALLS):
            break
        out.append(rest[best])
        left[np.flatnonzero(left)[rest @ rest[best] >= near]] = False
    return np.array(out).reshape(len(out), sample.shape[1])


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a key, tables) for n vectors."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / BUCKET + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    v = np.asarray(column.flatten(), np.float64).reshape(-1, dims)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def linked(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, an array of numbers).

    Two rows link when the cosine of their vectors, in double precision, is at least `threshold`; equal vectors do.
    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable. A pair at the
    threshold is found with the chance `recall`, closer pairs with a higher one; no link is below the threshold.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors link only
    with others of their length; rows whose vec_id is null link with nothing (their component_id is null, kept false).
    Rows that repeat count each. Extra columns are ignored; an empty table gives an empty one.
    """
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fine = F.coalesce(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0), F.lit(False)) & F.col("vec_id").isNotNull()
    # floats travel as they are, anything else as doubles
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    ids = rows.select("vec_id", F.when(fine, F.size(e)).alias("dims"), F.when(fine, F.xxhash64(e, F.lit(5))).alias("node"))
    lengths = ids.where("dims is not null").groupBy("dims").agg(F.count("*").alias("n")).where("n > 1").collect()
    ids = ids.select("vec_id", "node")
    info = vectors.sparkSession.createDataFrame([], "node long, links long, component long")
    for dims, n in sorted(lengths):
        info = info.unionByName(_of_length(rows.where(fine & (F.size(e) == dims)), dims, n, threshold, recall, sample))
    out = ids.join(info, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _of_length(good: DataFrame, dims: int, n: int, threshold: float, recall: float, sample: int) -> DataFrame:
    """(node, links, component) of the n valid vectors of one length."""
    e = F.col("embedding")
    number = np.float32 if good.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    classes = good.groupBy(F.xxhash64(e, F.lit(5)).alias("node")).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes)

    bits, tables = plan(n, threshold, recall)
    picked = good.select("embedding", F.xxhash64("vec_id", F.lit(11)).alias("h")).orderBy("h").limit(sample).toPandas()  # bounded
    s = np.stack(picked["embedding"].to_numpy()).astype(float)
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    rotation, tables = fitted(s, bits, tables, threshold, recall)
    radius = math.acos(threshold) / 2 - 1e-6
    centres = balls(s, radius)
    model = good.sparkSession.sparkContext.broadcast((rotation, centres))

    def encode(batches):
        rotation, centres = model.value
        weight = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(b.column("embedding"), dims)
            keys = ((u @ rotation >= 0).reshape(len(u), tables, bits) @ weight).astype(np.int32)
            ball = np.full(len(u), -1, np.int32)
            if len(centres):
                cos = u @ centres.T
                ball = np.where(cos.max(1) >= math.cos(radius), cos.argmax(1), -1).astype(np.int32)
            raw = np.ascontiguousarray(np.asarray(b.column("embedding").flatten(), number)).reshape(len(u), dims)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("least"), b.column("copies"), pa.array(ball), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))],
                names=["node", "least", "copies", "ball", "vec", "keys", "each"],
            )

    coded = materialize(classes.mapInArrow(encode, "node long, least long, copies long, ball int, vec binary, keys binary, each array<int>"))
    in_ball = coded.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("ball_rows"), F.count("*").alias("ball_nodes"), F.min("node").alias("head"))  # BALLS rows at most
    entries = coded.select("node", "copies", "ball", "vec", "keys", F.posexplode("each").alias("table", "key"))

    # keys of more than PART vectors: at most one for each PART entries. The ball with most of a key's vectors is dealt to
    # the parts under `own`, whose members need not meet each other, all other vectors to the parts from `own` on
    crowd = entries.groupBy("table", "key", "ball").agg(F.count("*").alias("c"))
    crowd = crowd.groupBy("table", "key").agg(F.sum("c").alias("total"), F.max(F.when((F.col("ball") >= 0) & (F.col("c") >= PART), F.struct("c", "ball"))).alias("m")).where(F.col("total") > PART)
    dealt = lambda c: F.ceil(c / F.least(F.greatest(c / PARTS, F.lit(PART)), F.lit(LARGEST))).cast("int")
    held = F.coalesce("m.c", F.lit(0))
    crowd = crowd.select("table", "key", F.coalesce("m.ball", F.lit(-1)).alias("main"), dealt(held).alias("own"), dealt(F.col("total") - held).alias("others"))
    entries = entries.join(F.broadcast(crowd), ["table", "key"], "left")
    inner = (F.col("main") >= 0) & (F.col("ball") == F.col("main"))
    lot_of = lambda parts: F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")
    part = F.when(F.col("main").isNull(), 0).when(inner, lot_of(F.col("own"))).otherwise(F.col("own") + lot_of(F.col("others")))
    entries = entries.withColumn("part", part)
    last = F.col("own") + F.col("others") - 1
    partners = F.when(F.col("main").isNull(), F.array(F.lit(0))).when(~inner, F.sequence(F.lit(0), last)).when(F.col("others") > 0, F.sequence(F.col("own"), last)).otherwise(F.array().cast("array<int>"))
    entries = entries.withColumn("with", F.explode(partners))
    salt = F.coalesce(F.least("part", "with") * (last + 1) + F.greatest("part", "with"), F.lit(0))
    entries = entries.select("table", "key", salt.alias("salt"), "part", (F.col("part") != F.col("with")).alias("cross"), "node", "copies", "ball", "vec", "keys")
    # some neighbouring keys share a group, to spare Python calls
    lot = F.shiftright("key", 4)

    def meet(rows: pa.Table) -> pa.Table:
        key, cross, part, node, copies, ball = (np.asarray(rows.column(c)) for c in ("key", "cross", "part", "node", "copies", "ball"))
        table = int(rows.column("table")[0].as_py())
        order = np.lexsort((node, key))
        v = np.frombuffer(b"".join(rows.column("vec").to_pylist()), number).reshape(len(node), -1)[order].astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int32).reshape(len(node), -1)[order][:, :table]
        key, cross, part, node, copies, ball = (x[order] for x in (key, cross, part, node, copies, ball))
        count, label = np.zeros(len(node), np.int64), np.arange(len(node))
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, z in zip(cuts[:-1], cuts[1:]):
            for i in range(a, z, 1024):
                left = slice(i, min(i + 1024, z))
                for j in range(i, z, 1024):
                    right = slice(j, min(j + 1024, z))
                    p, q = np.nonzero(v[left] @ v[right].T >= threshold)
                    p, q = p + i, q + j
                    ok = p < q
                    p, q = p[ok], q[ok]
                    ok = (ball[p] < 0) | (ball[p] != ball[q])
                    if cross[a]:  # two parts of a salted key; the pairs within one meet in its own group
                        ok &= part[p] != part[q]
                    if table:
                        ok &= ~(keys[p] == keys[q]).any(1)
                    p, q = p[ok], q[ok]
                    np.add.at(count, p, copies[q])
                    np.add.at(count, q, copies[p])
                    while len(p) and (label[p] != label[q]).any():
                        least = np.minimum(label[p], label[q])
                        np.minimum.at(label, p, least)
                        np.minimum.at(label, q, least)
                        label = np.minimum(label, label[label])
        some = count > 0
        return pa.table({"node": pa.array(node[some]), "add": pa.array(count[some]), "to": pa.array(node[label[some]])})

    met = entries.withColumn("lot", lot).groupBy("table", "lot", "salt").applyInArrow(meet, "node long, add long, to long")
    met = materialize(met)
    edges = met.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b"))
    star = coded.where("ball >= 0").join(F.broadcast(in_ball.select("ball", "head")), "ball").select(F.col("node").alias("a"), F.col("head").alias("b"))
    comp = components(edges.unionByName(star))
    named = comp.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    comp = comp.join(named, "component").select("node", "first")
    added = met.groupBy("node").agg(F.sum("add").alias("add"))
    info = coded.select("node", "least", "copies", "ball").join(F.broadcast(in_ball.select("ball", "ball_rows")), "ball", "left")
    info = info.join(added, "node", "left").join(comp, "node", "left")
    links = F.coalesce("add", F.lit(0)) + F.coalesce("ball_rows", "copies") - 1
    return info.select("node", links.cast("long").alias("links"), F.coalesce("first", "least").alias("component"))


def brute(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """All linked pairs of a small table, for tests."""
    v = np.stack(pdf["embedding"].to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p, q = np.nonzero(np.triu(v @ v.T >= threshold, 1))
    ids = pdf["vec_id"].to_numpy()
    return list(zip(ids[p].tolist(), ids[q].tolist()))
