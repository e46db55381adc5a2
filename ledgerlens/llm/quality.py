"""Quality classifier: a linear support vector machine on naive Bayes features.

Features are indicators of word unigrams and bigrams and of byte trigrams, hashed into 2^18. Each indicator is scaled by
its log-count ratio between the classes, rows get unit length, and a hinge-loss model is fitted by dual coordinate
descent. A logistic curve, fitted on training rows the machine has not seen, turns margins into scores. The model is
trained on a sample of labelled rows, bounded in rows and in features; scoring goes over every document in place, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .packing import small_batches

BITS = 18
MAX_TRAIN_ROWS = 8000  # labelled rows that a model is fitted on
MAX_TRAIN_FEATURES = 40_000_000  # and features that they have together: 160 MB


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct features of each text in a slice, in that order."""
    size = W.U(1 << BITS)
    d = w.data
    parts = [(w.row, w.hash % size)]
    i = w.windows(2)
    parts.append((w.row[i], w.span_hash(i, 2) % size))
    if len(d) >= 3:
        x = d.astype(np.uint32)
        tri = W.mix((x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)).astype(W.U)) % size
        owner = np.repeat(np.arange(w.rows), np.diff(w.offsets))
        inside = owner[:-2] == owner[2:]
        parts.append((owner[:-2][inside], tri[inside]))
    key = np.concatenate([(r.astype(np.int64) << BITS) | f.astype(np.int64) for r, f in parts])
    key.sort()
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    return key >> BITS, key & ((1 << BITS) - 1)


def log_count_ratio(feature: np.ndarray, positive: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = alpha + np.bincount(feature[positive], minlength=1 << BITS)
    q = alpha + np.bincount(feature[~positive], minlength=1 << BITS)
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge(indptr, feature, y, ratio, c: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights over indicators (ratio included) and bias, by dual coordinate descent on rows of unit length."""
    rng = np.random.default_rng(seed)
    n = len(y)
    w, bias = np.zeros(1 << BITS), 0.0
    ends = indptr.tolist()
    length = np.array([max(np.linalg.norm(ratio[feature[a:z]]), 1e-12) for a, z in zip(ends[:-1], ends[1:])])
    alpha = np.zeros(n)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            f = feature[ends[i] : ends[i + 1]]
            x = ratio[f] / length[i]
            g = y[i] * (w[f] @ x + bias) - 1
            old = alpha[i]
            alpha[i] = min(max(old - g / 2, 0.0), c)  # |x|^2 and the bias make 2
            step = (alpha[i] - old) * y[i]
            if step:
                w[f] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a m + b))) fits the labels; targets are smoothed towards the middle."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(label: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, a, b) of labelled rows (label 0 or 1, features). One class only: a constant score."""
    if not len(label) or label.min() == label.max():
        share = (label.sum() + 0.5) / (len(label) + 1)
        return np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share)))

    def train(some):
        indptr = np.cumsum([0, *(len(features[i]) for i in some)])
        flat = np.concatenate([features[i] for i in some])
        ratio = log_count_ratio(flat, np.repeat(label[some] > 0, np.diff(indptr)))
        w, bias = hinge(indptr, flat, np.where(label[some] > 0, 1.0, -1.0), ratio)
        return ratio, w, bias

    def margin(model, i):
        x = model[0][features[i]]
        return model[1][features[i]] @ x / max(np.linalg.norm(x), 1e-12) + model[2]

    fold = np.arange(len(label)) % 4 == 0  # calibration rows, unseen by the machine whose margins they give
    part = train(np.flatnonzero(~fold)) if 0 < label[~fold].sum() < (~fold).sum() else None
    if part is None:
        a, b = 1.0, 0.0
    else:
        a, b = logistic(np.array([margin(part, i) for i in np.flatnonzero(fold)]), label[fold])
    ratio, w, bias = train(np.arange(len(label)))
    return np.stack([ratio, w]), bias, a, b


def score(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) and the columns `keep` of every row of docs (doc_id, text).

    labels (doc_id, quality 0 or 1) are learned only from rows whose crc32(doc_id as text) modulo 5 is not 0 (held_out
    is the others); of these, the max_train_rows with the smallest hash of doc_id are used, and fewer where they would have more
    than MAX_TRAIN_FEATURES features together. Labels that repeat, and rows that share a doc_id, count as often as they
    stand, within these bounds. Null texts and texts without
    words have no features: their score follows from the bias alone. Labels that are null or neither 0 nor 1 are ignored,
    as are those without a document; a null doc_id is not held out and not trained on. Without labels of both classes
    the score is the share of label 1. Rows that repeat are scored each.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held).select("doc_id", "quality")
    few = usable.orderBy(F.xxhash64("doc_id", "quality")).limit(max_train_rows)

    def extract(batches):
        for b in batches:
            for w in W.slices(b.column(1), W.FOLDED):
                row, f = features(w)
                cut = np.searchsorted(row, np.arange(w.rows + 1))
                f = f.astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.at, w.rows), pa.array([f[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()), b.column(2).slice(w.at, w.rows), pa.array(np.diff(cut))], names=["label", "features", "h", "n"])

    # at most max_train_rows labels are broadcast, and as many rows fitted in one task
    train = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("quality").cast("int").alias("label"), "text", F.xxhash64("doc_id").alias("h"))

    def fit_all(rows: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(rows.column("tie")), np.asarray(rows.column("label")), np.asarray(rows.column("h"))))
        label, column = np.asarray(rows.column("label"))[order], rows.column("features").combine_chunks()
        w, bias, a, b = fit(label, [np.frombuffer(column[i].as_buffer(), np.int32) for i in order.tolist()])
        return pa.table({"w": pa.array([np.asarray(w, np.float32).tobytes()], pa.binary()), "bias": [bias], "a": [a], "b": [b]})

    rows = train.mapInArrow(extract, "label int, features binary, h long, n long").withColumn("tie", F.xxhash64("features"))
    first = Window.orderBy("h", "label", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rows", F.count("*").over(first)).withColumn("total", F.sum("n").over(first))
    rows = rows.where((F.col("rows") <= max_train_rows) & (F.col("total") <= MAX_TRAIN_FEATURES)).select("label", "features", "h", "tie")
    found = rows.groupBy().applyInArrow(fit_all, "w binary, bias double, a double, b double").collect()
    if found:
        r = found[0]
        w = np.frombuffer(r["w"], np.float32).astype(float).reshape(-1, 1 << BITS)
        model = (w[0], w[-1], r["bias"], r["a"], r["b"])
    else:
        model = (np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0.0)
    shared = spark.sparkContext.broadcast(tuple(np.asarray(x, np.float32) if np.ndim(x) else x for x in model))

    def rate(batches):
        ratio, w, bias, a, b = shared.value
        pull, square = (w * ratio).astype(float), (ratio * ratio).astype(float)
        for batch in batches:
            got = []
            for s in W.slices(batch.column(0), W.FOLDED):
                row, f = features(s)
                dot, norm = np.bincount(row, pull[f], s.rows), np.sqrt(np.bincount(row, square[f], s.rows))
                margin = dot / np.maximum(norm, 1e-12) + bias
                got.append(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)) if got else pa.array([], pa.float64()), *batch.columns[skip:]], names=["score", *names])

    columns = docs.select("text", "doc_id", held.alias("held_out"), *(c for c in keep if c not in ("text", "doc_id", "held_out")))
    skip = 0 if "text" in keep else 1
    names = columns.columns[skip:]
    schema = "score double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[skip:])
    out = columns.mapInArrow(rate, schema)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *(c for c in keep if c not in ("doc_id", "held_out")))
