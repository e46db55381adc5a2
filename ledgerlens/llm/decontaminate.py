"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows, then an exact check.

Items are cut into windows of `k` words (an item of fewer words is one window). A window's tokens are its runs of SHINGLE
words. To contain a window whole a document must have every one of its tokens, so one is necessary and enough as its prefix:
the rarest, by counts over all documents. Documents send their occurrences of prefix tokens, each with the words around
it, and are joined with the windows on the token; a match must leave room for the whole window before and after it
(positions and lengths), and then all words of the window must agree. Both sides are shuffled, so neither has to fit anywhere.

Which tokens a document sends is decided by a Bloom filter of the windows' tokens, the only thing that is broadcast: at most
2^MOST_BITS bits (32 MB). It never drops a token; a benchmark too large for it makes documents send more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .packing import small_batches, stored

SHINGLE = 3
LEAST_BITS, MOST_BITS = 18, 28
PAGE = 32768  # bits of one bitmap of bitmap_construct_agg
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HIT = pa.struct([("token", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("words", pa.list_(pa.string()))])


class Bloom:
    """A set of 64-bit tokens that may answer yes for others."""

    def __init__(self, bits: int, pages: list[tuple[int, bytes]]):
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8)
        for bucket, page in pages:
            at = (bucket - 1) * (PAGE // 8)
            page = np.frombuffer(page, np.uint8)[: len(self.data) - at]
            self.data[at : at + len(page)] = page

    def has(self, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens), bool)
        for spot in spots(tokens, self.bits):
            out[out] = (self.data[(s := spot[out]) >> 3] >> (s & 7)) & 1
        return out


def spots(tokens: np.ndarray, bits: int) -> list[np.ndarray]:
    x, mask = W.mix(tokens), W.U((1 << bits) - 1)
    return [(x & mask).astype(np.int64), ((x >> W.U(32)) & mask).astype(np.int64)]


def bloom(tokens: DataFrame) -> Bloom:
    """The filter of tokens (token long), 16 bits for each and two of them set, as bitmaps that Spark aggregates."""
    n = tokens.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    def place(batches):
        for b in batches:
            for spot in spots(np.asarray(b.column(0)).view(W.U), bits):
                yield pa.RecordBatch.from_arrays([pa.array(spot + 1)], names=["spot"])

    spot = tokens.select("token").mapInArrow(place, "spot long")
    pages = spot.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("page"))
    return Bloom(bits, [tuple(r) for r in pages.collect()])  # 2^bits bits


def _words(w: W.Words, begin: int, stop: int) -> list[str]:
    return [w.data[w.start[i] : w.end[i]].tobytes().translate(LOWER).decode() for i in range(begin, stop)]


def windows(items: DataFrame, k: int) -> DataFrame:
    """(item_id, phrase, n, tokens array<long>) of every distinct window of items (item_id, text)."""

    def cut(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for w in W.slices(b.column(1), W.ALNUM):
                short = np.flatnonzero((w.counts > 0) & (w.counts < k))
                begin = np.concatenate([w.windows(k), w.first[short]])
                length = np.concatenate([np.full(len(begin) - len(short), k), w.counts[short]]).astype(np.int64)
                out: dict[str, list] = {c: [] for c in ("item_id", "phrase", "n", "tokens")}
                for i, n in zip(begin.tolist(), length.tolist()):
                    size = min(SHINGLE, n)
                    out["item_id"].append(ids[w.at + w.row[i]])
                    out["phrase"].append(" ".join(_words(w, i, i + n)))
                    out["n"].append(n)
                    out["tokens"].append(w.span_hash(np.arange(i, i + n - size + 1), size).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out["item_id"], pa.int64()), pa.array(out["phrase"], pa.string()), pa.array(out["n"], pa.int32()), pa.array(out["tokens"], pa.list_(pa.int64()))], names=list(out))

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, phrase string, n int, tokens array<long>").dropDuplicates(["item_id", "phrase"])


def _tokens(w: W.Words, sizes: list[int], filter: Bloom):
    """(size, word index, token) of the runs of each size that pass the filter."""
    for size in sizes:
        i = w.windows(size)
        token = w.span_hash(i, size)
        ok = filter.has(token)
        yield size, i[ok], token[ok]


def contaminated(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row of docs (doc_id, text), against items (item_id, text).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became lower case. A window is k consecutive words of an
    item, or all words of a shorter item. n_hit counts the document's words inside any occurrence of a window, items
    lists the items with such windows, spans the runs of hit words. Null and empty texts have no words; items with null
    id or text are left out; items that share an id are one. Every row is answered by its own text: rows that repeat
    each, those that share a doc_id or have none too. Extra columns are ignored. An empty benchmark hits nothing. Tokens
    are told apart by 64-bit hashes, windows by their words; rows by 128 bits of a hash of id and text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    both = [F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull()]
    docs = docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", "text", F.xxhash64(F.lit(1), *both).alias("a"), F.xxhash64(F.lit(2), *both).alias("b"))
    every = stored(windows(items.where("item_id is not null and text is not null"), k))
    sizes = sorted(r[0] for r in every.select(F.least("n", F.lit(SHINGLE)).alias("s")).distinct().collect())  # SHINGLE at most
    tokens = every.select("item_id", "phrase", "n", F.posexplode("tokens").alias("offset", "token"))

    # how often each token of a window occurs in all documents
    some = spark.sparkContext.broadcast(bloom(tokens.select("token").distinct()))

    def count(batches):
        for b in batches:
            found = [t for w in W.slices(b.column(0), W.ALNUM) for _, _, t in _tokens(w, sizes, some.value)]
            token, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, W.U), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "c"])

    counts = docs.select("text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    rarest = F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "offset", "token")).alias("m")
    prefix = tokens.join(counts, "token", "left").groupBy("item_id", "phrase", "n").agg(rarest).where("m.c > 0").select("item_id", "phrase", "n", "m.offset", "m.token")
    prefix = stored(prefix)
    wanted = spark.sparkContext.broadcast(bloom(prefix.select("token").distinct()))

    def find(batches):
        for b in batches:
            for w in W.slices(b.column(1), W.ALNUM):
                hits: list = [[] for _ in range(w.rows)]
                for size, at, token in _tokens(w, sizes, wanted.value):
                    row = w.row[at]
                    low, high = np.maximum(w.first[row], at - (k - size)), np.minimum(w.first[row + 1], at + k)
                    for i, r, t, x, y in zip(at.tolist(), row.tolist(), token.view(np.int64).tolist(), low.tolist(), high.tolist()):
                        hits[r].append({"token": t, "at": i - int(w.first[r]), "before": i - x, "words": _words(w, x, y)})
                ids = [b.column(c).slice(w.at, w.rows) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(w.counts, pa.int64()), pa.array(hits, pa.list_(HIT))], names=["doc_id", "a", "b", "n_words", "hits"])

    found = stored(docs.mapInArrow(find, "doc_id long, a long, b long, n_words long, hits array<struct<token:long,at:long,before:int,words:array<string>>>"))
    sent = found.where(F.size("hits") > 0).select("a", "b", F.explode("hits").alias("h")).select("a", "b", "h.token", "h.at", "h.before", "h.words")
    room = (F.col("before") >= F.col("offset")) & (F.size("words") - F.col("before") >= F.col("n") - F.col("offset"))
    match = sent.join(prefix, "token").where(room).where(F.array_join(F.slice("words", F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("phrase"))
    match = stored(match.select("a", "b", "item_id", (F.col("at") - F.col("offset")).alias("begin"), "n").distinct())

    # runs of hit words: a window begins a new run where nothing before it reaches it
    earlier = Window.partitionBy("a", "b").orderBy("begin", "n").rowsBetween(Window.unboundedPreceding, -1)
    runs = match.select("a", "b", "begin", "n").distinct().withColumn("reach", F.max(F.col("begin") + F.col("n")).over(earlier))
    fresh = F.coalesce(F.col("begin") > F.col("reach"), F.lit(True)).cast("int")
    runs = runs.withColumn("run", F.sum(fresh).over(Window.partitionBy("a", "b").orderBy("begin", "n")))
    runs = runs.groupBy("a", "b", "run").agg(F.min("begin").cast("int").alias("start"), F.max(F.col("begin") + F.col("n")).alias("stop"))
    span = F.struct("start", (F.col("stop") - F.col("start")).cast("int").alias("length"))
    runs = runs.groupBy("a", "b").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))
    who = match.groupBy("a", "b").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = found.drop("hits").join(runs.join(who, ["a", "b"]), ["a", "b"], "left")
    none = F.array()
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none.cast("array<long>")).alias("items"), F.coalesce("spans", none.cast("array<struct<start:int,length:int>>")).alias("spans"))


def digest(hits: DataFrame) -> DataFrame:
    """n_items, items_sha256 (of the ids, sorted as strings, comma-joined) and contaminated for `contaminated` rows."""
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
