"""Phrase collocations: exact counts of frequent phrases by double-array tries, scored by their weakest cut.

Texts are read once. A task turns them into rows of codes, one for each word in order and -1 between pieces, and gives out
for each language the words that its codes stand for, with their counts, dealt into buckets of words. Where a bucket meets, frequent words get
global ids, and each task gets back one packed row of its codes for them; ids take the place of codes; infrequent words become breaks, since no frequent phrase holds them.

Candidates are Apriori-safe. A pair of frequent words is one if it occurs often enough; a longer phrase if all its pairs are
candidates and it occurs often enough. "Often enough" is decided by sums of what each batch saw, cut at the threshold, which
is enough to tell and small to send; a batch is about JOINED words of a task, as a phrase that returns within it travels once. Candidates, sorted, are cut into shards of SHARD phrases; the trie of a shard (at
most `longest` nodes a phrase) is broadcast as a double array and all positions of a batch walk it together, level by level,
counting the states that accept. Counts are summed over batches and shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import INDEX, PACKED, bucket_count, discard, key_bucket, read, rows_of, small_batches, squeeze, stored, unsqueeze
from .ranking import ranked
from .wordhash import mix

SHARD = 1 << 19  # phrases in one trie
WORDS = 1 << 17  # words in one row of codes, about: bounds what a task holds of a text column
JOINED = 1 << 20  # words of a task whose pairs and phrases are summed before they travel
PER_BUCKET, BUCKETS = 1 << 16, 64  # documents for each bucket of words, and the fewest buckets
BLOCK = 1 << 14  # phrases whose counts travel as one row
_BREAK, _BLANK = 1, 2
#: Bytes that end a piece and bytes that end a word.
_KIND = np.zeros(256, np.uint8)
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = _BREAK
_KIND[[*b" \t"]] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, first): the lower-cased words of all texts in order, as binary, and which of them begin a piece."""
    texts = texts.fill_null("") if texts.null_count else texts
    off = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < len(data)]  # a text begins a word and a piece
    begins[cut] = inside[cut]
    start = np.flatnonzero(begins)
    breaks = np.cumsum(kind == _BREAK)[start] + np.searchsorted(off, start, "right") if len(start) else np.zeros(0, int)
    kept = _LOWER[data[inside]]
    ends = np.r_[np.cumsum(inside)[start] - 1, len(kept)].astype(np.int64) if len(start) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    first = np.ones(len(start), bool)
    first[1:] = breaks[1:] != breaks[:-1]
    return words, first


def packed(x: np.ndarray) -> bytes:
    """Integers from -1 on, with their bytes transposed: compression shrinks them to the bytes that differ."""
    return np.ascontiguousarray((np.asarray(x, np.int32) + 1).view(np.uint8).reshape(-1, 4).T).tobytes()


def ints(raw) -> np.ndarray:
    """What `packed` made of integers."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel() - 1


CODED = "part int, lang string, bucket int, codes binary, words array<string>, counts array<long>"


def _coded(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """CODED rows of batches (lang, text): codes of about WORDS words each, and at the end for each language a row of words for each bucket, with their codes."""
    part = TaskContext.get().partitionId()
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    known: dict[str, dict[bytes, int]] = {}
    counts: dict[str, np.ndarray] = {}
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("bucket", pa.int32()), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def row(lang: str) -> pa.RecordBatch:
        words, first = words_of(pa.concat_arrays(held.pop(lang)))
        size.pop(lang)
        here, code_of = pc.dictionary_encode(words), known.setdefault(lang, {})
        code = np.array([code_of.setdefault(x, len(code_of)) for x in here.dictionary.to_pylist()], np.int32)
        n = np.zeros(len(code_of), np.int64)
        n[: len(counts.get(lang, ()))] = counts.get(lang, ())
        place = np.asarray(here.indices)
        n[code] += np.bincount(place, minlength=len(code))
        counts[lang] = n
        codes = np.full(len(place) + int(first.sum()), -1, np.int32)
        codes[np.arange(len(place)) + np.cumsum(first)] = code[place]
        return pa.RecordBatch.from_pylist([{"part": part, "lang": lang, "codes": packed(codes)}], schema)

    for b in batches:
        lang = b.column("lang").dictionary_encode()
        index = np.asarray(lang.indices)
        for i, name in enumerate(lang.dictionary.to_pylist()):
            texts = b.column("text").take(pa.array(np.flatnonzero(index == i)))
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):  # whole texts, up to the bytes that a row still takes
                have, used = size.get(name, 0), ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, used + 6 * WORDS - have, "right")))
                held.setdefault(name, []).append(texts.slice(at, stop - at))
                size[name] = have + int(ends[stop - 1] - used)
                if size[name] >= 5 * WORDS:
                    yield row(name)
                at = stop
        while sum(size.values()) > 12 * WORDS:  # many languages
            yield row(max(size, key=size.get))
    for name in list(held):
        yield row(name)
    for name, code_of in known.items():
        if not code_of:
            continue
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in code_of), np.int64, len(code_of))
        order = np.argsort(bucket, kind="stable")
        words = pa.array(list(code_of), pa.large_binary()).take(pa.array(order)).cast(pa.large_string()).cast(pa.string())
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]), len(order)].astype(np.int32)
        codes = [packed(order[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (words, pa.array(counts[name][order]))]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(codes), pa.int32()), pa.array([name] * len(codes)), pa.array(bucket[order][cuts[:-1]], pa.int32()), pa.array(codes, pa.binary()), *lists], schema=schema)


MET = "part int, lang string, bucket int, n long, words array<string>, f array<long>, codes binary, at binary"


def _met(least: int):
    """MET rows of one bucket of a language: its frequent words with their counts and n, all its occurrences, and for each task the codes of these words and their places."""

    def meet(rows: pa.Table) -> pa.Table:
        words, count = (pa.concat_arrays(rows.column(c).chunks) for c in ("words", "counts"))
        size = pc.list_value_length(words).to_numpy()
        word = words.flatten().dictionary_encode()
        place = np.asarray(word.indices)
        f = np.zeros(len(word.dictionary), np.int64)
        np.add.at(f, place, np.asarray(count.flatten()))
        often = f >= least
        at, end = np.where(often, np.cumsum(often) - 1, -1)[place], np.cumsum(size)
        lang, bucket = rows.column("lang")[0].as_py(), rows.column("bucket")[0].as_py()
        out = [{"part": None, "lang": lang, "bucket": bucket, "n": int(f.sum()), "words": word.dictionary.filter(pa.array(often)).to_pylist(), "f": f[often].tolist()}]
        for part, raw, i, j in zip(rows.column("part").to_pylist(), rows.column("codes"), end - size, end):
            has = at[i:j] >= 0
            out.append({"part": part, "lang": lang, "bucket": bucket, "codes": packed(ints(raw.as_buffer())[has]), "at": packed(at[i:j][has])})
        types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.Table.from_pylist(out, pa.schema(list(zip(("part", "lang", "bucket", "n", "words", "f", "codes", "at"), types))))

    return meet


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, pair) of about JOINED words: rows (ids, ok) of a task behind one another, and where a pair of words starts that `ok` marks, or any if it is null.

    A row begins with a break, so no pair spans two.
    """
    held, pairs, size = [], [], 0
    for b in batches:
        for raw, ok in zip(b.column("ids"), b.column("ok")):
            x = ints(raw.as_buffer())
            if not len(x):
                continue
            pair = (x[:-1] >= 0) & (x[1:] >= 0) if not ok.is_valid else np.unpackbits(np.frombuffer(ok.as_buffer(), np.uint8), count=len(x) - 1).astype(bool)
            held.append(x), pairs.append(np.r_[pair, False])
            size += len(x)
            if size >= JOINED:
                yield np.concatenate(held), np.concatenate(pairs)[:-1]
                held, pairs, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(pairs)[:-1]


@dataclass
class Trie:
    """A double-array trie: the child of state s by symbol c is t = base[s] + c if check[t] = s. State 0 is the root."""

    symbols: np.ndarray  #: sorted ids; a symbol is a place among them, from 1
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray  #: what a state accepts, or -1

    def walk(self, ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, states) after 1, 2, ... `longest` words, all positions at once; those without a child are left behind."""
        place = np.searchsorted(self.symbols, ids)
        symbol = np.where(self.symbols[np.minimum(place, len(self.symbols) - 1)] == ids, place + 1, 0)
        at = np.flatnonzero(symbol)
        state = np.zeros(len(at), np.int64)
        for depth in range(longest):
            keep = at + depth < len(symbol)
            at, state = at[keep], state[keep]
            c = symbol[at + depth]
            target = self.base[state] + c
            ok = (c > 0) & (target >= 0) & (target < len(self.check))
            ok &= self.check[np.where(ok, target, 0)] == state
            at, state = at[ok], target[ok]
            yield at, state


def trie(phrases: np.ndarray) -> Trie:
    """The trie of phrases (rows of ids, -1 after the last): row i is what its state accepts."""
    symbols = np.unique(phrases[phrases >= 0])
    symbol = np.where(phrases >= 0, np.searchsorted(symbols, phrases) + 1, 0)
    # nodes of every depth: distinct prefixes. node: (parent's number, symbol); numbers follow the depth
    parent, by, node, total = [], [], np.zeros(len(symbol), np.int64), 1
    for depth in range(symbol.shape[1]):
        live = np.flatnonzero(symbol[:, depth])
        pair, inverse = np.unique(node[live] * (len(symbols) + 1) + symbol[live, depth], return_inverse=True)
        node[live] = total + inverse
        total += len(pair)
        parent.append(pair // (len(symbols) + 1)), by.append(pair % (len(symbols) + 1))
    parent, by = np.r_[-1, np.concatenate(parent)], np.r_[0, np.concatenate(by)]
    accepts = np.full(total, -1, np.int64)
    accepts[node] = np.arange(len(symbol))

    children = np.argsort(parent[1:], kind="stable") + 1
    degree = np.bincount(parent[1:], minlength=total)
    begin = np.r_[0, np.cumsum(degree)]
    room = len(symbols) + 2
    used, base = np.zeros(2 * (total + room), bool), np.zeros(total, np.int64)
    used[0] = True
    slot = np.zeros(total, np.int64)
    floor, lead, most = 1, 1, 0
    for s in np.argsort(-degree, kind="stable"):  # those with most children first, each at the next base without a clash
        if degree[s] < 2:
            break
        if 2 * degree[s] <= most or not most:  # nodes of half as many children may fit where larger ones did not; those of about as many go on where the last one was put
            most, lead = degree[s], floor
        kids = by[children[begin[s] : begin[s + 1]]]
        apart, wide = (kids - kids[0]).tolist(), 1 << (16 if degree[s] >= 64 else 12)
        while True:
            while lead + wide + room >= len(used):
                used = np.r_[used, np.zeros(len(used), bool)]
            clash = used[lead : lead + wide].copy()  # of all bases of a stretch at once
            for i, k in enumerate(apart):
                clash |= used[lead + k : lead + k + wide]
                if i % 16 == 15 and clash.all():
                    break
            at = int(clash.argmin())
            if not clash[at]:
                lead += at
                break
            lead += wide
        base[s] = lead - kids[0]
        used[base[s] + kids] = True
        slot[children[begin[s] : begin[s + 1]]] = base[s] + kids
        while used[floor : floor + 64].all() and floor < len(used):
            floor += 64
    single = np.flatnonzero(degree == 1)  # one child fits any free place
    kids = children[begin[single]]
    while (~used).sum() < len(single):
        used = np.r_[used, np.zeros(len(used), bool)]
    slot[kids] = np.flatnonzero(~used)[: len(single)]
    base[single] = slot[kids] - by[kids]
    size = int(slot.max()) + 1 if total > 1 else 1
    out_base, check, phrase = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    out_base[slot] = base
    phrase[slot] = accepts
    check[slot[1:]] = slot[parent[1:]]
    return Trie(symbols, out_base, check, phrase)


def _windows(valid: np.ndarray, k: int) -> np.ndarray:
    """Where k neighbours all are valid."""
    if len(valid) < k:
        return np.zeros(0, int)
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(valid, k).all(1))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each stands there."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
    return rows[cut], np.diff(np.r_[cut, len(rows)])


def _often(ids: DataFrame, lengths: tuple[int, ...], longest: int, least: int, buckets: int) -> DataFrame:
    """Phrases (w1, w2, ..., null after the last) of these lengths that occur `least` times, of the rows (ids, ok) of a table:
    ok marks the positions from which a pair is a candidate; null: any two words are.

    Each batch's sums travel by bucket, one packed row for each, with a column of words in each of `ids`.
    """
    names = [f"w{i + 1}" for i in range(longest)]

    def send(batches):
        for x, pair in _joined(batches):
            found = [(k, *_distinct(x[at[:, None] + np.arange(k)])) for k in lengths if len(at := _windows(pair, k - 1))]
            if not found:
                continue
            rows = np.concatenate([np.pad(r, ((0, 0), (0, longest - k)), constant_values=-1) for k, r, _ in found]).astype(np.int64)
            n = np.minimum(np.concatenate([n for _, _, n in found]), least)
            key = np.zeros(len(rows), np.uint64)
            for word in rows.T:
                key = mix(key ^ word.view(np.uint64))
            bucket = key_bucket(key, buckets)
            order = np.lexsort((*rows.T[::-1], bucket))
            bucket, rows, n = bucket[order], rows[order], n[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            runs = list(zip(cuts[:-1], cuts[1:]))
            words = [[squeeze(w[i:j]) for w in rows.T] for i, j in runs]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([squeeze(n[i:j]) for i, j in runs], pa.binary()), pa.array(words, pa.list_(pa.binary()))], names=["bucket", "n", "ids"])

    def meet(sent: pa.Table) -> pa.Table:
        n = np.concatenate([unsqueeze(x.as_buffer()) for x in sent.column("n")])
        rows = np.concatenate([np.stack([unsqueeze(w.as_buffer()) for w in x.values], 1) for x in sent.column("ids")])
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        cut = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
        rows = rows[cut][np.add.reduceat(n[order], cut) >= least].astype(np.int32)
        return pa.table({c: pa.array(w, pa.int32(), mask=w < 0) for c, w in zip(names, rows.T)})

    return ids.select("ids", "ok").mapInArrow(send, "bucket int, n binary, ids array<binary>").groupBy("bucket").applyInArrow(meet, ", ".join(f"{c} int" for c in names))


def _pairs(ids: DataFrame, least: int, buckets: int) -> DataFrame:
    """(w1, w2): the pairs of neighbouring ids that occur `least` times in a table of ids.

    Pairs are many and mostly rare, so each batch's sums travel by bucket as packed arrays, a few bytes a pair.
    """

    def send(batches):
        for x, ok in _joined(batches):
            x = x.astype(np.int64)
            key, n = np.unique(x[:-1][ok] << 32 | x[1:][ok], return_counts=True)
            if len(key):
                yield rows_of(INDEX, key_bucket(key.view(np.uint64), buckets), owner=key, value=np.minimum(n, least))

    def meet(rows: pa.Table) -> pa.Table:
        key, n = read(rows, INDEX, "owner", "value")
        key, at = np.unique(key, return_inverse=True)
        often = key[np.bincount(at, n, len(key)) >= least]
        return pa.table({"w1": pa.array((often >> 32).astype(np.int32)), "w2": pa.array((often & 0xFFFFFFFF).astype(np.int32))})

    return ids.select("ids", "ok").mapInArrow(send, PACKED).groupBy("bucket").applyInArrow(meet, "w1 int, w2 int")


def _shards(phrases: DataFrame, longest: int) -> Iterator[tuple[int, Trie]]:
    """(first, trie) of each shard of a ranked table of phrases; the trie's phrase i has the rank first + i."""
    names = [f"w{i + 1}" for i in range(longest)]
    total = phrases.count()
    for first in range(0, total, SHARD):
        part = phrases.where((F.col("rank") >= first) & (F.col("rank") < first + SHARD)).orderBy("rank").select(*names)  # SHARD rows
        yield first, trie(np.stack([part_column.fillna(-1).to_numpy(np.int64) for _, part_column in part.toPandas().items()], 1))


def _marked(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table of ids with `ok` set where a pair of `pairs` starts; one pass, and one written table, for each shard of pairs."""
    spark = ids.sparkSession
    for _, tree in _shards(pairs, 2):
        model = spark.sparkContext.broadcast(tree)

        def mark(batches, model=model):
            for b in batches:
                out = []
                for raw, ok in zip(b.column("ids"), b.column("ok")):
                    x = ints(raw.as_buffer())
                    valid = np.zeros(max(len(x) - 1, 0), bool)
                    if ok.is_valid:
                        valid |= np.unpackbits(np.frombuffer(ok.as_buffer(), np.uint8), count=len(valid)).astype(bool)
                    for depth, (at, state) in enumerate(model.value.walk(x, 2)):
                        if depth == 1:
                            valid[at[model.value.phrase[state] >= 0]] = True
                    out.append(np.packbits(valid).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("ids"), pa.array(out, pa.binary())], names=["ids", "ok"])

        last, ids = ids, stored(ids.select("ids", "ok").mapInArrow(mark, "ids binary, ok binary"))
        discard(last)
        model.destroy()
    return ids


def _count(model, longest: int):
    """A task's counts of the phrases of a broadcast trie, in blocks of BLOCK phrases."""

    def of(batches):
        tree = model.value
        n = np.zeros(len(tree.check), np.int64)
        for b in batches:
            for raw in b.column("ids"):
                for _, state in tree.walk(ints(raw.as_buffer()), longest):
                    n += np.bincount(state, minlength=len(n))
        accepts = tree.phrase >= 0
        out = np.zeros(int(tree.phrase.max(initial=-1)) + 1, np.int64)
        out[tree.phrase[accepts]] = n[accepts]
        blocks = range(-(-len(out) // BLOCK)) if out.any() else range(0)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([out[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in blocks], pa.binary())], names=["block", "n"])

    return of


def _add(rows: pa.Table) -> pa.Table:
    f = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("n"))
    at = int(rows.column("block")[0].as_py()) * BLOCK + np.arange(len(f))
    return pa.table({"at": pa.array(at[f > 0]), "f": pa.array(f[f > 0])})


def _counted(ids: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(rank, f): exact occurrences of ranked phrases, stored."""
    spark, out = ids.sparkSession, []
    for first, tree in _shards(phrases, longest):
        model = spark.sparkContext.broadcast(tree)
        sums = ids.select("ids").mapInArrow(_count(model, longest), "block int, n binary").groupBy("block").applyInArrow(_add, "at long, f long")
        out.append(stored(sums.select((F.col("at") + first).alias("rank"), "f")))
        model.destroy()
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "rank long, f long")


def counts(docs: DataFrame, least: int, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals), stored: (ids, f) of every phrase of 1 to `longest` words that occurs `least` times in its
    language, (id, lang, word) of frequent words, and (lang, n), all words of a language.

    Languages: null is `und`. Null texts have no words. Words are lower-cased in A-Z; phrases stay within pieces.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    many = bucket_count(docs.count(), PER_BUCKET, BUCKETS)
    coded = stored(texts.mapInArrow(lambda batches: _coded(batches, many), CODED))
    met = stored(coded.where("words is not null").groupBy("lang", "bucket").applyInArrow(_met(least), MET))
    of_bucket = met.where("words is not null").select("lang", "bucket", "n", "words", "f")  # a row for each bucket of a language
    totals = stored(of_bucket.groupBy("lang").agg(F.sum("n").alias("n")))
    before = F.coalesce(F.sum(F.size("words")).over(Window.orderBy("lang", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(stored(of_bucket.select("lang", "bucket", before.cast("int").alias("shift"))))
    words = of_bucket.join(shift, ["lang", "bucket"]).select("lang", "shift", F.posexplode(F.arrays_zip("words", "f")).alias("i", "w"))
    words = stored(words.select("lang", F.col("w.words").alias("word"), F.col("w.f").alias("f"), (F.col("shift") + F.col("i")).cast("int").alias("id")))

    known = met.where("words is null").join(shift, ["lang", "bucket"]).groupBy("part", "lang").agg(F.collect_list(F.struct("codes", "at", "shift")).alias("known"))
    plain = coded.where("words is null").select("part", "lang", "codes").join(known, ["part", "lang"]).select("codes", F.col("known.codes").alias("code"), F.col("known.at").alias("at"), F.col("known.shift").alias("shift"))

    def translate(batches):
        for b in batches:
            out = []
            for raw, codes, at, shift in zip(b.column("codes"), b.column("code"), b.column("at"), b.column("shift")):
                x = ints(raw.as_buffer())
                code = np.concatenate([ints(c.as_buffer()) for c in codes.values])
                id_ = np.concatenate([ints(a.as_buffer()) + s for a, s in zip(at.values, np.asarray(shift.values))])
                new = np.full(max(int(x.max(initial=0)), int(code.max(initial=0))) + 2, -1, np.int32)  # its last place is that of -1
                new[code] = id_
                x = new[x]
                x = x[np.r_[True, (x[1:] >= 0) | (x[:-1] >= 0)]] if len(x) else x  # one break is as good as many
                out.append(packed(x))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names=["ids", "ok"])

    ids = stored(plain.mapInArrow(translate, "ids binary, ok binary"))
    discard(coded, met)
    names = [f"w{i + 1}" for i in range(longest)]
    order = [F.col(c).asc_nulls_first() for c in names]
    buckets = bucket_count(totals.agg(F.sum("n")).first()[0] or 0, WORDS * 4)
    frequent = _pairs(ids, least, buckets).select("w1", "w2", *(F.lit(None).cast("int").alias(c) for c in names[2:]))
    pairs = ranked(frequent, *order)
    ids = _marked(ids, pairs)
    longer = _often(ids, tuple(range(3, longest + 1)), longest, least, buckets) if longest > 2 else pairs.limit(0)
    phrases = ranked(pairs.select(*names).unionByName(longer.select(*names)), *order)
    found = phrases.join(_counted(ids, phrases, longest), "rank").select(F.array_compact(F.array(*names)).alias("ids"), "f")
    found = stored(found.unionByName(words.select(F.array("id").alias("ids"), "f")))
    discard(pairs, phrases, ids)
    return found, words.select("id", "lang", "word"), totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, cover: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words by their weakest cut.

    a, l and r are the occurrences of the phrase and of the two parts of the cut with the least score, n the language's
    words; score is floor(1000 * a * n / (l * r)), in exact decimals of 38 digits; of equal scores the first cut counts. A phrase is left out if its
    words lie within a longer frequent phrase with at least `cover` percent of its occurrences. Order: score and a
    descending, then the phrase's bytes. No documents, or none with words, give no rows; repeated documents count each;
    other columns are not read.
    """
    found, words, totals = counts(docs, least, longest)
    size = F.size("ids")
    many = found.where(size > 1)
    cut = many.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"))
    cut = cut.join(found.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(found.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    lang = words.select(F.col("id").alias("first"), "lang")
    cut = cut.withColumn("first", F.col("ids")[0]).join(lang, "first").join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in "alrn"}
    cut = cut.withColumn("score", F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"]))
    best = cut.groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r", "n", "lang")).alias("m"))

    # what lies within a longer phrase: every shorter run of its words
    part = many.where(size > 2).select("f", "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    part = part.select("f", "ids", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("i")).select(F.slice("ids", F.col("i"), F.col("k")).alias("ids"), "f")
    part = part.groupBy("ids").agg(F.max("f").alias("longer"))
    kept = best.join(part, "ids", "left").where(F.coalesce(F.col("longer") * 100 < F.col("m.a") * cover, F.lit(True)))

    spelt = kept.select("ids", "m", F.posexplode("ids").alias("i", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    out = spelt.select("m.lang", F.array_join("w.word", " ").alias("phrase"), "m.a", "m.l", "m.r", "m.n", "m.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
