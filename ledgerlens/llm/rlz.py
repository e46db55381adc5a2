"""Substring dedup by relative Lempel-Ziv parsing against the corpus's own earlier documents.

The reference is every document with a smaller doc_id, indexed in blocks: hash buckets that each hold part of the
windows of all documents. Parsing a document looks its windows up in every block and goes through it once: a factor starts
at the first window that stands in a reference and takes in words as long as they go on there; factors have at least `k`
words. What they cover is what is removed. A factor may not go on although the next window stands in another reference: so
every window across the boundary of two factors was looked up too, and the next factor starts within the one before.

Indexing all windows would shuffle more than the corpus, so a first exchange finds anchors: of every k consecutive
words the run of ANCHOR words with the least hash. Equal windows have equal anchors, so only windows around an anchor
that occurs in two documents can repeat, and only these enter the second exchange. Both exchanges send each key for
one document per sender: later documents of the same sender are answered on the spot by its smallest one, so that a
passage all documents share stays small in every bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .packing import ARROW, INDEX, NOTE, PACKED, REPLY, bucket_count, bucket_of, key_bucket, owner_bucket, pass_on, read, rows_of, small_batches

ANCHOR = 5
SALTS = 16


def _anchors(w: W.Words, k: int) -> np.ndarray:
    """Word indices of the anchors of all windows of k words: the same words for the same window anywhere."""
    size = min(ANCHOR, k)
    begin = w.windows(k)
    if not len(begin):
        return begin
    h = w.span_hash(np.arange(len(w.hash) - size + 1), size)
    best, at = h[begin].copy(), begin.copy()
    for d in range(1, k - size + 1):
        x = h[begin + d]
        less = x < best
        best[less], at[less] = x[less], begin[less] + d
    return np.unique(at)


def _send(key, doc, pos, buckets: int, wide: bool):
    """INDEX rows with one document per key, and REPLY rows for what can be answered here: (doc, pos[, ref, at])."""
    order = np.lexsort((pos, doc, key))
    key, doc, pos = key[order], doc[order], pos[order]
    new = np.r_[True, key[1:] != key[:-1]]
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    later = doc != doc[start][group]
    own = ~later
    yield rows_of(INDEX, key_bucket(key[own], buckets), key=key[own], owner=doc[own], value=pos[own])
    if wide:
        hit, ref, at = later, doc[start][group][later], pos[start][group][later]
        if hit.any():
            yield rows_of(REPLY, owner_bucket(doc[hit], buckets), owner=doc[hit], value=pos[hit], ref=ref, at=at)
    else:
        hit = np.zeros(len(start), bool)
        hit[group[later]] = True
        hit = hit[group]
        if hit.any():
            yield rows_of(REPLY, owner_bucket(doc[hit], buckets), owner=doc[hit], value=pos[hit])


def _match(buckets: int, wide: bool):
    """Of a bucket's INDEX entries, those whose key occurs in two documents; what was answered before goes on."""

    def of(rows: pa.Table) -> pa.Table:
        key, doc, pos = read(rows, INDEX, "key", "owner", "value")
        out = [b for b in pass_on(rows).to_batches()]
        if len(key):
            order = np.lexsort((pos, doc, key))
            key, doc, pos = key[order], doc[order], pos[order]
            new = np.r_[True, key[1:] != key[:-1]]
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            later = doc != doc[start][group]
            if wide:
                hit, ref, at = later, doc[start][group], pos[start][group]
                if hit.any():
                    out.append(rows_of(REPLY, owner_bucket(doc[hit], buckets), owner=doc[hit], value=pos[hit], ref=ref[hit], at=at[hit]))
            else:
                two = np.zeros(len(start), bool)
                two[group[later]] = True
                hit = two[group]
                if hit.any():
                    out.append(rows_of(REPLY, owner_bucket(doc[hit], buckets), owner=doc[hit], value=pos[hit]))
        return pa.Table.from_batches(out, ARROW)

    return of


def _by_doc(ids: np.ndarray, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a slice in the order of their ids: (sorted ids, rows)."""
    mine = ids[w.at : w.at + w.rows]
    order = np.argsort(mine, kind="stable")
    return mine[order], order


#: Positions carry which of an id's texts they are of, above their own bits.
VARIANT = 40


class _Texts:
    """The rows of a bucket: ids, which of its id's texts each row holds, and the smaller document that it is an exact copy of."""

    def __init__(self, rows: pa.Table, copies: list[np.ndarray] | None = None):
        column = rows.column("doc_id")
        self.ids = np.asarray(column.fill_null(-1).combine_chunks() if column.null_count else column)
        self.variant, self.of = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), -1, np.int64)
        self.is_copy = np.zeros(len(self.ids), bool)
        if copies is None or not len(self.ids):
            return
        a, b = (np.asarray(rows.column(c)) for c in ("a", "b"))
        order = np.lexsort((b, a, self.ids))
        ids, a, b = self.ids[order], a[order], b[order]
        new_id = np.r_[True, ids[1:] != ids[:-1]]
        number = np.cumsum(new_id | np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.variant[order] = number - number[np.flatnonzero(new_id)][np.cumsum(new_id) - 1]
        known = {(d, x, y): r for d, r, x, y in zip(*(c.tolist() for c in copies))}
        if known:
            found = [known.get(k) for k in zip(ids.tolist(), a.tolist(), b.tolist())]
            some = [i for i, r in enumerate(found) if r is not None]
            self.is_copy[order[some]], self.of[order[some]] = True, [found[i] for i in some]

    def words(self, w: W.Words, doc: np.ndarray, pos: np.ndarray, any_text: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Word indices in a slice of (doc, pos), once for each row that holds that text (or, any_text, that id), and the entries they come from."""
        sorted_ids, rows = _by_doc(self.ids, w)
        lo, hi = np.searchsorted(sorted_ids, doc, "left"), np.searchsorted(sorted_ids, doc, "right")
        n = hi - lo
        entry = np.repeat(np.arange(len(doc)), n)
        row = rows[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        at, end = w.first[row] + (pos[entry] & ((1 << VARIANT) - 1)), w.first[row + 1]
        ok = at < end
        if not any_text:
            ok &= pos[entry] >> VARIANT == self.variant[w.at + row]
        return at[ok], entry[ok]


def repeated_spans(docs: DataFrame, k: int = 13, buckets: int | None = None) -> DataFrame:
    """Every row of docs (doc_id, text) with its duplicate spans.

    Returns doc_id, n_words, n_removed, kept_sha256, spans array<struct<start, length, ref_doc, ref_start>>. Words are
    `[^\\x20\\x09-\\x0D]+`. A window of k words repeats if the same words also start in a document with a smaller
    doc_id; the words of all repeating windows count as removed, and kept_sha256 is the SHA-256 of the others joined by
    one space. spans are the factors of the parse in order: runs of repeating windows that go on in the same reference
    document. An exact copy of an earlier document has no spans of its own: ref_doc is that document.
    Null and empty texts have no words (the digest of nothing). A null doc_id is before and after nothing: it keeps all
    its words. Rows that repeat are answered each; equal ids never repeat each other. Rows of one id may hold different
    texts: each is judged by its own windows. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = buckets or bucket_count(docs.count())
    known = docs.where("doc_id is not null")
    whole = (F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    texts = known.select("doc_id", "text", *whole, bucket_of(F.col("doc_id"), n).alias("bucket"))

    # exact copies are known from whole-text digests; they take no part in the exchanges beyond the first
    digests = known.where("text is not null").select("doc_id", *whole)
    first = digests.groupBy("a", "b").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last")).where("ref <> last")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a text may have very many copies
    digests = digests.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = digests.join(first, ["a", "b", "salt"]).where("doc_id <> ref").select("doc_id", "ref", "a", "b").distinct().withColumn("bucket", bucket_of(F.col("doc_id"), n))

    def note(batches):
        for b in batches:
            doc, ref, bucket, x, y = (np.asarray(b.column(i)) for i in range(5))
            yield rows_of(NOTE, bucket, owner=doc, value=ref, ref=x, at=y)

    copies = copies.select("doc_id", "ref", "bucket", "a", "b").mapInArrow(note, PACKED)

    def send_anchors(batches):
        for b in batches:
            ids, got = np.asarray(b.column(0)), []
            for w in W.slices(b.column(1), W.PLAIN):
                i = _anchors(w, k)
                if len(i):
                    got.append((w.span_hash(i, min(ANCHOR, k)), ids[w.at + w.row[i]], w.pos[i]))
            if got:
                yield from _send(*(np.concatenate(x) for x in zip(*got)), n, False)

    def send_windows(key, hits: pa.Table, rows: pa.Table) -> pa.Table:
        doc, pos = read(hits, REPLY, "owner", "value")
        held, got = _Texts(rows, read(hits, NOTE, "owner", "value", "ref", "at")), []
        for w in W.slices(rows.column("text"), W.PLAIN):
            anchor, _ = held.words(w, doc, pos, any_text=True)
            if not len(anchor) or len(w.hash) < k:
                continue
            near = W.covered(len(w.hash) + k, np.maximum(anchor + min(ANCHOR, k) - k, 0), anchor + 1 - np.maximum(anchor + min(ANCHOR, k) - k, 0))
            i = w.windows(k)
            i = i[near[i] & ~held.is_copy[w.at + w.row[i]]]
            if len(i):
                got.append((w.span_hash(i, k, seed=1), held.ids[w.at + w.row[i]], w.pos[i] + (held.variant[w.at + w.row[i]] << VARIANT)))
        return pa.Table.from_batches(list(_send(*(np.concatenate(x) for x in zip(*got)), n, True)) if got else [], ARROW)

    def parse(key, hits: pa.Table, rows: pa.Table) -> pa.Table:
        doc, pos, ref, at = read(hits, REPLY, "owner", "value", "ref", "at")
        return _parsed(rows, k, _Texts(rows, read(hits, NOTE, "owner", "value", "ref", "at")), doc, pos, ref, at)

    def untouched(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            rows = pa.Table.from_batches([b])
            yield from _parsed(rows, k, _Texts(rows), *[none] * 4).to_batches()

    anchors = known.mapInArrow(send_anchors, PACKED).groupBy("bucket").applyInArrow(_match(n, False), PACKED)
    hits = anchors.unionByName(copies).groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(send_windows, PACKED)
    hits = hits.groupBy("bucket").applyInArrow(_match(n, True), PACKED)
    out = hits.unionByName(copies).groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(parse, RESULT)
    return out.unionByName(docs.where("doc_id is null").mapInArrow(untouched, RESULT))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,length:long,ref_doc:long,ref_start:long>>"
_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "ref_doc", "ref_start")]))


def _parsed(rows: pa.Table, k: int, held: _Texts, doc, pos, ref, at) -> pa.Table:
    column, place = rows.column("doc_id"), (1 << VARIANT) - 1
    out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "spans")}
    for w in W.slices(rows.column("text"), W.PLAIN):
        word, entry = held.words(w, doc, pos) if len(doc) else (np.zeros(0, np.int64),) * 2
        o = np.lexsort((ref[entry], word)) if len(entry) else np.zeros(0, np.int64)
        word, entry = word[o], entry[o]
        if len(word):  # the same window may be answered twice; its smallest reference counts
            one = np.r_[True, word[1:] != word[:-1]]
            word, entry = word[one], entry[one]
        here = slice(w.at, w.at + w.rows)
        of, is_copy = held.of[here], held.is_copy[here] & (w.counts >= k)
        n, factors = w.counts, [[] for _ in range(w.rows)]
        row, start, length, rd, ra = _factors(w, k, word, ref[entry], at[entry])
        for i, *factor in zip(row.tolist(), start.tolist(), length.tolist(), rd.tolist(), (ra & place).tolist()):
            factors[i].append(dict(zip(("start", "length", "ref_doc", "ref_start"), factor)))
        for i in np.flatnonzero(is_copy).tolist():
            factors[i] = [{"start": 0, "length": int(n[i]), "ref_doc": int(of[i]), "ref_start": 0}]
        gone = W.covered(len(w.hash), w.first[row] + start, length) | is_copy[w.row]
        removed = np.bincount(w.row[gone], minlength=w.rows)
        out["n_words"].append(n), out["n_removed"].append(removed), out["spans"].extend(factors)
        out["kept_sha256"].extend(hashlib.sha256(t).hexdigest() for t in kept_texts(w, ~gone))
    whole = lambda c: np.concatenate(out[c]) if out[c] else np.zeros(0, np.int64)
    return pa.table({"doc_id": column, "n_words": pa.array(whole("n_words"), pa.int64()), "n_removed": pa.array(whole("n_removed"), pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "spans": pa.array(out["spans"], _SPANS)})


def _factors(w: W.Words, k: int, word: np.ndarray, ref: np.ndarray, at: np.ndarray):
    """(row, start, length, ref, ref start) of the factors that windows at `word` make, each as long as it goes on."""
    row = w.row[word]
    start = word - w.first[row]
    on = (word[1:] == word[:-1] + 1) & (ref[1:] == ref[:-1]) & (at[1:] == at[:-1] + 1) & (row[1:] == row[:-1])
    s = np.flatnonzero(np.r_[True, ~on]) if len(word) else np.zeros(0, np.int64)
    return row[s], start[s], np.diff(np.r_[s, len(word)]) + k - 1, ref[s], at[s]


def kept_texts(w: W.Words, keep: np.ndarray) -> list[memoryview]:
    """The kept words of each text, joined by one space, as bytes."""
    i = np.flatnonzero(keep)
    data, use = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
    np.add.at(use, w.start[i], 1)
    np.add.at(use, w.end[i], -1)
    use = np.cumsum(use[:-1], dtype=np.int8) > 0
    if len(i):
        followed = i[:-1][w.row[i[:-1]] == w.row[i[1:]]]
        data[w.end[followed]] = 0x20
        use[w.end[followed]] = True
    kept = memoryview(data[use].tobytes())
    total = np.concatenate([[0], np.cumsum(use)])
    edge = np.searchsorted(w.row, np.arange(w.rows + 1))
    begin = np.where(w.counts > 0, w.start[np.minimum(edge[:-1], max(len(w.start) - 1, 0))], 0) if len(w.start) else np.zeros(w.rows, int)
    finish = np.where(w.counts > 0, w.end[np.maximum(edge[1:] - 1, 0)], 0) if len(w.end) else np.zeros(w.rows, int)
    return [kept[a:b] for a, b in zip(total[begin].tolist(), total[finish].tolist())]
