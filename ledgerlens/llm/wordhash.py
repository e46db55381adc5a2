"""Words, word windows and shingle sets of Arrow string columns, with numpy over whole batches.

A text is read as UTF-8 bytes. Words are maximal runs of word bytes; both alphabets used here are cut at ASCII bytes
only, so cutting bytes equals cutting characters. Every word gets a 64-bit hash, every run of k words a 64-bit hash
that also depends on k. Nulls count as texts without words. Arrays are cut into slices of about a quarter of a megabyte of text, so
memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 18
_BYTE_STEP = 0x9E3779B97F4A7C13  # 3 modulo 8: byte and word positions stay distinguishable modulo 2^64
_WORD_STEPS = (0xC2B2AE3D27D4EB4B, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Alphabet:
    """Which bytes make words, and the value of each byte; `lower` gives A-Z the values of a-z."""

    def __init__(self, separators: list[tuple[int, int]], lower: bool):
        code = np.arange(256)
        if lower:
            code = np.where((code >= 65) & (code <= 90), code + 32, code)
        self.lower = lower
        self.word = np.ones(256, bool)
        for a, b in separators:
            self.word[a : b + 1] = False
        if lower:  # a letter is a word byte if its lower-case form is one
            self.word = self.word[code]
        self.value = mix(code.astype(U) + U(0x51))


#: `[^\x20\x09-\x0D]+`, unchanged or with A-Z in lower case.
PLAIN = Alphabet([(0x20, 0x20), (0x09, 0x0D)], lower=False)
FOLDED = Alphabet([(0x20, 0x20), (0x09, 0x0D)], lower=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became lower case.
ALNUM = Alphabet([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], lower=True)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step^i and step^-i modulo 2^64 for i in 0..n-1."""
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for x in (step, pow(step, -1, 1 << 64)):
            p = np.full(size, x, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        have = (both[0], both[1])
        if size <= 4 * SLICE_BYTES:
            _powers[step] = have
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """The words of a slice of texts."""

    rows: int  #: texts in the slice
    at: int  #: index of its first text in the array
    row: np.ndarray  #: text of each word, within the slice
    first: np.ndarray  #: index of the first word of each text, and the number of words at the end
    hash: np.ndarray
    start: np.ndarray  #: byte offsets within `data`
    end: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  #: byte offsets of the texts within `data`, and its length
    _sums: dict[int, np.ndarray]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def pos(self) -> np.ndarray:
        """Position of each word within its text."""
        return np.arange(len(self.row)) - self.first[self.row]

    def span_hash(self, begin: np.ndarray, length: np.ndarray | int, seed: int = 0) -> np.ndarray:
        """Hash of the `length` words from each index `begin`; seeds 0 and 1 are independent."""
        step = _WORD_STEPS[seed]
        p, q = powers(step, len(self.hash) + 1)
        if seed not in self._sums:
            s = np.zeros(len(self.hash) + 1, U)
            value = self.hash if seed == 0 else mix(self.hash ^ U(0xA5A5A5A5A5A5A5A5))
            np.cumsum(value * p[:-1], dtype=U, out=s[1:])
            self._sums[seed] = s
        s = self._sums[seed]
        raw = (s[begin + length] - s[begin]) * q[begin]
        return mix(raw + np.asarray(length).astype(U) * U(0xD1B54A32D192ED03))

    def windows(self, k: int) -> np.ndarray:
        """Indices of the words at which a run of k words within one text starts."""
        i = np.arange(max(0, len(self.hash) - k + 1))
        return i[self.row[i] == self.row[i + k - 1]] if len(i) else i


def slices(column: pa.Array | pa.ChunkedArray, alphabet: Alphabet) -> Iterator[Words]:
    """The words of every text, slice by slice, in order."""
    for chunk, at in _chunks(column):
        wide = pa.types.is_large_string(chunk.type)
        _, offsets, data = chunk.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
            j = min(j, len(chunk), i + 60_000)
            yield _words(raw[off[i] : off[j]], off[i : j + 1] - off[i], at + i, alphabet)
            i = j


def _chunks(column):
    at = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            if chunk.null_count:
                chunk = chunk.fill_null("")
            yield chunk, at
        at += len(chunk)


def _words(data: np.ndarray, off: np.ndarray, at: int, alphabet: Alphabet) -> Words:
    n, rows = len(data), len(off) - 1
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = alphabet.word[data]
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cut = off[(off > 0) & (off < n)]  # a word never goes on into the next text
    begins[cut] = inside[cut + 1]
    ends[cut] = inside[cut]
    start, end = np.flatnonzero(begins[:n]), np.flatnonzero(ends)
    p, q = powers(_BYTE_STEP, n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(alphabet.value[data] * p[:-1], dtype=U, out=sums[1:])
    h = mix((sums[end] - sums[start]) * q[start])
    row = np.searchsorted(off, start, "right") - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    return Words(rows, at, row, first, h, start, end, data, off, {})


def by_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs in that order, and for each pair the index of one of its occurrences. Rows < 65536."""
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    r, x = row[order], h[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return r[keep], x[keep], order[keep]


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles; a text of 1 to k-1 words has its whole sequence as one."""
    i = w.windows(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    begin = w.first[short]
    row = np.concatenate([w.row[i], short])
    h = np.concatenate([w.span_hash(i, k), w.span_hash(begin, w.counts[short])])
    r, x, _ = by_row(row, h)
    return r, x


def covered(n: int, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, begin, 1)
    np.add.at(d, begin + length, -1)
    return np.cumsum(d[:-1]) > 0
