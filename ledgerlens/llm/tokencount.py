"""Edit-aware token counts: per document a segment tree over its pre-tokens; edits re-encode only what they touch.

A tokenizer of byte pairs first cuts a text into pre-tokens by a regular expression and then encodes each for itself,
so a document's count is the sum over its pre-tokens. The tree's leaves are runs of whole pre-tokens, cut where a word
surely starts, and its inner nodes hold sums of characters and tokens. A leaf is taken apart into single pre-tokens when an edit
first touches it. An edit finds its leaf by position, cuts again from a few characters before the edit (matching looks no
further ahead than that) until it meets an old boundary behind the edit, and updates the sums on the way to the root.

Trees are kept as a table, a row for each document (TREE). `build_trees` makes it, `edit_trees` joins it with a table of edits
and returns it changed; only edited leaves are encoded, everything else is taken over as it was stored.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import small_batches

BLOCK = 512  # characters of a leaf when a tree is built, about
SURE = re.compile(r"(?<=\S) (?=[^\W\d_])")  # a pre-token starts at such a space whatever is around
CONTEXT = 4  # characters behind a pre-token that its match may have looked at: `'ve`, `\s+(?!\S)`
#: Fixed value: the pattern by which the byte-level vocabularies cut texts into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: chars and tokens are the tree's sums in heap order (the root at 1, the leaves in the last half), cuts the lengths of the pre-tokens of
#: leaves that were taken apart; n_tokens counts the text as it was built, n_edits and n_reencoded what happened since.
TREE = "doc_id long, text string, chars array<int>, tokens array<int>, cuts array<array<int>>, n_tokens long, n_edits int, n_reencoded long"
EDITS = "doc_id long, seq int, pos int, del int, ins string"


class Counter:
    """Tokens of a pre-token, remembered for the short ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 200_000):
        import regex
        import tiktoken

        self.encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.remember = remember

    def one(self, x: str) -> int:
        n = self.known.get(x)
        if n is None:
            n = len(self.encode(x))
            if len(self.known) < self.remember and len(x) < 40:
                self.known[x] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        get = self.known.get
        out = [get(x) for x in pieces]
        return [self.one(x) if n is None else n for x, n in zip(pieces, out)] if None in out else out


class Tree:
    """Leaves of (pre-tokens, counts) under a binary tree of (characters, tokens)."""

    def __init__(self, blocks: list, sums: list[tuple[int, int]], counter: Counter):
        self.counter, self.blocks, self.sums = counter, blocks, sums  # a block is a text, or its pre-tokens once it was taken apart
        self.width = len(sums) // 2
        self.reencoded = 0

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        blocks, i = [], 0
        while i < len(text):
            m = SURE.search(text, i + BLOCK)
            j = m.start() if m else len(text)
            blocks.append(text[i:j])
            i = j
        blocks = blocks or [""]
        width = 1 << (len(blocks) - 1).bit_length()
        tree = cls(blocks, [(0, 0)] * (2 * width), counter)
        for i, b in enumerate(blocks):
            tree.sums[width + i] = (len(b), len(counter.encode(b)))
        for i in range(width - 1, 0, -1):
            tree._sum(i)
        return tree

    @classmethod
    def restored(cls, text: str, chars: list[int], tokens: list[int], cuts: list | None, counter: Counter) -> Tree:
        """The tree that `row` gave; nothing is encoded."""
        blocks, at, width = [], 0, len(chars) // 2
        n = len(cuts) if cuts is not None else width
        for i in range(n):
            stop = at + chars[width + i]
            if cuts is not None and cuts[i] is not None:
                ends = [at]
                for x in cuts[i]:
                    ends.append(ends[-1] + x)
                blocks.append([text[p:q] for p, q in zip(ends[:-1], ends[1:])])
            else:
                blocks.append(text[at:stop])
            at = stop
        return cls(blocks, list(zip(chars, tokens)), counter)

    def row(self) -> tuple:
        """(text, chars, tokens, cuts)."""
        cuts = None
        if any(isinstance(b, list) for b in self.blocks):
            cuts = [[len(x) for x in b] if isinstance(b, list) else None for b in self.blocks]
        return self.text(), [c for c, _ in self.sums], [t for _, t in self.sums], cuts

    def pieces(self, b: int) -> list[str]:
        if isinstance(self.blocks[b], str):
            self.blocks[b] = self.counter.cut.findall(self.blocks[b])
        return self.blocks[b]

    def _sum(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1])

    @property
    def chars(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def text(self) -> str:
        return "".join("".join(b) for b in self.blocks)

    def _find(self, pos: int) -> tuple[int, int]:
        """(block, its first character) of the block that holds the character at pos, or else the last one."""
        i, before = 1, 0
        while i < self.width:
            left = self.sums[2 * i][0]
            if pos < before + left:
                i = 2 * i
            else:
                i, before = 2 * i + 1, before + left
        i -= self.width
        if i >= len(self.blocks):
            i = len(self.blocks) - 1
            before = self.chars - self.sums[self.width + i][0]
        return i, before

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replace `delete` characters at pos by `insert`; both are cut to what there is."""
        pos = min(max(pos, 0), self.chars)
        delete = min(max(delete, 0), self.chars - pos)
        if not delete and not insert:
            return
        b, at = self._find(max(0, pos - CONTEXT))
        pieces, j = self.pieces(b), 0
        while j < len(pieces) and at + len(pieces[j]) + CONTEXT <= pos:  # not affected
            at += len(pieces[j])
            j += 1
        if j == 0 and b and at > 0 and at + CONTEXT > pos:  # the last pre-token of the block before may be
            while b and not (j and at + CONTEXT <= pos):
                if j == 0:
                    b -= 1
                    pieces = self.pieces(b)
                    j = len(pieces)
                    continue
                j -= 1
                at -= len(pieces[j])
        start = (b, j)
        # old pre-tokens from here on, as far as needed, and the boundaries they end at, measured in the new text
        shift, old, end = len(insert) - delete, [], at
        block, k = start
        tail: list[str] = []
        done = None
        new: list[str] = []
        while done is None:
            # take in old pre-tokens until there is enough behind the edit
            more = 0
            while more < 8 and block < len(self.blocks):
                if k >= len(self.pieces(block)):
                    block, k = block + 1, 0
                    continue
                x = self.pieces(block)[k]
                tail.append(x)
                end += len(x)
                old.append((end, block, k + 1))
                k += 1
                more += end > pos + delete
            whole = more < 8
            joined = "".join(tail)
            changed = joined[: pos - at] + insert + joined[pos - at + delete :]
            ends = {e + shift: (bb, kk) for e, bb, kk in old if e >= pos + delete}
            new, here = [], at
            limit = at + len(changed)
            for m in self.counter.cut.finditer(changed):
                if here >= pos + len(insert) and here in ends and new:
                    done = ends[here]
                    break
                if not whole and m.end() + at + CONTEXT > limit:
                    break  # the end of what was taken in is not the end of the text
                new.append(m.group())
                here = at + m.end()
            else:
                if whole:
                    done = (len(self.blocks) - 1, len(self.pieces(len(self.blocks) - 1)))
            if done is None and not whole and here >= pos + len(insert) and here in ends and new:
                done = ends[here]
        self._replace(start, done, new)

    def _replace(self, start: tuple[int, int], stop: tuple[int, int], new: list[str]) -> None:
        self.reencoded += len(new)
        (b, j), (c, k) = start, stop
        for i in range(b, c + 1):
            pieces, n = self.pieces(i), self.sums[self.width + i][1]
            gone = slice(j if i == b else 0, k if i == c else len(pieces))
            put = new if i == b else []
            n += sum(self.counter.counts(put)) - sum(self.counter.counts(pieces[gone]))
            pieces[gone] = put
            self.sums[self.width + i] = (sum(map(len, pieces)), n)
        lo, hi = (self.width + b) >> 1, (self.width + c) >> 1
        while lo:
            for i in range(lo, hi + 1):
                self._sum(i)
            lo, hi = lo >> 1, hi >> 1


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("cuts", pa.list_(pa.list_(pa.int32()))), ("n_tokens", pa.int64()), ("n_edits", pa.int32()), ("n_reencoded", pa.int64())])


def _counter(spark, vocabulary: str, pattern: str):
    """What makes a Counter in a task. vocabulary is a file on the driver, of bounded size, whose bytes are broadcast."""
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return lambda: Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}, pattern)


def build_trees(docs: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """TREE of every row of docs (doc_id, text).

    Null and empty texts have a tree without tokens, and an empty text. Rows that repeat have a tree each, null doc_ids too.
    Extra columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    make = _counter(docs.sparkSession, vocabulary, pattern)

    def of(batches):
        counter = make()
        for b in batches:
            trees = [Tree.of(t.as_py() or "", counter) for t in b.column(1)]
            text, chars, tokens, cuts = zip(*(t.row() for t in trees)) if trees else ([],) * 4
            n = [t.tokens for t in trees]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip((b.column(0), text, chars, tokens, cuts, n, [0] * len(n), [0] * len(n)), _ARROW)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, TREE)


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """TREE after the edits (EDITS) of each doc_id, applied in the order of seq to every row that has it.

    Each edit replaces `del` characters at `pos` of the text as it then is by `ins`; positions and lengths beyond the text
    are cut to it, nulls count as 0 and as nothing. Edits that repeat a doc_id and seq are one, the first by position,
    length and text; those of a null or unknown doc_id do nothing. Trees without edits stay as they are.
    """
    one = edits.where("doc_id is not null").groupBy("doc_id", "seq").agg(F.min(F.struct("pos", "del", "ins")).alias("e"))
    todo = one.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"]).alias("todo"))
    return edit_in_place(trees.join(todo, "doc_id", "left"), "todo", vocabulary, pattern)


def edit_in_place(trees: DataFrame, todo: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """TREE after the edits that each row brings along: the column `todo`, an array of (pos, del, ins), applied in order.

    Nothing is joined or shuffled. A null array, or a null entry, is no edit.
    """
    small_batches(trees.sparkSession)
    make = _counter(trees.sparkSession, vocabulary, pattern)
    names = [f.name for f in _ARROW]

    def of(batches):
        counter = make()
        for b in batches:
            out = []
            for r in b.to_pylist():
                some = [e for e in r["todo"] or [] if e is not None]
                if some:
                    tree = Tree.restored(r["text"], r["chars"], r["tokens"], r["cuts"], counter)
                    for e in some:
                        tree.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                    r["text"], r["chars"], r["tokens"], r["cuts"] = tree.row()
                    r["n_edits"] += len(some)
                    r["n_reencoded"] += tree.reencoded
                out.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in zip(names, _ARROW)], schema=_ARROW)

    return trees.select(*names, F.col(todo).alias("todo")).mapInArrow(of, TREE)


def tree_counts(trees: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_reencoded): the root's tokens are the text's."""
    return trees.select("doc_id", "n_tokens", "n_edits", F.get("tokens", F.lit(1)).cast("long").alias("n_tokens_edited"), "n_reencoded")


def sample_edits(text, doc_id):
    """Three edits that follow from a row alone: an insertion, a deletion and a replacement, at hashed positions."""
    n = F.coalesce(F.length(text), F.lit(0))
    spot = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1).cast("int")
    edit = lambda pos, cut, ins: F.struct(pos.alias("pos"), F.lit(cut).alias("del"), ins.alias("ins"))
    return [
        edit(spot(1), 0, F.concat(F.lit(" revised "), F.coalesce(doc_id.cast("string"), F.lit("")))),
        edit(spot(2), 11, F.lit("")),
        edit(spot(3), 5, F.coalesce(F.substring(text, 1, 9), F.lit(""))),
    ]
