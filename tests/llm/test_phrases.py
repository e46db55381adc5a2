"""Collocations against a plain re-computation: many trie shards, nulls, odd separators, ties, repeats, clashing columns, no rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import phrases


def pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, longest, cover, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    longer = Counter()
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    out = []
    for lang in {lang for lang, _ in f}:
        rank = []
        for (g, p), a in f.items():
            if g == lang and len(p) > 1 and not (longer[g, p] * 100 >= cover * a and longer[g, p]):
                score, _, left, right = min((1000 * a * n[g] // (f[g, p[:k]] * f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcDEéñ|-'\x01 ") for _ in range(r.randint(1, 4))) for _ in range(25)]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!", " ?"]
    text = lambda n: "".join(w + r.choice(seps) for w in r.choices(words, weights=range(1, 26), k=n))
    out = [(r.choice(["en", "fr", None, "und"]), text(r.randint(1, 60))) for _ in range(150)]
    out += [("en", "To be or not to be. To be or not to be")] * 6 + [("en", text(3000))]
    return out + [("en", None), (None, ""), ("de", " \t "), ("de", "...,"), ("xx", "one"), (None, None)]


@pytest.mark.parametrize("shard, top, cover", [(1 << 19, 2000, 100), (7, 2000, 100), (60, 12, 70)])
def test_collocations(spark, monkeypatch, shard, top, cover):
    monkeypatch.setattr(phrases, "SHARD", shard)
    docs = spark.createDataFrame([(g, t, 1, 2, "x") for g, t in rows()], "lang string, text string, id int, f int, word string").repartition(3)
    out = phrases.collocations(docs, 4, 5, cover, top)
    assert sorted(map(tuple, out.collect())) == brute(rows(), 4, 5, cover, top)


def test_large_products(spark):
    """Products beyond 64 bits stay exact."""
    big = [("a b",)] * 3
    docs = spark.createDataFrame(big, "text string").selectExpr("text", "'en' AS lang").repartition(2)
    assert [tuple(r) for r in phrases.collocations(docs, 2).collect()] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]
    q = spark.range(1).selectExpr("div(cast(1000 as decimal(4,0)) * cast(9000000000000007 as decimal(20,0)) * cast(9000000000000011 as decimal(20,0)), cast(9000000000000001 as decimal(20,0)) * cast(9000000000000013 as decimal(20,0))) AS x")
    assert q.first().x == 1000 * 9000000000000007 * 9000000000000011 // (9000000000000001 * 9000000000000013)


def test_no_rows(spark):
    for r in ([], [(None, None)], [("en", "a b c")]):
        assert phrases.collocations(spark.createDataFrame(r, "lang string, text string")).collect() == []


def test_words():
    texts = pa.array(["A b.c", None, "", "É\tx\n", "\ny z"])
    words, first = phrases.words_of(texts[1:])
    assert (words.cast(pa.large_string()).to_pylist(), first.tolist()) == (["É", "x", "y", "z"], [True, False, True, False])
    words, first = phrases.words_of(texts)
    assert (len(words), first.tolist()) == (7, [True, False, True, True, False, True, False])


def test_trie():
    r = np.random.default_rng(0)
    rows = {tuple(r.integers(0, 40, r.integers(1, 5)).tolist()) for _ in range(3000)}
    table = np.array([[*p, *[-1] * (4 - len(p))] for p in sorted(rows)])
    tree = phrases.trie(table)
    x = r.integers(-1, 45, 20000).astype(np.int32)
    n = Counter()
    for at, state in tree.walk(x, 4):
        n.update(tree.phrase[state][tree.phrase[state] >= 0].tolist())
    want = Counter(tuple(x[i : i + k].tolist()) for k in range(1, 5) for i in range(len(x) - k + 1))
    assert {tuple(table[i][table[i] >= 0].tolist()): c for i, c in n.items()} == {p: want[p] for p in rows if want[p]}


def test_ids_travel_packed(spark, monkeypatch):
    """Phrases that return within a task travel once, in packed rows; batches end anywhere, and no phrase spans two rows."""
    r = np.random.default_rng(5)
    runs = [np.r_[-1, r.integers(-1, 6, n)].astype(np.int32) for n in (0, 1, 7, 300, 900)]
    assert all((phrases.ints(phrases.packed(x)) == x).all() for x in runs)
    ids = spark.createDataFrame([(bytearray(phrases.packed(x)), None) for x in runs], "ids binary, ok binary").repartition(1)
    want = Counter(tuple(x[i : i + k].tolist()) for x in runs for k in (3, 4) for i in range(len(x) - k + 1) if (x[i : i + k] >= 0).all())
    for joined in (1, 1 << 20):
        monkeypatch.setattr(phrases, "JOINED", joined)
        got = phrases._often(ids, (3, 4), 4, 5, 3).collect()
        assert sorted(tuple(w for w in row if w is not None) for row in got) == sorted(p for p, n in want.items() if n >= 5)
