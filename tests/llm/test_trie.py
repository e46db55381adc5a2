"""The double-array trie of many phrases: complete, and made in time that grows as they do."""

import time

import numpy as np

from ledgerlens.llm.phrases import trie


def test_many_phrases_with_uneven_numbers_of_children():
    """Placing nodes one base at a time from the first free place took 106 s for these phrases."""
    rng = np.random.default_rng(1)
    n = 150_000
    w = (rng.zipf(1.3, size=(4 * n, 5)) - 1) % 8_000
    w[np.arange(5)[None, :] >= rng.integers(2, 6, size=4 * n)[:, None]] = -1
    w = np.unique(w, axis=0)
    w = w[np.sort(rng.permutation(len(w))[:n])]
    began = time.time()
    t = trie(w)
    assert time.time() - began < 20
    text, length, got = np.c_[w, np.full(len(w), -1)].ravel(), (w >= 0).sum(1), np.full(len(w), -1)
    for depth, (at, state) in enumerate(t.walk(text, 5)):
        whole = (at % 6 == 0) & (length[at // 6] == depth + 1)
        got[at[whole] // 6] = t.phrase[state[whole]]
    assert (got == np.arange(len(w))).all()
    assert len(t.check) < 4 * len(w)
