"""Quantile leaves and permutation importance on planted data."""

import random

import pytest

from ledgerlens.operators import stats as S


@pytest.fixture(scope="module")
def planted(spark):
    """`wide` sets the spread of y; `leak` is the label with a little noise, `copy` repeats pure noise."""
    r = random.Random(5)
    rows = []
    for i in range(6000):
        wide, level, noise = r.random(), r.random(), r.random()
        label = int(r.random() < 0.2 + 0.6 * level)
        rows.append((i, wide, level, noise, noise, label + r.gauss(0, 0.2), label, level * 10 + r.gauss(0, 0.5 + 6 * wide) ** 3))
    return spark.createDataFrame(rows, "id long, wide double, level double, noise double, copy double, leak double, label int, y double").cache()


def test_leaf_quantiles(planted):
    d = S.assembled(planted, ["wide", "level"])
    qs = (0.1, 0.25, 0.5, 0.75, 0.9)
    out = S.leaf_quantiles(d.where("id < 4000"), d.where("id >= 4000"), "id", "y", qs).cache()
    for r in S.coverage(out, "y", qs).collect():
        assert r.n == 2000 and abs(r.coverage - r.quantile) <= 0.05, r
    for narrow in ("wide < 0.3", "wide > 0.7"):  # the trees follow the level first and the spread less
        for r in S.coverage(out.where(narrow), "y", qs).collect():
            assert abs(r.coverage - r.quantile) <= 0.15, (narrow, r)
    assert all(list(r.q) == sorted(r.q) for r in out.select("q").collect())


def test_permutation_importance(planted):
    names = ["level", "noise", "copy", "leak"]
    d = S.assembled(S.balanced(planted, "label"), names)
    m = S.train_classifier(d.where("id < 4000"), "label", "gbt", maxIter=5, maxDepth=3)
    test = d.where("id >= 4000")
    out = S.permutation_importance(m, test, names, "label", "id", 1)
    got = {r.feature: r.importance for r in out.collect()}
    assert set(got) == set(names) and got["leak"] > 0.2 and abs(got["noise"]) < 0.02 and abs(got["copy"]) < 0.02
    checked = S.leak_check(out, ["leak", "copy"], 1).collect()
    assert [(r.feature, r.leak) for r in checked] == [("leak", True)]
    # each column is dealt anew by itself: without the leak the level is what counts
    d = S.assembled(S.balanced(planted, "label"), names[:3])
    m = S.train_classifier(d.where("id < 4000"), "label", "logistic")
    got = {r.feature: r.importance for r in S.permutation_importance(m, d.where("id >= 4000"), names[:3], "label", "id", 1).collect()}
    assert got["level"] > 0.15 > 0.02 > abs(got["copy"])
