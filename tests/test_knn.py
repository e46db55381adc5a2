"""Nearest neighbours with metric pruning against all pairs."""

import numpy as np
import pytest

from ledgerlens.operators import knn as K

SCHEMA = "vec_id long, embedding array<double>, label int, cell string"


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows])
    v = (v - v.mean(0)) / np.where(v.std(0) > 0, v.std(0), 1.0)
    d = np.round(np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2)), 9)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, d[a])) if ids[j] != i][:k] for a, i in enumerate(ids)}


def rows_of(n, clusters, spread, seed=3, dims=8):
    r = np.random.default_rng(seed)
    c = r.normal(size=(clusters, dims)) * 10
    return [(int(i), [float(x) for x in c[i % clusters] + r.normal(size=dims) * spread], int(i % 3), "x") for i in range(n)]


@pytest.mark.parametrize("clusters,spread", [(20, 0.1), (1, 5.0)])
def test_equals_all_pairs(spark, clusters, spread):
    rows = rows_of(600, clusters, spread)
    best, probes = K.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", "label", 4, 20)
    got = {}
    for r in sorted(best.collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.near)
    assert got == brute(rows, 4)
    blocks = K._homes(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 20)[0].select("cell", "ring", "sub").distinct().count()
    share = probes.count() / (len(rows) * blocks)
    assert blocks >= 30 and (share < 0.25 if clusters > 1 else share < 1)


def test_equal_rows_and_odd_ones(spark):
    """A hot group of equal vectors is cut into blocks; ties go by id; a null vector takes no part; a constant column is harmless."""
    rows = [(i, [1.0, 2.0, 7.0], i % 2, "x") for i in range(60)] + [(100 + i, [float(i), -float(i), 7.0], 0, "x") for i in range(30)]
    df = spark.createDataFrame([*rows, (999, None, 1, "x")], SCHEMA)
    best, _ = K.nearest(df, "vec_id", "embedding", "label", 3, 10)
    got = {}
    for r in sorted(best.collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append(r.near)
    assert got == brute(rows, 3)
    noise = {r.vec_id: r.noise for r in K.knn_label_noise(df, "vec_id", "embedding", "label", 3, 10).collect()}
    label = {i: y for i, _, y, _ in rows}
    assert noise == pytest.approx({i: np.mean([label[j] != label[i] for j in js]) for i, js in brute(rows, 3).items()})


def test_few_and_none(spark):
    rows = [(1, [0.0, 1.0], 0, "x"), (2, [1.0, 1.0], 1, "x")]
    assert {(r.vec_id, r.noise) for r in K.knn_label_noise(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 5).collect()} == {(1, 1.0), (2, 1.0)}
    assert K.knn_label_noise(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", "label", 5).count() == 0


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    """Where nothing can be left out a row goes to a bounded number of blocks, and the result stays exact, ties by id."""
    import numpy as np

    from ledgerlens.operators import knn as K

    monkeypatch.setattr(K, "BLOCK", 8)
    monkeypatch.setattr(K, "CELLS", 3000, raising=False)
    r = np.random.default_rng(3)
    v = r.integers(0, 3, (1200, 12)).astype(float)  # many equal distances
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, v array<double>, label int").repartition(4)
    best, probes = K.nearest(df, "id", "v", "label", 4)
    assert probes.count() <= 1200 * 3 * 32
    z = (v - v.mean(0)) / v.std(0)
    d = np.round(np.sqrt(np.maximum((z * z).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * z @ z.T, 0)), 9)
    np.fill_diagonal(d, np.inf)
    got = {(x.id, x.place): x.near for x in best.collect()}
    assert len(got) == 4800 and all(abs(d[i, got[i, p + 1]] - d[i, j]) < 1e-6 for i in range(1200) for p, j in enumerate(np.argsort(d[i], kind="stable")[:4]))
