"""Every registered query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import datetime
import math

import duckdb
import pytest

from ledgerlens import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.7g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return v


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    cur = duck.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-4)) for x, y in zip(a, b)), (a, b)


def one(rs):
    (r,) = rs
    return r


#: What a result that SQL can't express has to fulfil.
CHECKED = {
    "train_entry": lambda rs: {r.part for r in rs} == {"val", "test"} and all(0 <= r.auc <= 1 and 0 <= r.precision <= 1 and r.n_top == 13 and r.n1 + r.n0 == 135 for r in rs),
    "train_entry_regression": lambda rs: -1 <= one(rs).spearman <= 1 and 0 <= one(rs).sign_auc <= 1,
    "train_quantile": lambda rs: {(r.head, r.quantile) for r in rs} == {(h, q) for h in ("hold", "result") for q in (0.25, 0.75)} and all(abs(r.coverage - r.quantile) <= 0.12 for r in rs if r.head == "result"),
    "train_entry_dataset": lambda rs: {(r.variant, r.part) for r in rs} == {(v, p) for v in ("full", "early") for p in ("val", "test")} and all(r.n1 + r.n0 == 30 and r.n_top == 3 and 0 <= r.auc <= 1 for r in rs),
    "train_value_dataset": lambda rs: {r.part for r in rs} == {"val", "test"} and all(r.n == 30 and -1 <= r.spearman <= 1 and 0 <= r.sign_auc <= 1 for r in rs),
    "train_timing_dataset": lambda rs: {r.label for r in rs} == {0, 1, 2} and sum(r.n for r in rs) == 45 and sum(r.n for r in rs if r.label == r.prediction) > 22,
    "train_hazard_lives": lambda rs: one(rs).n == 150 and 1 <= one(rs).lives <= 10 and one(rs).degenerate == (one(rs).lives < 5) and 5 <= one(rs).shortest <= one(rs).longest <= 50,
    "axis_bootstrap": lambda rs: len({(r.axis, r.value) for r in rs}) == len(rs) == 7 and all(r.lo <= r.hi for r in rs),
    "axis_verdicts": lambda rs: len(rs) == 7 and all(r.lo <= r.by_trades <= r.hi and r.level == (0.99 if r.axis == "a" else 0.95) for r in rs) and all(sum(r.verdict in ("best", "trades_best") for r in rs if r.axis == x) <= 1 for x in "ab"),
    "leak_importance": lambda rs: max(rs, key=lambda r: r.importance).feature == "forward_return" and {r.feature for r in rs if r.leak} == {"forward_return"} and len(rs) == 5,
    "train_timing": lambda rs: {r.label for r in rs} <= {0, 1, 2} and sum(r.n for r in rs) == 135,
    "train_hazard": lambda rs: all(0 <= r.rate <= 1 and 0 < r.mean_proba < 1 for r in rs) and len({r.degenerate for r in rs}) == 1,
    "platt": lambda rs: sum(r.n for r in rs) == 135 and all(r.brier <= 1 for r in rs),
    "shuffled_labels": lambda rs: {r.kind for r in rs} == {"real", "shuffled"} and {r.kind: r.auc for r in rs}["real"] > {r.kind: abs(r.auc - 0.5) + 0.5 for r in rs}["shuffled"] - 0.1,
    "adversarial": lambda rs: abs(one(rs).auc - 0.5) < 0.15,
    "rolling_walk_forward": lambda rs: [r.fold for r in sorted(rs, key=lambda r: r.fold)] == [1, 2, 3, 4, 5] and all(0 <= r.auc <= 1 for r in rs),
    "feature_stability": lambda rs: {r.state for r in rs} <= {"dead", "active", "unstable"} and {r.feature: r.state for r in rs}["score"] == "active" and len(rs) == 6,
    "bootstrap_ci": lambda rs: {r.metric for r in rs} == {"base_rate", "auc", "precision"} and all(r.lo <= r["mean"] <= r.hi for r in rs),
    "forward_hold": lambda rs: len({(r.entity_id, r.i) for r in rs}) == len(rs) > 500 and max(r.i for r in rs) > 20 and {r.reason for r in rs} >= {"hard_stop", "timeout"} and all(r.hold > 0 for r in rs),
    "random_sample": lambda rs: len({r.entity_id for r in rs}) == len(rs) == 200,
}


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_fulfils(spark, name):
    assert CHECKED[name](plans.QUERIES[name](spark, SF).collect())


@pytest.mark.parametrize("name", sorted({*plans.QUERIES} - {*plans.SQL} - {*CHECKED}))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
