"""Queries V: training, validation and statistics on positions of the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.actors import _shared
from ..operators.windows import chrono_parts
from ..sources.tables import kept, ledger_tokens, stream_tokens, stream_trades, table
from ..streaming.live import folder
from .base import query
from .store import POSITIONS_SQL, positions

FEATURES = ["entry_buyer_number", "score", "hold_seconds"]
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
DAY = 86400.0
MID = 1704067200.0 + 15 * 86400.0


def labelled(spark, sf_dir):
    p = positions(spark, sf_dir).where("status = 'closed'")
    return p.withColumn("label", (F.col("pnl_pct") + F.col("score") / 4 > 10).cast("int"))


def _parts(df, label="label", features=FEATURES, time="entry_time", keep=()):
    """Rows with a vector of features and balanced weights, by time: 70 % train, 15 % validation, 15 % test.

    Written once, as models and reports read them many times: id, label, weight, features and the columns of `keep`.
    """
    d = S.assembled(S.balanced(df.select(*dict.fromkeys(("id", label, time, *features, *keep))), label), features)
    s = _shared(chrono_parts(d.select(*dict.fromkeys(("id", label, time, "weight", "features", *keep))), time, SHARES, ("id",)))
    return tuple(s.where(F.col("split") == name) for name in SHARES)


def _report(model, rows, name):
    """AUC, precision among the top 10 % and base rate of a model on rows."""
    p = _shared(S.probabilities(model, rows, ["id", "label"]))
    return S.auc(p, "proba", "label").crossJoin(S.top_precision(p, "proba", "label", "id")).withColumn("part", F.lit(name))  # a row each


@query()
def train_entry(spark, sf_dir):
    """A boosted classifier, chosen on nothing but its training part: how it does on validation and test."""
    train, val, test = _parts(labelled(spark, sf_dir))
    m = S.train_classifier(train, "label", "gbt", maxIter=5, maxDepth=3)
    return _report(m, val, "val").unionByName(_report(m, test, "test"))


@query()
def train_entry_regression(spark, sf_dir):
    """The clipped result as a number: rank correlation with the result, and AUC of its sign, on the test part."""
    train, _, test = _parts(labelled(spark, sf_dir), keep=("pnl_pct",))
    m = S.train_regressor(train.withColumn("y", F.greatest(F.least("pnl_pct", F.lit(300.0)), F.lit(-100.0))), "y", maxIter=5, maxDepth=3)
    p = _shared(m.transform(test).select("id", "pnl_pct", "prediction").withColumn("won", (F.col("pnl_pct") > 0).cast("int")))
    return S.spearman(p, "prediction", "pnl_pct").crossJoin(S.auc(p, "prediction", "won").select(F.col("auc").alias("sign_auc")))  # a row each


def _entry_rows(spark, sf_dir, early=False, shared=None):
    """The dataset of entries, written once: its plan is long, and training reads it many times."""
    from ..operators.features import FEATURE_ORDER, FEATURE_ORDER_EARLY
    from .exits import EARLY_SPAN, dataset
    from .metrics import FULL

    order, sf_dir = FEATURE_ORDER_EARLY if early else FEATURE_ORDER, kept(spark, sf_dir)
    d = dataset(spark, sf_dir, EARLY_SPAN if early else FULL, order, shared).join(ledger_tokens(spark, sf_dir).select("entity_id", "created_at"), "entity_id")
    return _shared(d.withColumnRenamed("entity_id", "id")), order


@query()
def train_entry_dataset(spark, sf_dir):
    """The entry model on its own vector and label, as known at the end of the window and at the first age: validation and test."""
    from .exits import dataset_parts

    out, sf_dir = None, kept(spark, sf_dir)
    shared = dataset_parts(spark, sf_dir)
    for early in (False, True):
        d, order = _entry_rows(spark, sf_dir, early, shared)
        train, val, test = _parts(d, features=order, time="created_at")
        m = S.train_classifier(train, "label", "gbt", maxIter=5, maxDepth=3)
        r = _report(m, val, "val").unionByName(_report(m, test, "test")).withColumn("variant", F.lit("early" if early else "full"))
        out = r if out is None else out.unionByName(r)
    return out


@query()
def train_value_dataset(spark, sf_dir):
    """The result of entering, clipped to [-100, 300], from the same vector: rank correlation, and AUC of its sign, on validation and test."""
    d, order = _entry_rows(spark, sf_dir)
    train, val, test = _parts(d, features=order, time="created_at", keep=("realized",))
    m, out = S.train_regressor(train.withColumn("y", F.greatest(F.least("realized", F.lit(300.0)), F.lit(-100.0))), "y", maxIter=5, maxDepth=3), None
    for name, rows in (("val", val), ("test", test)):
        p = _shared(m.transform(rows).select("realized", "prediction", "label"))
        r = S.spearman(p, "prediction", "realized").crossJoin(S.auc(p, "prediction", "label").select(F.col("auc").alias("sign_auc"))).withColumn("part", F.lit(name))  # a row each
        out = r if out is None else out.unionByName(r)
    return out


@query()
def train_timing_dataset(spark, sf_dir):
    """When to enter: three classes from the replay at each age, told from what is seen by then; the test part by label and prediction."""
    from . import exits

    seen = exits.snaps(spark, sf_dir).join(stream_tokens(spark, sf_dir).select("entity_id", "created_at"), "entity_id")
    d = exits.timing_labels(spark, sf_dir).select("entity_id", "age", "label").join(seen, ["entity_id", "age"])
    kind = F.array_position(F.array(*map(F.lit, ("SKIP", "WAIT", "ENTER"))), F.col("label")) - 1
    d = _shared(d.withColumns({"label": kind.cast("int"), "at": F.col("created_at") + F.col("age"), "id": F.concat_ws("/", "entity_id", "age")}))
    train, _, test = _parts(d, features=["age", "n_events", "n_buys", "buy_volume", "unique_buyers", "price", "reserve"], time="at")
    m = S.train_classifier(train, "label", "forest", numTrees=8, maxDepth=4)
    return m.transform(test).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def train_quantile(spark, sf_dir):
    """Quantile leaves for the hold and for the result: the share of test rows at or below each."""
    train, _, test = _parts(labelled(spark, sf_dir), keep=("hold_seconds", "pnl_pct"))
    qs, out = (0.25, 0.75), None
    for head, y in (("hold", "hold_seconds"), ("result", "pnl_pct")):
        row = S.coverage(S.leaf_quantiles(train, test, "id", y, qs), y, qs).select(F.lit(head).alias("head"), "quantile", "n", "coverage")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"WITH {POSITIONS_SQL}, x AS (SELECT min(score) AS lo, max(score) AS hi FROM positions) SELECT least(floor((score - lo) / ((hi - lo) / 10)), 9)::BIGINT AS cell, count(*) AS n, quantile_cont(pnl_pct, 0.25) AS q25, quantile_cont(pnl_pct, 0.75) AS q75 FROM positions, x GROUP BY 1", rounded=("q25", "q75"))
def quantile_cells(spark, sf_dir):
    return S.cell_quantiles(positions(spark, sf_dir), "score", "pnl_pct", (0.25, 0.75))


@query()
def train_timing(spark, sf_dir):
    """Three classes (enter, wait, skip): the confusion table on the test part."""
    d = labelled(spark, sf_dir).withColumn("label", F.when(F.col("pnl_pct") > 20, 2).when(F.col("pnl_pct") > -20, 1).otherwise(0))
    train, _, test = _parts(d)
    m = S.train_classifier(train, "label", "forest", numTrees=8, maxDepth=4)
    return m.transform(test).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def train_hazard(spark, sf_dir):
    """Hazard per bucket of life on later positions; `degenerate` if the model tells nearly nothing apart."""
    from ..operators.exits import hazard_rows

    h = hazard_rows(positions(spark, sf_dir), 5.0, 50.0, -3.0, ("score", "entry_time")).withColumnRenamed("died", "label")
    d = S.assembled(S.balanced(h, "label"), ["bucket", "score"]).select("id", "bucket", "label", "weight", "features", "entry_time")
    a = _shared(chrono_parts(d, "entry_time", SHARES, ("id", "bucket")))
    m = S.train_classifier(a.where("split = 'train'"), "label", "logistic")
    r = _shared(S.probabilities(m, a.where("split = 'test'"), ["id", "bucket", "label"]))
    spread = r.agg(F.percentile("proba", F.lit(0.99)).alias("hi"), F.percentile("proba", F.lit(0.01)).alias("lo")).select((F.col("hi") - F.col("lo") < 0.01).alias("degenerate"))
    return r.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("label").alias("rate"), F.avg("proba").alias("mean_proba")).crossJoin(spread)  # a row


@query()
def train_hazard_lives(spark, sf_dir):
    """How long positions live, predicted bucket by bucket: of the test part the lives, how many differ, and their rank correlation with the holds.

    Under five different lives the model is degenerate: it tells positions apart by next to nothing.
    """
    from ..operators.exits import hazard_rows, survival_curve

    p = positions(spark, sf_dir).select("id", "config_id", "score", "entry_buyer_number", "proba", "entry_time", "hold_seconds", "status", "pnl_pct")
    names = ["bucket", "score", "entry_buyer_number", "proba"]
    parts = _shared(chrono_parts(p, "entry_time", SHARES, ("id",)))
    kept = ("hold_seconds", *names[1:])
    lived = hazard_rows(parts.where("split = 'train'"), 5.0, 50.0, -3.0, kept).withColumnRenamed("died", "label").select("id", "label", "hold_seconds", *names)
    ahead = parts.where("split = 'test'").select("id", *kept, F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bucket"))  # what a life is read from: every bucket up to the horizon
    both = S.assembled(S.balanced(lived, "label").withColumn("_test", F.lit(False)).unionByName(ahead.withColumn("_test", F.lit(True)), allowMissingColumns=True), names)
    both = _shared(both.select("id", "bucket", "hold_seconds", "label", "weight", "features", "_test"))
    m = S.train_classifier(both.where("not _test"), "label", "gbt", maxIter=5, maxDepth=3)
    lives = _shared(survival_curve(S.probabilities(m, both.where("_test"), ["id", "hold_seconds", "bucket"]).withColumnRenamed("proba", "h"), ["id", "hold_seconds"], 0.7, 5.0))
    n = lives.agg(F.count_distinct("predicted_life").alias("lives"), F.min("predicted_life").alias("shortest"), F.max("predicted_life").alias("longest"))
    return S.spearman(lives, "predicted_life", "hold_seconds").crossJoin(n).withColumn("degenerate", F.col("lives") < 5)  # a row each


@query(
    f"""WITH {POSITIONS_SQL}, th AS (SELECT t / 10 AS threshold, count(*) FILTER (proba >= t / 10) AS n, avg(pnl) FILTER (proba >= t / 10) AS ev, count(*) FILTER (proba < t / 10) AS nb, avg(pnl) FILTER (proba < t / 10) AS eb FROM positions, range(1, 10) r(t) WHERE {{0}} GROUP BY t),
m AS (SELECT arg_max(threshold, round(ev, 9) - threshold * 1e-12) AS threshold, max(ev) AS ev FROM th WHERE n >= 30), q AS (SELECT quantile_cont(proba, 0.8) AS hi, quantile_cont(proba, 0.2) AS lo FROM positions WHERE {{0}})
SELECT '{{1}}' AS part, CASE WHEN ev > 0 THEN threshold ELSE hi END AS ceiling, CASE WHEN ev > 0 THEN coalesce((SELECT max(th.threshold) FROM th WHERE nb >= 30 AND eb < 0 AND th.threshold < m.threshold), 0) ELSE lo END AS floor, CASE WHEN ev > 0 THEN 'search' ELSE 'quintiles' END AS source, CASE WHEN ev > 0 THEN ev END AS ev FROM m, q""".replace("{0}", "true").replace("{1}", "all")
    + " UNION ALL "
    + f"""SELECT * FROM (WITH {POSITIONS_SQL}, th AS (SELECT t / 10 AS threshold, count(*) AS n, avg(pnl) AS ev FROM positions, range(1, 10) r(t) WHERE pnl < 0 AND proba >= t / 10 GROUP BY t HAVING count(*) >= 30) SELECT 'losers' AS part, quantile_cont(proba, 0.8) AS ceiling, quantile_cont(proba, 0.2) AS floor, 'quintiles' AS source, NULL::DOUBLE AS ev FROM positions WHERE pnl < 0)""",
    rounded=("ceiling", "floor", "ev"),
)
def chosen_thresholds(spark, sf_dir):
    """Where to buy and to skip, for all positions and for those that only lost, which leave nothing to choose."""
    p = positions(spark, sf_dir)
    both = [S.chosen_thresholds(rows, "proba", "pnl", 30).withColumn("part", F.lit(name)) for name, rows in (("all", p), ("losers", p.where("pnl < 0")))]
    return both[0].unionByName(both[1])


@query(f"WITH {POSITIONS_SQL} SELECT t / 10 AS threshold, count(*) AS n, avg(pnl) AS ev, avg((pnl > 0)::INT) AS win_rate, count(*) >= 30 AS usable FROM positions, range(1, 10) r(t) WHERE proba >= t / 10 GROUP BY t", rounded=("ev", "win_rate"))
def threshold_search(spark, sf_dir):
    return S.threshold_search(positions(spark, sf_dir), "proba", "pnl", 30)


@query(f"WITH {POSITIONS_SQL} SELECT CASE WHEN proba >= 0.6 THEN 'BUY' WHEN proba < 0.2 THEN 'SKIP' ELSE 'RULES' END AS zone, count(*) AS n, avg((pnl > 0)::INT) AS win_rate, avg(pnl) AS mean_outcome FROM positions GROUP BY 1", rounded=("win_rate", "mean_outcome"))
def gated_eval(spark, sf_dir):
    return S.gated_eval(positions(spark, sf_dir), "proba", "pnl", 0.2, 0.6)


@query()
def platt(spark, sf_dir):
    """A logistic curve over a score, fitted on the validation part: Brier score and calibration by bin on the test part."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    _, val, test = _parts(labelled(spark, sf_dir), keep=("score",))
    a = VectorAssembler(inputCols=["score"], outputCol="x")
    m = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / max(1, val.count()), standardization=False).fit(a.transform(val))
    return S.calibration_bins(S.probabilities(m, a.transform(test), ["id", "label"]), "proba", "label")


_LABEL = f"{POSITIONS_SQL}, lb AS (SELECT *, (pnl_pct + score / 4 > 10)::INT AS label FROM positions WHERE status = 'closed')"


@query(f"WITH {_LABEL}, b AS (SELECT least(floor(proba * 10), 9)::BIGINT AS bin, count(*) AS n, avg(proba) AS mean_proba, avg(label) AS hit_rate, avg((proba - label) ** 2) AS brier FROM lb GROUP BY 1) SELECT *, hit_rate - mean_proba AS deviation, CASE WHEN n < 30 THEN 'few' WHEN abs(hit_rate - mean_proba) > 0.1 THEN 'off' ELSE 'ok' END AS verdict FROM b", rounded=("mean_proba", "hit_rate", "brier", "deviation"))
def calibration_bins(spark, sf_dir):
    return S.calibration_bins(labelled(spark, sf_dir), "proba", "label")


@query(
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY i),
v AS (SELECT vec_id, label, list((x - m) / sd ORDER BY i) AS z FROM e JOIN s USING (i) GROUP BY ALL), d AS (SELECT a.vec_id, a.label, b.vec_id AS o, b.label AS ol, list_distance(a.z, b.z) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS q FROM d) SELECT vec_id, label, avg((ol <> label)::INT) AS noise FROM r WHERE q <= 5 GROUP BY ALL""",
    rounded=("noise",),
)
def knn_label_noise(spark, sf_dir):
    return S.knn_label_noise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 5)


@query(f"WITH {_LABEL}, r AS (SELECT label, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2 AS rk FROM lb), g AS (SELECT sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM r) SELECT n1, n0, (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM g", rounded=("auc",))
def auc_rank(spark, sf_dir):
    return S.auc(labelled(spark, sf_dir), "proba", "label")


@query()
def bootstrap_ci(spark, sf_dir):
    """Intervals of base rate, AUC and precision among the top 10 % by score, from 500 draws."""
    return S.bootstrap_ci(labelled(spark, sf_dir), "id", "score", "label", 500, 7)


@query(f"WITH {POSITIONS_SQL}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY pnl_pct) + (count(*) OVER (PARTITION BY pnl_pct) - 1) / 2 AS b FROM positions) SELECT count(*) AS n, corr(a, b) AS spearman FROM r", rounded=("spearman",))
def spearman(spark, sf_dir):
    return S.spearman(positions(spark, sf_dir), "score", "pnl_pct")


_KS = " + ".join(f"{'2' if k % 2 else '-2'} * exp(-2 * {k * k} * x * x)" for k in range(1, 21))


@query(
    f"""WITH {POSITIONS_SQL}, c AS (SELECT pnl_pct AS v, count(*) FILTER (entry_time < {MID}) AS a, count(*) FILTER (entry_time >= {MID}) AS b FROM positions GROUP BY 1), t AS (SELECT sum(a) AS na, sum(b) AS nb FROM c),
d AS (SELECT max(abs(sa / na - sb / nb)) AS ks, any_value(sqrt(na * nb / (na + nb))) AS m FROM (SELECT sum(a) OVER w AS sa, sum(b) OVER w AS sb FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)), t) SELECT ks, least(greatest({_KS}, 0), 1) AS p_value FROM (SELECT ks, ks * m AS x FROM d)""",
    rounded=("ks", "p_value"),
)
def ks_two_sample(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("side", (F.col("entry_time") >= MID).cast("int"))
    return S.ks_two_sample(p, "pnl_pct", "side")


@query(f"WITH {_LABEL}, g AS (SELECT avg(label) FILTER (entry_time < {MID}) AS before, avg(label) FILTER (entry_time >= {MID}) AS after FROM lb) SELECT *, abs(after - before) / greatest(before, 1e-9) AS shift, abs(after - before) / greatest(before, 1e-9) > 0.5 AS drifted FROM g", rounded=("before", "after", "shift"))
def prior_drift(spark, sf_dir):
    return S.prior_drift(labelled(spark, sf_dir), "label", F.col("entry_time") >= MID)


@query(f"WITH {POSITIONS_SQL} SELECT count(*) AS n, sum(pnl) AS plain, sum(pnl - 0.002) AS realistic, avg((pnl > 0.002)::INT) AS win_rate FROM positions WHERE proba >= 0.5", rounded=("plain", "realistic", "win_rate"))
def economic_backtest(spark, sf_dir):
    return S.economic_backtest(positions(spark, sf_dir), "proba", "pnl", 0.5, 0.002)


_CANDIDATES = ["proba", *FEATURES]
_IMPORTANCE = "im AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, pnl_pct)) AS importance FROM positions" for c in _CANDIDATES) + ")"


@query(f"WITH {POSITIONS_SQL}, {_IMPORTANCE} SELECT feature, importance, feature IN ('proba') AS leak FROM im ORDER BY round(importance, 9) DESC, feature LIMIT 3", rounded=("importance",))
def leak_check(spark, sf_dir):
    g = positions(spark, sf_dir).agg(*(F.abs(F.corr(c, "pnl_pct")).alias(c) for c in _CANDIDATES))
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in _CANDIDATES))
    return S.leak_check(g.select(F.explode(cells).alias("x")).select("x.*"), ["proba"], 3)


@query()
def leak_importance(spark, sf_dir):
    """Permutation importance of a model of the exit dataset, one of whose columns looks ahead: it has to be named among the most important ones."""
    from ..operators.exits import exit_samples
    from .exits import kept_entries

    names, leaks = ["i", "price", "peak", "buys_back", "forward_return"], ["forward_return"]
    e = kept_entries(spark, sf_dir)
    d = exit_samples(stream_trades(spark, sf_dir), e, DAY / 2, DAY, DAY, 2 * DAY, 50.0).join(e.select("entity_id", "entry_ts"), "entity_id")
    d = _shared(d.withColumn("t", F.col("entry_ts") + F.col("i") * DAY / 2).withColumn("id", F.col("entity_id") * 100_000 + F.col("i")))
    train, _, test = _parts(d, features=names, time="t")
    m = S.train_classifier(train, "label", "gbt", maxIter=5, maxDepth=4)
    return S.leak_check(S.permutation_importance(m, test, names, "label", "id", 3), leaks)


def _auc_of(train, test):
    m = S.train_classifier(train, "label", "logistic")
    return S.auc(_shared(S.probabilities(m, test, ["id", "label"])), "proba", "label").select("n1", "n0", "auc")


@query()
def shuffled_labels(spark, sf_dir):
    """A model of permuted labels should have no skill."""
    train, _, test = _parts(labelled(spark, sf_dir))
    shuffled = S.balanced(_shared(S.permuted(train.drop("weight"), "id", "label", 7)), "label")
    return _auc_of(train, test).withColumn("kind", F.lit("real")).unionByName(_auc_of(shuffled, test).withColumn("kind", F.lit("shuffled")))


@query()
def adversarial(spark, sf_dir):
    """Whether earlier and later rows can be told apart, by a model of one half of the rows on the other."""
    d = S.assembled(S.balanced(labelled(spark, sf_dir).withColumn("label", (F.col("entry_time") >= MID).cast("int")), "label"), FEATURES)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    return _auc_of(d.where(half == 0), d.where(half == 1))


@query()
def rolling_walk_forward(spark, sf_dir):
    """Five windows: trained on all folds before, tested on the next."""
    from ..operators.windows import time_folds

    d = S.assembled(S.balanced(labelled(spark, sf_dir), "label"), FEATURES)
    f = time_folds(d, "entry_time", 6, 0.0)
    out = None
    for k in range(1, 6):
        r = _auc_of(f.where(F.col("fold") < k), f.where(F.col("fold") == k)).withColumn("fold", F.lit(k))
        out = r if out is None else out.unionByName(r)
    return out


@query()
def feature_stability(spark, sf_dir):
    """Importance of features over five seeds of a model of all training rows: dead, active or unstable."""
    train, _, _ = _parts(labelled(spark, sf_dir))
    names, rows = [*FEATURES, *(f"{c}_null" for c in FEATURES)], []
    for seed in range(5):
        m = S.train_classifier(train, "label", "forest", seed=seed, numTrees=5, maxDepth=3)
        rows += [(n, float(x)) for n, x in zip(names, m.featureImportances.toArray())]
    g = spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.min("importance").alias("lo"), F.max("importance").alias("hi"))
    return g.withColumn("state", F.when(F.col("hi") < 0.01, "dead").when(F.col("lo") >= 0.01, "active").otherwise("unstable"))


@query(f"WITH {POSITIONS_SQL}, u AS (SELECT 'proba' AS model, proba AS p, pnl FROM positions UNION ALL SELECT 'score', score, pnl FROM positions) SELECT model, t / 10 AS threshold, count(*) AS n, avg((pnl > 0)::INT) AS win_rate, sum(pnl) AS total, avg(pnl) AS mean, median(pnl) AS median, quantile_cont(pnl, 0.9) AS p90 FROM u, (VALUES (3), (5), (7)) v(t) WHERE p >= t / 10 GROUP BY model, t", rounded=("win_rate", "total", "mean", "median", "p90"))
def model_compare(spark, sf_dir):
    return S.model_compare(positions(spark, sf_dir), ["proba", "score"], "pnl", [0.3, 0.5, 0.7])


@query(f"WITH {POSITIONS_SQL}, m AS (SELECT config_id AS model, CASE WHEN config_id = 'c0' THEN NULL ELSE avg((pnl > 0)::INT) + 0.1::DOUBLE END AS auc, quantile_cont(proba, 0.99) - quantile_cont(proba, 0.01) AS spread, avg(pnl) AS ev FROM positions GROUP BY config_id) SELECT *, CASE WHEN auc IS NULL OR spread IS NULL THEN 'unmeasured' WHEN auc < 0.55 OR spread < 0.05 THEN 'degenerate' WHEN ev < 0 THEN 'ev_warning' ELSE 'ok' END AS verdict FROM m", rounded=("auc", "spread", "ev"))
def skill_gate(spark, sf_dir):
    g = positions(spark, sf_dir).groupBy(F.col("config_id").alias("model")).agg((F.avg((F.col("pnl") > 0).cast("int")) + 0.1).alias("auc"), (F.percentile("proba", F.lit(0.99)) - F.percentile("proba", F.lit(0.01))).alias("spread"), F.avg("pnl").alias("ev"))
    return S.skill_gate(g.withColumn("auc", F.when(F.col("model") != "c0", F.col("auc"))))


@query(
    f"""WITH {_LABEL}, g AS (SELECT config_id, quantile_cont(score, 0.01) AS p1, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.99) AS p99, quantile_cont(CASE WHEN entry_time >= {MID} THEN score END, 0.5) AS recent_p50 FROM lb GROUP BY config_id),
r AS (SELECT config_id, label, rank() OVER (PARTITION BY config_id ORDER BY score) + (count(*) OVER (PARTITION BY config_id, score) - 1) / 2 AS rk FROM lb WHERE entry_time >= {MID}),
a AS (SELECT config_id, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS recent_auc FROM r GROUP BY config_id)
SELECT config_id, p1, p50, p99, recent_p50, recent_auc, p99 - p1 < 30 AS flat, coalesce(0.75::DOUBLE - recent_auc > 0.05::DOUBLE, false) AS auc_drop, coalesce(abs(recent_p50 - 50) > 3, false) AS p50_shift FROM g LEFT JOIN a USING (config_id)""",
    rounded=("p1", "p50", "p99", "recent_p50", "recent_auc"),
)
def model_health(spark, sf_dir):
    return S.model_health(labelled(spark, sf_dir), "score", "config_id", "label", F.col("entry_time") >= MID, 0.75, 50.0, flat=30.0, shift=3.0)


@query(f"WITH {POSITIONS_SQL} SELECT id, 'entry' AS model, entry_time AS scored_at, proba, abs(proba - 0.5) * 2 AS confidence FROM positions", rounded=("confidence",))
def shadow_log(spark, sf_dir):
    """Predictions appended to a log by day, in two runs, and read back."""
    where = folder(spark)
    p = positions(spark, sf_dir).select("id", F.lit("entry").alias("model"), F.col("entry_time").alias("scored_at"), "proba", (F.abs(F.col("proba") - 0.5) * 2).alias("confidence"))
    for later in (False, True):
        rows = p.where((F.col("scored_at") >= MID) == later).withColumn("day", F.date_format(F.timestamp_seconds("scored_at"), "yyyy-MM-dd"))
        rows.write.mode("append").partitionBy("day").parquet(where)
    return spark.read.parquet(where).drop("day")
