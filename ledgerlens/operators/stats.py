"""Model training with pyspark.ml, and the statistics that say whether a model can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .actors import _shared
from .knn import knn_label_noise as knn_label_noise
from .windows import average_rank, global_row_number, ranged


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """NULLs, and what is NaN or infinite, become the mean of their column, with an indicator beside it, in one vector."""
    from pyspark.ml.feature import VectorAssembler

    floats = [c for c in features if dict(df.dtypes)[c] in ("double", "float")]
    df = df.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in floats})  # NaN counts as larger than all
    means = df.agg(*(F.avg(c).alias(c) for c in features)).first()
    filled = df.withColumns({f"{c}_null": F.col(c).isNull().cast("double") for c in features}).fillna({c: float(means[c] or 0.0) for c in features})
    return VectorAssembler(inputCols=[*features, *(f"{c}_null" for c in features)], outputCol="features").transform(filled.withColumns({c: F.col(c).cast("double") for c in features}))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """A weight column that gives every class the same total."""
    n = df.groupBy(label).agg(F.count("*").alias("_c"))
    total, k = n.agg(F.sum("_c"), F.count("*")).first()
    return df.join(F.broadcast(n), label).withColumn("weight", F.lit(float(total or 1)) / (F.col("_c") * (k or 1))).drop("_c")  # a row per class


def train_classifier(df: DataFrame, label: str, kind: str = "gbt", seed: int = 7, **params):
    from pyspark.ml import classification as c

    make = {"gbt": c.GBTClassifier, "forest": c.RandomForestClassifier, "logistic": c.LogisticRegression}[kind]
    return make(labelCol=label, weightCol="weight", seed=seed, **params).fit(df) if kind != "logistic" else make(labelCol=label, weightCol="weight", **params).fit(df)


def train_regressor(df: DataFrame, label: str, **params):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol=label, seed=7, **params).fit(df)


def probabilities(model, df: DataFrame, keep: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("proba"))


def cell_quantiles(df: DataFrame, by: str, value: str, qs: tuple, cells: int = 10) -> DataFrame:
    """Conditional quantiles: the value's percentiles within equal-width cells of one feature."""
    lo, hi = df.agg(F.min(by), F.max(by)).first()
    width = (float(hi - lo) / cells) if lo is not None and hi > lo else 1.0
    d = df.withColumn("cell", F.least(F.floor((F.col(by) - F.lit(lo)) / width), F.lit(cells - 1)))
    return d.groupBy("cell").agg(F.count("*").alias("n"), *(F.percentile(value, F.lit(q)).alias(f"q{round(q * 100)}") for q in qs))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks; NULL if only one class occurs."""
    r = average_rank(df, score)
    g = r.agg(F.sum(F.when(F.col(label) == 1, F.col("avg_rank"))).alias("s"), F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    return g.select("n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.greatest("n0", F.lit(1)))).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    r = average_rank(df, a).withColumnRenamed("avg_rank", "_ra")
    return average_rank(r, b).agg(F.count("*").alias("n"), F.corr("_ra", "avg_rank").alias("spearman"))


def ks_two_sample(df: DataFrame, value: str, side: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic between side 0 and side 1 with its asymptotic p-value.

    Counts per distinct value first; cumulative shares over ranges of values, as for ranks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    n, na, nb = counts.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    c, r = ranged(counts, value, n)
    per = c.groupBy(r).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))  # a row for each range
    w = Window.orderBy(r).rowsBetween(Window.unboundedPreceding, 0)
    off = per.select(r, (F.sum("sa").over(w) - F.col("sa")).alias("oa"), (F.sum("sb").over(w) - F.col("sb")).alias("ob"))
    v = Window.partitionBy(r).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = c.join(off, r).select(F.abs((F.col("oa") + F.sum("a").over(v)) / F.lit(float(na or 1)) - (F.col("ob") + F.sum("b").over(v)) / F.lit(float(nb or 1))).alias("d"))
    m = F.sqrt(F.lit(float((na or 1) * (nb or 1)) / float((na or 1) + (nb or 1))))
    x = F.col("ks") * m
    terms = sum((F.exp(-2.0 * k * k * x * x) * (2.0 if k % 2 else -2.0) for k in range(1, 21)), F.lit(0.0))
    return d.agg(F.max("d").alias("ks")).select("ks", F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)).alias("p_value"))


def calibration_bins(df: DataFrame, proba: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of the probability: size, mean probability, hit rate, deviation, verdict, and the bin's Brier score."""
    b = F.least(F.floor(F.col(proba) * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(proba).alias("mean_proba"), F.avg(label).alias("hit_rate"), F.avg((F.col(proba) - F.col(label)) ** 2).alias("brier"))
    dev = F.col("hit_rate") - F.col("mean_proba")
    return g.withColumn("deviation", dev).withColumn("verdict", F.when(F.col("n") < 30, "few").when(F.abs(dev) > 0.1, "off").otherwise("ok"))


def threshold_search(df: DataFrame, proba: str, outcome: str, least: int) -> DataFrame:
    """Each threshold 0.1 ... 0.9 with the size, mean outcome and win rate at or above it; `usable` if it is large enough."""
    grid = F.explode(F.array(*(F.lit(i / 10) for i in range(1, 10)))).alias("threshold")
    g = df.select(proba, outcome, grid).where(F.col(proba) >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.avg(outcome).alias("ev"), F.avg((F.col(outcome) > 0).cast("int")).alias("win_rate"))
    return g.withColumn("usable", F.col("n") >= least)


def chosen_thresholds(df: DataFrame, proba: str, outcome: str, least: int) -> DataFrame:
    """(ceiling, floor, source, ev): where to buy and where to skip.

    The ceiling is the usable threshold of the highest mean outcome, if that is positive; the floor the highest threshold
    below it under which the mean outcome is negative on enough rows. Without such a ceiling the upper and the lower
    quintile of the scores are used.
    """
    above = threshold_search(df, proba, outcome, least).where("usable").agg(F.max_by(F.struct("threshold", "ev"), F.struct(F.round("ev", 9), -F.col("threshold"))).alias("m"))
    grid = F.explode(F.array(*(F.lit(i / 10) for i in range(1, 10)))).alias("threshold")
    below = df.select(proba, outcome, grid).where(F.col(proba) < F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n"), F.avg(outcome).alias("ev")).where((F.col("n") >= least) & (F.col("ev") < 0))
    below = below.agg(F.sort_array(F.collect_list("threshold")).alias("low"))  # nine at most
    q = df.agg(F.percentile(proba, F.lit(0.8)).alias("hi"), F.percentile(proba, F.lit(0.2)).alias("lo"))
    j = above.crossJoin(below).crossJoin(q)  # a row each
    good = F.coalesce(F.col("m.ev") > 0, F.lit(False))
    floor = F.array_max(F.filter("low", lambda t: t < F.col("m.threshold")))
    return j.select(F.when(good, F.col("m.threshold")).otherwise(F.col("hi")).alias("ceiling"), F.when(good, F.coalesce(floor, F.lit(0.0))).otherwise(F.col("lo")).alias("floor"), F.when(good, "search").otherwise("quintiles").alias("source"), F.when(good, F.col("m.ev")).alias("ev"))


def top_precision(df: DataFrame, score: str, label: str, tie: str, share: float = 0.1) -> DataFrame:
    """(n_top, precision, base_rate, lift) of the `share` of rows with the highest score, ties by `tie`."""
    n = df.count()
    k = max(1, int(n * share))
    r = global_row_number(df.withColumn("_down", -F.col(score)), "_down", (tie,))
    top = F.col("row") <= k
    g = r.agg(F.count_if(top).alias("n_top"), F.avg(F.when(top, F.col(label))).alias("precision"), F.avg(label).alias("base_rate"))
    return g.withColumn("lift", F.try_divide("precision", "base_rate"))


def permuted(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """df with its labels dealt out anew: the row that is k-th by a hash gets the label of the k-th by `key`."""
    order = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)).cast("double")
    by_key = global_row_number(df.select(F.col(key).alias("_k"), F.col(label).alias("_label")), "_k").select("row", "_label")
    by_hash = global_row_number(df.withColumn("_h", order), "_h", (key,))
    return by_hash.join(by_key, "row").drop("row", "_h", label).withColumnRenamed("_label", label)


def gated_eval(df: DataFrame, proba: str, outcome: str, lo: float, hi: float) -> DataFrame:
    zone = F.when(F.col(proba) >= hi, "BUY").when(F.col(proba) < lo, "SKIP").otherwise("RULES")
    return df.groupBy(zone.alias("zone")).agg(F.count("*").alias("n"), F.avg((F.col(outcome) > 0).cast("int")).alias("win_rate"), F.avg(outcome).alias("mean_outcome"))


def prior_drift(df: DataFrame, label: str, recent, limit: float = 0.5) -> DataFrame:
    """Relative change of the positive share between old and recent rows."""
    g = df.agg(F.avg(F.when(~recent, F.col(label).cast("double"))).alias("before"), F.avg(F.when(recent, F.col(label).cast("double"))).alias("after"))
    shift = F.abs(F.col("after") - F.col("before")) / F.greatest("before", F.lit(1e-9))
    return g.withColumn("shift", shift).withColumn("drifted", shift > limit)


def economic_backtest(df: DataFrame, proba: str, pnl: str, threshold: float, cost: float) -> DataFrame:
    """Result of trading what reaches the threshold, plain and after a cost per trade."""
    t = df.where(F.col(proba) >= threshold)
    return t.agg(F.count("*").alias("n"), F.sum(pnl).alias("plain"), F.sum(F.col(pnl) - cost).alias("realistic"), F.avg((F.col(pnl) > cost).cast("int")).alias("win_rate"))


def leak_check(importance: DataFrame, leaks: list[str], top: int = 10) -> DataFrame:
    """Known leaks among the `top` features (feature, importance) of a model, ties by name; a model has few features."""
    r = importance.orderBy(F.desc(F.round("importance", 9)), "feature").limit(top)
    return r.select("feature", "importance", F.col("feature").isin(leaks).alias("leak"))


def bootstrap_ci(df: DataFrame, key: str, score: str, label: str, draws: int, seed: int, level: float = 0.95, bins: int = 1000, share: float = 0.1) -> DataFrame:
    """(metric, mean, lo, hi): percentile intervals of base rate, AUC and precision among the top `share` by score.

    Every row gets a Poisson weight for each draw, hashed from its key, and counts per draw and bin of the score (of `bins`
    equal ones between its least and its greatest) are all that leaves a task: draws x bins at most, whatever the rows.
    Pairs within a bin count half for the AUC, and the bin at the cut counts in part for the precision.
    """
    import numpy as np
    import pyarrow as pa

    lo, hi = df.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
    cuts = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1)) for i in range(10)])  # of a Poisson variable of mean 1

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))

    def count(batches):
        total = np.zeros((draws, 2, bins + 1))
        for b in batches:
            h, at, y = (np.asarray(b.column(i)) for i in range(3))
            for d in range(draws):
                u = mixed(h.view(np.uint64) ^ mixed(np.full(1, d + 1, np.uint64))).astype(float) / 2.0**64
                np.add.at(total[d], (y, at), np.searchsorted(cuts, u))
        d, y, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(y), pa.array(at), pa.array(total[d, y, at])], names=["draw", "y", "bin", "w"])

    at = F.least(F.floor((F.col(score) - F.lit(lo or 0.0)) / width), F.lit(bins)).cast("long")
    rows = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(F.xxhash64(key, F.lit(seed)).alias("h"), at.alias("at"), F.col(label).cast("long").alias("y"))
    g = rows.mapInArrow(count, "draw long, y long, bin long, w double").groupBy("draw", "bin").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("q"))
    w = Window.partitionBy("draw").orderBy(F.desc("bin"))
    whole = Window.partitionBy("draw")
    g = g.select("*", F.sum("p").over(w).alias("p_up"), F.sum(F.col("p") + F.col("q")).over(w).alias("n_up"), F.sum(F.col("p") + F.col("q")).over(whole).alias("n"))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("n") * share - (F.col("n_up") - F.col("p") - F.col("q"))) / (F.col("p") + F.col("q"))))
    m = g.groupBy("draw").agg(
        F.try_divide(F.sum("p"), F.sum(F.col("p") + F.col("q"))).alias("base_rate"),
        F.try_divide(F.sum(F.col("q") * (F.col("p_up") - F.col("p") / 2)), F.sum("p") * F.sum("q")).alias("auc"),
        F.try_divide(F.sum(F.col("p") * inside), F.sum((F.col("p") + F.col("q")) * inside)).alias("precision"),
    )
    cut = (1 - level) / 2
    long = m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in ("base_rate", "auc", "precision")))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.percentile("v", F.lit(cut)).alias("lo"), F.percentile("v", F.lit(1 - cut)).alias("hi"))


def model_compare(df: DataFrame, scores: list[str], outcome: str, thresholds: list[float]) -> DataFrame:
    """Two or more scores at several thresholds on the same rows."""
    cells = F.array(*(F.struct(F.lit(s).alias("model"), F.col(s).alias("p")) for s in scores))
    e = df.select(outcome, F.explode(cells).alias("c")).select(outcome, "c.*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where("p >= threshold")
    return e.groupBy("model", "threshold").agg(F.count("*").alias("n"), F.avg((F.col(outcome) > 0).cast("int")).alias("win_rate"), F.sum(outcome).alias("total"), F.avg(outcome).alias("mean"), F.median(outcome).alias("median"), F.percentile(outcome, F.lit(0.9)).alias("p90"))


def skill_gate(metrics: DataFrame) -> DataFrame:
    """ok, degenerate, unmeasured or ev_warning for rows (model, auc, spread, ev)."""
    v = F.when(F.col("auc").isNull() | F.col("spread").isNull(), "unmeasured").when((F.col("auc") < 0.55) | (F.col("spread") < 0.05), "degenerate").when(F.col("ev") < 0, "ev_warning").otherwise("ok")
    return metrics.withColumn("verdict", v)


def model_health(df: DataFrame, proba: str, by: str, label: str, recent, base_auc: float, base_median: float, flat: float = 0.30, drop: float = 0.05, shift: float = 0.10) -> DataFrame:
    """Per group: percentiles of the scores, whether their spread is too small, and whether recent rows (a condition) have lost
    AUC or moved their median against a baseline."""
    p = lambda q, c=True: F.percentile(F.when(c, F.col(proba)) if c is not True else F.col(proba), F.lit(q))
    g = df.groupBy(by).agg(p(0.01).alias("p1"), p(0.5).alias("p50"), p(0.99).alias("p99"), p(0.5, recent).alias("recent_p50"))
    now = df.where(recent & F.col(label).isNotNull())
    w = Window.partitionBy(by).orderBy(proba)
    counts = now.groupBy(by, proba).agg(F.count_if(F.col(label) == 1).alias("a"), F.count_if(F.col(label) == 0).alias("b"))
    under = F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("b") / 2
    auc_ = counts.withColumn("u", F.col("a") * under).groupBy(by).agg(F.try_divide(F.sum("u"), F.sum("a") * F.sum("b")).alias("recent_auc"))
    g = g.join(auc_, by, "left").withColumn("flat", F.col("p99") - F.col("p1") < flat)
    return g.withColumn("auc_drop", F.coalesce(F.lit(base_auc) - F.col("recent_auc") > drop, F.lit(False))).withColumn("p50_shift", F.coalesce(F.abs(F.col("recent_p50") - base_median) > shift, F.lit(False)))


def leaf_quantiles(train: DataFrame, test: DataFrame, key: str, target: str, qs: tuple, trees: int = 20, depth: int = 4, smallest: int = 20, seed: int = 7) -> DataFrame:
    """test (key, features, ...) with `q`, an array of the predicted quantiles `qs` of `target`: quantile leaves of two forests.

    The first forest is fitted to the target's rank, which no long tail can pull, and tells rows apart by level; the second, two levels deep, to how
    far ranks lie from the first one's prediction, and tells them apart by spread. The i-th trees of both cut the rows into cells, each with the quantiles of
    the training rows in it; a row's prediction is the mean over its cells. A row whose cell holds no training row in some pair of trees
    goes without that pair. Rows of train without a target are left out.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    def forest(y: str, levels: int, leaf: str, out: str, least: int):
        return RandomForestRegressor(featuresCol="features", labelCol=y, predictionCol=out, numTrees=trees, maxDepth=levels, minInstancesPerNode=least, subsamplingRate=0.7, seed=seed, leafCol=leaf)

    known = _shared(average_rank(train.where(F.col(target).isNotNull()), target))  # both forests read it many times
    level = forest("avg_rank", depth, "_a", "_level", 4 * smallest).fit(known)
    spread = forest("_far", 2, "_b", "_spread", 4 * smallest).fit(level.transform(known).withColumn("_far", F.abs(F.col("avg_rank") - F.col("_level"))))
    both = F.arrays_zip(vector_to_array("_a").alias("a"), vector_to_array("_b").alias("b"))
    at = lambda df, *keep: spread.transform(level.transform(df)).select(*keep, F.posexplode(both).alias("tree", "cell"))
    cells = at(known, target).groupBy("tree", "cell").agg(F.percentile(target, F.array(*map(F.lit, qs))).alias("_q"))
    got = at(test, key).join(cells, ["tree", "cell"]).select(key, F.posexplode("_q").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("v"))
    per = got.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))  # one for each of qs
    return test.join(per, key, "left")


def coverage(rows: DataFrame, target: str, qs: tuple) -> DataFrame:
    """(quantile, n, coverage): the share of rows at or below each predicted quantile, which should be the quantile itself."""
    at = rows.select(F.col(target).alias("y"), F.posexplode("q").alias("i", "at"))
    name = F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1)
    return at.groupBy("i").agg(F.count("*").alias("n"), F.avg((F.col("y") <= F.col("at")).cast("int")).alias("coverage")).select(name.alias("quantile"), "n", "coverage")


def permutation_importance(model, df: DataFrame, features: list[str], label: str, key: str, seed: int, bins: int = 10_000) -> DataFrame:
    """(feature, auc, importance): how much AUC a fitted model loses on df (key, features, label) when one feature is dealt anew among its rows.

    All features in one pass. Rows are numbered by key; feature f of row r comes from row (a_f * r + b_f) mod n, a permutation of its own. The cells of all
    features travel once and meet their rows as a second vector; then each row is scored once for each feature and once as it is. AUCs come from counts
    by `bins` equal ranges of the probability, ties within one counting half.
    """
    from math import gcd
    from random import Random

    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = df.count()
    rows = global_row_number(df.select(F.xxhash64(key, F.lit(seed)).cast("double").alias("_h"), key, label, vector_to_array("features").alias("_x")), "_h", (key,)).withColumn("row", F.col("row") - 1)
    r, deals = Random(seed), []
    for _ in features:
        a = r.randrange(1, max(n, 2))
        while gcd(a, max(n, 1)) != 1:
            a = r.randrange(1, max(n, 2))
        deals.append((a, r.randrange(max(n, 1))))
    to = F.array(*(((F.lit(a).cast("decimal(20,0)") * F.col("row") + b) % max(n, 1)).cast("long") for a, b in deals))
    dealt = rows.select(F.posexplode(F.arrays_zip("_x", to.alias("to"))).alias("f", "c")).select(F.col("c.to").alias("row"), "f", F.col("c._x").alias("v"))
    dealt = dealt.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias("_p"))  # a row's features
    both = rows.join(dealt, "row").select(label, "_x", "_p", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))).alias("f"))
    mixed = F.transform("_x", lambda x, i: F.when(i == F.col("f"), F.get("_p", i)).otherwise(x))
    scored = model.transform(both.select("f", label, array_to_vector(mixed).alias("features")))
    bin_ = F.least(F.floor(vector_to_array("probability")[1] * bins), F.lit(bins - 1))
    g = scored.groupBy("f", bin_.alias("bin")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    w = Window.partitionBy("f").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # bins, not rows
    g = g.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    a = g.groupBy("f").agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))
    whole = a.where("f = -1").select(F.col("auc").alias("_whole"))
    name = F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1)
    return a.where("f >= 0").crossJoin(F.broadcast(whole)).select(name.alias("feature"), "auc", (F.col("_whole") - F.col("auc")).alias("importance"))  # a row
