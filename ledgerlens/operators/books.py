"""Aggregations over books of positions, and over flags of an entity's buyers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rate(c):
    return F.avg(c.cast("int"))


def flag_counts(top: DataFrame) -> DataFrame:
    """Flags among an entity's top buyers; NULL where none of them is classified."""
    known = F.count("is_sniper") > 0
    return top.groupBy("entity_id").agg(*(F.when(known, F.count_if(f"is_{c}")).alias(f"n_{c}") for c in ("sniper", "smart", "bot")))


def largest_cluster(events: DataFrame, clusters: DataFrame, lo: int, hi: int) -> DataFrame:
    """The cluster, of a size in the band, with most of an entity's early buyers; ties by cluster."""
    early = events.where("side = 'buy'").select("entity_id", "actor_id").distinct()
    g = early.join(clusters.where(F.col("cluster_size").between(lo, hi)), "actor_id").groupBy("entity_id", "cluster_id", "cluster_size").agg(F.count("*").alias("n_early"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("n_early"), "cluster_id")
    return g.withColumn("q", F.row_number().over(w)).where("q = 1").drop("q")


def decision_counts(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), *(F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in ("BUY", "BORDERLINE", "SKIP")))


def signal_universe(df: DataFrame) -> DataFrame:
    """Cells of (fast, full): size, mean result, win rate in percent, warning if large and nearly always lost."""
    win = _rate(F.col("pnl") > 0) * 100
    return df.groupBy("fast", "full").agg(F.count("*").alias("n"), F.avg("pnl").alias("avg_pnl"), win.alias("win_rate"), ((F.count("*") >= 500) & (win < 5)).alias("warning"))


def ab_breakdown(book: DataFrame, configs: DataFrame) -> DataFrame:
    """Per configuration; those without positions are kept."""
    done = F.col("status") == "closed"
    g = book.groupBy("config_id").agg(F.count_if(done).alias("n_closed"), F.count_if(F.col("status") == "open").alias("n_open"), (F.avg(F.when(done, (F.col("pnl") > 0).cast("int"))) * 100).alias("win_rate"), F.sum(F.when(done, F.col("pnl"))).alias("pnl"), F.avg(F.when(done, F.col("pnl"))).alias("avg_pnl"))
    j = configs.join(g, "config_id", "left")
    return j.select("config_id", F.coalesce("n_closed", F.lit(0)).alias("n_closed"), F.coalesce("n_open", F.lit(0)).alias("n_open"), "win_rate", F.coalesce("pnl", F.lit(0.0)).alias("pnl"), "avg_pnl")


def breakdown(book: DataFrame, by: str) -> DataFrame:
    """Count, share in percent, mean result and win rate per value of a column."""
    g = book.groupBy(by).agg(F.count("*").alias("n"), F.avg("pnl_pct").alias("avg_pnl"), (_rate(F.col("pnl_pct") > 0) * 100).alias("win_rate"))
    total = g.agg(F.sum("n").alias("total"))  # one row
    return g.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("total") * 100).alias("share"), "avg_pnl", "win_rate")


def book_summary(book: DataFrame, by: str, size: float) -> DataFrame:
    """Wins, losses, gross results, profit factor (floor 1e-4), means, return on what was staked, exit reasons as a map."""
    pnl, won, lost = F.col("pnl"), F.col("pnl") > 0, F.col("pnl") <= 0
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    exits = book.groupBy(by, "exit_reason").agg(F.count("*").alias("c")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("exit_reason", "c"))).alias("exit_reasons"))
    gain, loss = zero(F.sum(F.when(won, pnl))), zero(-F.sum(F.when(lost, pnl)))
    g = book.groupBy(by).agg(
        F.count("*").alias("trades"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        (_rate(won) * 100).alias("win_rate"),
        gain.alias("gross_profit"),
        loss.alias("gross_loss"),
        (gain / F.greatest(loss, F.lit(1e-4))).alias("profit_factor"),
        zero(F.avg(F.when(won, pnl))).alias("avg_win"),
        zero(F.avg(F.when(lost, pnl))).alias("avg_loss"),
        (F.sum(pnl) / (F.count("*") * size) * 100).alias("roi_pct"),
        F.avg("hold_seconds").alias("avg_hold"),
    )
    return g.join(exits, by)


def nth_summary(pnls: DataFrame, columns: dict[int, str]) -> DataFrame:
    """Per N: wins, losses, win rate and sums of the non-zero results."""
    rows = F.array(*(F.struct(F.lit(n).alias("nth"), F.col(c).alias("pnl")) for n, c in columns.items()))
    u = pnls.select(F.explode(rows).alias("x")).select("x.*").where("pnl <> 0")
    pnl = F.col("pnl")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return u.groupBy("nth").agg(F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"), (F.count_if(pnl > 0) / F.count("*") * 100).alias("win_rate"), zero(F.sum(F.when(pnl > 0, pnl))).alias("sum_won"), zero(F.sum(F.when(pnl < 0, pnl))).alias("sum_lost"), zero(F.sum(pnl)).alias("net"))


def realized_balance(book: DataFrame, by: str, start: float, share: float, floor: float, cap: float) -> DataFrame:
    """Running balance of each book, and the stake it allows: a share of it within floor and cap, rounded to 3 decimals."""
    w = Window.partitionBy(by).orderBy("exit_time", "id").rowsBetween(Window.unboundedPreceding, 0)
    b = book.select("id", by, (F.lit(start) + F.sum("pnl").over(w)).alias("balance"))
    return b.withColumn("size", F.floor(F.least(F.greatest(F.round("balance", 6) * share, F.lit(floor)), F.lit(cap)) * 1000 + 0.5) / 1000)


def session_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("session").agg(F.count("*").alias("runs"), F.count_if(F.col("pnl") > 0).alias("profitable"), F.max("win_rate").alias("best_win_rate"), F.max("pnl").alias("best_pnl"), F.avg("pnl").alias("avg_pnl"), F.max("created_at").alias("last_run"))


def window_health(book: DataFrame, now: float, recent: float, baseline: float) -> DataFrame:
    """The same figures for the recent span and the rolling baseline that contains it."""
    t, pnl = F.col("exit_time"), F.col("pnl")
    spans = F.array_compact(F.array(F.when(t > now - recent, "recent"), F.lit("baseline")))
    e = book.where((t > now - baseline) & (t <= now)).withColumn("span", F.explode(spans)).withColumn("hour", F.hour(F.timestamp_seconds("exit_time")))
    band = lambda c: F.coalesce(F.sum(F.when(c, pnl)), F.lit(0.0))
    h = F.col("hour")
    return e.groupBy("span").agg(
        F.count("*").alias("n"),
        (_rate(pnl > 0) * 100).alias("win_rate"),
        F.avg(pnl).alias("avg_pnl"),
        (_rate(F.col("exit_reason") == "hard_stop") * 100).alias("hard_stop_pct"),
        (_rate(F.col("exit_reason") == "timeout") * 100).alias("survival_pct"),
        band(h.between(9, 16)).alias("pnl_day"),
        band(h.between(17, 22)).alias("pnl_evening"),
        band(~h.between(9, 22)).alias("pnl_rest"),
    )


def health_verdict(health: DataFrame, least: int, least_base: int, win_drop: float, pnl_drop: float, stop_rise: float) -> DataFrame:
    """OK, WARN or REGRESSION of the recent span against the baseline; too few rows are OK."""
    r, b = health.where("span = 'recent'").alias("r"), health.where("span = 'baseline'").alias("b")
    j = r.crossJoin(b)  # one row each
    win = F.col("r.win_rate") < F.col("b.win_rate") - win_drop
    pnl = F.col("r.avg_pnl") < F.col("b.avg_pnl") - pnl_drop
    stops = F.col("r.hard_stop_pct") > F.col("b.hard_stop_pct") * (1 + stop_rise) + 1e-9
    few = (F.col("r.n") < least) | (F.col("b.n") < least_base)
    return j.select(F.col("r.n").alias("n"), F.col("b.n").alias("n_baseline"), (F.col("r.win_rate") - F.col("b.win_rate")).alias("win_rate_change"), F.when(few, "OK").when(win & pnl, "REGRESSION").when(win | pnl | stops, "WARN").otherwise("OK").alias("verdict"))


def percentiles(df: DataFrame, by: str, value: str, qs: tuple) -> DataFrame:
    """The elements at index floor(n q) in order, per group."""
    w = Window.partitionBy(by)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    at = lambda q: F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1), F.col(value))).alias(f"p{round(q * 100)}")
    return r.groupBy(by).agg(*(at(q) for q in qs))


def proba_stats(df: DataFrame, now: float, span: float) -> DataFrame:
    return df.where((F.col("entry_time") > now - span) & (F.col("entry_time") <= now)).agg(F.count("*").alias("n"), F.max("proba").alias("max_proba"), F.avg("proba").alias("avg_proba"))


def zero_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, zeros and NULLs in percent, mean."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns))
    u = df.select(F.explode(cells).alias("c")).select("c.*")
    return u.groupBy("field").agg(F.count("*").alias("n"), (_rate(F.coalesce(F.col("x") == 0, F.lit(False))) * 100).alias("zero_pct"), (_rate(F.col("x").isNull()) * 100).alias("null_pct"), F.avg("x").alias("mean"))


def slipped(p, s):
    """A result after slippage on both legs."""
    return (1 + p) * (1 - s) / (1 + s) - 1


def slippage_buckets(df: DataFrame, base: float, reference: float) -> DataFrame:
    """Results before and after slippage base * sqrt(size / reference), by bucket of the result."""
    s = base * F.sqrt(F.col("size") / reference)
    d = df.withColumn("q", slipped(F.col("p"), s)).withColumn("bucket", F.when(F.col("p") < -0.2, "loss").when(F.col("p") < 0, "small_loss").when(F.col("p") < 0.2, "small_gain").otherwise("gain"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p").alias("before"), F.avg("q").alias("after"), F.avg(F.col("q") - F.col("p")).alias("cost"))


def sweep_summary(book: DataFrame, by: list[str]) -> DataFrame:
    """Per combination: rates of exits and results, mean winner, and mean of the best 5 % (one at least)."""
    w = Window.partitionBy(*by)
    r = book.withColumn("_k", F.row_number().over(w.orderBy(F.desc("pnl_pct"), "id"))).withColumn("_n", F.count("*").over(w))
    p, e = F.col("pnl_pct"), F.col("exit_reason")
    return r.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(p).alias("avg_pnl"),
        _rate(p > 0).alias("win_rate"),
        _rate(e == "take_profit").alias("tp_rate"),
        _rate(e == "hard_stop").alias("stop_rate"),
        _rate(e == "timeout").alias("timeout_rate"),
        _rate(e == "trailing_stop").alias("trail_rate"),
        _rate(p >= 30).alias("rate_up"),
        _rate(p <= -10).alias("rate_down"),
        F.avg(F.when(p > 0, p)).alias("avg_winner"),
        F.avg(F.when(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.05)), p)).alias("top5_mean"),
    )


def audit(book: DataFrame, now: float, day: float) -> DataFrame:
    p, t = F.col("pnl_pct"), F.col("exit_time")
    b = book.where(t <= now)
    return b.agg(F.count("*").alias("n"), _rate(p > 0).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("avg_winner"), F.avg(F.when(p <= 0, p)).alias("avg_loser"), F.avg(p).alias("ev"), F.avg(F.when(t > now - day, p)).alias("last_day"), F.avg(F.when((t <= now - day) & (t > now - 2 * day), p)).alias("day_before"))


def dead_before_capture(failures: DataFrame, captured: DataFrame, least: int) -> DataFrame:
    """Entities with `least` failures and no capture, as explicit negative rows."""
    f = failures.groupBy("entity_id").agg(F.count("*").alias("n_failures")).where(F.col("n_failures") >= least)
    return f.join(captured.select("entity_id"), "entity_id", "left_anti").select("entity_id", "n_failures", F.lit(-1.0).alias("capture_age"), F.lit(True).alias("is_negative"))


def capture_lag(samples: DataFrame) -> DataFrame:
    lag = F.col("actual") - F.col("target")
    return samples.groupBy("target").agg(F.count("*").alias("n"), F.avg(lag).alias("mean_lag"), F.percentile(lag, F.lit(0.5)).alias("p50"), F.percentile(lag, F.lit(0.95)).alias("p95"))
