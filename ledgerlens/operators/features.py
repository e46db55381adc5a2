"""Feature vectors of entry models: an explicit order and a version, put together from metrics, holders, creators and buyers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "entry-1"
METRICS = [
    "unique_buyers", "unique_sellers", "buy_count", "sell_count", "buy_volume", "sell_volume", "buy_diversity", "max_buy", "avg_buy", "median_buy", "sell_ratio", "top3_share", "repeat_buyers",
    "first_buy", "velocity_trend", "size_trend", "first_delay", "buys_per_unique", "curve_velocity", "curve_acceleration", "fast_buy_count", "fast_unique_buyers", "fast_volume", "fast_buy_rate",
    "entities_recent", "concurrent", "pnl_at_fast_entry", "fast_events", "n_events", "gap_to_first_event", "market_price",
]
RATIOS = ["hour_sin", "hour_cos", "volume_ratio", "count_ratio", "buy_size_growth", "fast_volume_share", "fast_rate_share"]
SPREAD = ["top5_minus_top1", "top10_minus_top5", "holder_growth"]
HOLDERS_1, HOLDERS_3 = ["top1_1", "top5_1", "top10_1", "holders_1"], ["top1_3", "top5_3", "top10_3", "holders_3", "top1_delta", "top5_delta", "top10_delta", "holder_velocity"]
CREATOR = ["creator_age_days", "creator_median_peak", "creator_interval", "creator_balance"]
BUYERS = ["top3_prior_entities", "top3_prior_realized", "top3_prior_winrate", "top3_best_realized", "top3_age_days", "top10_prior_winrate", "top10_prior_realized", "n_buyers_first", "n_sniper", "n_smart", "n_bot", "n_small_cluster"]
AT_AGES = [f"{c}_at_{i}" for c in ("unique_buyers", "buy_rate", "buy_volume") for i in (1, 2, 3)]
DELTAS = ["top1_at_2", "top1_1_to_2", "buy_rate_2_to_3", "unique_buyers_1_to_2"]

#: What a model is trained on; another order, or another set, is another version.
FEATURE_ORDER = [*METRICS, *RATIOS, *SPREAD, *HOLDERS_1, *HOLDERS_3, *CREATOR, *BUYERS, *AT_AGES, *DELTAS]
#: What can be known at the first of the three ages.
FEATURE_ORDER_EARLY = [*METRICS, *RATIOS, *HOLDERS_1, "holder_velocity_early", *CREATOR, *BUYERS]


def in_order(df: DataFrame, order: list[str], *keep: str) -> DataFrame:
    """df with just the features, in order; a missing one is an error."""
    missing = [c for c in order if c not in df.columns]
    if missing:
        raise ValueError(f"features missing: {', '.join(missing)}")
    return df.select(*keep, *order)


def holder_features(samples: DataFrame, first: float, second: float, span: float = 90.0) -> DataFrame:
    """(entity_id, HOLDERS_1, HOLDERS_3) of holder samples at two ages; the third is where their line leads, shares within 0 and 100."""
    at = lambda c, age: F.max(F.when(F.col("age") == age, F.col(c)))
    names = {"top1_pct": "top1", "top5_pct": "top5", "top10_pct": "top10", "holder_count": "holders"}
    p = samples.groupBy("entity_id").agg(*(at(c, a).alias(f"{n}_{i}") for c, n in names.items() for i, a in ((1, first), (2, second))))
    ahead = lambda n: 2 * F.col(f"{n}_2") - F.col(f"{n}_1")
    for n in ("top1", "top5", "top10"):
        p = p.withColumn(f"{n}_3", F.when(ahead(n).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), ahead(n))))).withColumn(f"{n}_delta", F.col(f"{n}_3") - F.col(f"{n}_1"))
    p = p.withColumn("holders_3", F.when(ahead("holders").isNotNull(), F.greatest(ahead("holders"), "holders_1", "holders_2")))
    return p.withColumn("holder_velocity", (F.col("holders_3") - F.col("holders_1")) / span).select("entity_id", *HOLDERS_1, *HOLDERS_3)


def buyer_features(prior: DataFrame) -> DataFrame:
    """(entity_id, ...) sums and means over the top buyers' (prior_stats) pasts; NULL where none has one."""
    c, has = F.col, F.col("n_prior") > 0
    top3, closed, more = F.col("rank") <= 3, F.col("n_closed") > 0, F.count("*") > 3
    won = c("n_won") / c("n_closed")
    age = F.when(c("cutoff") > c("first_seen"), (c("cutoff") - c("first_seen")) / 86400.0)
    return prior.groupBy("entity_id").agg(
        F.sum(F.when(has & top3, c("n_prior"))).alias("top3_prior_entities"),
        F.sum(F.when(has & top3, c("sum_realized"))).alias("top3_prior_realized"),
        F.avg(F.when(closed & top3, won)).alias("top3_prior_winrate"),
        F.max(F.when(closed & top3, c("sum_realized"))).alias("top3_best_realized"),
        F.avg(F.when(has & top3, age)).alias("top3_age_days"),
        F.when(more, F.avg(F.when(closed, won))).alias("top10_prior_winrate"),
        F.when(more, F.sum(F.when(has, c("sum_realized")))).alias("top10_prior_realized"),
    )


def derived(df: DataFrame, span: float) -> DataFrame:
    """Ratios, spreads and differences of rows that have METRICS, holders and metrics at ages. Missing holders count as 0."""
    c = F.col
    df = df.fillna(0.0, [x for x in (*HOLDERS_1, *HOLDERS_3) if x in df.columns])
    angle = F.hour(F.timestamp_seconds("created_at")) * F.lit(2 * 3.141592653589793 / 24)
    out: dict[str, Column] = {
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "volume_ratio": c("buy_volume") / (c("sell_volume") + 0.01),
        "count_ratio": c("buy_count") / (c("sell_count") + 1.0),
        "buy_size_growth": c("max_buy") / (c("avg_buy") + 0.001),
        "fast_volume_share": c("fast_volume") / (c("buy_volume") + 0.01),
        "fast_rate_share": c("fast_buy_rate") / (c("buy_count") / span + 0.001),
        "top5_minus_top1": c("top5_3") - c("top1_3"),
        "top10_minus_top5": c("top10_3") - c("top5_3"),
        "holder_growth": c("holders_3") / (c("holders_1") + 1.0),
        "holder_velocity_early": c("holders_1") / 30.0,
        "top1_at_2": c("top1_1") + (c("top1_3") - c("top1_1")) / 3.0,
        "top1_1_to_2": (c("top1_3") - c("top1_1")) / 3.0,
        "buy_rate_2_to_3": c("buy_rate_at_3") - c("buy_rate_at_2"),
        "unique_buyers_1_to_2": c("unique_buyers_at_2") - c("unique_buyers_at_1"),
    }
    return df.withColumns(out)
