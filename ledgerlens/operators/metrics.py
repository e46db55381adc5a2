"""Per-entity metrics: events are ranked once per entity, then one aggregation makes every metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRADUATION = 85.0  # reserve at which an entity graduates
DAY = 86400.0


def reserve_pct(reserve, graduation: float = GRADUATION):
    """Share of the way to graduation in percent, at most 100; 0 where the reserve is not positive."""
    return F.when(reserve > 0, F.least(reserve / graduation * 100.0, F.lit(100.0))).otherwise(0.0)


def ranked(events: DataFrame) -> DataFrame:
    """Events with their rank, the number of events, the rank among buys, neighbours, the buy's predecessor and which one is the last priced buy, all per entity."""
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id")
    whole = Window.partitionBy("entity_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    buy = F.col("side") == "buy"
    priced = F.col("is_buy") & (F.col("qty") > 0) & (F.col("amount") > 0)
    return (
        events.withColumn("is_buy", buy)
        .withColumn("rn", F.row_number().over(w))
        .withColumn("n", F.count("*").over(whole))
        .withColumn("n_buys", F.count_if("is_buy").over(whole))
        .withColumn("last_ts", F.max("ts").over(whole))
        .withColumn("buy_rn", F.when(F.col("is_buy"), F.count_if("is_buy").over(w.rowsBetween(Window.unboundedPreceding, 0))))
        .withColumn("prev_ts", F.lag("ts").over(w))
        .withColumn("next_ts", F.lead("ts").over(w))
        .withColumn("last_priced", priced & (F.count_if(priced).over(w.rowsBetween(Window.unboundedPreceding, 0)) == F.count_if(priced).over(whole)))
        .withColumn("prev_buy_ts", F.last(F.when(F.col("is_buy"), F.col("ts")), ignorenulls=True).over(before))
    )


def event_metrics(events: DataFrame, early: float = 10.0, attention: float = 30.0, ages: tuple = (30.0, 60.0, 90.0)) -> DataFrame:
    """Metrics of each entity over its events (with created_at and creator_id), one row per entity that has any.

    Follows the total order (ts, event_id). Missing values: 0 where nothing was observed. First and last rows are told by their ranks, so that
    what is kept of an entity while its events are added up are plain numbers.
    """
    e = ranked(events)
    buy, sell = F.col("is_buy"), ~F.col("is_buy")
    amount, ts, age = F.col("amount"), F.col("ts"), F.col("ts") - F.col("created_at")
    if_ = lambda c, x: F.when(c, x)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    half1, half2 = buy & (F.col("buy_rn") <= F.floor(F.col("n_buys") / 2)), buy & (F.col("buy_rn") > F.floor(F.col("n_buys") / 2))
    first, last, mid = F.col("rn") == 1, F.col("rn") == F.col("n"), F.col("rn") == F.floor(F.col("n") / 2) + 1
    aggs = {
        "n_events": F.count("*"),
        "buy_count": F.count_if(buy),
        "sell_count": F.count_if(sell),
        "buy_volume": zero(F.sum(if_(buy, amount))),
        "sell_volume": zero(F.sum(if_(sell, amount))),
        "max_buy": zero(F.max(if_(buy, amount))),
        "creator_sold": F.coalesce(F.bool_or(sell & (F.col("actor_id") == F.col("creator_id"))), F.lit(False)),
        "creator_buy_position": F.coalesce(F.min(if_(buy & (F.col("actor_id") == F.col("creator_id")), F.col("buy_rn"))), F.lit(0)),
        "avg_buy": zero(F.avg(if_(buy, amount))),
        "median_buy": zero(F.median(if_(buy, amount))),
        "std_buy": zero(F.stddev_samp(if_(buy, amount))),
        "first_buy": zero(F.max(if_(F.col("buy_rn") == 1, amount))),
        "median_gap": F.when(F.max("n_buys") >= 3, F.median(if_(buy, ts - F.col("prev_buy_ts")))).otherwise(0.0),
        "h1_n": F.count_if(half1),
        "h2_n": F.count_if(half2),
        "h1_span": F.max(if_(half1, ts)) - F.min(if_(half1, ts)),
        "h2_span": F.max(if_(half2, ts)) - F.min(if_(half2, ts)),
        "h1_avg": F.avg(if_(half1, amount)),
        "h2_avg": F.avg(if_(half2, amount)),
        "first_ts": F.min("ts"),
        "last_ts": F.max("ts"),
        "created_at": F.first("created_at"),
        "first_reserve": F.max(if_(first, F.col("reserve"))),
        "mid_reserve": F.max(if_(mid, F.col("reserve"))),
        "mid_ts": F.max(if_(mid, ts)),
        "last_reserve": F.max(if_(last, F.col("reserve"))),
        "last_mcap": F.max(if_(last, F.col("mcap"))),
        "last_price": zero(F.max(if_(F.col("last_priced"), amount / F.col("qty")))),
        "median_gap_first20": F.when(F.count("*") >= 21, F.median(if_((F.col("rn") > 1) & (F.col("rn") <= 20), ts - F.col("prev_ts")))).otherwise(0.0),
        "buy_volume_early": zero(F.sum(if_(buy & (age <= early), amount))),
    }
    for i, a in enumerate(ages, 1):
        aggs[f"reserve_at_{i}"] = F.max(if_((age <= a) & (F.col("next_ts").isNull() | (F.col("next_ts") - F.col("created_at") > a)), F.col("reserve")))
        aggs[f"buy_rate_at_{i}"] = F.count_if(buy & (age <= a)) / F.lit(float(a))
        aggs[f"buy_volume_at_{i}"] = zero(F.sum(if_(buy & (age <= a), amount)))
    out = e.groupBy("entity_id").agg(*(c.alias(k) for k, c in aggs.items()))
    return out.join(actor_counts(events, attention, ages), "entity_id").join(buy_diversity(events), "entity_id", "left").withColumn("buy_diversity", F.coalesce("buy_diversity", F.lit(0)))


def actor_counts(events: DataFrame, attention: float, ages: tuple) -> DataFrame:
    """(entity_id, unique_buyers, unique_sellers, and buyers of the first and last `attention` seconds and up to each age).

    Each count follows from the first and last buy of an actor, so events are grouped by actor once, and no row is repeated for a count.
    """
    buy, ts = F.col("side") == "buy", F.col("ts")
    per = events.groupBy("entity_id", "actor_id").agg(F.min(F.when(buy, ts - F.col("created_at"))).alias("first_age"), F.max(F.when(buy, ts)).alias("last_buy"), F.bool_or(~buy).alias("sold"), F.max("ts").alias("last"))
    per = per.withColumn("end", F.max("last").over(Window.partitionBy("entity_id")))
    known = F.col("actor_id").isNotNull()
    counts = {
        "unique_buyers": F.col("last_buy").isNotNull(),
        "unique_sellers": F.col("sold"),
        "unique_buyers_first": F.col("first_age") <= attention,
        "unique_buyers_last": F.col("last_buy") >= F.col("end") - attention,
        **{f"unique_buyers_at_{i}": F.col("first_age") <= a for i, a in enumerate(ages, 1)},
    }
    return per.groupBy("entity_id").agg(*(F.count_if(known & c).alias(k) for k, c in counts.items()))


def buy_diversity(events: DataFrame) -> DataFrame:
    """(entity_id, buy_diversity): different amounts of buys, to four decimals."""
    return events.where("side = 'buy'").select("entity_id", F.bround("amount", 4).alias("a")).distinct().groupBy("entity_id").agg(F.count("a").alias("buy_diversity"))


def finished(m: DataFrame, ages: int = 3) -> DataFrame:
    """Ratios and trends of event_metrics."""
    four, many = F.col("buy_count") >= 4, F.col("n_events") > 1
    rate = lambda n, span: F.col(n) / F.greatest(F.when(F.col(n) > 1, F.col(span)).otherwise(1.0), F.lit(0.1))
    elapsed = F.col("last_ts") - F.col("first_ts")
    e1, e2 = F.col("mid_ts") - F.col("first_ts"), F.col("last_ts") - F.col("mid_ts")
    out = (
        m.withColumn("sell_ratio", F.col("sell_count") / F.greatest("buy_count", F.lit(1)))
        .withColumn("creator_self_buy", F.col("creator_buy_position") > 0)
        .withColumn("buys_per_unique", F.when(F.col("unique_buyers") > 0, F.col("buy_count") / F.col("unique_buyers")).otherwise(0.0))
        .withColumn("first_half_rate", F.when(four, rate("h1_n", "h1_span")).otherwise(0.0))
        .withColumn("second_half_rate", F.when(four, rate("h2_n", "h2_span")).otherwise(0.0))
        .withColumn("velocity_trend", F.when(four, F.col("second_half_rate") / F.greatest("first_half_rate", F.lit(0.01))).otherwise(0.0))
        .withColumn("first_half_avg", F.when(four, F.col("h1_avg")).otherwise(0.0))
        .withColumn("second_half_avg", F.when(four, F.col("h2_avg")).otherwise(0.0))
        .withColumn("size_trend", F.when(four, F.col("h2_avg") / F.greatest("h1_avg", F.lit(1e-6))).otherwise(0.0))
        .withColumn("first_delay", F.greatest(F.col("first_ts") - F.col("created_at"), F.lit(0.0)))
        .withColumn("window_span", elapsed)
        .withColumn("reserve_pct", reserve_pct(F.col("last_reserve")))
        .withColumn("to_graduation", F.greatest(GRADUATION - F.col("last_reserve"), F.lit(0.0)))
        .withColumn("curve_velocity", F.when(many & (elapsed > 0), (F.col("last_reserve") - F.col("first_reserve")) / elapsed).otherwise(0.0))
        .withColumn("curve_acceleration", F.when((F.col("n_events") >= 4) & (e1 > 0) & (e2 > 0), (F.col("last_reserve") - F.col("mid_reserve")) / e2 - (F.col("mid_reserve") - F.col("first_reserve")) / e1).otherwise(0.0))
    )
    for i in range(1, ages + 1):
        out = out.withColumn(f"reserve_pct_at_{i}", F.coalesce(reserve_pct(F.col(f"reserve_at_{i}")), F.lit(0.0)))
    return out


def buyer_metrics(events: DataFrame) -> DataFrame:
    """Metrics over each entity's buyers, from their volumes: two-level aggregation."""
    per = events.where("side = 'buy'").groupBy("entity_id", "actor_id").agg(F.sum("amount").alias("v"), F.count("*").alias("c"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("v"), "actor_id")
    per = per.withColumn("r", F.row_number().over(w)).withColumn("total", F.sum("v").over(Window.partitionBy("entity_id")))
    p = F.col("v") / F.col("total")
    out = per.groupBy("entity_id").agg(
        F.count("*").alias("buyers"),
        F.sum("v").alias("total"),
        F.sum(F.when(F.col("r") <= 3, F.col("v"))).alias("top3"),
        F.count_if(F.col("c") > 1).alias("repeat_buyers"),
        F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).alias("h"),
    )
    top3 = F.when((F.col("total") > 0) & (F.col("buyers") >= 3), F.col("top3") / F.col("total") * 100.0).otherwise(-1.0)
    entropy = F.when((F.col("total") > 0) & (F.col("buyers") >= 2), F.col("h") / F.log2(F.col("buyers").cast("double"))).otherwise(0.0)
    return out.select("entity_id", top3.alias("top3_share"), "repeat_buyers", entropy.alias("buyer_entropy"))


def entity_metrics(events: DataFrame, early: float = 10.0, attention: float = 30.0, ages: tuple = (30.0, 60.0, 90.0)) -> DataFrame:
    """All metrics of one window, one row per entity with events."""
    m = finished(event_metrics(events, early, attention, ages), len(ages))
    b = buyer_metrics(events)
    out = m.join(b, "entity_id", "left")
    return out.withColumn("top3_share", F.coalesce("top3_share", F.lit(0.0))).withColumn("repeat_buyers", F.coalesce("repeat_buyers", F.lit(0))).withColumn("buyer_entropy", F.coalesce("buyer_entropy", F.lit(0.0)))


def nth_entry_pnl(events: DataFrame, ns: tuple = (5, 10, 20, 50, 100)) -> DataFrame:
    """(entity_id, pnl_5, ...): the last priced buy against the average price of the first N, 0 where there are fewer."""
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    b = events.where("side = 'buy' and qty > 0 and amount > 0")
    b = b.withColumn("k", F.count("*").over(w)).withColumn("avg_price", F.sum("amount").over(w) / F.sum("qty").over(w))
    per = b.groupBy("entity_id").agg(F.max_by(F.col("amount") / F.col("qty"), F.struct("ts", "event_id")).alias("p"), *(F.max(F.when(F.col("k") == n, F.col("avg_price"))).alias(f"a{n}") for n in ns))
    return per.select("entity_id", *(F.coalesce((F.col("p") - F.col(f"a{n}")) / F.col(f"a{n}") * 100.0, F.lit(0.0)).alias(f"pnl_{n}") for n in ns))


def fast_metrics(events: DataFrame) -> DataFrame:
    """The short set for early decisions; elapsed has a floor of 0.1 s."""
    m = finished(event_metrics(events, 0, 0, ()), 0)
    elapsed = F.greatest("window_span", F.lit(0.1))
    return m.select("entity_id", "buy_count", "sell_count", "unique_buyers", "buy_volume", "buy_diversity", elapsed.alias("elapsed"), (F.col("buy_count") / elapsed).alias("buy_rate"), "sell_ratio", "reserve_pct", "creator_sold", "creator_self_buy", "creator_buy_position", "last_mcap")


def observation_metrics(events: DataFrame) -> DataFrame:
    """A reduced set with the list of buy amounts in order; events carry their entity's creator_id."""
    buy = F.col("side") == "buy"
    last = F.max_by("reserve", F.struct("ts", "event_id"))
    sold = F.coalesce(F.bool_or(~buy & (F.col("actor_id") == F.col("creator_id"))), F.lit(False))
    amounts = F.transform(F.array_sort(F.collect_list(F.when(buy, F.struct("ts", "event_id", "amount")))), lambda x: x["amount"])
    return events.groupBy("entity_id").agg(F.count_if(buy).alias("buy_count"), F.count_if(~buy).alias("sell_count"), F.count_distinct(F.when(buy, F.col("actor_id"))).alias("unique_buyers"), F.coalesce(F.sum(F.when(buy, F.col("amount"))), F.lit(0.0)).alias("buy_volume"), reserve_pct(last).alias("reserve_pct"), sold.alias("creator_sold"), amounts.alias("buy_amounts"))


def buyers_within(events: DataFrame, span: float) -> DataFrame:
    """(entity_id, n): different buyers less than `span` after creation."""
    age = F.col("ts") - F.col("created_at")
    return events.groupBy("entity_id").agg(F.count_distinct(F.when((F.col("side") == "buy") & (age >= 0) & (age < span), F.col("actor_id"))).alias("n"))


def top_buyers(events: DataFrame, n: int) -> DataFrame:
    """(entity_id, actor_id, volume, rank) of the n largest buyers, ties by actor."""
    per = events.where("side = 'buy'").groupBy("entity_id", "actor_id").agg(F.sum("amount").alias("volume"))
    w = Window.partitionBy("entity_id").orderBy(F.desc("volume"), "actor_id")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def entry_points(tokens: DataFrame, trades: DataFrame, scored_after: float) -> DataFrame:
    """The first priced buy at or after scoring, or why there is none: (entity_id, entry_ts, entry_price, status)."""
    t = tokens.select("entity_id", (F.col("created_at") + scored_after).alias("scored_at"))
    e = t.join(trades, "entity_id", "left").withColumn("after", F.col("ts") >= F.col("scored_at"))
    usable = F.col("after") & (F.col("side") == "buy") & (F.col("amount") != 0) & (F.col("qty") != 0)
    out = e.groupBy("entity_id").agg(F.count_if("after").alias("n_after"), F.min(F.when(usable, F.struct("ts", "event_id", (F.col("amount") / F.col("qty")).alias("price")))).alias("first"))
    status = F.when(F.col("n_after") == 0, "doa_no_trades").when(F.col("first").isNull(), "doa_no_entry").otherwise("entered")
    return out.select("entity_id", F.col("first.ts").alias("entry_ts"), F.col("first.price").alias("entry_price"), status.alias("status"))
