"""Sliding windows over the last events of an entity, replayed reserves, and analytic windows over books and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import reserve_pct

SIZE, WARM = 20, 15  # events in the window, events before the first row
NOISE = 1e-12  # more than additions of doubles, in whatever order, put into the quotient of two sums


def pulse(events: DataFrame, whale: float, threshold: float = 0.15, size: int = SIZE, warm: int = WARM, keys: tuple = ("entity_id",), cold: bool = False, noise: float = NOISE) -> DataFrame:
    """The state of each entity's last `size` events at every event from the `warm`-th on.

    One window specification serves all columns: rates, mean and total buys, the largest sell, whether the creator sold, the share
    of actors not seen before, trends against the previous row, the run of declines and the fall from the peak rate.
    With `cold` the rows before the `warm`-th stay, with NULL in what only warm rows have. A mean has to change by `noise` more than
    the threshold, so that one that changes by just the threshold is no trend; with 0 its sums decide, as doubles added in order.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    last, upto = w.rowsBetween(-(size - 1), 0), w.rowsBetween(Window.unboundedPreceding, 0)
    buy, is_warm = F.col("side") == "buy", F.col("rn") >= warm
    creator = F.col("creator_id").isNotNull() & (F.col("actor_id") == F.col("creator_id"))
    of_actor = Window.partitionBy(*keys, "actor_id").orderBy("ts", "event_id")
    # one sort by actor, then one by time: row numbers come with the sums, as what precedes them would be sorted once more
    e = events.select("*", (F.row_number().over(of_actor) == 1).alias("new_actor"), (buy & F.col("actor_id").isNotNull() & (F.count_if(buy).over(of_actor.rowsBetween(Window.unboundedPreceding, 0)) == 1)).alias("new_buyer"))
    e = e.select(
        "*",
        F.row_number().over(w).alias("rn"),
        F.count("*").over(last).alias("window_events"),
        F.count_if(buy).over(last).alias("n_buys"),
        F.coalesce(F.sum(F.when(buy, F.col("amount"))).over(last), F.lit(0.0)).alias("buy_volume"),
        F.coalesce(F.max(F.when(~buy, F.col("amount"))).over(last), F.lit(0.0)).alias("max_sell"),
        F.max(~buy & creator).over(last).alias("creator_selling"),
        F.count_if("new_buyer").over(upto).alias("distinct_buyers"),  # at the `warm`-th event, where it is used: of all events so far
    ).drop("new_buyer")
    e = e.withColumn("buy_rate", F.when(is_warm, F.col("n_buys") / F.col("window_events"))).withColumn("sell_rate", 1 - F.col("buy_rate"))
    e = e.withColumn("avg_buy", F.when(is_warm, F.col("buy_volume") / F.greatest("n_buys", F.lit(1)))).withColumn("whale_exit", F.col("max_sell") > whale).withColumn("reserve_pct", reserve_pct(F.col("reserve")))
    unseen = F.when(F.col("rn") == warm, F.col("distinct_buyers")).otherwise((buy & F.col("new_actor")).cast("int"))
    e = e.withColumn("new_actor_rate", F.when(is_warm, unseen / F.greatest("n_buys", F.lit(1))))

    def trend(c, most):
        before = F.lag(c).over(w)
        change = (F.col(c) - before) / before
        return F.when(is_warm, F.when(before.isNull() | (before < 0.001), "stable").when(change > most, "rising").when(change < -most, "declining").otherwise("stable"))

    # rates are quotients of counts, without such noise
    e = e.withColumn("rate_trend", trend("buy_rate", threshold)).withColumn("size_trend", trend("avg_buy", threshold + noise))
    stop = F.coalesce(F.max(F.when(F.col("rate_trend") != "declining", F.col("rn"))).over(upto), F.lit(warm - 1))
    e = e.withColumn("declining_run", F.when(is_warm, F.col("rn") - stop)).withColumn("peak_rate", F.max("buy_rate").over(upto))
    e = e.withColumn("of_peak", F.when(is_warm, F.when(F.col("peak_rate") > 0, F.col("buy_rate") / F.col("peak_rate")).otherwise(1.0)))
    return e if cold else e.where(is_warm)


def replayed_reserve(events: DataFrame, start: float, k: float, supply: float, floor: float = 1e-9) -> DataFrame:
    """reserve_sim and mcap_sim after each event: buys add, sells take off, never below `floor`.

    The floor is a reflection: the clamped sum is the plain prefix sum plus the running maximum of what it fell short.
    """
    w = Window.partitionBy("entity_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = F.lit(start) + F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(-F.col("amount"))).over(w)
    e = events.withColumn("_s", s)
    e = e.withColumn("reserve_sim", F.col("_s") + F.greatest(F.lit(0.0), F.max(F.lit(floor) - F.col("_s")).over(w))).drop("_s")
    return e.withColumn("mcap_sim", F.col("reserve_sim") * F.col("reserve_sim") / k * supply)


def filled(events: DataFrame, stored_reserve: str, stored_mcap: str) -> DataFrame:
    """Replayed values where both stored ones are 0, the stored ones elsewhere."""
    gap = (F.col(stored_reserve) == 0) & (F.col(stored_mcap) == 0)
    return events.withColumn("reserve_filled", F.when(gap, F.col("reserve_sim")).otherwise(F.col(stored_reserve))).withColumn("mcap_filled", F.when(gap, F.col("mcap_sim")).otherwise(F.col(stored_mcap))).withColumn("was_filled", gap)


def drift(events: DataFrame, stored: str, simulated: str) -> DataFrame:
    """Mean and largest deviation in percent of the replayed from the stored value, per entity, where that is positive."""
    d = F.abs(F.col(simulated) - F.col(stored)) / F.col(stored) * 100.0
    return events.where(F.col(stored) > 0).groupBy("entity_id").agg(F.count("*").alias("n"), F.avg(d).alias("mean_drift"), F.max(d).alias("max_drift"))


def same_day(tokens: DataFrame) -> DataFrame:
    """How many entities the creator had made before on the same UTC day."""
    day = F.to_date(F.timestamp_seconds("created_at"))
    w = Window.partitionBy("creator_id", day).orderBy("insert_order")
    return tokens.select("entity_id", (F.row_number().over(w) - 1).alias("n_same_day"))


def cumulative(book: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return book.withColumn("cum_pnl", F.sum("pnl").over(w))


def drawdown(book: DataFrame, keys: list[str], order: list[str], start: float) -> DataFrame:
    """Per book: the current and the largest drawdown of start + running result from its peak so far, in percent."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = book.withColumn("v", start + F.sum("pnl").over(w))
    b = b.withColumn("peak", F.greatest(F.lit(start), F.max("v").over(w))).withColumn("dd", (F.col("peak") - F.col("v")) / F.col("peak") * 100.0)
    return b.groupBy(*keys).agg(F.max_by("dd", F.struct(*order)).alias("current_drawdown"), F.max("dd").alias("max_drawdown"))


RANGES, MOST_RANGES, PER_RANGE = 64, 1024, 10_000  # so many ranges of rows, and between these about so many rows in each


def ranged(df: DataFrame, value: str, n: int, least: int = RANGES, most: int = MOST_RANGES) -> tuple[DataFrame, str]:
    """df with a range number that grows with `value` (NULL last) and the name of its column.

    Bounds are approximate quantiles, so ranges hold about as many rows each however the values are spread; `least` ranges at least, `most` at most.
    """
    k = min(most, max(least, n // PER_RANGE))
    bounds = k > 1 and df.agg(F.percentile_approx(F.col(value).cast("double"), [i / k for i in range(1, k)], 10 * k).alias("b")).first()["b"] or []
    bounds = sorted({b for b in bounds if b == b})  # NaN is larger than all
    own = "_range"
    while own in df.columns:
        own += "_"
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]  # a binary search: the cost of a row is the logarithm of the ranges
    below = lambda at, step: at + F.when(F.get(F.lit(bounds), at + step - 1) < F.col(value), step).otherwise(0)
    rank = F.aggregate(F.lit(steps), F.lit(0), below) if len(bounds) else F.lit(0)
    return df.withColumn(own, F.when(F.col(value).isNull(), len(bounds) + 1).otherwise(rank)), own


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """df with avg_rank, ties sharing the mean of their ranks; NULL for NULL.

    Ranks come from counts per distinct value in two stages: values are dealt into ranges of about equal counts, ranges get
    offsets, and only counts are summed, never rows in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    counts, r = ranged(counts, value, counts.count())
    per = counts.groupBy(r).agg(F.sum("c").alias("s"))  # a row for each range
    offset = per.select(r, (F.sum("s").over(Window.orderBy(r).rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("o"))
    w = Window.partitionBy(r).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.join(offset, r).select(value, (F.col("o") + F.sum("c").over(w) - F.col("c") + (F.col("c") + 1) / 2).alias("avg_rank"))
    return df.join(ranks, value, "left")


def chrono_split(df: DataFrame, key: str, share: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with split: the earliest floor(n * share) rows by `key`, then `ties`, are train; NULL keys are the latest."""
    cut = int(df.count() * share)
    ranked = global_row_number(df, key, ties)
    return ranked.withColumn("split", F.when(F.col("row") <= cut, "train").otherwise("test")).drop("row")


def chrono_parts(df: DataFrame, key: str, shares: dict[str, float], ties: tuple[str, ...] = ()) -> DataFrame:
    """df with split: parts in order of `key`, then `ties`, each with its share of the rows; the last takes what is left."""
    n, at, split = df.count(), 0.0, F.when(F.lit(False), "")
    for name, share in list(shares.items())[:-1]:
        at += share
        split = split.when(F.col("row") <= int(n * at), name)
    return global_row_number(df, key, ties).withColumn("split", split.otherwise(list(shares)[-1])).drop("row")


def global_row_number(df: DataFrame, key: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with row: the position by a numeric key (NULL last) and ties, from offsets of key ranges and numbers within a range."""
    d, r = ranged(df, key, df.count())
    per = d.groupBy(r).agg(F.count("*").alias("s"))  # a row for each range
    offset = per.select(r, (F.sum("s").over(Window.orderBy(r).rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("_o"))
    return d.join(offset, r).withColumn("row", F.col("_o") + F.row_number().over(Window.partitionBy(r).orderBy(F.col(key).asc_nulls_last(), *ties))).drop(r, "_o")


def grouped_split(df: DataFrame, group: str, key: str, share: float) -> DataFrame:
    """Train and test by groups in order of their first key (ties by group); no group is on both sides."""
    first = df.groupBy(group).agg(F.min(key).alias("f"))
    cut = int(first.count() * share)
    order = global_row_number(first, "f", (group,))
    return df.join(order.select(group, F.when(F.col("row") <= cut, "train").otherwise("test").alias("split")), group)


def time_folds(df: DataFrame, key: str, k: int, burn: float = 0.1) -> DataFrame:
    """df with fold 0..k-1 of equal duration, after the first `burn` share of the time span; earlier rows are dropped."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return df.withColumn("fold", F.lit(0)).limit(0)
    start = lo + (hi - lo) * burn
    width = (hi - start) / k or 1.0
    return df.where(F.col(key) >= start).withColumn("fold", F.least(F.floor((F.col(key) - start) / width), F.lit(k - 1)).cast("int"))


def burn_in(tokens: DataFrame, trades: DataFrame, split: float, window: float) -> tuple[DataFrame, DataFrame]:
    """Training entities whose whole window ends before the split, and their events before it."""
    t = tokens.where(F.col("created_at") + window < split)
    return t, trades.join(t.select("entity_id"), "entity_id", "left_semi").where(F.col("ts") < split)


def tail_outcomes(df: DataFrame, score: str, outcome: str, tie: str, parts: int = 4) -> DataFrame:
    """Mean outcome of the top and the bottom n div parts rows by score (ties by `tie`)."""
    n = df.count()
    k = n // parts
    top = df.orderBy(F.desc(score), tie).limit(k).agg(F.lit("top").alias("tail"), F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"))
    low = df.orderBy(score, tie).limit(k).agg(F.lit("bottom").alias("tail"), F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"))
    return top.unionByName(low)


#: A value's rank is taken apart into digits of this base, one window for each.
RADIX = 16
SMALL = 256  # rows of a key whose running medians one window takes as they are


def running_median(rows: DataFrame, key: str, order: list[str], value: str, name: str, small: int = SMALL) -> DataFrame:
    """rows with `name`: the median of the non-null `value`s of the key's earlier rows in `order`, NULL without any.

    Keys of at most `small` rows: a percentile over what came before, in the window that sorts the rows anyway; nothing else is shuffled. The result is
    written once. Larger keys, if there are any: a descent through the digits of ranks. Values are ranked within their key; each row asks for the middle
    places among what came before it. At every level the values and the questions that share the digits so far lie in time order, and running counts by the
    next digit tell where a place lies. What a task holds does not grow with a key: windows run over sorted rows and carry RADIX counts. Levels: the logarithm
    of the largest key to the base RADIX. Rows of equal order are put in any order.
    """
    from .actors import _shared

    c = F.col
    in_time = Window.partitionBy(key).orderBy(*order)
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    t = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    few = F.when(c("_n") <= small, c(value))
    t = t.withColumn("_at", F.row_number().over(in_time)).withColumn("_m", F.count(value).over(before)).withColumn("_few", F.percentile(few, F.lit(0.5)).over(before))
    t = _shared(t)
    # the values of a key that has none ask for no level
    most = t.where(c("_n") > small).groupBy(key).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0]
    if not most:
        return t.select(*rows.columns, c("_few").alias(name))
    levels = 1
    while RADIX**levels < most:
        levels += 1
    big = t.where(c("_n") > small)
    big = big.withColumn("_rank", F.when(c(value).isNotNull(), F.count(value).over(Window.partitionBy(key).orderBy(F.col(value).asc_nulls_last(), "_at").rowsBetween(Window.unboundedPreceding, -1))))
    big = _shared(big.select(c(key).alias("_key"), "_at", "_m", "_rank", c(value).alias("_v")))
    items = big.where("_v is not null").select("_key", "_at", F.lit(1).alias("kind"), c("_rank").alias("k"))
    middle = F.explode(F.array(F.floor((c("_m") - 1) / 2), F.floor(c("_m") / 2)))
    asked = big.where("_m > 0").select("_key", "_at", F.lit(0).alias("kind"), middle.alias("k"))
    u = items.unionByName(asked).withColumn("prefix", F.lit(0).cast("long"))
    for level in reversed(range(levels)):
        w = Window.partitionBy("_key", "prefix").orderBy("_at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.floor(c("k") / RADIX**level) % RADIX  # of an item: k stays its rank
        upto = [F.count_if((c("kind") == 1) & (own <= j)).over(w) for j in range(RADIX - 1)]
        u = u.withColumn("counts", F.array(F.lit(0).cast("long"), *upto))
        taken = F.size(F.filter("counts", lambda x: x <= c("k"))) - 1  # of a question: below how many digits its place is not
        u = u.withColumn("digit", F.when(c("kind") == 1, own).otherwise(taken))
        left = F.when(c("kind") == 1, c("k")).otherwise(c("k") - F.get("counts", c("digit").cast("int")))
        u = u.withColumn("left", left).select("_key", "_at", "kind", c("left").alias("k"), (c("prefix") * RADIX + c("digit")).alias("prefix"))
    found = u.where("kind = 0").select("_key", "_at", c("prefix").alias("_rank"))
    values = big.where("_v is not null").select("_key", "_rank", "_v")
    found = found.join(values.withColumnsRenamed({"_key": "_of_key", "_rank": "_of_rank"}), c("_key").eqNullSafe(c("_of_key")) & (c("_rank") == c("_of_rank"))).groupBy("_key", "_at").agg(F.avg("_v").alias("_many"))
    found = found.withColumnsRenamed({"_at": "_of"})
    return t.join(found, c(key).eqNullSafe(c("_key")) & (c("_at") == c("_of")), "left").select(*rows.columns, F.coalesce("_few", "_many").alias(name))
