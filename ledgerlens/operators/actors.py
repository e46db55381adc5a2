"""Actors, creators and holders: activity, history as of a moment, clusters."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof
from .windows import running_median


def activity(trades: DataFrame) -> DataFrame:
    """Per (actor, entity): volumes by side, first and last event, realised result, closed flag."""
    buy = F.col("side") == "buy"
    g = trades.groupBy("actor_id", "entity_id").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.coalesce(F.sum(F.when(buy, F.col("amount"))), F.lit(0.0)).alias("buy_amount"),
        F.coalesce(F.sum(F.when(~buy, F.col("amount"))), F.lit(0.0)).alias("sell_amount"),
    )
    return g.withColumn("realized", F.col("sell_amount") - F.col("buy_amount")).withColumn("is_closed", (F.col("buy_amount") > 0) & (F.col("sell_amount") > 0))


def actor_stats(trades: DataFrame, tokens: DataFrame, now: float, recent: float) -> DataFrame:
    """Per actor, over buys: age at the fastest, coefficient of variation of amounts, counts in all and recently."""
    b = trades.where("side = 'buy'").join(tokens.select("entity_id", "created_at"), "entity_id")
    mean = F.avg("amount")
    return b.groupBy("actor_id").agg(
        F.min(F.col("ts") - F.col("created_at")).alias("fastest_buy_age"),
        F.when(mean > 0, F.stddev_pop("amount") / mean).alias("amount_cv"),
        F.count("*").alias("n_buys"),
        F.count_if(F.col("ts") >= now - recent).alias("n_buys_recent"),
    )


def median_hold(act: DataFrame) -> DataFrame:
    return act.where("is_closed").groupBy("actor_id").agg(F.percentile(F.col("last_ts") - F.col("first_ts"), F.lit(0.5)).alias("median_hold"))


def graduated_winrate(act: DataFrame, trades: DataFrame, peak: float, least: int) -> DataFrame:
    """Of entities whose valuation reached `peak`: how many an actor closed and how often at a gain, from `least` on."""
    grown = trades.groupBy("entity_id").agg(F.max("mcap").alias("peak")).where(F.col("peak") >= peak).select("entity_id")
    g = act.where("is_closed").join(grown, "entity_id").groupBy("actor_id").agg(F.count("*").alias("n_graduated"), F.avg((F.col("realized") > 0).cast("double")).alias("graduated_winrate"))
    return g.where(F.col("n_graduated") >= least)


def actor_flags(stats: DataFrame, hold: DataFrame, wins: DataFrame, fast: float, cv: float, busy: int, short: float, winrate: float) -> DataFrame:
    """sniper: two of four signs; bot: all of them; smart: a high win rate on graduated entities."""
    j = stats.join(hold, "actor_id", "left").join(wins, "actor_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    signs = yes(F.col("fastest_buy_age") <= fast) + yes(F.col("amount_cv") <= cv) + yes(F.col("n_buys_recent") >= busy) + yes(F.col("median_hold") <= short)
    return j.select("actor_id", "fastest_buy_age", "amount_cv", "n_buys", "n_buys_recent", "median_hold", "n_graduated", "graduated_winrate", (signs >= 2).alias("is_sniper"), (signs == 4).alias("is_bot"), F.coalesce(F.col("graduated_winrate") >= winrate, F.lit(False)).alias("is_smart"))


def _shared(df: DataFrame) -> DataFrame:
    """Written once to the cluster's shared checkpoint folder; later rounds read it from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def clusters(pairs: DataFrame) -> DataFrame:
    """(actor_id, cluster_id, cluster_size) of the graph of pairs (a, b): the smallest actor reachable.

    Labels fall to the least among neighbours and jump to their label's label, until nothing changes.
    """
    e = _shared(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = _shared(e.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("c")))
    while True:
        near = e.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        step = label.join(near, "a").select("a", F.least("c", "n").alias("m"), "c")
        jump = step.join(label.select(F.col("a").alias("m"), F.col("c").alias("j")), "m").select("a", F.least("m", "j").alias("m"), "c")
        jump = _shared(jump)
        changed = jump.where("m <> c").limit(1).count()
        label = jump.select("a", F.col("m").alias("c"))
        if not changed:
            break
    size = label.groupBy("c").agg(F.count("*").alias("cluster_size"))
    return label.join(size, "c").select(F.col("a").alias("actor_id"), F.col("c").alias("cluster_id"), "cluster_size")


def flag_report(flags: DataFrame) -> DataFrame:
    """Counts and shares in percent per flag."""
    n = flags.agg(F.count("*").alias("n_actors"), *(F.count_if(c).alias(c) for c in ("is_sniper", "is_bot", "is_smart")))
    return n.select("n_actors", *(x for c in ("is_sniper", "is_bot", "is_smart") for x in (F.col(c).alias(f"n_{c[3:]}"), (F.col(c) / F.col("n_actors") * 100.0).alias(f"pct_{c[3:]}"))))


def prior_stats(top: DataFrame, act: DataFrame) -> DataFrame:
    """For buyers (entity_id, actor_id, rank, cutoff): what they did elsewhere, ended before the cutoff.

    One pass per actor over the union of activity and probes: running sums, so that an actor with many entities and many probes
    costs a sort and not their product. Ties: activity that ends at the cutoff is not before it. What is known of the entity itself
    comes from the same rows, dealt by actor already, and not from a join, which would deal activity once more.
    """
    # only closed positions have a result that counts
    a = act.select("actor_id", F.col("last_ts").alias("t"), F.lit(1).alias("kind"), "is_closed", F.when(F.col("is_closed"), F.col("realized")).alias("realized"), "first_ts", "entity_id", F.lit(None).cast("int").alias("rank"))
    p = top.select("actor_id", F.col("cutoff").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("boolean").alias("is_closed"), F.lit(None).cast("double").alias("realized"), F.lit(None).cast("double").alias("first_ts"), "entity_id", "rank")
    w = Window.partitionBy("actor_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    is_a = F.col("kind") == 1
    of_own = Window.partitionBy("actor_id", "entity_id")  # activity has a row for each
    own = lambda c, name: F.max(F.when(is_a & F.col("actor_id").isNotNull(), F.col(c))).over(of_own).alias(name)
    run = a.unionByName(p).select(
        "*",
        F.count_if(is_a).over(w).alias("n"),
        F.count_if(is_a & F.col("is_closed")).over(w).alias("n_closed"),
        F.count_if(is_a & F.col("is_closed") & (F.col("realized") > 0)).over(w).alias("n_won"),
        F.sum(F.when(is_a & F.col("is_closed"), F.col("realized"))).over(w).alias("sum_realized"),
        F.min(F.when(is_a, F.col("first_ts"))).over(w).alias("first_seen"),
    )
    # the entity itself is not among them: its activity ends after the cutoff or is taken off again
    out = run.select("*", own("t", "o_last"), own("is_closed", "o_closed"), own("realized", "o_realized")).where("kind = 0")
    mine = F.coalesce(F.col("o_last") < F.col("t"), F.lit(False))
    return out.select(
        "entity_id",
        "actor_id",
        "rank",
        F.col("t").alias("cutoff"),
        (F.col("n") - mine.cast("int")).alias("n_prior"),
        (F.col("n_closed") - (mine & F.col("o_closed")).cast("int")).alias("n_closed"),
        (F.col("n_won") - (mine & F.col("o_closed") & (F.col("o_realized") > 0)).cast("int")).alias("n_won"),
        (F.coalesce("sum_realized", F.lit(0.0)) - F.when(mine & F.col("o_closed"), F.col("o_realized")).otherwise(0.0)).alias("sum_realized"),
        "first_seen",
    )


def prior_buyer_features(prior: DataFrame) -> DataFrame:
    """Per entity, over its top buyers with history: top-3 and, beyond 3 buyers, top-10 features; NULL without history."""
    has = F.col("n_prior") > 0
    top3, win = has & (F.col("rank") <= 3), F.col("n_won") / F.col("n_closed")
    day = 86400.0
    age = F.when(F.col("cutoff") > F.col("first_seen"), (F.col("cutoff") - F.col("first_seen")) / day)
    more = F.count("*") > 3
    return prior.groupBy("entity_id").agg(
        F.avg(F.when(top3, F.col("n_prior"))).alias("top3_prior"),
        F.avg(F.when(top3 & (F.col("n_closed") > 0), win)).alias("top3_winrate"),
        F.max(F.when(top3 & (F.col("n_closed") > 0), win)).alias("top3_best_winrate"),
        F.avg(F.when(top3, age)).alias("top3_age_days"),
        F.avg(F.when(top3, F.col("sum_realized"))).alias("top3_realized"),
        F.when(more, F.avg(F.when(has, F.col("n_prior")))).alias("top10_prior"),
        F.when(more, F.avg(F.when(has & (F.col("n_closed") > 0), win))).alias("top10_winrate"),
    )


def creator_snapshots(tokens: DataFrame, trades: DataFrame, rug: float, graduated: float) -> DataFrame:
    """At each entity's creation, what its creator's earlier entities came to.

    Per (creator_id, ref_ts): count, rugs (0 < last valuation < rug and reserve share < graduated), graduations, median of the
    positive peaks, mean lifetime, mean interval between creations, age in days.
    """
    last = F.struct("ts", "event_id")
    per = trades.groupBy("entity_id").agg(F.max("mcap").alias("peak"), F.max_by("mcap", last).alias("last_mcap"), F.max("reserve").alias("top_reserve"), F.max("ts").alias("last_ts"))
    t = tokens.join(per, "entity_id", "left")
    pct = F.least(F.col("top_reserve") / 85.0 * 100.0, F.lit(100.0))
    t = t.withColumn("rug", (F.col("last_mcap") > 0) & (F.col("last_mcap") < rug) & (pct < graduated)).withColumn("grad", pct >= graduated).withColumn("ttl", F.col("last_ts") - F.col("created_at"))
    w = Window.partitionBy("creator_id").orderBy("created_at", "insert_order").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("n", F.count("*").over(w)).withColumn("lo", F.min("created_at").over(w)).withColumn("hi", F.max("created_at").over(w))
    t = t.withColumn("rug_count", F.count_if("rug").over(w)).withColumn("graduated_count", F.count_if("grad").over(w)).withColumn("avg_ttl", F.avg("ttl").over(w))
    t = t.withColumn("positive", F.when(F.col("peak") > 0, F.col("peak")))
    t = running_median(t, "creator_id", ["created_at", "insert_order"], "positive", "median_peak")
    return t.select(
        "creator_id",
        "entity_id",
        F.col("created_at").alias("ref_ts"),
        F.col("n").alias("n_prior"),
        "rug_count",
        "graduated_count",
        "median_peak",
        "avg_ttl",
        F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1)).alias("mean_interval"),
        ((F.col("created_at") - F.col("lo")) / 86400.0).alias("age_days"),
    )


def creator_blacklist(snapshots: DataFrame, old: DataFrame, least: int, max_grad: float, max_median: float) -> DataFrame:
    """The latest snapshot per creator against the flags so far: (creator_id, was, is, change)."""
    latest = snapshots.groupBy("creator_id").agg(F.max_by(F.struct("n_prior", "graduated_count", "median_peak"), F.struct("ref_ts", "entity_id")).alias("s"))
    bad = (F.col("s.n_prior") >= least) & (F.col("s.graduated_count") / F.col("s.n_prior") < max_grad) & (F.col("s.median_peak") < max_median)
    now = latest.select("creator_id", F.coalesce(bad, F.lit(False)).alias("is_flagged"))
    j = now.join(old.select("creator_id", F.lit(True).alias("was")), "creator_id", "full").select("creator_id", F.coalesce("was", F.lit(False)).alias("was_flagged"), F.coalesce("is_flagged", F.lit(False)).alias("is_flagged"))
    change = F.when(F.col("is_flagged") & ~F.col("was_flagged"), "on").when(F.col("was_flagged") & ~F.col("is_flagged"), "off").otherwise("same")
    return j.withColumn("change", change)


def holder_samples(tokens: DataFrame, trades: DataFrame, ages: tuple, partial_below: int = 20) -> DataFrame:
    """(entity_id, age, top1_pct, top5_pct, top10_pct, holder_count, is_partial): balances of actors up to each age."""
    t = tokens.select("entity_id", "created_at", F.explode(F.array(*map(F.lit, ages))).alias("age"))
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    b = trades.join(t, "entity_id").where(F.col("ts") <= F.col("created_at") + F.col("age")).groupBy("entity_id", "age", "actor_id").agg(F.sum(signed).alias("bal")).where("bal > 0")
    w = Window.partitionBy("entity_id", "age")
    b = b.withColumn("r", F.row_number().over(w.orderBy(F.desc("bal"), "actor_id"))).withColumn("total", F.sum("bal").over(w))
    pct = lambda n: (F.sum(F.when(F.col("r") <= n, F.col("bal"))) / F.max("total") * 100.0).alias(f"top{n}_pct")
    return b.groupBy("entity_id", "age").agg(pct(1), pct(5), pct(10), F.count("*").alias("holder_count"), (F.count("*") < partial_below).alias("is_partial"))


def holder_extrapolated(samples: DataFrame, a1: float, a2: float) -> DataFrame:
    """The next sample from two: twice the second less the first, kept within 0..100; counts never fall; with velocities."""
    g = samples.groupBy("entity_id").agg(*(F.max(F.when(F.col("age") == a, F.col(c))).alias(f"{c}_{i}") for i, a in ((1, a1), (2, a2)) for c in ("top1_pct", "holder_count")))
    ahead = F.col("top1_pct_2") * 2 - F.col("top1_pct_1")
    nxt = F.when(ahead.isNotNull(), F.least(F.greatest(ahead, F.lit(0.0)), F.lit(100.0)))
    count = F.when(F.col("holder_count_1").isNotNull() & F.col("holder_count_2").isNotNull(), F.greatest(F.col("holder_count_2") * 2 - F.col("holder_count_1"), "holder_count_1", "holder_count_2"))
    g = g.withColumn("top1_pct_3", nxt).withColumn("holder_count_3", count)
    return g.withColumn("top1_delta", F.col("top1_pct_3") - F.col("top1_pct_1")).withColumn("holder_velocity", (F.col("holder_count_3") - F.col("holder_count_1")) / 90.0)


def latest_snapshot(probes: DataFrame, snapshots: DataFrame, strict: bool = False) -> DataFrame:
    """Each probe (creator_id, ts) with its creator's latest snapshot at or, if strict, before it."""
    return asof(probes, snapshots, "creator_id", "ts", "observed_at", ["n_prior", "rug_count", "graduated_count"], strict=strict, tie="id")
