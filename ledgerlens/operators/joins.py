"""As-of, interval and bucketed range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import ranged


def asof(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """left with the `values` of the latest row of right per key, at or (strict) before its time; NULL if there is none.

    Both sides are merged and the last value seen is carried on: one shuffle by key and one sort, without a range
    condition. At equal times rows of right come first, or last if strict; among them `tie` decides.
    """
    struct = F.struct(right_ts, *values)
    blank = F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType)
    payload = F.struct(*left.columns)
    order = F.lit(None).cast(right.schema[tie].dataType) if tie else F.lit(None).cast("int")
    a = left.select(F.col(key), F.col(left_ts).alias("_t"), F.lit(0 if strict else 1).alias("_side"), order.alias("_tie"), payload.alias("_p"), blank.alias("_v"))
    b = right.select(F.col(key), F.col(right_ts).alias("_t"), F.lit(1 if strict else 0).alias("_side"), (F.col(tie) if tie else order).alias("_tie"), F.lit(None).cast(a.schema["_p"].dataType).alias("_p"), struct.alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_p is not null")
    return out.select("_p.*", f"_last.{right_ts}", *(f"_last.{v}" for v in values))


def prior_by_order(tokens: DataFrame) -> DataFrame:
    """A creator's earlier entities by insert_order: their number (NULL for none), first and last creation."""
    w = Window.partitionBy("creator_id").orderBy("insert_order").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(w)
    return tokens.select("entity_id", F.when(n > 0, n).alias("n_prior"), F.min("created_at").over(w).alias("first_prior"), F.max("created_at").over(w).alias("last_prior"))


def scd2(flags: DataFrame, key: str, start: str) -> DataFrame:
    """Versions as intervals: each is valid until the key's next one starts; the last stays open."""
    return flags.withColumn("valid_to", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def flag_at(probes: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """The flag valid at each probe (key, ts): of the key's intervals [valid_from, valid_to) that hold ts, also overlapping ones, the one that started last.

    A segment tree as equi-joins. The starts and ends of a key cut its time into segments, numbered in order; an interval is a run of
    segments and so the union of a few nodes, runs of 2^level segments that start at a multiple of that, at most two for each level. All
    intervals of a node hold all its times, so one is enough: the last started. A probe looks at the node of its segment on each level.
    Cost: probes and intervals times the logarithm of a key's intervals, whatever overlaps. valid_to NULL: open. Repeated probes are looked up once
    and answered each; they are told apart by key and time, which stay the same when a task runs again, and not by a number of their row.
    """
    c = F.col
    of = intervals.where(c(key).isNotNull() & c("valid_from").isNotNull() & (c("valid_to").isNull() | (c("valid_to") > c("valid_from"))))
    of = of.select(c(key).alias("_k"), "flag", "valid_from", "valid_to")
    # places in time: of starts, ends and probes together; a segment is the number of different starts and ends at or before a time
    edge = of.select("_k", c("valid_from").alias("_t")).unionByName(of.where("valid_to is not null").select("_k", c("valid_to").alias("_t"))).distinct()
    edge = edge.withColumn("_s", F.row_number().over(Window.partitionBy("_k").orderBy("_t")).cast("long"))
    top = edge.groupBy("_k").agg(F.max("_s").alias("_top"))
    run = of.join(edge.select("_k", c("_t").alias("valid_from"), c("_s").alias("_i")), ["_k", "valid_from"]).join(edge.select("_k", c("_t").alias("valid_to"), c("_s").alias("_j")), ["_k", "valid_to"], "left")
    run = run.join(top, "_k").withColumn("_j", F.coalesce("_j", c("_top") + 1))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(c("_top") + 2)).cast("int"))
    run = run.withColumn("_level", F.explode(levels)).withColumn("_l", F.ceil(c("_i") / F.pow(F.lit(2.0), "_level"))).withColumn("_r", F.floor(c("_j") / F.pow(F.lit(2.0), "_level")))
    nodes = F.array(F.when(c("_l") % 2 == 1, c("_l")), F.when(c("_r") % 2 == 1, c("_r") - 1))
    run = run.where("_l < _r").withColumn("_node", F.explode(F.array_distinct(F.array_compact(nodes))))
    best = run.groupBy("_k", "_level", "_node").agg(F.max(F.struct("valid_from", "flag")).alias("_b"))
    # a probe's segment: the last edge at or before it
    time = c("ts").cast(edge.schema["_t"].dataType)
    asked = probes.select(c(key).alias("_k"), time.alias("_t")).where("_k is not null and _t is not null").distinct()
    u = edge.select("_k", "_t", F.lit(0).alias("_side"), "_s").unionByName(asked.withColumns({"_side": F.lit(1), "_s": F.lit(None).cast("long")}))
    u = u.withColumn("_s", F.last("_s", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1 and _s is not null")
    look = u.join(top, "_k").withColumn("_level", F.explode(levels)).withColumn("_node", F.floor(c("_s") / F.pow(F.lit(2.0), "_level")))
    found = look.join(best, ["_k", "_level", "_node"]).groupBy("_k", "_t").agg(F.max("_b").alias("_b"))
    return probes.join(found, (c(key) == c("_k")) & (time == c("_t")), "left").select(*(probes[x] for x in probes.columns), c("_b.flag").alias("flag"))


def co_actor_pairs(trades: DataFrame, gap: float, least: int) -> DataFrame:
    """(a, b, n_shared): actors a < b whose first buys of at least `least` entities lie within `gap` seconds.

    First buys are put in time buckets of `gap`; a pair within it shares a bucket or has neighbouring ones, so the self-join is an
    equi-join on (entity, bucket) followed by the exact test.
    """
    first = trades.where("side = 'buy'").groupBy("entity_id", "actor_id").agg(F.min("ts").alias("t")).withColumn("bucket", F.floor(F.col("t") / gap))
    left = first.select("entity_id", F.col("actor_id").alias("a"), F.col("t").alias("ta"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = first.select("entity_id", F.col("actor_id").alias("b"), F.col("t").alias("tb"), "bucket")
    near = left.join(right, ["entity_id", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= gap))
    return near.groupBy("a", "b").agg(F.count_distinct("entity_id").alias("n_shared")).where(F.col("n_shared") >= least)


DIGIT, WHOLE = 16, 1 << 16  # base of the digits of ranks; so many rows of a prefix are counted in one go


def ranged_count(tokens: DataFrame, span: float, open_start: bool) -> DataFrame:
    """Per entity, how many others of a smaller insert_order were created in the `span` seconds before it.

    The start of the span counts unless open_start; the entity's own instant never does. No pairs are made: the count is the number of earlier
    orders created before the instant less that before the span, and each of them a sum over the digits of the order's rank: of the rows that share the
    higher digits those with a smaller digit, created before. Rows of all levels are shuffled once, by prefix and, where a prefix has many rows, by range of
    time; running counts and offsets of the ranges do the rest. Cost: rows times the logarithm of their number, however many lie within a span.
    """
    from .actors import _shared

    c = F.col
    t = tokens.where("insert_order is not null and created_at is not null").select("entity_id", c("insert_order").alias("o"), c("created_at").cast("double").alias("c"))
    n = t.count()
    d, r = ranged(t, "o", n)
    per = d.groupBy(r).agg(F.count("*").alias("s"))  # a row for each range
    offset = per.select(r, (F.sum("s").over(Window.orderBy(r).rowsBetween(Window.unboundedPreceding, 0)) - c("s")).alias("before"))
    # equal orders lie in one range and have the same rank
    at = _shared(d.join(F.broadcast(offset), r).select("entity_id", "c", (c("before") + F.rank().over(Window.partitionBy(r).orderBy("o")) - 1).alias("rank")))
    # what is asked for: creations before c, less those before (or, if open, also at) c - span
    low = F.struct((c("c") - span).alias("t"), F.lit(2 if open_start else 0).alias("side"), F.lit(-1).alias("sign"))
    high = F.struct(c("c").alias("t"), F.lit(0).alias("side"), F.lit(1).alias("sign"))
    point = F.struct(c("c").alias("t"), F.lit(1).alias("side"), F.lit(0).alias("sign"))
    u = at.select("entity_id", "rank", F.inline(F.array(low, high, point)))
    u, when = ranged(u, "t", 3 * n)
    levels = 1
    while DIGIT**levels < n:
        levels += 1
    place = F.array(*(F.struct(F.lit(i).alias("level"), F.floor(c("rank") / DIGIT ** (i + 1)).alias("prefix"), (F.floor(c("rank") / DIGIT**i) % DIGIT).cast("int").alias("digit"), F.when(F.lit(DIGIT ** (i + 1) > WHOLE), c(when)).otherwise(0).alias("part")) for i in range(levels)))
    u = u.select("entity_id", "t", "side", "sign", F.inline(place)).where(f"(sign = 0 and digit < {DIGIT - 1}) or (sign <> 0 and digit > 0)")
    group, is_point = ["level", "prefix"], c("sign") == 0
    counts = lambda w: F.array(*(F.count_if(is_point & (c("digit") <= j)).over(w) for j in range(DIGIT - 1)))
    u = u.withColumn("seen", F.get(counts(Window.partitionBy(*group, "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)), c("digit") - 1))
    inside = u.where("sign <> 0").groupBy("entity_id").agg(F.sum(c("sign") * c("seen")).alias("inside"))
    # whole ranges of time before a row's own, of the prefixes that are dealt by time: a row for each prefix, digit and range
    dealt = u.where(c("level") >= min((i for i in range(levels) if DIGIT ** (i + 1) > WHOLE), default=levels))
    cells = dealt.groupBy(*group, "part").agg(*(F.count_if(is_point & (c("digit") <= j)).alias(f"n{j}") for j in range(DIGIT - 1)))
    w = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, "part", F.array(*(F.coalesce(F.sum(f"n{j}").over(w), F.lit(0)) for j in range(DIGIT - 1))).alias("whole"))
    outside = dealt.where("sign <> 0").join(cells, [*group, "part"]).groupBy("entity_id").agg(F.sum(c("sign") * F.get("whole", c("digit") - 1)).alias("outside"))
    found = inside.join(outside, "entity_id", "left").select("entity_id", (c("inside") + F.coalesce("outside", F.lit(0))).alias("n"))
    return tokens.select("entity_id").join(found, "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).alias("n"))
