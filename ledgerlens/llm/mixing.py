"""Mixing sources to target weights: random order within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import materialize, stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for sources (source, source_size): a share of all sizes dealt by weight.

    Sources are ranked by code point, null last, and weigh weights[rank modulo their number]. A target stops at
    `most` times its source's size; the excess is dealt to the others by weight, again and again. Ranks come from ranges of
    sources, counted, and numbered within; the loop looks at sums only.
    """
    first = F.col("source").asc_nulls_last()
    dealt = materialize(sources.repartitionByRange(first).select("source", "source_size", F.spark_partition_id().alias("part")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    offset = dealt.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    table = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(first))).join(offset, "part").withColumn("rank", F.col("offset") + F.col("n") - 1)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(table.select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1  # words per unit of weight; a source is full once its share reaches its cap
    while True:
        is_full = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, weight, n = table.agg(F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))), F.sum(is_full.cast("long"))).first()
        if n == full or not weight:
            break
        level, full = max(level, (share * total - capped) / weight), n
    return table.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, per_bucket: int = 2000) -> DataFrame:
    """docs (doc_id, text, source and any other columns) with size, source_size, target and taken.

    size is the number of words `[^\\x20\\x09-\\x0D]+` (null: 0). Each document gets a random key hashed from its id and
    text; within its source the documents lie in the order of their keys. A source takes whole epochs of its documents
    and then, in that order, up to its exact budget: `taken` counts the words of the document that the mix takes,
    repeats included, and the document at the cut gives a part. Sources without words and documents without words take
    none. Null is a source of its own. Rows that repeat count each; equal rows are interchangeable. Reruns agree. Columns of
    docs keep their values whatever their names, but those named like the results are replaced.

    Keys are uniform, so their leading bits range-partition a source evenly whatever its size: sums per (source, range)
    show in which range the budget ends, and prefix sums within that range alone give the key at which the source is cut.
    Every document then decides by its own key, so texts are never shuffled.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    own = "_"  # starts the names of columns used on the way, and no name of docs
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    key, named, goal_size, goal, epochs, cut, rest, n_at, place = (own + c for c in ("key", "named", "size", "goal", "epochs", "cut", "rest", "n", "place"))
    random = F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseXOR(F.lit(-(1 << 63)))
    sized = docs.withColumn("size", word_count("text")).withColumn(key, random)
    slim = materialize(sized.select("source", "size", F.col(key).alias("key")))
    cuts = stored(_cuts(slim, list(weights), share, most, per_bucket))
    cuts = cuts.select(*(F.col(c).alias(n) for c, n in (("source", named), ("source_size", goal_size), ("target", goal), ("epochs", epochs), ("cut", cut), ("rest", rest), ("n", n_at))))
    placed = sized.join(cuts, F.col("source").eqNullSafe(F.col(named)))
    at_cut = F.coalesce(F.col(key) == F.col(cut), F.lit(False))
    if cuts.where(F.col(n_at) > 1).isEmpty():
        placed = placed.withColumn(place, F.lit(1))
    else:  # rows that repeat share the key at which their source is cut: they are numbered
        among = Window.partitionBy(named).orderBy("doc_id")
        placed = placed.where(~at_cut).withColumn(place, F.lit(1)).unionByName(placed.where(at_cut).withColumn(place, F.row_number().over(among)))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col(rest) - (F.col(place) - 1) * F.col("size")))
    more = F.when(F.col(key) < F.col(cut), F.col("size")).when(at_cut, part).otherwise(F.lit(0))
    taken = (F.col("size") * F.col(epochs) + more).cast("long")
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), "size", F.col(goal_size).alias("source_size"), F.col(goal).alias("target"), taken.alias("taken"))


def _cuts(slim: DataFrame, weights: list[float], share: float, most: float, per_bucket: int) -> DataFrame:
    """(source, source_size, target, epochs, cut, rest, n) for slim (source, size, key): after its whole epochs a source takes the
    documents with keys below `cut` and `rest` words of the n that have it; cut is NULL where nothing more is taken."""
    bits = max(0, (slim.count() // per_bucket).bit_length())
    slim = slim.withColumn("part", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = materialize(slim.groupBy("source", "part").agg(F.sum("size").alias("words")))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = materialize(goals.withColumn("epochs", epochs).withColumn("left", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    reach = sums.withColumn("after", F.sum("words").over(upto)).alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source"))
    here = reach.where("left > 0 and after - words <= left and left < after").select(F.col("s.source").alias("source"), "part", (F.col("left") - F.col("after") + F.col("words")).alias("rest"))  # one range of a source
    keys = slim.alias("d").join(here.alias("h"), F.expr("d.source <=> h.source and d.part = h.part")).groupBy(F.col("d.source").alias("source"), "key", "rest").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    keys = keys.withColumn("after", F.sum("words").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    cut = keys.where("after - words <= rest and rest < after").select("source", F.col("key").alias("cut"), (F.col("rest") - F.col("after") + F.col("words")).alias("rest"), "n")
    # where the budget is all of a source, nothing lies behind the cut
    whole = F.when(F.col("left") >= F.col("source_size"), F.lit((1 << 63) - 1))
    return goals.alias("g").join(cut.alias("c"), F.expr("g.source <=> c.source"), "left").select("g.source", "source_size", "target", "epochs", F.coalesce("cut", whole).alias("cut"), F.coalesce("c.rest", F.lit(0)).cast("long").alias("rest"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))
