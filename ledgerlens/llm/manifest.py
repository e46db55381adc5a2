"""Merkle manifest of a dataset: a tree for each source, one tree above them, and proofs by a recursive query.

Leaves are digests of whole rows. Three digests at a time become the digest of their concatenation, level by level.
Texts are read once; from then on only digests travel. Leaves get their places by a range sort. 27 consecutive leaves
(FAMILY, three levels) are hashed together in one row, so that a level costs a row for 27 leaves; the heads of families are
hashed in the same way until one digest is left. Every node above a family becomes a row of the links table: itself, its
parent, and the digests beside it.

A recursive query then climbs that table. Its rows are families: the leaves of one share all nodes above their head, but
each leaf has its own digest folded at every step, and the siblings met are appended to the family's proof. All families
of a source pass through the same last nodes; links are therefore repeated for each lane, which is a run of LANE families (in the tree
above the sources, also a run of LANE sources), and the climb joins by lane: no key has more than LANE families of a source.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import discard, stored
from .ranking import ranked

FANOUT, STEP = 3, 3  # FANOUT and how many levels one pass hashes
FAMILY = FANOUT**STEP
LANE = 81
DEEPEST = 40  # FANOUT**40 exceeds 2^63


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each `-` if null and else its UTF-8 byte count, a colon and its value as text."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in fields)), 256)


def depth(n: Column) -> Column:
    """Levels above n leaves: the least d with FANOUT**d >= n."""
    return sum((n > F.lit(FANOUT**d)).cast("int") for d in range(DEEPEST))


def _parents(x: Column, more: Column) -> Column:
    """The level above an array of consecutive digests. An array of one stays as it is, unless the tree has `more` nodes beside it."""
    up = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / FANOUT).cast("int")), lambda j: F.sha2(F.array_join(F.slice(x, j * FANOUT + 1, FANOUT), ""), 256))
    return F.when(more | (F.size(x) > 1), up).otherwise(x)


def _beside(x: Column, i: Column) -> tuple[Column, Column]:
    """What stands before and after member i of its run in x, joined; both empty beside a lone node."""
    run = F.floor(i / FANOUT).cast("int") * FANOUT
    return F.array_join(F.slice(x, run + 1, i - run), ""), F.array_join(F.slice(x, i + 2, F.lit(FANOUT - 1) - (i - run)), "")


def _places(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """leaves (source, key, leaf, claim) with `tree` (place of the source, null first), `at` (place in it) and `n` (its leaves); the tables behind it."""
    rows = ranked(leaves, F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("claim"), name="place")
    per = rows.groupBy("source", F.floor(F.col("place") / F.lit(1 << 16)).alias("page")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    per = stored(per)  # a row for each source and page of 65,536 places
    sources = per.groupBy("source").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    sources = ranked(sources, F.col("first"), name="tree")
    whole = sources.select(F.col("source").alias("of"), "n", "first", "tree")
    pages = per.select("source", "page").join(whole, F.col("source").eqNullSafe(F.col("of"))).select("of", F.col("page").alias("on"), "n", "first", "tree")
    page = F.floor(F.col("place") / F.lit(1 << 16))
    out = rows.join(pages, F.col("source").eqNullSafe(F.col("of")) & (page == F.col("on")))
    return out.withColumn("at", F.col("place") - F.col("first")).drop("of", "on", "first", "place", "source"), [leaves, rows, per, sources]


def _families(rows: DataFrame, members: Sequence[str]) -> DataFrame:
    """rows (tree, n, at, leaf, members...) by runs of FAMILY: `kin` (members in order), digests of levels 0 to STEP as l0 to l3."""
    kin = F.array_sort(F.collect_list(F.struct("at", "leaf", *members)))
    out = rows.groupBy("tree", F.floor(F.col("at") / FAMILY).alias("family")).agg(F.first("n").alias("n"), kin.alias("kin"))
    out = out.withColumn("more", F.col("n") > FAMILY).withColumn("l0", F.col("kin.leaf"))
    for i in range(STEP):
        out = out.withColumn(f"l{i + 1}", _parents(F.col(f"l{i}"), F.col("more")))
    return out


def _links(families: DataFrame, level: int) -> DataFrame:
    """(tree, level, idx, parent, before, after) of every node in families whose l0 is `level` that has a parent."""
    out = None
    for i in range(STEP):
        x = F.col(f"l{i}")
        one = families.where(F.col("more") | (F.size(x) > 1)).select("tree", "family", F.col(f"l{i + 1}").alias("above"), x.alias("x"), F.posexplode(x).alias("i", "own"))
        idx = F.col("family") * FANOUT ** (STEP - i) + F.col("i")
        before, after = _beside(F.col("x"), F.col("i"))
        one = one.select("tree", F.lit(level + i).alias("level"), idx.alias("idx"), F.get("above", F.floor(F.col("i") / FANOUT).cast("int")).alias("parent"), before.alias("before"), after.alias("after"))
        out = one if out is None else out.unionByName(one)
    return out


def _grow(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over heads (tree, n, at, leaf), the nodes at level 0: (links of all nodes below the roots, (tree, leaf) of the roots), both stored."""
    links, roots, old, level = [], [], [], 0
    while True:
        roots.append(heads.where("n = 1").select("tree", "leaf"))
        families = stored(_families(heads.where("n > 1"), ()))
        old.append(families)
        links.append(_links(families, level))
        if families.isEmpty():
            break
        heads = families.select("tree", F.ceil(F.col("n") / FAMILY).alias("n"), F.col("family").alias("at"), F.element_at(f"l{STEP}", 1).alias("leaf"))
        level += STEP
    out = stored(reduce(DataFrame.unionByName, links)), stored(reduce(DataFrame.unionByName, roots))
    discard(*old)
    return out


def _power(level: Column) -> Column:
    return F.pow(F.lit(float(FANOUT)), level).cast("long")  # exact below 2^53


def _lane(tree: Column, run: Column) -> Column:
    return F.floor(tree / LANE) * (1 << 31) + run


CLIMB = """
WITH RECURSIVE climb(tree, family, lane, at_tree, at_level, at_idx, node, subroot, ended, proof, folded) AS (
  SELECT tree, family, lane, tree, 0, family, head, head, ended, '', folded FROM {families}
  UNION ALL
  SELECT c.tree, c.family, c.lane, l.up_tree, l.up_level, l.up_idx, l.parent, IF(l.up_tree >= 0, l.parent, c.subroot), l.ended,
         concat(c.proof, l.before, l.after), transform(c.folded, f -> unhex(sha2(concat(l.before, lower(hex(f)), l.after), 256)))
  FROM climb c JOIN {links} l ON l.lane = c.lane AND l.tree = c.at_tree AND l.level = c.at_level AND l.idx = c.at_idx)
SELECT tree, family, node AS root, subroot, proof, folded FROM climb WHERE ended
"""


def climbed(families: DataFrame, links: DataFrame) -> DataFrame:
    """(tree, family, root, subroot, proof, folded) of families (tree, family, lane, head, ended, folded), stored. folded: binary.

    The recursion ends where no node has a link. The session's bounds on a recursive query are lifted while it runs, as
    its rows are the families times their levels.
    """
    spark = families.sparkSession
    bounds = {k: spark.conf.get(k) for k in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")}
    try:
        for k in bounds:
            spark.conf.set(k, "-1")
        return stored(spark.sql(CLIMB, families=families, links=links))
    finally:
        for k, v in bounds.items():
            spark.conf.set(k, v)


def trees(low: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links table of families `low`: (lane, tree, level, idx), the node's place, (up_tree, up_level, up_idx, parent, ended), its parent's
    place, digest and whether it is the root, and (before, after), the digests beside the node. Second, one row (trees), how many sources there are."""
    heads = low.select("tree", F.ceil(F.col("n") / FAMILY).alias("n"), F.col("family").alias("at"), F.element_at(f"l{STEP}", 1).alias("leaf"))
    inner, subroots = _grow(heads)
    n_trees = F.broadcast(subroots.agg(F.count("*").alias("trees")))  # one row
    outer, _ = _grow(subroots.join(n_trees).select(F.lit(-1).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("at"), "leaf"))
    per = stored(low.where("family = 0").select("tree", F.ceil(F.col("n") / FAMILY).alias("heads")).join(n_trees))

    span = _power(F.col("level"))
    last = F.floor((F.least((F.col("idx") + 1) * span, F.col("heads")) - 1) / LANE)
    run = F.explode(F.sequence(F.floor(F.col("idx") * span / LANE), last)).alias("run")
    up = F.col("level") + 1
    inner = inner.join(per, "tree").select("*", run).select(
        _lane(F.col("tree"), F.col("run")).alias("lane"), "tree", "level", "idx", F.col("tree").alias("up_tree"), up.alias("up_level"), F.floor(F.col("idx") / FANOUT).alias("up_idx"),
        "parent", ((up == depth(F.col("heads"))) & (F.col("trees") == 1)).alias("ended"), "before", "after",
    )
    lanes = per.select("tree", "heads", "trees", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("heads") - 1) / LANE))).alias("run"))
    # which nodes above the sources a lane passes: one at every level; at level 0 a node is known as its source's subroot
    at = lanes.where("trees > 1").select("*", F.explode(F.sequence(F.lit(0), depth(F.col("trees")) - 1)).alias("level"))
    low_one = F.col("level") == 0
    at = at.select(
        _lane(F.col("tree"), F.col("run")).alias("lane"), F.when(low_one, F.col("tree")).otherwise(-1).alias("from_tree"), F.when(low_one, depth(F.col("heads"))).otherwise(F.col("level")).alias("from_level"),
        "level", F.floor(F.col("tree") / _power(F.col("level"))).alias("idx"), (F.col("level") + 1 == depth(F.col("trees"))).alias("ended"),
    ).distinct()
    outer = at.join(outer.drop("tree"), ["level", "idx"]).select(
        "lane", F.col("from_tree").alias("tree"), F.col("from_level").alias("level"), F.when(low_one, 0).otherwise(F.col("idx")).cast("long").alias("idx"),
        F.lit(-1).cast("long").alias("up_tree"), up.alias("up_level"), F.floor(F.col("idx") / FANOUT).alias("up_idx"), "parent", "ended", "before", "after",
    )
    return stored(inner.unionByName(outer)), n_trees


def manifest(docs: DataFrame, fields: Sequence[str], claims: dict[str, Column], source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    A leaf is the digest of `fields`; `claims` replaces some of them by what is claimed of the row, whose digest is then
    folded with the original siblings: verified says whether that gives the root. Leaves of a source stand in the order of
    `key`, null first, rows of one key in the order of their digests; sources in byte order, null first. A row alone in
    its source is that source's subroot, a lone source's subroot is the root, and an empty table gives an empty one.
    Repeated rows are leaves each; null and empty values are told apart by the digest. Other columns are not read.
    """
    leaf, claim = digest(*map(F.col, fields)), digest(*(claims.get(f, F.col(f)) for f in fields))
    own = stored(docs.select(F.col(source).alias("source"), F.col(key).alias("key"), leaf.alias("leaf"), claim.alias("claim")))
    places, old = _places(own)
    low = stored(_families(places, ("key", "claim")))
    discard(*old)
    links, n_trees = trees(low)

    # within a family: every member's digest folded up to the head, and the digests beside its path
    def path(m: Column, i: Column) -> Column:
        folded, proof = m["claim"], F.lit("")
        for level in range(STEP):
            x = F.col(f"l{level}")
            before, after = _beside(x, F.floor(i / FANOUT**level).cast("int"))
            folded = F.when(F.col("more") | (F.size(x) > 1), F.sha2(F.concat(before, folded, after), 256)).otherwise(folded)
            proof = F.concat(proof, before, after)
        return F.struct(m["key"].alias("key"), m["leaf"].alias("leaf"), F.unhex(folded).alias("folded"), proof.alias("proof"))

    paths = stored(low.select("tree", "family", "n", F.element_at(f"l{STEP}", 1).alias("head"), F.transform("kin", path).alias("kin")))
    discard(low)
    start = paths.join(n_trees).select("tree", "family", _lane(F.col("tree"), F.floor(F.col("family") / LANE)).alias("lane"), "head", ((F.col("n") <= FAMILY) & (F.col("trees") == 1)).alias("ended"), F.col("kin.folded").alias("folded"))
    ends = climbed(start, links).withColumnRenamed("folded", "ends")
    out = paths.join(ends, ["tree", "family"]).select("root", "subroot", F.col("proof").alias("above"), "ends", F.posexplode("kin").alias("i", "m"))
    end = F.lower(F.hex(F.get("ends", F.col("i"))))
    return out.select(
        F.col("m.key").alias(key), F.col("m.leaf").alias("leaf"), "subroot", "root", F.sha2(F.concat("m.proof", "above"), 256).alias("proof_sha256"), end.alias("folded_root"), (end == F.col("root")).alias("verified"),
    )
