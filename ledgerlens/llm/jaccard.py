"""N-gram Jaccard join: an exact metric-space join of shingle sets, for groups of near copies of any size.

The Jaccard distance and the number of shingles in which two sets differ are metrics.

1. Most texts are at distance 1 from each other, where no pivot can tell them apart: every window would hold everything.
   Documents are therefore first blocked. The shingle universe is dealt into m parts, and sets with the same content of a
   part form a region; sets within the distance differ in at most h shingles, so with m = h + 1 parts they share one. Where
   the window of sizes around the class below reaches a set (sizes are distances from the empty set), it goes there too.
2. Each region picks a pivot and measures all its sets against it: a region of n near copies costs n distances, not n^2.
3. Regions of different components are joined. A large one samples more pivots, whose Voronoi cells divide it; the
   triangle inequality gives the window in which sets near a boundary are replicated. Cells that are still large are
   divided again, and small ones are compared in one task, by odd sketches and then exactly by texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .components import components
from .packing import INDEX, PACKED, bucket_count, discard, key_bucket, read, rows_of, small_batches, stored

BROADCAST_ROWS = 200_000  # ids that are broadcast at most, counted before; more are joined by shuffle
KEY_BYTES = 5
REGION = 1024  # sets of a region that meet in one task; larger ones are split
PIVOTS = 32  # of a region at once
SPREAD, MOST = 3, 0.75  # rows a set that a split writes at most, and the share of a region that one cell keeps at most
BLOCK = 8192  # sets of a block, where pivots can't split
PARTNERS = 4  # of a set in a task, in the first turn
LOT = 400_000  # shingles that are verified in one group, about
MEASURED = pa.schema([*((c, pa.int64()) for c in ("region", "node", "n", "own", "comp", "g")), ("d", pa.list_(pa.int32()))])
SPARE = 2  # parts beyond h + 1; sets with no more empty parts than this need no regions for them


def size_classes(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(first size, last size, largest partner, parts) of each class of smaller sizes, up to size `most`.

    Sizes a <= b reach the similarity only if 100 a >= percent b, and then differ in at most
    (100 - percent)(a + b) / (100 + percent) shingles.
    """
    out, a = [], 1
    while a <= most:
        z = max(a, a * 100 // percent)
        partner = z * 100 // percent
        h = (100 - percent) * (z + partner) // (100 + percent)
        out.append((a, z, partner, 1 if h == 0 else h + 1 + SPARE))
        a = z + 1
    return out


def _signatures(row, x, sizes, c, percent):
    """(row, signature) of the sets `row` in class c: the content of each part; row and x are the sets' shingles."""
    m = c[3]
    if m == 1:
        key = np.zeros(len(sizes), W.U)
        np.add.at(key, row, W.mix(x))
        r = np.unique(row)
        return r, W.mix(key[r] + W.U(c[0]))
    part = (W.mix(x ^ W.U(0x3C6EF372FE94F82B)) % W.U(m)).astype(np.int64)
    flat = row.astype(np.int64) * m + part
    n = len(sizes) * m
    key, filled = np.zeros(n, W.U), np.zeros(n, bool)
    np.add.at(key, flat, W.mix(x))
    filled[flat] = True
    mine = np.zeros(len(sizes), bool)
    mine[row] = True
    empty = (~filled).reshape(-1, m)
    wanted = filled.reshape(-1, m) | (empty & (mine & (empty.sum(1) > SPARE))[:, None])
    r, p = np.nonzero(wanted)
    return r, W.mix(key.reshape(-1, m)[r, p] + W.mix((p + (c[0] << 24)).astype(W.U)))


def set_ids(row: np.ndarray, x: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit id, size) of each row's set; the id is the same for equal sets."""
    s = np.zeros(rows, W.U)
    np.add.at(s, row, W.mix(x ^ W.U(0x6A09E667F3BCC908)))
    n = np.bincount(row, minlength=rows)
    return (W.mix(s ^ n.astype(W.U)) >> W.U(1)).astype(np.int64), n


def sketch_bits(n: np.ndarray) -> np.ndarray:
    return 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)


def odd_sketches(row: np.ndarray, x: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set the parity of its shingles in 2 to 4 bits per shingle (a power of two, 64 at least).

    Shingles that two sets share cancel out in the difference of their sketches, so its weight is a lower bound of the
    number of shingles in which they differ. A sketch folds by halves to the length of a shorter one.
    """
    m = sketch_bits(n)
    at = np.concatenate([[0], np.cumsum(m)])
    bit = at[row] + (W.mix(x ^ W.U(0xBB67AE8584CAA73B)) & (m[row] - 1).astype(W.U)).astype(np.int64)
    packed = np.packbits((np.bincount(bit, minlength=at[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[i:j] for i, j in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist())]


def least_difference(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())


def _folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, node, n_shingles, sketch) of every document; node identifies its set and is null where it is empty."""

    def of(batches):
        for b in batches:
            for w in W.slices(b.column(1), W.FOLDED):
                r, x = W.shingle_sets(w, k)
                node, n = set_ids(r, x, w.rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.at, w.rows), pa.array(node, mask=n == 0), pa.array(n.astype(np.int64)), pa.array(odd_sketches(r, x, n), pa.binary(), mask=n == 0)], names=["doc_id", "node", "n_shingles", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, node long, n_shingles long, sketch binary")


def regions(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(region long, doc_id long) of every region that holds two or more documents; equal regions count once.

    Signatures are cut to KEY_BYTES: they only propose who is compared.
    """

    def send(batches):
        classes: list = []
        for b in batches:
            got: dict[str, list] = {"key": [], "doc": []}
            ids, known = np.asarray(b.column(0)), np.zeros(0, np.int64)
            for w in W.slices(b.column(1), W.FOLDED):
                r, x = W.shingle_sets(w, k)
                node, n = set_ids(r, x, w.rows)
                first = np.zeros(w.rows, bool)  # equal sets of a batch are one
                first[np.unique(node, return_index=True)[1]] = True
                first &= (n > 0) & ~np.isin(node, known)
                if not first.any():
                    continue
                known = np.concatenate([known, node[first]])
                if not classes or classes[-1][1] < n.max():
                    classes = size_classes(percent, int(n.max()))
                own = np.searchsorted([c[0] for c in classes], n, "right") - 1
                for c in np.unique(own[first]):
                    for at in (c, c - 1):
                        if at >= 0:
                            use = first & (own == c) & (n <= classes[at][2])
                            if use.any():
                                pick = use[r]
                                rr, key = _signatures(r[pick], x[pick], n, classes[at], percent)
                                got["key"].append(key), got["doc"].append(ids[w.at + rr])
            if got["key"]:
                key, doc = (np.concatenate(got[c]) for c in ("key", "doc"))
                yield rows_of(INDEX, key_bucket(key, buckets), key=key, owner=doc, key_bytes=KEY_BYTES)

    def match(rows: pa.Table) -> pa.Table:
        key, doc = read(rows, INDEX, "key", "owner", key_bytes=KEY_BYTES)
        key, doc = _distinct(key, doc)
        if len(key):
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[start, len(key)])
            name = W.mix(np.add.reduceat(W.mix(doc.astype(W.U)), start) + count.astype(W.U)).astype(np.int64)
            keep = np.repeat(count > 1, count)
            key, doc = _distinct(np.repeat(name, count)[keep], doc[keep])
        return pa.table({"region": pa.array(key.astype(np.int64), pa.int64()), "doc_id": pa.array(doc, pa.int64())})

    sent = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(send, PACKED)
    return sent.groupBy("bucket").applyInArrow(match, "region long, doc_id long").dropDuplicates(["region", "doc_id"])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b, sketch_a, sketch_b) that their sketches don't rule out, as (a, b)."""

    def of(batches):
        for b in batches:
            n = np.asarray(b.column(2)) + np.asarray(b.column(3))
            d = np.array([least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column(4), b.column(5))], np.int64)
            ok = pa.array((100 + percent) * d <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(of, "a long, b long")


def window(n, percent: int):
    """In how many shingles a set of n may differ from a set that reaches the similarity, at most."""
    return F.floor(n * (100 - percent) / percent)


def _sized(state: DataFrame) -> DataFrame:
    """state with g, the sets of its region, and least, the size of the smallest; regions of one component are left out."""
    sizes = state.groupBy("region").agg(F.count("*").alias("g"), F.min("n").alias("least"), (F.min("comp") < F.max("comp")).alias("open"))
    return state.drop("g", "least").join(sizes.where("open").drop("open"), "region")


def _alone(docs: DataFrame, nodes: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(node, own): how many shingles of each node's set no other of these sets has."""

    def of(batches):
        for b in batches:
            node = np.asarray(b.column(0))
            for w in W.slices(b.column(1), W.FOLDED):
                r, x = W.shingle_sets(w, k)
                yield pa.RecordBatch.from_arrays([pa.array(node[w.at + r]), pa.array(x.view(np.int64))], names=["node", "shingle"])

    texts = _own_texts(docs, owners.join(nodes, "node").select("node", F.col("doc").alias("doc_id")), k)
    once = texts.mapInArrow(of, "node long, shingle long").groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("c")).where("c = 1")
    own = stored(once.groupBy("node").agg(F.count("*").alias("own")))
    discard(texts)
    return own


def _cells(big: DataFrame, info: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Regions (region, node, n, own, comp, g, least) split into Voronoi cells: (cells, regions that pivots can't split).

    The distance is the number of bits in which two odd sketches differ once both are folded to the length of the region's
    shortest: a pseudometric, never above the number of shingles in which the sets differ. Every region samples up to
    PIVOTS pivots, one for each half REGION of sets; each set belongs to the nearest. If x and y differ in at most w, and
    x is nearest to p and y to q, then d(y, p) <= d(y, q) + 2w and d(y, p) <= r + w with r the radius of p's cell: in
    this window y is replicated to p, for one order of p and q, which is enough for the pair to meet. A split is made if it
    writes at most SPREAD rows for each set and no cell keeps more than MOST of the region.
    """
    k = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("g") / REGION)).cast("int")
    draw = F.xxhash64("node", "region", F.lit(21))
    one, rare = F.struct(draw.alias("draw"), "node"), F.pmod(F.xxhash64("node", "region", F.lit(22)), F.greatest(F.lit(1), F.floor(F.col("g") / (4 * k)).cast("int"))) == 0
    few = F.array_union(F.collect_list(F.when(rare, one)), F.array(F.min(one)))  # 4 * PIVOTS or so
    drawn = big.groupBy("region").agg(F.sort_array(few).alias("all"), F.first(k).alias("k"), F.first("g").alias("g"))
    lots = F.ceil(F.col("g") / REGION).cast("int")
    pivots = drawn.select("region", lots.alias("lots"), F.posexplode(F.slice("all", 1, F.col("k")))).select("region", "pos", "col.node", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    pivots = pivots.join(info.select("node", "sketch"), "node").select(F.col("region").alias("to"), F.col("lot").alias("at"), F.col("pos").alias("number"), F.col("sketch").alias("bits"))
    sets = big.withColumn("lot", F.pmod(F.xxhash64("node", F.lit(23)), lots).cast("int")).join(info.select("node", "sketch"), "node")

    def apart(rows: pa.Table, near: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return MEASURED.empty_table()
        least = rows.column("least")[0].as_py()
        size = int(sketch_bits(np.array([least]))[0]) // 8
        order = np.argsort(np.asarray(near.column("number")))
        fold = lambda x: np.stack([_folded(b, size) for b in x.to_pylist()]).view(np.uint64)
        p, s = fold(near.column("bits"))[order], fold(rows.column("sketch"))
        d = np.stack([np.bitwise_count(s ^ x).sum(1) for x in p], 1).astype(np.int32)
        return pa.table([*(rows.column(c) for c in MEASURED.names[:-1]), pa.array(list(d), pa.list_(pa.int32()))], schema=MEASURED)

    measured = sets.groupBy("region", "lot").cogroup(pivots.groupBy("to", "at")).applyInArrow(apart, "region long, node long, n long, own long, comp long, g long, d array<int>")
    near = F.array_min("d")
    measured = stored(measured.withColumn("home", (F.array_position("d", near) - 1).cast("int")).withColumn("w", window(F.col("n"), percent)))
    radius = measured.groupBy("region", "home").agg(F.max(near).alias("r")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("home", "r"))).alias("radius"))  # PIVOTS at most
    inside = lambda i: (F.get("d", i) <= near + 2 * F.col("w")) & (F.get("d", i) <= F.coalesce(F.element_at("radius", i), F.lit(-1)) + F.col("w"))
    own = F.array(F.col("home"))
    below = F.when(F.col("home") > 0, F.filter(F.sequence(F.lit(0), F.col("home") - 1), inside)).otherwise(F.array().cast("array<int>"))
    dealt = stored(measured.join(radius, "region").select("region", "node", "n", "own", "comp", "g", F.concat(own, below).alias("cells")))
    counts = dealt.select("region", "g", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count("*").alias("c"), F.first("g").alias("g"))
    good = counts.groupBy("region").agg((F.sum("c") <= SPREAD * F.first("g")).alias("a"), (F.max("c") <= MOST * F.first("g")).alias("b")).where("a and b").select("region")
    split = dealt.join(good, "region", "left_semi").select(F.explode("cells").alias("cell"), "region", "node", "n", "own", "comp")
    split = stored(split.select(F.xxhash64("region", "cell").alias("region"), "node", "n", "own", "comp"))
    stuck = stored(dealt.join(good, "region", "left_anti").select("region", "node", "n", "own", "comp", "g"))
    discard(measured, dealt)
    return split, stuck


def _blocks(stuck: DataFrame) -> DataFrame:
    """Regions that pivots can't split, dealt into blocks that meet: (region, part, cross, side, node, n, own).

    All their sets lie within two windows of each other. In a region with up to BLOCK sets outside its largest component, that
    component's sets are dealt into blocks and the others go to each; else all are dealt into blocks of BLOCK sets and
    every two blocks meet: g / BLOCK rows for each of g sets. In a part marked `cross` only sets of different sides meet.
    """
    sizes = stuck.groupBy("region", "comp").agg(F.count("*").alias("c")).groupBy("region").agg(F.max(F.struct("c", "comp")).alias("m"))
    s = stuck.join(sizes.select("region", F.col("m.c").alias("m"), F.col("m.comp").alias("main")), "region")
    few = F.col("g") - F.col("m") <= BLOCK
    k = F.ceil(F.when(few, F.col("m")).otherwise(F.col("g")) / BLOCK).cast("int")
    s = s.withColumn("k", k).withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), k).cast("int"))
    place = lambda part, cross, side: F.struct(part.alias("part"), cross.alias("cross"), side.alias("side"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    dealt = F.when(F.col("comp") == F.col("main"), F.array(place(F.col("block"), F.col("block") > 0, F.lit(1)))).otherwise(F.transform(every, lambda i: place(i, i > 0, F.lit(0))))
    both = F.transform(every, lambda i: place(F.least(i, F.col("block")) * F.col("k") + F.greatest(i, F.col("block")), i != F.col("block"), (i < F.col("block")).cast("int")))
    return s.select("region", "node", "n", "own", F.explode(F.when(few, dealt).otherwise(both)).alias("x")).select("region", "x.part", "x.cross", "x.side", "node", "n", "own")


def _meetings(docs: DataFrame, state: DataFrame, info: DataFrame, owners: DataFrame, k: int, percent: int) -> DataFrame:
    """state (region, node, n, comp) as groups of sets that meet in one task: (region, part, cross, side, node, n, own).

    Regions of more than REGION sets are split by pivots, again and again. Before that, sets that can't link leave them: two sets
    differ at least in the shingles that are in no other set, so a set goes if its own ones and the least number of
    own ones of its region exceed its window.
    """
    state = stored(_sized(state).withColumn("own", F.lit(0).cast("long")))
    whole = lambda df: df.select("region", F.lit(0).alias("part"), F.lit(False).alias("cross"), F.lit(0).alias("side"), "node", "n", "own")
    out = whole(state.where(F.col("g") <= REGION))
    big = state.where(F.col("g") > REGION)
    if big.isEmpty():
        return out
    own = _alone(docs, big.select("node").distinct(), owners, k)
    big = big.drop("own").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    fewest = big.groupBy("region").agg(F.min("own").alias("fewest"))
    big = stored(_sized(big.join(fewest, "region").where(F.col("own") + F.col("fewest") <= window(F.col("n"), percent)).drop("fewest")))
    while True:
        out = out.unionByName(whole(big.where(F.col("g") <= REGION)))
        big = big.where(F.col("g") > REGION)
        if big.isEmpty():
            return out
        split, stuck = _cells(big, info, percent)
        out = out.unionByName(_blocks(stuck))
        big = stored(_sized(split))
        discard(split)


def possible_in_regions(groups: DataFrame, comp: DataFrame | None, info: DataFrame, percent: int, lots: int, partners: int) -> DataFrame:
    """Pairs (a, b) of a group and of different components that their sketches and own shingles don't rule out.

    Pairs are compared as bit matrices and only what is left is written: of each set and group the `partners` closest
    pairs. Where a set has more, a row with a = b says so.
    """

    def meet(rows: pa.Table) -> pa.Table:
        region, part, node, n, own, comp, cross, side = (np.asarray(rows.column(c)) for c in ("region", "part", "node", "n", "own", "comp", "cross", "side"))
        order = np.lexsort((node, part, region))
        sketches = rows.column("sketch").combine_chunks()
        region, part, node, n, own, comp, cross, side = (x[order] for x in (region, part, node, n, own, comp, cross, side))
        cut = np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (part[1:] != part[:-1]), True]).tolist()
        left, right = [], []
        for i, j in zip(cut[:-1], cut[1:]):
            sketch = [np.frombuffer(sketches[k].as_buffer(), np.uint8) for k in order[i:j].tolist()]
            size = min(map(len, sketch))
            bits = np.stack([_folded(b, size) for b in sketch]).view(np.uint64)
            for k in range(i, j, 64):
                e = min(k + 64, j)
                d = np.zeros((e - k, j - i), np.int64)
                for word in range(bits.shape[1]):
                    d += np.bitwise_count(bits[k - i : e - i, word, None] ^ bits[None, :, word])
                d = np.maximum(d, own[k:e, None] + own[None, i:j])
                ok = ((100 + percent) * d <= (100 - percent) * (n[k:e, None] + n[None, i:j])) & (comp[k:e, None] != comp[None, i:j])
                if cross[i]:
                    ok &= side[k:e, None] != side[None, i:j]
                if ok.shape[1] > partners and (more := ok.sum(1) > partners).any():
                    d[~ok] = 1 << 40
                    far = np.argpartition(d[more], partners - 1, axis=1)[:, partners:]
                    ok[np.flatnonzero(more)[:, None], far] = False
                    left.append(node[k : k + 1]), right.append(node[k : k + 1])
                p, q = np.nonzero(ok)
                left.append(node[p + k]), right.append(node[q + i])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        a, b = _distinct(np.minimum(a, b), np.maximum(a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = groups.withColumn("comp", F.col("node")) if comp is None else groups.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    left = rows.groupBy("region", "part").agg((F.min("comp") < F.max("comp")).alias("open")).where("open").select("region", "part")
    rows = rows.join(left, ["region", "part"]).join(info.select("node", "sketch"), "node").withColumn("lot", F.pmod(F.xxhash64("region", "part"), F.lit(lots)))
    return rows.groupBy("lot").applyInArrow(meet, "a long, b long").distinct()


def _linked(docs: DataFrame, r: DataFrame, sets: DataFrame, owners: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, component) of all nodes that have links, or None.

    First one pivot of every region meets the region's other sets, which settles families of near copies; then all that is
    left meets within its region, or within the cells that pivots split a large one into, sets of one component excepted:
    the closest partners of each set first, and, where a set has more, again with 16 times as many, until no pair of
    different components is left out. Sketches rule out nearly all that is too far, and the texts decide exactly.
    """
    n_rows = r.count()
    if not n_rows:
        return None
    info = sets.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    info = stored(info.join(r.select("node").distinct(), "node"))
    state = stored(r.join(info.select("node", "n"), "node").select("region", "node", "n"))

    pivot = state.groupBy("region").agg(F.min(F.struct("node", "n")).alias("p")).select("region", F.col("p.node").alias("p"), F.col("p.n").alias("pn"))
    fits = (F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent) & (F.col("node") != F.col("p"))
    pairs = state.join(pivot, "region").where(fits).select(F.col("p").alias("a"), F.col("node").alias("b")).distinct()
    named = lambda x: info.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    pairs = stored(possible(pairs.join(named("b"), "b").join(named("a"), "a"), percent))
    links = _verified(docs, owners, info, pairs, words, percent)
    discard(pairs)
    comp = None if links.isEmpty() else stored(components(links))
    first = state.withColumn("comp", F.col("node")) if comp is None else state.join(comp, "node", "left").select("region", "node", "n", F.coalesce("component", "node").alias("comp"))
    groups = _meetings(docs, first, info, owners, words, percent)
    partners, size = PARTNERS, bucket_count(n_rows, 20_000, 16)
    while True:
        found = stored(possible_in_regions(groups, comp, info, percent, size, partners))
        new = _verified(docs, owners, info, found.where("a <> b"), words, percent)
        links = links.unionByName(new)
        whole = found.where("a = b").isEmpty()  # no pair was left out
        discard(found)
        if not new.isEmpty():
            comp = stored(components(links))
        if whole:
            return comp
        partners *= 16


def _verified(docs: DataFrame, owners: DataFrame, info: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose texts reach the similarity, by exact set operations.

    Pairs are dealt into lots of about LOT shingles, those of one `a` into as many as their sizes ask for; a lot gets each
    of its texts once.
    """
    sized = pairs.join(info.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    load = sized.groupBy("a").agg((F.floor(F.sum("n_b") / LOT) + 1).alias("parts"))
    total = sized.agg(F.sum("n_b")).first()[0]
    if total is None:
        return pairs.sparkSession.createDataFrame([], "a long, b long")
    lots = bucket_count(total, LOT, 16)
    dealt = stored(pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), "parts")), F.lit(lots)).cast("int").alias("lot")))
    needed = dealt.select(F.col("lot").alias("place"), F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _own_texts(docs, owners.join(needed.select("node").distinct(), "node").select("node", F.col("doc").alias("doc_id")), k)

    def decide(some: pa.Table, rows: pa.Table) -> pa.Table:
        sets = {}
        node = rows.column("node").to_pylist()
        for w in W.slices(rows.column("text"), W.FOLDED):
            r, x = W.shingle_sets(w, k)
            cut = np.searchsorted(r, np.arange(w.rows + 1))
            for i in range(w.rows):
                sets[node[w.at + i]] = x[cut[i] : cut[i + 1]]
        a, b = some.column("a").to_pylist(), some.column("b").to_pylist()
        ok = [_reach(sets[x], sets[y], percent) for x, y in zip(a, b)]
        return some.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = stored(dealt.groupBy("lot").cogroup(needed.join(texts, "node").groupBy("place")).applyInArrow(decide, "a long, b long"))
    discard(texts, dealt)
    return out


def _reach(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a set holds the distinct k-word shingles, or the whole
    sequence of a text with fewer words. Two documents link when 100 |a & b| >= percent |a | b|; component_id is the
    smallest doc_id reachable. Null and empty texts have n_shingles 0 and link with nothing (component_id: their own
    doc_id). Repeated rows are answered each. Rows with a null doc_id link with nothing and have a null component_id.
    Extra columns are ignored. Sets are told apart by 64-bit hashes of shingles.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = stored(shingle_sets(docs, k))
    buckets = buckets or bucket_count(sets.count())
    owners = sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"))
    r = regions(docs, k, percent, buckets).join(sets.where("node is not null").select("doc_id", "node"), "doc_id")
    r = stored(r.select("region", "node").distinct())
    several = r.groupBy("region").agg(F.count("*").alias("c")).where("c > 1").select("region")
    comp = _linked(docs, r.join(several, "region"), sets, owners, k, percent)
    if comp is None:
        first = owners.select("node", F.col("doc").alias("component_id"))
    else:
        named = owners.join(comp, "node").groupBy("component").agg(F.min("doc").alias("least"))
        comp = comp.join(named, "component").select("node", "least")
        first = owners.join(comp, "node", "left").select("node", F.coalesce("least", "doc").alias("component_id"))
    out = sets.drop("sketch").join(first, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _own_texts(docs: DataFrame, owner: DataFrame, k: int) -> DataFrame:
    """(node, text) of each node of owner (doc_id, node); of rows that repeat a doc_id, those whose set it is."""

    def of(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for w in W.slices(b.column(1), W.FOLDED):
                r, x = W.shingle_sets(w, k)
                keep[w.at : w.at + w.rows] = set_ids(r, x, w.rows)[0] == np.asarray(b.column(0))[w.at : w.at + w.rows]
            yield b.filter(pa.array(keep))

    owner = stored(owner)
    n = owner.count()
    found = docs.join(F.broadcast(owner) if n <= BROADCAST_ROWS else owner, "doc_id").select("node", "text")
    texts = stored(found.mapInArrow(of, "node long, text string"))
    if texts.count() == n:
        return texts
    once = stored(texts.dropDuplicates(["node"]))  # rows repeat
    discard(texts)
    return once
