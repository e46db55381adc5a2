"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, jaccard, mixing, quality, sharding
from ledgerlens.llm.packing import discard, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and `key`, a 64-bit hash of the whole row: null and repeated doc_ids name no row, equal rows are interchangeable."""
    return docs.select(F.xxhash64(*(x for c in COLUMNS for x in (F.col(c), F.col(c).isNull()))).alias("key"), *COLUMNS)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: each row by its own text, whatever its doc_id.

    Null and empty texts have no features and are judged by the model's bias; rows that repeat are judged alike. Without
    labels the score is a constant. Columns besides COLUMNS are dropped, here and in every stage; empty tables stay empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, labels, keep=tuple(COLUMNS)).where("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays. Shingles of five words, similarity 0.8.

    It is the one with the least doc_id, null last. Rows are compared by their own texts: a null doc_id is a document
    like others, rows that share a doc_id are documents each, and of equal rows one stays. Rows whose text has no words
    link with nothing and all stay.
    """
    docs = keyed(docs)
    groups = jaccard.jaccard_components(docs.select(F.col("key").alias("doc_id"), "text"), 5, 80)
    groups = groups.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"), ((F.first("n_shingles") > 0) & (F.count("*") > 1)).alias("repeated"))
    ids = docs.groupBy("key").agg(F.first("doc_id").alias("doc_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "repeated")).alias("m")
    keep = stored(groups.join(ids, "key").groupBy("component").agg(least).select("m.key", "m.repeated"))
    out = docs.join(keep.where("not repeated"), "key", "left_semi")
    again = keep.where("repeated")
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return out.select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go: each row by its own text, with a null or repeated doc_id too.

    Null and empty texts stay; items without words hit nothing, and an empty benchmark keeps all.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = keyed(docs)
    hits = decontaminate.contaminated(docs.select(F.col("key").alias("doc_id"), "text"), items, 10)
    bad = hits.where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(bad, "key", "left_anti").select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whatever its doc_id; the one at a source's cut stays whole.

    Texts without words are never taken. A null source is a source like others; rows that repeat are taken each.
    """
    mixed = mixing.mix(docs.select(COLUMNS), (3, 1, 2), 1.5, 2.0).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.withColumn("time", F.explode(F.sequence(F.lit(1), times))).select(COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there, and the text and other columns to write. Null texts are one group; rows that
    repeat each get a slot."""
    return sharding.shard(docs.select(COLUMNS), 16, tuple(COLUMNS))


STAGES = [
    ("quality classifier", classifier),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL can't express the classifier, the random order of the mix and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each stage's rows written to the shared checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
