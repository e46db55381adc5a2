"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LENGTHS = 4096  # distinct path lengths of rules that are listed; beyond them every prefix of a path is looked up


def parsed(url):
    """(host, path) columns: from the first `://` up to `/`, `?`, `#`, A-Z in lower case; then up to `?` or `#`."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest):
    """The first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url), by rules (host, path, action).

    A rule fits a URL if its host equals the URL's or is a suffix of it at a dot, and the URL's path starts with the
    rule's path; the rule with the longest host and path together wins, at equal length the one with the longer host,
    then `block` before `allow`. rule is its host and path, verdict its action; without a fitting rule they are null
    and `default`. A null URL or one without `://` has an empty host and path and fits no rule but one with an empty
    host and path. Rules with a null host or path are ignored, repeated ones count once. Pages that repeat, or have a
    null page_id, are answered each. Extra columns are ignored.

    Only distinct (host, path) pairs are expanded. The equi-join is on 32 bits of the digest; Spark broadcasts the rules
    only below spark.sql.autoBroadcastJoinThreshold and else shuffles both sides.
    """
    host, path = parsed(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("a", F.xxhash64("host", "path")).withColumn("b", F.xxhash64(F.lit(1), "path", "host"))  # names the pair on the way
    rules = rules.where("host is not null and path is not null and action is not null").select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "action")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("action").alias("action"))  # block over allow
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", _short(F.col("r_digest")))
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().limit(MAX_LENGTHS + 1).collect())
    every = F.sequence(F.lit(0), F.length("path"))
    if len(lengths) <= MAX_LENGTHS:
        every = F.filter(F.lit(lengths), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    urls = pages.select("a", "b", "host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(every, lambda n: F.substring(F.col("path"), F.lit(1), n))
    each = urls.withColumn("e_host", F.explode(hosts)).withColumn("e_path", F.explode(paths)).select("a", "b", _digest(F.col("e_host"), F.col("e_path")).alias("digest"))
    each = each.withColumn("short", _short(F.col("digest")))
    fits = each.join(rules, "short").where(F.col("digest") == F.col("r_digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "action", F.concat("r_host", "r_path").alias("rule"))
    best = fits.groupBy("a", "b").agg(F.max(rank).alias("best")).select("a", "b", "best.rule", "best.action")
    out = pages.join(best, ["a", "b"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
