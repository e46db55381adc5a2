"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, jaccard, manifest, mixing, neighbours, phrases, quality, rlz, sharding, tokencount, urls
from .packing import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, action)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: (tool, argument, type, required)
TOOLS = [("answer", "query", "string", True), ("answer", "turn", "integer", True), ("answer", "words", "integer", True)]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.as_calls(table(spark, sf_dir, "conversations"))
    return chat.format_messages(messages, spark.createDataFrame(TOOLS, "name string, argument string, type string, required boolean"))


def op2_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.repeated_spans(table(spark, sf_dir, "documents"), 13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return urls.judged(table(spark, sf_dir, "pages"), rules, "allow")


def op5_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings"), 0.9)


def op6_edit_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Trees of all documents are built, edited twice and stored, leaves taken apart and all; then edited once more from that table."""
    built = tokencount.build_trees(table(spark, sf_dir, "documents"), vocabulary)
    edits = tokencount.sample_edits(F.col("text"), F.col("doc_id"))
    once = stored(tokencount.edit_in_place(built.withColumn("todo", F.array(*edits[:2])), "todo", vocabulary))
    return tokencount.tree_counts(tokencount.edit_in_place(once.withColumn("todo", F.array(edits[2])), "todo", vocabulary))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return decontaminate.digest(hits)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, (3, 1, 2), 1.5, 2.0).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    claims = {"text": F.when(odd, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return manifest.manifest(table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), claims)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), 100, 5, 100, 2000)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), 10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_tool_calls, op2_vector_sharding, op3_rlz_dedup, op4_url_filter, op5_itq_dedup, op6_edit_counts, op7_decontamination, op8_quality, op9_source_mix, op10_jaccard_join,
        op11_merkle_manifest, op12_collocations, op13_neighbours,
    )
}

#: Words of every document by position, as CTEs for the statements below.
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = """w AS (SELECT doc_id, regexp_extract_all({text}, '{word}') AS ws FROM documents)"""

_OP3 = (
    "WITH "
    + _WORDS.format(text="coalesce(text, '')", word=r"[^\x20\x09-\x0D]+")
    + """,
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM w, unnest(range(1, len(ws) - 11)) AS t(i) WHERE len(ws) >= 13),
lo AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN lo USING (s), unnest(range(0, 13)) AS u(j) WHERE d < doc_id),
word AS (SELECT doc_id, p, ws[p] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""
)

_OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS t(i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s FROM d, ks, unnest(range(1, len(ws) - k + 2)) AS t(i) WHERE len(ws) >= k),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, s)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM m, unnest(range(0, k)) AS u(j)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

_OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS x FROM w, unnest(range(1, greatest(len(ws) - 4, 0) + 2)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
         JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) c USING (doc_id)"""

_OP1 = r"""WITH RECURSIVE q AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations),
u AS (SELECT conv_id, turn FROM q WHERE role = 'user'),
a AS (SELECT conv_id, turn FROM q WHERE role = 'assistant'),
-- a call waits for the result of the call two turns before, which is the assistant's turn just before it
lv(conv_id, turn, level) AS (
  SELECT u.conv_id, u.turn, CASE WHEN a.turn IS NULL THEN 0 ELSE 1 END
  FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1 LEFT JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2 WHERE a.turn IS NULL OR p.turn IS NULL
  UNION ALL SELECT u.conv_id, u.turn, level + 2 FROM lv JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2 JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn - 1),
x AS (SELECT q.*, c.level AS lvl, r.turn IS NOT NULL AS has_result, n % 5 AS m, '"query":' || to_json(coalesce(text, ''))::VARCHAR AS query,
        CASE WHEN role = 'user' THEN q.turn WHEN role = 'assistant' THEN q.turn - 1 END AS t
      FROM q LEFT JOIN lv c ON c.conv_id = q.conv_id AND c.turn = CASE WHEN role = 'user' THEN q.turn WHEN role = 'assistant' THEN q.turn - 1 END
             LEFT JOIN a r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND role = 'user')
SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN lvl WHEN role = 'assistant' AND lvl IS NOT NULL THEN lvl + 1 ELSE 0 END::INT AS level, 't' || t AS call_id,
       CASE WHEN role = 'user' THEN has_result WHEN role = 'assistant' THEN lvl IS NOT NULL END AS linked,
       CASE WHEN role = 'user' THEN m = 4 END AS valid,
       CASE WHEN role = 'user' THEN CASE m WHEN 0 THEN 'wrong type of turn' WHEN 1 THEN 'missing argument words' WHEN 2 THEN 'unknown argument extra' WHEN 3 THEN 'unknown tool' END
            WHEN role = 'assistant' AND lvl IS NULL THEN 'orphan' END AS error,
       '{' || CASE WHEN role = 'user' THEN '"call":{"arguments":{' || CASE m
           WHEN 0 THEN query || ',"turn":"x' || turn || '","words":' || n
           WHEN 1 THEN query || ',"turn":' || turn
           WHEN 2 THEN '"extra":"1",' || query || ',"turn":' || turn || ',"words":' || n
           WHEN 3 THEN query || ',"turn":"' || turn || '","words":"' || n || '"'
           ELSE query || ',"turn":' || turn || ',"words":' || n END
         || '},"id":"t' || t || '","name":"' || CASE m WHEN 3 THEN 'unheard' ELSE 'answer' END || '"},' ELSE '' END || '"content":' || to_json(coalesce(text, ''))::VARCHAR
         || CASE WHEN role = 'assistant' THEN ',"result_of":"t' || t || '"' ELSE '' END || ',"role":' || to_json(role)::VARCHAR || '}' AS json
FROM x"""

_OP4 = f"""WITH r(r_host, r_path, action) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (SELECT page_id, {_FOLD.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
f AS (SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(action, length(r_host || r_path)) AS action
      FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f USING (host, path)"""

_OP5 = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.9 * a.n * b.n),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a), k AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT u.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(u.vec_id, coalesce(c.m, u.vec_id)) AS component_id,
       u.vec_id = least(u.vec_id, coalesce(c.m, u.vec_id)) AS kept
FROM u LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 bit by bit; 3988292384 is its polynomial, 4294967295 its start
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295::BIGINT)"""

_OP11 = f"""WITH RECURSIVE
x AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf,
             CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS claim FROM documents),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS idx FROM x),
lo(tree, level, idx, n, h) AS (SELECT tree, 0, idx, n, leaf FROM p UNION ALL
  SELECT tree, level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM lo WHERE n > 1 GROUP BY tree, level, idx // 3),
hi(level, idx, n, h) AS (SELECT 0, tree, count(*) OVER (), h FROM lo WHERE n = 1 UNION ALL
  SELECT level + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM hi WHERE n > 1 GROUP BY level, idx // 3),
nodes AS (SELECT tree, level, idx, n, h FROM lo UNION ALL SELECT -1, level, idx, n, h FROM hi),
-- a lone node of a source stands at its place above the sources
steps AS (SELECT tree, level, idx, n,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM nodes),
climb(doc_id, src, leaf, i, tree, level, idx, f, proof) AS (SELECT doc_id, tree, leaf, idx, tree, 0, idx, claim, '' FROM p UNION ALL
  SELECT doc_id, src, leaf, i, CASE WHEN s.n > 1 THEN c.tree ELSE -1 END, CASE WHEN s.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN s.n > 1 THEN c.idx // 3 ELSE c.tree END,
         CASE WHEN s.n > 1 THEN sha256(b || f || a) ELSE f END, CASE WHEN s.n > 1 THEN proof || b || a ELSE proof END
  FROM climb c JOIN steps s ON s.tree = c.tree AND s.level = c.level AND s.idx = c.idx WHERE s.n > 1 OR c.tree >= 0)
SELECT c.doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM climb c JOIN steps s ON s.tree = -1 AND c.tree = -1 AND s.level = c.level AND s.idx = c.idx AND s.n = 1
JOIN (SELECT tree, h FROM lo WHERE n = 1) sub ON sub.tree = c.src, (SELECT h FROM hi WHERE n = 1) root"""

_OP12 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
tot AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, ws[i:i + k - 1] AS x, count(*)::HUGEINT AS f FROM p, unnest([1, 2, 3, 4, 5]) AS ks(k), unnest(range(1, len(ws) - k + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(x) > 1),
cut AS (SELECT c.lang, c.x, c.f AS a, k, lf.f AS l, rf.f AS r, n, (1000 * c.f * n) // (lf.f * rf.f) AS score
        FROM c JOIN tot USING (lang), unnest(range(1, len(c.x))) AS t(k) JOIN f lf ON lf.lang = c.lang AND lf.x = c.x[1:k] JOIN f rf ON rf.lang = c.lang AND rf.x = c.x[k + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
part AS (SELECT c.lang, c.x[i:i + k - 1] AS x, max(f) AS f FROM c, unnest(range(2, len(c.x))) AS t(k), unnest(range(1, len(c.x) - k + 2)) AS u(i) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN part USING (lang, x) WHERE part.f IS NULL OR 100 * part.f < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(x, ' ')) AS rank, array_to_string(x, ' ') AS phrase,
         a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept) WHERE rank <= 2000"""

#: Exact: on small tables the search has to find all.
_OP13 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (v.e[i] - q.e[i]) * (v.e[i] - q.e[i])), lambda a, x: a + x)) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL = {"op13_neighbours": _OP13, "op12_collocations": _OP12, "op11_merkle_manifest": _OP11, "op1_tool_calls": _OP1, "op4_url_filter": _OP4, "op5_itq_dedup": _OP5, "op3_rlz_dedup": _OP3, "op7_decontamination": _OP7, "op10_jaccard_join": _OP10}
