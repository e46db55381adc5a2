"""Queries J and A: as-of and range joins, actor and creator histories, holders, books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actors as C
from ..operators import books as K
from ..operators import joins as J
from ..operators import metrics as M
from ..sources.tables import kept, ledger_tokens, ledger_trades, stream_tokens, stream_trades, table
from .base import A, A_TRADES, B, query
from .metrics import window
from .store import _SCORES_SQL, POSITIONS_SQL, _T0, positions, scores

DAY = 86400.0
NOW = 852076800.0  # 1997-01-01

ACT_SQL = """act AS (SELECT *, sell_amount - buy_amount AS realized, buy_amount > 0 AND sell_amount > 0 AS is_closed FROM (SELECT actor_id, entity_id, min(ts) AS first_ts, max(ts) AS last_ts,
 coalesce(sum(amount) FILTER (side = 'buy'), 0) AS buy_amount, coalesce(sum(amount) FILTER (side = 'sell'), 0) AS sell_amount FROM trades GROUP BY actor_id, entity_id))"""
SNAP_SQL = """per AS (SELECT entity_id, max(mcap) AS peak, first(mcap ORDER BY ts DESC, event_id DESC) AS last_mcap, max(reserve) AS top_reserve, max(ts) AS last_ts FROM trades GROUP BY entity_id),
tp AS (SELECT tokens.*, peak, last_ts - created_at AS ttl, least(top_reserve / 85 * 100, 100) >= 99 AS grad, last_mcap > 0 AND last_mcap < 40 AND least(top_reserve / 85 * 100, 100) < 99 AS rug FROM tokens LEFT JOIN per USING (entity_id)),
snap AS (SELECT creator_id, entity_id, created_at AS ref_ts, count(*) OVER w AS n_prior, count(*) FILTER (rug) OVER w AS rug_count, count(*) FILTER (grad) OVER w AS graduated_count,
 median(CASE WHEN peak > 0 THEN peak END) OVER w AS median_peak, avg(ttl) OVER w AS avg_ttl, CASE WHEN count(*) OVER w > 1 THEN (max(created_at) OVER w - min(created_at) OVER w) / (count(*) OVER w - 1) END AS mean_interval,
 (created_at - min(created_at) OVER w) / 86400 AS age_days FROM tp WINDOW w AS (PARTITION BY creator_id ORDER BY created_at, insert_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def snapshots(spark, sf_dir):
    sf_dir = kept(spark, sf_dir)
    return C.creator_snapshots(ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir), 40.0, 99.0)


def activity(spark, sf_dir):
    return C.activity(ledger_trades(spark, sf_dir))


@query(f"WITH {_SCORES_SQL} SELECT s.event_id, s.entity_id, s.score, t.created_at, t.creator_id, s.scored_at - t.created_at AS age FROM scores s JOIN tokens t USING (entity_id)")
def join_score_token(spark, sf_dir):
    j = scores(spark, sf_dir).join(stream_tokens(spark, sf_dir), "entity_id")
    return j.select("event_id", "entity_id", "score", "created_at", "creator_id", (F.col("scored_at") - F.col("created_at")).alias("age"))


AGES = (400 * DAY, 800 * DAY, 1200 * DAY)
_HOLD_SQL = f"""{A}, hb AS (SELECT entity_id, age, actor_id, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS bal FROM trades JOIN tokens USING (entity_id), (VALUES ({AGES[0]}), ({AGES[1]}), ({AGES[2]})) v(age)
 WHERE ts <= created_at + age GROUP BY ALL HAVING bal > 0),
hr AS (SELECT *, row_number() OVER (PARTITION BY entity_id, age ORDER BY bal DESC, actor_id) AS r FROM hb),
holders AS (SELECT entity_id, age::DOUBLE AS age, coalesce(sum(bal) FILTER (r <= 1), 0) / sum(bal) * 100 AS top1_pct, sum(bal) FILTER (r <= 5) / sum(bal) * 100 AS top5_pct, sum(bal) FILTER (r <= 10) / sum(bal) * 100 AS top10_pct,
 count(*) AS holder_count, count(*) < 20 AS is_partial FROM hr GROUP BY entity_id, hr.age)"""


def holders(spark, sf_dir):
    return C.holder_samples(ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir), AGES)


@query(f"""WITH {_HOLD_SQL} SELECT entity_id, {", ".join(f"max(top1_pct) FILTER (h.age = {a}) AS top1_{i}, max(holder_count) FILTER (h.age = {a}) AS count_{i}" for i, a in enumerate(AGES, 1))}
FROM tokens LEFT JOIN holders h USING (entity_id) GROUP BY entity_id""")
def left_join_holders(spark, sf_dir):
    h = holders(spark, sf_dir)
    label = F.element_at(F.create_map(*(F.lit(x) for i, a in enumerate(AGES, 1) for x in (a, f"a{i}"))), F.col("age"))
    p = h.withColumn("label", label).groupBy("entity_id").pivot("label", ["a1", "a2", "a3"]).agg(F.max("top1_pct").alias("top1"), F.max("holder_count").alias("count"))
    p = p.select("entity_id", *(F.col(f"a{i}_{c}").alias(f"{c}_{i}") for i in (1, 2, 3) for c in ("top1", "count")))
    return ledger_tokens(spark, sf_dir).select("entity_id").join(p, "entity_id", "left")


def _probes(spark, sf_dir):
    t = ledger_tokens(spark, sf_dir).select("entity_id", "creator_id")
    return ledger_trades(spark, sf_dir).join(t, "entity_id").select("event_id", "entity_id", "creator_id", "ts")


def _observed(spark, sf_dir):
    return snapshots(spark, sf_dir).select("creator_id", F.col("ref_ts").alias("observed_at"), "n_prior", "rug_count", "graduated_count", F.col("entity_id").alias("id"))


def _latest(spark, sf_dir, strict):
    return C.latest_snapshot(_probes(spark, sf_dir), _observed(spark, sf_dir), strict)


for _name, _op, _strict in (("asof_creator_snapshot", "<=", False), ("asof_strict", "<", True)):
    query(
        f"""WITH {A}, {SNAP_SQL}, p AS (SELECT event_id, entity_id, creator_id, ts FROM trades JOIN tokens USING (entity_id)),
o AS (SELECT creator_id, ref_ts AS observed_at, n_prior, rug_count, graduated_count FROM (SELECT *, row_number() OVER (PARTITION BY creator_id, ref_ts ORDER BY entity_id DESC) AS q FROM snap) WHERE q = 1)
SELECT p.*, o.observed_at, o.n_prior, o.rug_count, o.graduated_count FROM p ASOF LEFT JOIN o ON p.creator_id = o.creator_id AND o.observed_at {_op} p.ts""",
        _name,
    )(lambda spark, sf_dir, strict=_strict: _latest(spark, kept(spark, sf_dir), strict))


@query(f"WITH {A} SELECT entity_id, nullif(count(*) OVER w, 0) AS n_prior, min(created_at) OVER w AS first_prior, max(created_at) OVER w AS last_prior FROM tokens WINDOW w AS (PARTITION BY creator_id ORDER BY insert_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def asof_prior_entities(spark, sf_dir):
    return J.prior_by_order(ledger_tokens(spark, sf_dir))


_FLAG_SQL = f"{A}, fl AS (SELECT creator_id, min(ts) AS valid_from, CASE WHEN sum(qty) > 60 THEN 'heavy' ELSE 'light' END AS flag FROM trades JOIN tokens USING (entity_id) GROUP BY creator_id, floor(ts / {90 * DAY})), iv AS (SELECT *, lead(valid_from) OVER (PARTITION BY creator_id ORDER BY valid_from) AS valid_to FROM fl)"


def _flags(spark, sf_dir):
    t = ledger_trades(spark, sf_dir).join(ledger_tokens(spark, sf_dir).select("entity_id", "creator_id"), "entity_id")
    f = t.groupBy("creator_id", F.floor(F.col("ts") / (90 * DAY)).alias("q")).agg(F.min("ts").alias("valid_from"), F.when(F.sum("qty") > 60, "heavy").otherwise("light").alias("flag"))
    return J.scd2(f.drop("q"), "creator_id", "valid_from")


@query(f"WITH {_FLAG_SQL} SELECT p.entity_id, p.created_at + {100 * DAY} AS ts, p.creator_id, iv.flag FROM tokens p LEFT JOIN iv ON p.creator_id = iv.creator_id AND valid_from <= p.created_at + {100 * DAY} AND (valid_to IS NULL OR valid_to > p.created_at + {100 * DAY})")
def interval_flag_asof(spark, sf_dir):
    p = ledger_tokens(spark, sf_dir).select("entity_id", (F.col("created_at") + 100 * DAY).alias("ts"), "creator_id")
    return J.flag_at(p, _flags(spark, sf_dir), "creator_id")


@query(f"WITH {_FLAG_SQL} SELECT creator_id, flag, valid_from, valid_to FROM iv")
def scd2_close_open(spark, sf_dir):
    return _flags(spark, sf_dir).select("creator_id", "flag", "valid_from", "valid_to")


_PAIR_SQL = f"""fb AS (SELECT entity_id, actor_id, min(ts) AS t FROM trades WHERE side = 'buy' GROUP BY ALL),
pairs AS (SELECT x.actor_id AS a, y.actor_id AS b, count(DISTINCT x.entity_id) AS n_shared FROM fb x JOIN fb y ON x.entity_id = y.entity_id AND x.actor_id < y.actor_id AND abs(x.t - y.t) <= {30 * DAY} GROUP BY ALL HAVING n_shared >= 2)"""


def co_pairs(spark, sf_dir):
    return J.co_actor_pairs(ledger_trades(spark, sf_dir), 30 * DAY, 2)


@query(f"WITH {A_TRADES}, {_PAIR_SQL} SELECT * FROM pairs")
def co_actor_pairs(spark, sf_dir):
    return co_pairs(spark, sf_dir)


TOP_SQL = f"""{A}, {ACT_SQL}, v AS (SELECT entity_id, actor_id, sum(amount) AS volume FROM trades JOIN tokens USING (entity_id) WHERE side = 'buy' AND ts BETWEEN created_at AND created_at + {365 * DAY} GROUP BY ALL),
top AS (SELECT entity_id, actor_id, row_number() OVER (PARTITION BY entity_id ORDER BY volume DESC, actor_id) AS rank, created_at + {365 * DAY} AS cutoff FROM v JOIN tokens USING (entity_id)),
prior AS (SELECT t.entity_id, t.actor_id, t.rank, t.cutoff, count(a.entity_id) AS n_prior, count(*) FILTER (a.is_closed) AS n_closed, count(*) FILTER (a.is_closed AND a.realized > 0) AS n_won,
 coalesce(sum(a.realized) FILTER (a.is_closed), 0) AS sum_realized, min(a.first_ts) AS first_seen FROM top t LEFT JOIN act a ON a.actor_id = t.actor_id AND a.entity_id <> t.entity_id AND a.last_ts < t.cutoff WHERE t.rank <= 10 GROUP BY ALL)"""


def prior(spark, sf_dir, span=365 * DAY, top=None):
    """The pasts of each entity's ten largest buyers within `span`; `top` (entity_id, actor_id, rank), if they are known already."""
    if top is None:
        top = M.top_buyers(window(spark, sf_dir, span), 10).select("entity_id", "actor_id", "rank")
    cut = ledger_tokens(spark, sf_dir).select("entity_id", (F.col("created_at") + span).alias("cutoff"))
    return C.prior_stats(top.join(cut, "entity_id"), activity(spark, sf_dir))


@query(f"WITH {TOP_SQL} SELECT entity_id, actor_id, rank, cutoff, n_prior, n_closed, n_won, sum_realized FROM prior", rounded=("sum_realized",), digits=4)
def prior_stats_join(spark, sf_dir):
    return prior(spark, sf_dir).drop("first_seen")


_CLASS_SQL = f"""{TOP_SQL}, st AS (SELECT actor_id, min(ts - created_at) AS fastest_buy_age, CASE WHEN avg(amount) > 0 THEN stddev_pop(amount) / avg(amount) END AS amount_cv, count(*) AS n_buys, count(*) FILTER (ts >= {NOW} - {180 * DAY}) AS n_buys_recent
 FROM trades JOIN tokens USING (entity_id) WHERE side = 'buy' GROUP BY actor_id),
mh AS (SELECT actor_id, quantile_cont(last_ts - first_ts, 0.5) AS median_hold FROM act WHERE is_closed GROUP BY actor_id),
gw AS (SELECT actor_id, count(*) AS n_graduated, avg((realized > 0)::INT) AS graduated_winrate FROM act WHERE is_closed AND entity_id IN (SELECT entity_id FROM trades GROUP BY entity_id HAVING max(mcap) >= 35) GROUP BY actor_id HAVING count(*) >= 1),
fg0 AS (SELECT st.*, median_hold, n_graduated, graduated_winrate, coalesce((fastest_buy_age <= {10 * DAY})::INT, 0) + coalesce((amount_cv <= 0.5)::INT, 0) + coalesce((n_buys_recent >= 3)::INT, 0) + coalesce((median_hold <= {400 * DAY})::INT, 0) AS sg FROM st LEFT JOIN mh USING (actor_id) LEFT JOIN gw USING (actor_id)),
fg AS (SELECT * EXCLUDE (sg), sg >= 2 AS is_sniper, sg = 4 AS is_bot, coalesce(graduated_winrate >= 0.5, false) AS is_smart FROM fg0)"""


def flags(spark, sf_dir):
    trades, tokens = ledger_trades(spark, sf_dir), ledger_tokens(spark, sf_dir)
    act = activity(spark, sf_dir)
    return C.actor_flags(C.actor_stats(trades, tokens, NOW, 180 * DAY), C.median_hold(act), C.graduated_winrate(act, trades, 35.0, 1), 10 * DAY, 0.5, 3, 400 * DAY, 0.5)


@query(f"WITH {_CLASS_SQL} SELECT t.entity_id, t.actor_id, t.rank, is_sniper, is_bot, is_smart FROM top t LEFT JOIN fg USING (actor_id) WHERE rank <= 10")
def classification_join(spark, sf_dir):
    return top_flags(spark, sf_dir)


def top_flags(spark, sf_dir, span=365 * DAY):
    top = M.top_buyers(window(spark, sf_dir, span), 10).select("entity_id", "actor_id", "rank")
    return top.join(flags(spark, sf_dir).select("actor_id", "is_sniper", "is_bot", "is_smart"), "actor_id", "left").select("entity_id", "actor_id", "rank", "is_sniper", "is_bot", "is_smart")


@query(f"WITH {A_TRADES}, {ACT_SQL} SELECT actor_id, entity_id, realized FROM act JOIN (SELECT entity_id FROM trades GROUP BY entity_id HAVING max(mcap) >= 62) USING (entity_id)", rounded=("realized",), digits=4)
def peak_filter_join(spark, sf_dir):
    grown = ledger_trades(spark, sf_dir).groupBy("entity_id").agg(F.max("mcap").alias("m")).where("m >= 62").select("entity_id")
    return activity(spark, sf_dir).join(grown, "entity_id").select("actor_id", "entity_id", "realized")


@query(f"WITH {_SCORES_SQL} SELECT t.entity_id, t.created_at, t.creator_id, x.last_trade, s.n_scores FROM tokens t LEFT JOIN (SELECT entity_id, max(ts) AS last_trade FROM trades GROUP BY entity_id) x USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS n_scores FROM scores WHERE source = 'live' GROUP BY entity_id) s USING (entity_id) WHERE t.created_at < {_T0}")
def creator_history_lateral(spark, sf_dir):
    last = stream_trades(spark, sf_dir).groupBy("entity_id").agg(F.max("ts").alias("last_trade"))
    n = scores(spark, sf_dir).where("source = 'live'").groupBy("entity_id").agg(F.count("*").alias("n_scores"))
    t = stream_tokens(spark, sf_dir).where(F.col("created_at") < _T0).select("entity_id", "created_at", "creator_id")
    return t.join(last, "entity_id", "left").join(n, "entity_id", "left")


@query(f"WITH {A} SELECT entity_id, config_id, stop FROM tokens, (VALUES ('a', 10), ('b', 15), ('c', 20)) v(config_id, stop)")
def config_cross_join(spark, sf_dir):
    configs = spark.createDataFrame([("a", 10), ("b", 15), ("c", 20)], "config_id string, stop int")  # a parameter table, a row per configuration
    return ledger_tokens(spark, sf_dir).select("entity_id").crossJoin(F.broadcast(configs))


@query(f"""WITH {_SCORES_SQL}, l AS (SELECT entity_id, arg_max(decision, event_id) AS d, max(score) AS m FROM scores WHERE source = 'live' GROUP BY entity_id), r AS (SELECT entity_id, arg_max(decision, event_id) AS d, max(score) AS m FROM scores WHERE source = 'backfill' GROUP BY entity_id)
SELECT entity_id, l.d AS live, r.d AS replay, l.d IS NOT DISTINCT FROM r.d AS same_decision, l.m IS NOT DISTINCT FROM r.m AS same_score FROM l JOIN r USING (entity_id)""")
def live_vs_replay_join(spark, sf_dir):
    g = lambda s: scores(spark, sf_dir).where(F.col("source") == s).groupBy("entity_id").agg(F.max_by("decision", "event_id").alias("d"), F.max("score").alias("m")).alias(s)
    j = g("live").join(g("backfill"), "entity_id")
    return j.select("entity_id", F.col("live.d").alias("live"), F.col("backfill.d").alias("replay"), F.col("live.d").eqNullSafe(F.col("backfill.d")).alias("same_decision"), F.col("live.m").eqNullSafe(F.col("backfill.m")).alias("same_score"))


_CLUSTER_SQL = f"""{_PAIR_SQL}, ud AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a, b FROM ud UNION SELECT r.a, u.b FROM reach r JOIN ud u ON r.b = u.a),
cl0 AS (SELECT a AS actor_id, least(a, min(b)) AS cluster_id FROM reach GROUP BY a), cl AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM cl0)"""


def actor_cluster_table(spark, sf_dir):
    return C.clusters(co_pairs(spark, sf_dir))


@query(f"WITH RECURSIVE {A_TRADES}, {_CLUSTER_SQL} SELECT actor_id, cluster_id, cluster_size FROM cl")
def actor_clusters(spark, sf_dir):
    return actor_cluster_table(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {A}, {_CLUSTER_SQL}, eb AS (SELECT DISTINCT entity_id, actor_id FROM trades JOIN tokens USING (entity_id) WHERE side = 'buy' AND ts <= created_at + {365 * DAY}),
g AS (SELECT entity_id, cluster_id, cluster_size, count(*) AS n_early FROM eb JOIN cl USING (actor_id) WHERE cluster_size BETWEEN 2 AND 50 GROUP BY ALL)
SELECT entity_id, cluster_id, cluster_size, n_early FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n_early DESC, cluster_id) AS q FROM g) WHERE q = 1"""
)
def cluster_buyers_join(spark, sf_dir):
    return K.largest_cluster(window(spark, sf_dir), actor_cluster_table(spark, sf_dir), 2, 50)


@query(f"WITH {A_TRADES}, {ACT_SQL} SELECT * FROM act", rounded=("buy_amount", "sell_amount", "realized"), digits=4)
def actor_activity(spark, sf_dir):
    return activity(spark, sf_dir)


@query(f"WITH {_CLASS_SQL} SELECT * FROM st", rounded=("amount_cv",))
def actor_stats(spark, sf_dir):
    return C.actor_stats(ledger_trades(spark, sf_dir), ledger_tokens(spark, sf_dir), NOW, 180 * DAY)


@query(f"WITH {_CLASS_SQL} SELECT * FROM mh")
def actor_median_hold(spark, sf_dir):
    return C.median_hold(activity(spark, sf_dir))


@query(f"WITH {_CLASS_SQL} SELECT * FROM gw", rounded=("graduated_winrate",))
def actor_graduated_winrate(spark, sf_dir):
    return C.graduated_winrate(activity(spark, sf_dir), ledger_trades(spark, sf_dir), 35.0, 1)


@query(f"WITH {_CLASS_SQL} SELECT actor_id, fastest_buy_age, n_buys, n_buys_recent, median_hold, n_graduated, is_sniper, is_bot, is_smart FROM fg")
def actor_flags(spark, sf_dir):
    return flags(spark, sf_dir).drop("amount_cv", "graduated_winrate")


@query(f"WITH {_CLASS_SQL} SELECT count(*) AS n_actors, {', '.join(f'count(*) FILTER (is_{c}) AS n_{c}, count(*) FILTER (is_{c}) / count(*) * 100 AS pct_{c}' for c in ('sniper', 'bot', 'smart'))} FROM fg", rounded=("pct_sniper", "pct_bot", "pct_smart"))
def classification_report(spark, sf_dir):
    return C.flag_report(flags(spark, sf_dir))


_PB = ("top3_prior", "top3_winrate", "top3_best_winrate", "top3_age_days", "top3_realized", "top10_prior", "top10_winrate")


@query(
    f"""WITH {TOP_SQL}, x AS (SELECT *, n_prior > 0 AS has, n_won / nullif(n_closed, 0) AS wr, CASE WHEN cutoff > first_seen THEN (cutoff - first_seen) / 86400 END AS ad FROM prior)
SELECT entity_id, avg(n_prior) FILTER (has AND rank <= 3) AS top3_prior, avg(wr) FILTER (has AND rank <= 3) AS top3_winrate, max(wr) FILTER (has AND rank <= 3) AS top3_best_winrate,
avg(CASE WHEN has AND rank <= 3 THEN ad2 END) AS top3_age_days, avg(sum_realized) FILTER (has AND rank <= 3) AS top3_realized, CASE WHEN count(*) > 3 THEN avg(n_prior) FILTER (has) END AS top10_prior, CASE WHEN count(*) > 3 THEN avg(wr) FILTER (has) END AS top10_winrate
FROM (SELECT x.*, CASE WHEN x.cutoff > af.fs THEN (x.cutoff - af.fs) / 86400 END AS ad2 FROM x LEFT JOIN (SELECT t.entity_id, t.actor_id, min(a.first_ts) AS fs FROM top t JOIN act a ON a.actor_id = t.actor_id AND a.last_ts < t.cutoff WHERE t.rank <= 10 GROUP BY ALL) af USING (entity_id, actor_id)) GROUP BY entity_id""",
    rounded=_PB,
    digits=4,
)
def prior_buyer_features(spark, sf_dir):
    return C.prior_buyer_features(prior(spark, sf_dir))


@query(
    f"""WITH {_CLASS_SQL} SELECT entity_id, CASE WHEN count(fg.actor_id) > 0 THEN count(*) FILTER (is_sniper) END AS n_sniper, CASE WHEN count(fg.actor_id) > 0 THEN count(*) FILTER (is_smart) END AS n_smart, CASE WHEN count(fg.actor_id) > 0 THEN count(*) FILTER (is_bot) END AS n_bot
FROM top t LEFT JOIN fg USING (actor_id) WHERE rank <= 10 GROUP BY entity_id"""
)
def top10_flag_counts(spark, sf_dir):
    return K.flag_counts(classification_join(spark, sf_dir))


@query(f"WITH {A}, {SNAP_SQL} SELECT * FROM snap", rounded=("avg_ttl", "median_peak"))
def creator_snapshot(spark, sf_dir):
    return snapshots(spark, sf_dir)


@query(f"WITH {A}, {SNAP_SQL} SELECT creator_id, entity_id, ref_ts, n_prior FROM snap WHERE entity_id % 3 <> 0")
def creator_snapshot_backfill(spark, sf_dir):
    sf_dir = kept(spark, sf_dir)
    have = ledger_tokens(spark, sf_dir).where("entity_id % 3 = 0").select("entity_id")
    return snapshots(spark, sf_dir).join(have, "entity_id", "left_anti").select("creator_id", "entity_id", "ref_ts", "n_prior")


@query(
    f"""WITH {A}, {SNAP_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY ref_ts DESC, entity_id DESC) AS q FROM snap) WHERE q = 1),
n AS (SELECT creator_id, coalesce(n_prior >= 5 AND graduated_count / nullif(n_prior, 0) < 1.1 AND median_peak < 62.5, false) AS is_flagged FROM l), o AS (SELECT DISTINCT creator_id FROM tokens WHERE creator_id % 3 = 0)
SELECT coalesce(n.creator_id, o.creator_id) AS creator_id, o.creator_id IS NOT NULL AS was_flagged, coalesce(is_flagged, false) AS is_flagged,
 CASE WHEN coalesce(is_flagged, false) AND o.creator_id IS NULL THEN 'on' WHEN o.creator_id IS NOT NULL AND NOT coalesce(is_flagged, false) THEN 'off' ELSE 'same' END AS change FROM n FULL JOIN o ON n.creator_id = o.creator_id"""
)
def creator_blacklist(spark, sf_dir):
    sf_dir = kept(spark, sf_dir)
    old = ledger_tokens(spark, sf_dir).where("creator_id % 3 = 0").select("creator_id").distinct()
    return C.creator_blacklist(snapshots(spark, sf_dir), old, 5, 1.1, 62.5)


@query(f"WITH {_HOLD_SQL} SELECT * FROM holders", rounded=("top1_pct", "top5_pct", "top10_pct"))
def holder_concentration(spark, sf_dir):
    return holders(spark, sf_dir)


@query(
    f"""WITH {_HOLD_SQL}, g AS (SELECT entity_id, max(top1_pct) FILTER (age = {AGES[0]}) AS top1_pct_1, max(holder_count) FILTER (age = {AGES[0]}) AS holder_count_1, max(top1_pct) FILTER (age = {AGES[1]}) AS top1_pct_2, max(holder_count) FILTER (age = {AGES[1]}) AS holder_count_2 FROM holders GROUP BY entity_id),
e AS (SELECT *, CASE WHEN top1_pct_1 IS NOT NULL AND top1_pct_2 IS NOT NULL THEN least(greatest(2 * top1_pct_2 - top1_pct_1, 0), 100) END AS top1_pct_3, CASE WHEN holder_count_1 IS NOT NULL AND holder_count_2 IS NOT NULL THEN greatest(2 * holder_count_2 - holder_count_1, holder_count_1, holder_count_2) END AS holder_count_3 FROM g)
SELECT *, top1_pct_3 - top1_pct_1 AS top1_delta, (holder_count_3 - holder_count_1) / 90 AS holder_velocity FROM e""",
    rounded=("top1_pct_1", "top1_pct_2", "top1_pct_3", "top1_delta", "holder_velocity"),
)
def holder_extrapolate(spark, sf_dir):
    return C.holder_extrapolated(holders(spark, sf_dir), AGES[0], AGES[1])


# -- books --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_SCORES_SQL} SELECT count(*) AS n, count(*) FILTER (decision = 'BUY') AS n_buy, count(*) FILTER (decision = 'BORDERLINE') AS n_borderline, count(*) FILTER (decision = 'SKIP') AS n_skip FROM scores")
def decision_counts(spark, sf_dir):
    return K.decision_counts(scores(spark, sf_dir))


@query(f"WITH {_SCORES_SQL} SELECT source AS fast, decision AS full, count(*) AS n, avg(amount - 50) AS avg_pnl, avg((amount > 50)::INT) * 100 AS win_rate, count(*) >= 500 AND avg((amount > 50)::INT) * 100 < 5 AS warning FROM scores GROUP BY 1, 2", rounded=("avg_pnl", "win_rate"))
def signal_universe(spark, sf_dir):
    return K.signal_universe(scores(spark, sf_dir).select(F.col("source").alias("fast"), F.col("decision").alias("full"), (F.col("amount") - 50).alias("pnl")))


@query(
    f"""WITH {POSITIONS_SQL}, c(config_id) AS (VALUES ('c0'), ('c1'), ('c2'), ('c3'), ('c9'))
SELECT config_id, count(*) FILTER (status = 'closed') AS n_closed, count(*) FILTER (status = 'open') AS n_open, avg((pnl > 0)::INT) FILTER (status = 'closed') * 100 AS win_rate, coalesce(sum(pnl) FILTER (status = 'closed'), 0) AS pnl, avg(pnl) FILTER (status = 'closed') AS avg_pnl
FROM c LEFT JOIN positions USING (config_id) GROUP BY config_id""",
    rounded=("win_rate", "pnl", "avg_pnl"),
)
def ab_breakdown(spark, sf_dir):
    configs = spark.createDataFrame([(f"c{i}",) for i in (0, 1, 2, 3, 9)], "config_id string")
    return K.ab_breakdown(positions(spark, sf_dir), configs)


@query(f"WITH {POSITIONS_SQL} SELECT exit_reason, count(*) AS n, count(*) / (SELECT count(*) FROM positions WHERE status = 'closed') * 100 AS share, avg(pnl_pct) AS avg_pnl, avg((pnl_pct > 0)::INT) * 100 AS win_rate FROM positions WHERE status = 'closed' GROUP BY exit_reason", rounded=("share", "avg_pnl", "win_rate"))
def exit_reason_breakdown(spark, sf_dir):
    return K.breakdown(positions(spark, sf_dir).where("status = 'closed'"), "exit_reason")


_BOOK = ("win_rate", "gross_profit", "gross_loss", "profit_factor", "avg_win", "avg_loss", "roi_pct", "avg_hold")


@query(
    f"""WITH {POSITIONS_SQL}, x AS (SELECT config_id, exit_reason, count(*) AS c FROM positions WHERE status = 'closed' GROUP BY ALL), h AS (SELECT config_id, string_agg(exit_reason || '=' || c, ',' ORDER BY exit_reason) AS exits FROM x GROUP BY config_id)
SELECT config_id, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, avg((pnl > 0)::INT) * 100 AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit, coalesce(-sum(pnl) FILTER (pnl <= 0), 0) AS gross_loss,
coalesce(sum(pnl) FILTER (pnl > 0), 0) / greatest(coalesce(-sum(pnl) FILTER (pnl <= 0), 0), 1e-4) AS profit_factor, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss, sum(pnl) / (count(*) * 0.1) * 100 AS roi_pct, avg(hold_seconds) AS avg_hold, any_value(exits) AS exits
FROM positions JOIN h USING (config_id) WHERE status = 'closed' GROUP BY config_id""",
    rounded=_BOOK,
)
def book_summary(spark, sf_dir):
    out = K.book_summary(positions(spark, sf_dir).where("status = 'closed'"), "config_id", 0.1)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("exit_reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("config_id", "trades", "wins", "losses", *_BOOK, text.alias("exits"))


@query(
    f"""WITH {A.replace("trades AS", "trades AS")}, ev AS (SELECT trades.*, created_at FROM trades JOIN tokens USING (entity_id) WHERE ts BETWEEN created_at AND created_at + {365 * DAY}),
b AS (SELECT *, count(*) OVER w AS k, sum(amount) OVER w / sum(qty) OVER w AS a FROM ev WHERE side = 'buy' WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT entity_id, first(amount / qty ORDER BY ts DESC, event_id DESC) AS p, max(a) FILTER (k = 5) AS a5, max(a) FILTER (k = 10) AS a10 FROM b GROUP BY entity_id),
u AS (SELECT 5 AS nth, coalesce((p - a5) / a5 * 100, 0) AS pnl FROM g UNION ALL SELECT 10, coalesce((p - a10) / a10 * 100, 0) FROM g)
SELECT nth, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, coalesce(count(*) FILTER (pnl > 0) / nullif(count(*), 0) * 100, 0) AS win_rate, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS sum_won, coalesce(sum(pnl) FILTER (pnl < 0), 0) AS sum_lost, coalesce(sum(pnl), 0) AS net FROM u WHERE pnl <> 0 GROUP BY nth""",
    rounded=("win_rate", "sum_won", "sum_lost", "net"),
    digits=4,
)
def nth_entry_summary(spark, sf_dir):
    return K.nth_summary(M.nth_entry_pnl(window(spark, sf_dir), (5, 10)), {5: "pnl_5", 10: "pnl_10"})


@query(
    f"""WITH {POSITIONS_SQL} SELECT id, config_id, balance, floor(least(greatest(round(balance, 6) * 0.05::DOUBLE, 0.05::DOUBLE), 0.5::DOUBLE) * 1000 + 0.5) / 1000 AS size
FROM (SELECT id, config_id, 1.0 + sum(pnl) OVER (PARTITION BY config_id ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING) AS balance FROM positions WHERE status = 'closed')""",
    rounded=("balance",),
)
def realized_balance(spark, sf_dir):
    return K.realized_balance(positions(spark, sf_dir).where("status = 'closed'"), "config_id", 1.0, 0.05, 0.05, 0.5)


@query(f"""WITH {POSITIONS_SQL}, runs AS (SELECT config_id AS session, exit_reason AS run_id, sum(pnl) AS pnl, avg((pnl > 0)::INT) * 100 AS win_rate, max(exit_time) AS created_at FROM positions WHERE status = 'closed' GROUP BY ALL)
SELECT session, count(*) AS runs, count(*) FILTER (pnl > 0) AS profitable, max(win_rate) AS best_win_rate, max(pnl) AS best_pnl, avg(pnl) AS avg_pnl, max(created_at) AS last_run FROM runs GROUP BY session""", rounded=("best_win_rate", "best_pnl", "avg_pnl"))
def session_summary(spark, sf_dir):
    runs = positions(spark, sf_dir).where("status = 'closed'").groupBy(F.col("config_id").alias("session"), F.col("exit_reason").alias("run_id")).agg(F.sum("pnl").alias("pnl"), (F.avg((F.col("pnl") > 0).cast("int")) * 100).alias("win_rate"), F.max("exit_time").alias("created_at"))
    return K.session_summary(runs)


_NOW = 1704067200.0 + 20 * DAY
_HEALTH_SQL = f"""{POSITIONS_SQL}, z AS (SELECT 'recent' AS span, * FROM positions WHERE status = 'closed' AND exit_time > {_NOW - 4 * 3600} AND exit_time <= {_NOW} UNION ALL SELECT 'baseline', * FROM positions WHERE status = 'closed' AND exit_time > {_NOW - 48 * 3600} AND exit_time <= {_NOW}),
health AS (SELECT span, count(*) AS n, avg((pnl > 0)::INT) * 100 AS win_rate, avg(pnl) AS avg_pnl, avg((exit_reason = 'hard_stop')::INT) * 100 AS hard_stop_pct, avg((exit_reason = 'timeout')::INT) * 100 AS survival_pct,
 coalesce(sum(pnl) FILTER (hour(to_timestamp(exit_time) AT TIME ZONE 'UTC') BETWEEN 9 AND 16), 0) AS pnl_day, coalesce(sum(pnl) FILTER (hour(to_timestamp(exit_time) AT TIME ZONE 'UTC') BETWEEN 17 AND 22), 0) AS pnl_evening, coalesce(sum(pnl) FILTER (hour(to_timestamp(exit_time) AT TIME ZONE 'UTC') NOT BETWEEN 9 AND 22), 0) AS pnl_rest FROM z GROUP BY span)"""


@query(f"WITH {_HEALTH_SQL} SELECT * FROM health", rounded=("win_rate", "avg_pnl", "hard_stop_pct", "survival_pct", "pnl_day", "pnl_evening", "pnl_rest"))
def window_health(spark, sf_dir):
    return K.window_health(positions(spark, sf_dir).where("status = 'closed'"), _NOW, 4 * 3600.0, 48 * 3600.0)


@query(f"""WITH {_HEALTH_SQL} SELECT r.n, b.n AS n_baseline, r.win_rate - b.win_rate AS win_rate_change, CASE WHEN r.n < 30 OR b.n < 150 THEN 'OK' WHEN r.win_rate < b.win_rate - 5 AND r.avg_pnl < b.avg_pnl - 0.005 THEN 'REGRESSION'
 WHEN r.win_rate < b.win_rate - 5 OR r.avg_pnl < b.avg_pnl - 0.005 OR r.hard_stop_pct > b.hard_stop_pct * 1.2 + 1e-9 THEN 'WARN' ELSE 'OK' END AS verdict FROM health r, health b WHERE r.span = 'recent' AND b.span = 'baseline'""", rounded=("win_rate_change",))
def health_verdict(spark, sf_dir):
    return K.health_verdict(K.window_health(positions(spark, sf_dir).where("status = 'closed'"), _NOW, 4 * 3600.0, 48 * 3600.0), 30, 150, 5.0, 0.005, 0.2)


@query(f"WITH {POSITIONS_SQL}, r AS (SELECT config_id, hold_seconds AS x, row_number() OVER (PARTITION BY config_id ORDER BY hold_seconds) - 1 AS i, count(*) OVER (PARTITION BY config_id) AS n FROM positions) SELECT config_id, max(x) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(x) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(x) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY config_id")
def latency_percentiles(spark, sf_dir):
    return K.percentiles(positions(spark, sf_dir), "config_id", "hold_seconds", (0.5, 0.95, 0.99))


@query(f"WITH {POSITIONS_SQL} SELECT count(*) AS n, max(proba) AS max_proba, avg(proba) AS avg_proba FROM positions WHERE entry_time > {_NOW - 1800} AND entry_time <= {_NOW}", rounded=("avg_proba",))
def proba_window_stats(spark, sf_dir):
    return K.proba_stats(positions(spark, sf_dir), _NOW, 1800.0)


@query(f"""WITH {POSITIONS_SQL}, u AS (SELECT 'pnl' AS field, pnl AS x FROM positions UNION ALL SELECT 'entry_buyer_number', entry_buyer_number FROM positions UNION ALL SELECT 'score', score FROM positions UNION ALL SELECT 'hold_seconds', CASE WHEN status = 'open' THEN NULL ELSE hold_seconds END FROM positions)
SELECT field, count(*) AS n, avg((x = 0 AND x IS NOT NULL)::INT) * 100 AS zero_pct, avg((x IS NULL)::INT) * 100 AS null_pct, avg(x) AS mean FROM u GROUP BY field""", rounded=("zero_pct", "null_pct", "mean"))
def zero_rate_profile(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("hold_seconds", F.when(F.col("status") != "open", F.col("hold_seconds")))
    return K.zero_rates(p, ["pnl", "entry_buyer_number", "score", "hold_seconds"])


@query(f"""WITH {POSITIONS_SQL}, x AS (SELECT pnl_pct / 100 AS p, 0.02 * sqrt(entry_buyer_number / 3.0) AS s FROM positions WHERE status = 'closed'), y AS (SELECT p, (1 + p) * (1 - s) / (1 + s) - 1 AS q, CASE WHEN p < -0.2 THEN 'loss' WHEN p < 0 THEN 'small_loss' WHEN p < 0.2 THEN 'small_gain' ELSE 'gain' END AS bucket FROM x)
SELECT bucket, count(*) AS n, avg(p) AS before, avg(q) AS after, avg(q - p) AS cost FROM y GROUP BY bucket""", rounded=("before", "after", "cost"))
def slippage_buckets(spark, sf_dir):
    p = positions(spark, sf_dir).where("status = 'closed'").select((F.col("pnl_pct") / 100).alias("p"), F.col("entry_buyer_number").alias("size"))
    return K.slippage_buckets(p, 0.02, 3.0)


_SWEEP = ("avg_pnl", "win_rate", "tp_rate", "stop_rate", "timeout_rate", "trail_rate", "rate_up", "rate_down", "avg_winner", "top5_mean")


@query(
    f"""WITH {POSITIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY pnl_pct DESC, id) AS k, count(*) OVER (PARTITION BY config_id) AS n FROM positions WHERE status = 'closed')
SELECT config_id, count(*) AS n, avg(pnl_pct) AS avg_pnl, avg((pnl_pct > 0)::INT) AS win_rate, avg((exit_reason = 'take_profit')::INT) AS tp_rate, avg((exit_reason = 'hard_stop')::INT) AS stop_rate, avg((exit_reason = 'timeout')::INT) AS timeout_rate, avg((exit_reason = 'trailing_stop')::INT) AS trail_rate,
avg((pnl_pct >= 30)::INT) AS rate_up, avg((pnl_pct <= -10)::INT) AS rate_down, avg(pnl_pct) FILTER (pnl_pct > 0) AS avg_winner, avg(pnl_pct) FILTER (k <= greatest(1, floor(0.05 * n))) AS top5_mean FROM r GROUP BY config_id""",
    rounded=_SWEEP,
)
def sweep_summary(spark, sf_dir):
    return K.sweep_summary(positions(spark, sf_dir).where("status = 'closed'"), ["config_id"])


@query(f"""WITH {POSITIONS_SQL} SELECT count(*) AS n, avg((pnl_pct > 0)::INT) AS win_rate, avg(pnl_pct) FILTER (pnl_pct > 0) AS avg_winner, avg(pnl_pct) FILTER (pnl_pct <= 0) AS avg_loser, avg(pnl_pct) AS ev,
avg(pnl_pct) FILTER (exit_time > {_NOW - DAY}) AS last_day, avg(pnl_pct) FILTER (exit_time <= {_NOW - DAY} AND exit_time > {_NOW - 2 * DAY}) AS day_before FROM positions WHERE status = 'closed' AND exit_time <= {_NOW}""", rounded=("win_rate", "avg_winner", "avg_loser", "ev", "last_day", "day_before"))
def audit_summary(spark, sf_dir):
    return K.audit(positions(spark, sf_dir).where("status = 'closed'"), _NOW, DAY)


@query(f"""WITH {POSITIONS_SQL}, f AS (SELECT entity_id, count(*) AS n_failures FROM positions WHERE status = 'open' GROUP BY entity_id HAVING count(*) >= 3)
SELECT entity_id, n_failures, -1.0::DOUBLE AS capture_age, true AS is_negative FROM f WHERE entity_id NOT IN (SELECT entity_id FROM positions WHERE exit_reason = 'hard_stop' AND id % 5 = 0 AND entity_id % 2 = 0)""")
def pre_capture_deaths(spark, sf_dir):
    p = positions(spark, sf_dir)
    return K.dead_before_capture(p.where("status = 'open'"), p.where("exit_reason = 'hard_stop' and id % 5 = 0 and entity_id % 2 = 0"), 3)


@query(f"WITH {A_TRADES}, l AS (SELECT CASE WHEN event_id % 3 = 0 THEN 30 WHEN event_id % 3 = 1 THEN 60 ELSE 120 END AS target, qty AS lag FROM trades) SELECT target, count(*) AS n, avg(lag) AS mean_lag, quantile_cont(lag, 0.5) AS p50, quantile_cont(lag, 0.95) AS p95 FROM l GROUP BY target", rounded=("mean_lag", "p50", "p95"))
def capture_lag(spark, sf_dir):
    t = ledger_trades(spark, sf_dir)
    target = F.when(F.col("event_id") % 3 == 0, 30).when(F.col("event_id") % 3 == 1, 60).otherwise(120)
    return K.capture_lag(t.select(target.alias("target"), (target + F.col("qty")).alias("actual")))
