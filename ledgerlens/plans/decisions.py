"""Queries D: entry rules, gates and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import metrics as M
from ..operators import windows as W
from ..sources.tables import kept, ledger_tokens
from .base import A, query
from .history import _CLASS_SQL, _CLUSTER_SQL, _HOLD_SQL, AGES, SNAP_SQL, actor_cluster_table, flags, holders, snapshots
from .metrics import FAST, FULL, MSQL, full_metrics, window
from .store import POSITIONS_SQL, positions

DAY = 86400.0
FAST_RULES = D.FastRules(min_mcap=35.0, max_sell_ratio_reject=3.0, min_buyers=2, min_volume=60000.0, min_rate=1e-6, min_diversity=2, max_sell_ratio=0.5, max_reserve_pct=60.0, hard_min_volume=1000.0, hard_min_buyers=1, threshold=25)
_FAST_M = MSQL.replace(f"created_at + {FULL}", f"created_at + {FAST}")
_FD = f"""fm AS (SELECT *, buy_count / greatest(window_span, 0.1) AS buy_rate FROM m),
ft AS (SELECT *, unique_buyers >= 2 AS t1, buy_volume >= 60000 AS t2, buy_rate >= 1e-6 AS t3, buy_diversity >= 2 AS t4, sell_ratio <= 0.5 AS t5, reserve_pct <= 60 AS t6, buy_volume < 1000 OR unique_buyers < 1 AS hard,
 CASE WHEN last_mcap < 35 THEN 'mcap_too_low' WHEN sell_ratio > 3 THEN 'sell_pressure_reject' WHEN creator_sold THEN 'creator_sold_fast' END AS reject FROM fm),
fs AS (SELECT *, CASE WHEN t1 THEN 10 ELSE 0 END + CASE WHEN t2 THEN 10 ELSE 0 END + CASE WHEN t3 THEN 10 ELSE 0 END + CASE WHEN t4 THEN 5 ELSE 0 END + CASE WHEN t5 THEN 5 ELSE 0 END + CASE WHEN t6 THEN 5 ELSE 0 END + CASE WHEN creator_self_buy THEN -5 ELSE 0 END AS s FROM ft),
fast AS (SELECT entity_id, buy_count, CASE WHEN reject IS NOT NULL OR hard THEN 'WAIT' WHEN s >= 25 THEN 'FAST_BUY' ELSE 'WAIT' END AS decision, CASE WHEN reject IS NOT NULL THEN 0 ELSE s END AS score,
 coalesce(reject, concat_ws(' | ', CASE WHEN t1 THEN 'buyers(+10)' ELSE 'buyers_low' END, CASE WHEN t2 THEN 'vol(+10)' ELSE 'vol_low' END, CASE WHEN t3 THEN 'rate(+10)' ELSE 'rate_low' END, CASE WHEN t4 THEN 'div(+5)' ELSE 'div_low' END,
 CASE WHEN t5 THEN 'sells(+5)' ELSE 'sells_low' END, CASE WHEN t6 THEN 'curve(+5)' ELSE 'curve_low' END, CASE WHEN creator_self_buy THEN 'creator_self_buy(-5)' END, CASE WHEN hard THEN 'hard_reject' END)) AS reasons FROM fs)"""


def fast(spark, sf_dir):
    return D.fast_decision(M.fast_metrics(window(spark, sf_dir, FAST)), FAST_RULES)


@query(f"WITH {_FAST_M}, {_FD} SELECT * FROM fast")
def fast_decision(spark, sf_dir):
    return fast(spark, sf_dir)


GATE_PARAMS = {
    "min_mcap": 8.0, "max_sell_ratio": 2.5, "min_reserve_pct": 3.0, "min_buyers": 2, "min_volume": 40000.0, "min_velocity": 2e-7, "min_curve_velocity": -3e-6,
    "min_acceleration": -1.5e-5, "max_acceleration": 1.5e-5, "max_top3": 99.0, "max_same_day": 1, "max_holder_top1": 50.0, "max_holder_top5": 99.0,
    "max_holder_delta1": -1.0, "min_holder_delta1": -25.0, "blacklist": True, "max_rug_rate": 0.05, "min_graduated_rate": 0.95, "min_age_days": 30.0, "min_priors": 4,
}
_CONTEXT = f"""{SNAP_SQL}{_HOLD_SQL.split(A, 1)[1]},
hx AS (SELECT entity_id, max(top1_pct) FILTER (age = {AGES[1]}) AS holder_top1, max(top5_pct) FILTER (age = {AGES[1]}) AS holder_top5, max(top1_pct) FILTER (age = {AGES[2]}) - max(top1_pct) FILTER (age = {AGES[1]}) AS holder_delta1 FROM holders GROUP BY entity_id),
sd AS (SELECT entity_id, row_number() OVER (PARTITION BY creator_id, floor(created_at / 86400) ORDER BY insert_order) - 1 AS n_same_day, creator_id IN (SELECT creator_id FROM tokens GROUP BY creator_id HAVING count(*) >= 26) AS blacklisted FROM tokens),
ctx AS (SELECT entity_id, n_same_day, blacklisted, holder_top1, holder_top5, holder_delta1, n_prior, rug_count / nullif(n_prior, 0) AS rug_rate, graduated_count / nullif(n_prior, 0) AS graduated_rate, age_days FROM sd LEFT JOIN snap USING (entity_id) LEFT JOIN hx USING (entity_id))"""
_GATED = f"""{_CONTEXT}, gated AS (SELECT m.*, ctx.* EXCLUDE (entity_id), CASE WHEN last_mcap < 8 THEN 'mcap_too_low' WHEN sell_ratio > 2.5 THEN 'sell_pressure_reject' WHEN reserve_pct < 3 THEN 'curve_too_low' WHEN unique_buyers < 2 THEN 'uniq_buyers_low' WHEN buy_volume < 40000 THEN 'volume_low'
 WHEN velocity_trend < 2e-7::DOUBLE THEN 'velocity_fade' WHEN curve_velocity < -3e-6::DOUBLE THEN 'curve_vel_low' WHEN curve_acceleration < -1.5e-5::DOUBLE THEN 'curve_accel_low' WHEN curve_acceleration > 1.5e-5::DOUBLE THEN 'curve_accel_high' WHEN top3_share > 99 THEN 'top3_concentrated' WHEN n_same_day > 1 THEN 'creator_spammer'
 WHEN holder_top1 > 50 THEN 'holder_top1' WHEN holder_top5 > 99 THEN 'holder_top5' WHEN holder_delta1 > -1 THEN 'holder_delta1_high' WHEN holder_delta1 < -25 THEN 'holder_delta1_low' WHEN blacklisted THEN 'creator_blacklisted'
 WHEN n_prior >= 4 AND rug_rate >= 0.05 THEN 'creator_rug_rate' WHEN n_prior >= 4 AND graduated_rate < 0.95 THEN 'creator_grad_rate_low' WHEN n_prior >= 4 AND age_days < 30 THEN 'creator_too_new' END AS gate FROM m JOIN ctx USING (entity_id))"""
_SCORED = """scored AS (SELECT *, CASE WHEN n_prior > 15 THEN -5 WHEN n_prior > 1 THEN 10 ELSE 0 END + CASE WHEN n_prior >= 4 AND graduated_rate > 0 THEN least(20, floor(graduated_rate * 30)::INT) ELSE 0 END + CASE WHEN unique_buyers >= 30 THEN 30 WHEN unique_buyers >= 10 THEN 20 WHEN unique_buyers >= 5 THEN 10 ELSE -5 END + CASE WHEN buy_volume > 400000 THEN 20 WHEN buy_volume > 200000 THEN 10 WHEN buy_volume > 50000 THEN 5 ELSE -5 END
 + CASE WHEN buy_diversity >= 4 THEN 10 WHEN buy_diversity < 2 AND buy_count > 3 THEN -15 ELSE 0 END + CASE WHEN reserve_pct > 80 THEN 5 WHEN reserve_pct > 60 THEN 0 WHEN reserve_pct > 5 THEN 10 ELSE -5 END + CASE WHEN creator_sold THEN -15 ELSE 5 END
 + CASE WHEN buy_volume > 0 AND max_buy / buy_volume * 100 > 50 THEN -20 ELSE 0 END + CASE WHEN buy_count >= 3 THEN CASE WHEN sell_ratio >= 2 THEN -20 WHEN sell_ratio >= 1 THEN -10 WHEN sell_ratio >= 0.5 THEN -5 ELSE 5 END ELSE 0 END
 + CASE WHEN top3_share > 80 THEN -10 WHEN top3_share < 50 AND unique_buyers >= 5 THEN 5 ELSE 0 END + CASE WHEN velocity_trend > 1.5 THEN 10 WHEN velocity_trend < 0.5 AND buy_count >= 6 THEN -10 ELSE 0 END
 + CASE WHEN buys_per_unique > 2 AND buy_count >= 6 THEN -15 ELSE 0 END + CASE WHEN first_buy > 90000 THEN -10 ELSE 0 END + CASE WHEN curve_velocity > 0.5 THEN 5 ELSE 0 END AS score FROM gated)"""
SCORE_PARAMS = {"serial_above": 15, "min_priors": 4, "volume_massive": 400000.0, "volume_high": 200000.0, "volume_ok": 50000.0, "whale_pct": 50.0, "sniper": 90000.0}
_FULL = f"{MSQL}, {_GATED}, {_SCORED}, decided AS (SELECT *, CASE WHEN gate IS NOT NULL THEN 'SKIP' WHEN score >= 30 THEN 'BUY' WHEN score >= 15 THEN 'BORDERLINE' ELSE 'SKIP' END AS decision FROM scored)"


def context(spark, sf_dir):
    """What is known of each entity besides its events: its creator's past and day, and its holders at two ages."""
    t = ledger_tokens(spark, sf_dir)
    bad = t.groupBy("creator_id").agg(F.count("*").alias("n")).where("n >= 26").select("creator_id", F.lit(True).alias("blacklisted"))
    past = snapshots(spark, sf_dir).select("entity_id", "n_prior", F.try_divide("rug_count", "n_prior").alias("rug_rate"), F.try_divide("graduated_count", "n_prior").alias("graduated_rate"), "age_days")
    at = lambda c, age: F.max(F.when(F.col("age") == age, F.col(c)))
    held = holders(spark, sf_dir).groupBy("entity_id").agg(at("top1_pct", AGES[1]).alias("holder_top1"), at("top5_pct", AGES[1]).alias("holder_top5"), (at("top1_pct", AGES[2]) - at("top1_pct", AGES[1])).alias("holder_delta1"))
    day = W.same_day(t).join(t.select("entity_id", "creator_id"), "entity_id").join(bad, "creator_id", "left").drop("creator_id").withColumn("blacklisted", F.coalesce("blacklisted", F.lit(False)))
    return day.join(past, "entity_id", "left").join(held, "entity_id", "left")


def gated(spark, sf_dir):
    sf_dir = kept(spark, sf_dir)
    return D.hard_gates(full_metrics(spark, sf_dir).join(context(spark, sf_dir), "entity_id"), GATE_PARAMS)


def decided(spark, sf_dir):
    s = gated(spark, sf_dir).withColumn("score", D.rule_score(SCORE_PARAMS))
    return s.withColumn("decision", D.score_decision(F.col("score"), 30, 15, F.col("gate")))


@query(f"WITH {MSQL}, {_GATED} SELECT entity_id, gate FROM gated")
def score_hard_gates(spark, sf_dir):
    return gated(spark, sf_dir).select("entity_id", "gate")


@query(f"WITH {_FULL} SELECT entity_id, score FROM decided")
def score_rules(spark, sf_dir):
    return decided(spark, sf_dir).select("entity_id", "score")


@query(f"WITH {_FULL} SELECT entity_id, gate, score, decision FROM decided")
def score_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("entity_id", "gate", "score", "decision")


@query(
    f"""WITH {MSQL}, o AS (SELECT entity_id, count(*) FILTER (is_buy) AS b, count(*) FILTER (NOT is_buy) AS s, count(DISTINCT actor_id) FILTER (is_buy) AS u, coalesce(sum(amount) FILTER (is_buy), 0) AS v, count(DISTINCT round_even(amount, 4)) FILTER (is_buy) AS k, coalesce(max(amount) FILTER (is_buy), 0) AS t,
 first(reserve ORDER BY ts DESC, event_id DESC) AS lr, coalesce(bool_or(NOT is_buy AND actor_id = creator_id), false) AS cs FROM r GROUP BY entity_id),
q AS (SELECT *, CASE WHEN lr > 0 THEN least(lr / 85 * 100, 100) ELSE 0 END AS pct, s / greatest(b, 1) AS ratio FROM o),
p AS (SELECT entity_id, CASE WHEN u >= 30 THEN 30 WHEN u >= 10 THEN 20 WHEN u >= 5 THEN 5 ELSE -15 END + CASE WHEN v > 600000 THEN 25 WHEN v > 300000 THEN 15 WHEN v > 100000 THEN 5 ELSE -5 END + CASE WHEN b = 0 THEN 0 WHEN k >= 4 THEN 10 WHEN k < 2 AND b > 3 THEN -15 ELSE 0 END
 + CASE WHEN pct > 70 THEN -10 WHEN pct > 40 THEN -5 WHEN pct > 10 THEN 5 ELSE 0 END + CASE WHEN cs THEN -15 ELSE 5 END + CASE WHEN v > 0 AND t > 0 AND t / v * 100 > 50 THEN -20 ELSE 0 END
 + CASE WHEN b < 3 THEN 0 WHEN ratio >= 1.0 THEN -30 WHEN ratio >= 0.7 THEN -15 WHEN ratio >= 0.4 THEN -5 ELSE 5 END AS score FROM q)
SELECT entity_id, score, CASE WHEN score >= 40 THEN 'BUY' WHEN score >= 20 THEN 'BORDERLINE' ELSE 'SKIP' END AS decision FROM p"""
)
def observation_score(spark, sf_dir):
    return D.observation_score(M.observation_metrics(window(spark, sf_dir)), 600000.0, 300000.0, 100000.0)


_MODES = "(VALUES ('fast'), ('full'), ('both')) v(mode)"
_ENTRY = f"""fx AS (SELECT d.entity_id, d.decision AS full_decision, d.score AS full_score, d.buy_count AS full_buy_count, d.last_price AS exit_price, f.decision AS fast_decision, f.score AS fast_score, f.buy_count AS fast_buy_count FROM decided d JOIN fastd f USING (entity_id)),
en AS (SELECT *, CASE WHEN mode = 'full' THEN 'full' WHEN mode = 'fast' THEN 'fast' WHEN full_decision = 'BUY' THEN 'full' ELSE 'fast' END AS kind FROM fx, {_MODES}),
eo AS (SELECT *, CASE WHEN kind = 'fast' THEN fast_buy_count ELSE full_buy_count END + 1 AS number FROM en),
entered AS (SELECT *, coalesce(((mode = 'fast' AND fast_decision = 'FAST_BUY') OR (mode = 'full' AND full_decision = 'BUY') OR (mode = 'both' AND (fast_decision = 'FAST_BUY' OR full_decision = 'BUY'))) AND NOT (fast_decision = 'FAST_BUY' AND full_decision <> 'BUY' AND full_score < 0)
 AND exit_price > 0 AND number BETWEEN 2 AND 12 AND fast_score <= 40, false) AS enter FROM eo)"""


_FASTD = f"fastd AS (SELECT * FROM (WITH {_FAST_M}, {_FD} SELECT entity_id, decision, score, buy_count FROM fast))"


def entries(spark, sf_dir):
    sf_dir = kept(spark, sf_dir)
    d = decided(spark, sf_dir).select("entity_id", F.col("decision").alias("full_decision"), F.col("score").alias("full_score"), F.col("buy_count").alias("full_buy_count"), F.col("last_price").alias("exit_price"))
    f = fast(spark, sf_dir).select("entity_id", F.col("decision").alias("fast_decision"), F.col("score").alias("fast_score"), F.col("buy_count").alias("fast_buy_count"))
    j = d.join(f, "entity_id").withColumn("mode", F.explode(F.array(F.lit("fast"), F.lit("full"), F.lit("both"))))
    return D.entry_decision(j, F.col("mode"), 2, 12, 40)


@query(f"WITH {_FULL}, {_FASTD}, {_ENTRY} SELECT entity_id, mode, enter, CASE WHEN enter THEN kind END AS entry_type, CASE WHEN enter THEN CASE WHEN kind = 'fast' THEN fast_score ELSE full_score END END AS entry_score, CASE WHEN enter THEN number END AS entry_buyer_number FROM entered")
def entry_decision(spark, sf_dir):
    return entries(spark, sf_dir)


def _gate(name: str, flag: str, least: int, where: str = "") -> None:
    query(
        f"""WITH {_CLASS_SQL}, ge AS (SELECT DISTINCT entity_id, actor_id FROM trades JOIN tokens USING (entity_id) WHERE side = 'buy' AND ts - created_at >= 0 AND ts - created_at < {200 * DAY})
SELECT entity_id, count(*) FILTER ({flag}) AS n, count(*) FILTER ({flag}) >= {least} AS fires FROM ge LEFT JOIN fg USING (actor_id) GROUP BY entity_id""",
        name,
    )(lambda spark, sf_dir: D.early_flag_gate(window(spark, sf_dir), flags(spark, sf_dir).withColumn("is_positive", F.coalesce(F.col("graduated_winrate") > 0.10, F.lit(False))), where or flag, 200 * DAY, least))


_gate("gate_bot_cluster", "is_bot", 1)
_gate("gate_smart_money", "is_smart", 1)
_gate("gate_positive_actor", "graduated_winrate > 0.10", 1, "is_positive")


@query(f"WITH {A} SELECT entity_id, creator_id, creator_id IN (SELECT creator_id FROM tokens GROUP BY creator_id HAVING count(*) >= 22) AS fires FROM tokens")
def gate_blacklist(spark, sf_dir):
    t = ledger_tokens(spark, sf_dir)
    bad = t.groupBy("creator_id").agg(F.count("*").alias("n")).where("n >= 22").select("creator_id", F.lit(True).alias("f"))
    return t.join(bad, "creator_id", "left").select("entity_id", "creator_id", F.coalesce("f", F.lit(False)).alias("fires"))


@query(
    f"""WITH RECURSIVE {A}, {_CLUSTER_SQL}, eb AS (SELECT DISTINCT entity_id, actor_id FROM trades JOIN tokens USING (entity_id) WHERE side = 'buy' AND ts <= created_at + {365 * DAY}),
g AS (SELECT entity_id, cluster_id, count(*) AS n FROM eb JOIN cl USING (actor_id) WHERE cluster_size BETWEEN 2 AND 50 GROUP BY ALL) SELECT entity_id, max(n) AS n, max(n) >= 2 AS fires FROM g GROUP BY entity_id"""
)
def gate_wash_cluster(spark, sf_dir):
    from ..operators.books import largest_cluster

    g = largest_cluster(window(spark, sf_dir), actor_cluster_table(spark, sf_dir), 2, 50)
    return g.select("entity_id", F.col("n_early").alias("n"), (F.col("n_early") >= 2).alias("fires"))


_MO = f"{POSITIONS_SQL}, mo AS (SELECT id, proba, (proba + score / 100) / 2 AS raw, pnl_pct AS reg, entry_buyer_number AS buyers, CASE WHEN score > 60 THEN 'BUY' ELSE 'SKIP' END AS decision FROM positions)"


def _model_rows(spark, sf_dir):
    p = positions(spark, sf_dir)
    return p.select("id", "proba", ((F.col("proba") + F.col("score") / 100) / 2).alias("raw"), F.col("pnl_pct").alias("reg"), F.col("entry_buyer_number").alias("buyers"), F.when(F.col("score") > 60, "BUY").otherwise("SKIP").alias("decision"))


@query(
    f"""WITH {_MO}, z AS (SELECT *, CASE WHEN proba >= 0.6 THEN 'BUY' WHEN proba < 0.3 THEN 'SKIP' ELSE 'RULES' END AS zone, CASE WHEN buyers > 5 THEN 'buyers_max' WHEN raw < 0.15 THEN 'raw_floor' WHEN proba < 0.15 THEN 'calibrated_floor' WHEN reg < 12 THEN 'reg_floor' WHEN reg > 80 THEN 'reg_ceiling' END AS b FROM mo)
SELECT id, zone, CASE WHEN zone = 'BUY' THEN b END AS block, CASE WHEN zone = 'SKIP' THEN 'SKIP' WHEN zone = 'BUY' AND b IS NULL THEN 'BUY' WHEN zone = 'BUY' THEN 'SKIP' ELSE decision END AS decision FROM z"""
)
def model_override(spark, sf_dir):
    return D.model_override(_model_rows(spark, sf_dir), 0.3, 0.6, 12.0, 80.0, 5)


@query(f"WITH {_MO} SELECT id, CASE id % 11 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SKIP' ELSE decision END AS decision FROM mo")
def checkpoint_override(spark, sf_dir):
    early = F.when(F.col("id") % 11 == 0, "BUY_EARLY").when(F.col("id") % 11 == 1, "SKIP_EARLY")
    return _model_rows(spark, sf_dir).select("id", D.checkpoint_override(F.col("decision"), early).alias("decision"))


@query(f"WITH {_FULL}, cf(config_id, buy, min_buyers) AS (VALUES ('a', 30, 3), ('b', 15, 4), ('c', 45, 2)) SELECT config_id, entity_id, score >= buy AND unique_buyers >= min_buyers AS enter FROM decided, cf")
def multi_config_decisions(spark, sf_dir):
    configs = spark.createDataFrame([("a", 30, 3), ("b", 15, 4), ("c", 45, 2)], "config_id string, buy int, min_buyers int")  # a row per configuration
    j = decided(spark, sf_dir).select("entity_id", "score", "unique_buyers").crossJoin(F.broadcast(configs))
    return j.select("config_id", "entity_id", ((F.col("score") >= F.col("buy")) & (F.col("unique_buyers") >= F.col("min_buyers"))).alias("enter"))


@query(f"WITH {POSITIONS_SQL} SELECT id, 1 / (1 + exp(-(pnl_pct / 10))) AS p, CASE WHEN (entry_buyer_number + 1) / 7 < 0.4 THEN 'RULES' WHEN 1 / (1 + exp(-(pnl_pct / 10))) >= 0.7 THEN 'BUY' WHEN 1 / (1 + exp(-(pnl_pct / 10))) < 0.2 THEN 'SKIP' ELSE 'RULES' END AS zone FROM positions", rounded=("p",))
def model_zone(spark, sf_dir):
    p = D.sigmoid(F.col("pnl_pct") / 10)
    return positions(spark, sf_dir).select("id", p.alias("p"), D.model_zone(p, 0.2, 0.7, (F.col("entry_buyer_number") + 1) / 7).alias("zone"))


@query(f"WITH {POSITIONS_SQL} SELECT id, CASE WHEN proba >= 0.8 THEN 'SELL_ALL' WHEN proba >= 0.55 THEN 'SELL_PARTIAL' WHEN proba < 0.2 AND score - 50 >= -5 THEN 'HOLD_HARD' ELSE 'RULES' END AS zone FROM positions")
def exit_model_zone(spark, sf_dir):
    return positions(spark, sf_dir).select("id", D.exit_zone(F.col("proba"), F.col("score") - 50).alias("zone"))


@query(f"WITH {POSITIONS_SQL} SELECT id, CASE WHEN proba >= 0.7 THEN 0.75 WHEN proba >= 0.6 THEN 0.5 WHEN proba >= 0.55 THEN 0.25 ELSE 0 END::DOUBLE AS share FROM positions")
def confidence_ladder(spark, sf_dir):
    return positions(spark, sf_dir).select("id", D.ladder(F.col("proba"), [(0.55, 0.25), (0.6, 0.5), (0.7, 0.75)], 0.0).alias("share"))


@query(
    f"""WITH {POSITIONS_SQL}, z AS (SELECT id, proba, pnl_pct AS q25, score - 60 AS pnl, score * 4 AS peak, hold_seconds AS elapsed, proba * 120 AS mp, CASE WHEN proba >= 0.8 THEN 'SELL_ALL' WHEN proba >= 0.55 THEN 'SELL_PARTIAL' WHEN proba < 0.2 AND score - 60 >= -5 THEN 'HOLD_HARD' ELSE 'RULES' END AS zone FROM positions)
SELECT id, zone IN ('SELL_ALL', 'SELL_PARTIAL') AND pnl > -15 AND pnl <= -5 AND q25 BETWEEN -100 AND 0 AND q25 < -5 AS tighten, zone = 'HOLD_HARD' AND proba < 0.1 AND peak < 300 AND pnl < 500 AS block_take_profit, zone = 'HOLD_HARD' AS block_weak_exit,
CASE WHEN zone IN ('SELL_ALL', 'SELL_PARTIAL') AND elapsed >= 15 THEN zone END AS escalate, greatest(30, least(mp, 90)) AS max_hold FROM z""",
    rounded=("max_hold",),
)
def exit_model_overrides(spark, sf_dir):
    p = positions(spark, sf_dir).select("id", "proba", F.col("pnl_pct").alias("q25"), (F.col("score") - 60).alias("pnl"), (F.col("score") * 4).alias("peak"), F.col("hold_seconds").alias("elapsed"), (F.col("proba") * 120).alias("max_hold_pred"))
    return D.exit_overrides(p.withColumn("zone", D.exit_zone(F.col("proba"), F.col("pnl"))), 15.0, 90.0)


@query(f"WITH {POSITIONS_SQL} SELECT id, score < 30 AND proba >= 0.4 AND hold_seconds >= 20 AND hold_seconds < 60 AS sell FROM positions")
def survival_exit(spark, sf_dir):
    p = positions(spark, sf_dir).select("id", F.col("score").alias("predicted_life"), F.col("proba").alias("confidence"), F.col("hold_seconds").alias("elapsed"))
    return D.survival_exit(p, 30.0, 0.4, 20.0, 60.0)
