"""Entry rules over metric rows: each rule is a column, cascades are CASE expressions, parameters are columns or values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def cascade(rules: list[tuple[Column, Column | str]]) -> Column:
    """The reason of the first rule that holds; NULL if none does."""
    return F.coalesce(*(F.when(c, r if isinstance(r, Column) else F.lit(r)) for c, r in rules))


def points(rules: list[tuple[Column, int]]) -> Column:
    """The sum of the points of all rules that hold."""
    total = F.lit(0)
    for c, p in rules:
        total = total + F.when(c, _c(p)).otherwise(0)
    return total


@dataclass(frozen=True)
class FastRules:
    """Thresholds and weights of the early decision."""

    min_mcap: float = 0.0
    max_sell_ratio_reject: float = 999.0
    min_reserve_pct: float = 0.0
    creator_sold_reject: bool = True
    creator_position_reject: int = 0
    min_buyers: int = 3
    min_volume: float = 0.5
    min_rate: float = 1.0
    min_diversity: int = 3
    max_sell_ratio: float = 0.5
    max_reserve_pct: float = 60.0
    weights: tuple = (10, 10, 10, 5, 5, 5)
    creator_self_buy: int = -5
    hard_min_volume: float = 0.0
    hard_min_buyers: int = 0
    threshold: int = 25


def fast_decision(m: DataFrame, r: FastRules) -> DataFrame:
    """(entity_id, decision, score, reasons) of fast_metrics rows: hard rejects, six weighted tests, a penalty, hard minima."""
    reject = cascade(
        [
            (F.lit(r.min_mcap > 0) & (F.col("last_mcap") < r.min_mcap), "mcap_too_low"),
            (F.lit(r.max_sell_ratio_reject < 999) & (F.col("sell_ratio") > r.max_sell_ratio_reject), "sell_pressure_reject"),
            (F.lit(r.min_reserve_pct > 0) & (F.col("reserve_pct") < r.min_reserve_pct), "curve_too_low"),
            (F.lit(r.creator_sold_reject) & F.col("creator_sold"), "creator_sold_fast"),
            (F.lit(r.creator_position_reject > 0) & F.col("creator_self_buy") & (F.col("creator_buy_position") <= r.creator_position_reject), "creator_self_buy"),
        ]
    )
    tests = [
        ("buyers", F.col("unique_buyers") >= r.min_buyers),
        ("vol", F.col("buy_volume") >= r.min_volume),
        ("rate", F.col("buy_rate") >= r.min_rate),
        ("div", F.col("buy_diversity") >= r.min_diversity),
        ("sells", F.col("sell_ratio") <= r.max_sell_ratio),
        ("curve", F.col("reserve_pct") <= r.max_reserve_pct),
    ]
    score = points([*((c, w) for (_, c), w in zip(tests, r.weights)), (F.col("creator_self_buy"), r.creator_self_buy)])
    hard = (F.col("buy_volume") < r.hard_min_volume) | (F.col("unique_buyers") < r.hard_min_buyers)
    parts = [F.when(c, f"{n}(+{w})").otherwise(f"{n}_low") for (n, c), w in zip(tests, r.weights)]
    reasons = F.concat_ws(" | ", *parts, F.when(F.col("creator_self_buy"), f"creator_self_buy({r.creator_self_buy:+d})"), F.when(hard, "hard_reject"))
    decision = F.when(reject.isNotNull() | hard, "WAIT").when(score >= r.threshold, "FAST_BUY").otherwise("WAIT")
    return m.select("entity_id", "buy_count", decision.alias("decision"), F.when(reject.isNotNull(), 0).otherwise(score).alias("score"), F.coalesce(reject, reasons).alias("reasons"))


#: (name, column, comparison, parameter): the entry gates in order; a gate without its parameter is off. A null never fires.
GATES = [
    ("mcap_too_low", "last_mcap", "<", "min_mcap"),
    ("sell_pressure_reject", "sell_ratio", ">", "max_sell_ratio"),
    ("curve_too_low", "reserve_pct", "<", "min_reserve_pct"),
    ("uniq_buyers_low", "unique_buyers", "<", "min_buyers"),
    ("volume_low", "buy_volume", "<", "min_volume"),
    ("velocity_fade", "velocity_trend", "<", "min_velocity"),
    ("curve_vel_low", "curve_velocity", "<", "min_curve_velocity"),
    ("curve_accel_low", "curve_acceleration", "<", "min_acceleration"),
    ("curve_accel_high", "curve_acceleration", ">", "max_acceleration"),
    ("top3_concentrated", "top3_share", ">", "max_top3"),
    ("creator_spammer", "n_same_day", ">", "max_same_day"),
    ("holder_top1", "holder_top1", ">", "max_holder_top1"),
    ("holder_top5", "holder_top5", ">", "max_holder_top5"),
    ("holder_delta1_high", "holder_delta1", ">", "max_holder_delta1"),
    ("holder_delta1_low", "holder_delta1", "<", "min_holder_delta1"),
    ("creator_blacklisted", "blacklisted", "is", "blacklist"),
    ("creator_rug_rate", "rug_rate", ">=", "max_rug_rate"),
    ("creator_grad_rate_low", "graduated_rate", "<", "min_graduated_rate"),
    ("creator_too_new", "age_days", "<", "min_age_days"),
]
#: Gates that look at a creator's past only if it has `min_priors` entities.
PAST = {"creator_rug_rate", "creator_grad_rate_low", "creator_too_new"}


def hard_gates(m: DataFrame, params: dict[str, float]) -> DataFrame:
    """m with `gate`: the first gate, in order, that the entity fails; parameters may be names of columns."""
    known = F.col("n_prior") >= _c(params.get("min_priors", 0))

    def test(name: str, col: str, op: str, p) -> Column:
        c = F.col(col)
        fails = c if op == "is" else c < _c(p) if op == "<" else c >= _c(p) if op == ">=" else c > _c(p)
        return known & fails if name in PAST else fails

    return m.withColumn("gate", cascade([(test(name, col, op, params[p]), name) for name, col, op, p in GATES if p in params]))


#: Points and thresholds of the additive score; any may be replaced.
SCORE = {
    "serial_above": 50, "serial": -5, "clean": 10, "min_priors": 3,
    "buyers_30": 30, "buyers_10": 20, "buyers_5": 10, "buyers_low": -5,
    "volume_massive": 20.0, "volume_high": 5.0, "volume_ok": 0.5, "massive": 20, "high": 10, "ok": 5, "low": -5,
    "near_graduation_pct": 80.0, "mid_pct": 60.0, "low_pct": 5.0, "near_graduation": 5, "mid": 0, "healthy": 10, "curve_low": -5,
    "creator_sold": -15, "whale_pct": 50.0, "sniper": 2.0,
    "dump_ratio": 2.0, "heavy_ratio": 1.0, "moderate_ratio": 0.5, "dump": -20, "heavy": -10, "moderate": -5, "dominant": 5,
}


def rule_score(params: dict[str, float]) -> Column:
    """The additive score of metric rows with the creator's past; bands are exclusive, the highest that holds counts."""
    c, p = F.col, {**SCORE, **params}
    band = lambda *steps: F.coalesce(*(F.when(cond, _c(v)) for cond, v in steps), F.lit(0))
    whale = F.when((c("buy_volume") > 0) & (c("max_buy") > 0), c("max_buy") / c("buy_volume") * 100)
    return (
        band((c("n_prior") > p["serial_above"], p["serial"]), (c("n_prior") > 1, p["clean"]))
        + band(((c("n_prior") >= p["min_priors"]) & (c("graduated_rate") > 0), F.least(F.lit(20), F.floor(c("graduated_rate") * 30).cast("int"))))
        + band((c("unique_buyers") >= 30, p["buyers_30"]), (c("unique_buyers") >= 10, p["buyers_10"]), (c("unique_buyers") >= 5, p["buyers_5"]), (F.lit(True), p["buyers_low"]))
        + band((c("buy_volume") > p["volume_massive"], p["massive"]), (c("buy_volume") > p["volume_high"], p["high"]), (c("buy_volume") > p["volume_ok"], p["ok"]), (F.lit(True), p["low"]))
        + band((c("buy_diversity") >= 4, 10), ((c("buy_diversity") < 2) & (c("buy_count") > 3), -15))
        + band((c("reserve_pct") > p["near_graduation_pct"], p["near_graduation"]), (c("reserve_pct") > p["mid_pct"], p["mid"]), (c("reserve_pct") > p["low_pct"], p["healthy"]), (F.lit(True), p["curve_low"]))
        + F.when(c("creator_sold"), p["creator_sold"]).otherwise(5)
        + band((whale > p["whale_pct"], -20))
        + F.when(c("buy_count") >= 3, band((c("sell_ratio") >= p["dump_ratio"], p["dump"]), (c("sell_ratio") >= p["heavy_ratio"], p["heavy"]), (c("sell_ratio") >= p["moderate_ratio"], p["moderate"]), (F.lit(True), p["dominant"]))).otherwise(0)
        + band((c("top3_share") > 80, -10), ((c("top3_share") < 50) & (c("unique_buyers") >= 5), 5))
        + band((c("velocity_trend") > 1.5, 10), ((c("velocity_trend") < 0.5) & (c("buy_count") >= 6), -10))
        + band(((c("buys_per_unique") > 2) & (c("buy_count") >= 6), -15))
        + band((c("first_buy") > p["sniper"], -10))
        + band((c("curve_velocity") > 0.5, 5))
    )


def score_decision(score: Column, buy: float, borderline: float, gate: Column | None = None) -> Column:
    base = F.when(score >= buy, "BUY").when(score >= borderline, "BORDERLINE").otherwise("SKIP")
    return base if gate is None else F.when(gate.isNotNull(), "SKIP").otherwise(base)


def observation_score(m: DataFrame, massive: float = 20.0, high: float = 5.0, ok: float = 0.5, mid_pct: float = 40.0, whale_pct: float = 50.0, buy: float = 40, borderline: float = 20) -> DataFrame:
    """The older score of observation_metrics, seven parts in bands: buyers, volume, variety, curve, creator, largest buyer, pressure."""
    c = F.col
    n = F.size("buy_amounts")
    kinds = F.size(F.array_distinct(F.transform("buy_amounts", lambda a: F.bround(a, 4))))
    ratio = c("sell_count") / F.greatest(c("buy_count"), F.lit(1))
    top = F.coalesce(F.array_max("buy_amounts"), F.lit(0.0))
    score = (
        F.when(c("unique_buyers") >= 30, 30).when(c("unique_buyers") >= 10, 20).when(c("unique_buyers") >= 5, 5).otherwise(-15)
        + F.when(c("buy_volume") > massive, 25).when(c("buy_volume") > high, 15).when(c("buy_volume") > ok, 5).otherwise(-5)
        + F.when(n == 0, 0).when(kinds >= 4, 10).when((kinds < 2) & (n > 3), -15).otherwise(0)
        + F.when(c("reserve_pct") > 70, -10).when(c("reserve_pct") > mid_pct, -5).when(c("reserve_pct") > 10, 5).otherwise(0)
        + F.when(c("creator_sold"), -15).otherwise(5)
        + F.when((c("buy_volume") > 0) & (top > 0) & (top / c("buy_volume") * 100 > whale_pct), -20).otherwise(0)
        + F.when(c("buy_count") < 3, 0).when(ratio >= 1.0, -30).when(ratio >= 0.7, -15).when(ratio >= 0.4, -5).otherwise(5)
    )
    return m.select("entity_id", score.alias("score"), score_decision(score, buy, borderline).alias("decision"))


def entry_decision(df: DataFrame, mode: Column, lo: int, hi: int, max_fast: int) -> DataFrame:
    """Whether and by which window to enter: rows with fast_/full_ decision, score and buy_count, exit_price and a mode."""
    c = F.col
    fast, full = c("fast_decision") == "FAST_BUY", c("full_decision") == "BUY"
    wants = ((mode == "fast") & fast) | ((mode == "full") & full) | ((mode == "both") & (fast | full))
    wants = wants & ~(fast & ~full & (c("full_score") < 0))
    kind = F.when(mode == "full", "full").when(mode == "fast", "fast").when(full, "full").otherwise("fast")
    number = F.when(kind == "fast", c("fast_buy_count")).otherwise(c("full_buy_count")) + 1
    enter = wants & (c("exit_price") > 0) & number.between(lo, hi) & (F.lit(max_fast >= 1000) | (c("fast_score") <= max_fast))
    enter = F.coalesce(enter, F.lit(False))
    return df.select("entity_id", "mode", enter.alias("enter"), F.when(enter, kind).alias("entry_type"), F.when(enter, F.when(kind == "fast", c("fast_score")).otherwise(c("full_score"))).alias("entry_score"), F.when(enter, number).alias("entry_buyer_number"))


def early_flag_gate(events: DataFrame, flags: DataFrame, flag: str, span: float, least: int) -> DataFrame:
    """(entity_id, n, fires): flagged actors among buyers younger than `span`."""
    age = F.col("ts") - F.col("created_at")
    early = events.where((F.col("side") == "buy") & (age >= 0) & (age < span)).select("entity_id", "actor_id").distinct()
    n = early.join(flags.where(flag).select("actor_id", F.lit(1).alias("hit")), "actor_id", "left").groupBy("entity_id").agg(F.count("hit").alias("n"))
    return n.withColumn("fires", F.col("n") >= least)


def model_override(rows: DataFrame, lo: float, hi: float, reg_floor: float, reg_ceiling: float, max_buyers: int) -> DataFrame:
    """Rules' decision, overridden by a probability zone unless a block applies; the first block is named."""
    c = F.col
    zone = model_zone(c("proba"), lo, hi)
    block = cascade([(c("buyers") > max_buyers, "buyers_max"), (c("raw") < lo / 2, "raw_floor"), (c("proba") < lo / 2, "calibrated_floor"), (c("reg") < reg_floor, "reg_floor"), (c("reg") > reg_ceiling, "reg_ceiling")])
    final = F.when(zone == "SKIP", "SKIP").when((zone == "BUY") & block.isNull(), "BUY").when((zone == "BUY") & block.isNotNull(), "SKIP").otherwise(c("decision"))
    return rows.select("id", zone.alias("zone"), F.when(zone == "BUY", block).alias("block"), final.alias("decision"))


def model_zone(p: Column, lo: float, hi: float, filled: Column | None = None, least_filled: float = 0.4, grey_skips: bool = False) -> Column:
    """BUY from hi on, SKIP below lo, else the rules; rows with too few features go to the rules."""
    zone = F.when(p.isNull(), "RULES").when(p >= hi, "BUY").when(p < lo, "SKIP").otherwise("SKIP" if grey_skips else "RULES")
    return zone if filled is None else F.when(filled < least_filled, "RULES").otherwise(zone)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-50.0)), F.lit(50.0))))


def checkpoint_override(decision: Column, early: Column) -> Column:
    """An early verdict, where there is one, has the last word."""
    return F.when(early == "BUY_EARLY", "BUY").when(early == "SKIP_EARLY", "SKIP").otherwise(decision)


def exit_zone(p: Column, pnl: Column) -> Column:
    return F.when(p >= 0.80, "SELL_ALL").when(p >= 0.55, "SELL_PARTIAL").when((p < 0.20) & (pnl >= -5), "HOLD_HARD").otherwise("RULES")


def ladder(p: Column, steps: list[tuple[float, float]], base: float) -> Column:
    """The share of the highest step that the probability reaches."""
    ordered = sorted(steps, reverse=True)
    out = F.when(p >= ordered[0][0], ordered[0][1])
    for at, share in ordered[1:]:
        out = out.when(p >= at, share)
    return out.otherwise(base)


def exit_overrides(rows: DataFrame, stop: float, cap: float, confident: float = 0.10) -> DataFrame:
    """What a model's scores change in the exit cascade, per row (id, zone, proba, q25, pnl, peak, elapsed, max_hold_pred).

    tighten: sell before the stop while in a loss and the lower quantile is below -5; block_take_profit and block_weak_exit: hold on
    when the model is sure; escalate: sell what the model says after 15 s; max_hold: its prediction, between 30 s and the cap.
    """
    c = F.col
    selling = c("zone").isin("SELL_ALL", "SELL_PARTIAL")
    hold = c("zone") == "HOLD_HARD"
    lo = min(30.0, cap)
    return rows.select(
        "id",
        (selling & (c("pnl") > -stop) & (c("pnl") <= -5) & c("q25").between(-100, 0) & (c("q25") < -5)).alias("tighten"),
        (hold & (c("proba") < confident) & (c("peak") < 300) & (c("pnl") < 500)).alias("block_take_profit"),
        hold.alias("block_weak_exit"),
        F.when(selling & (c("elapsed") >= 15), c("zone")).alias("escalate"),
        F.greatest(F.lit(lo), F.least(c("max_hold_pred"), F.lit(cap))).alias("max_hold"),
    )


def survival_exit(rows: DataFrame, least_life: float, gate: float, min_hold: float, horizon: float) -> DataFrame:
    """Positions (id, predicted_life, confidence, elapsed) to close because little life is predicted with confidence."""
    c = F.col
    go = (c("predicted_life") < least_life) & (c("confidence") >= gate) & (c("elapsed") >= min_hold) & (c("elapsed") < horizon)
    return rows.select("id", F.coalesce(go, F.lit(False)).alias("sell"))
