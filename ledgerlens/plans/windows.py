"""Queries W and X: sliding windows, replayed reserves, splits and ranks, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import joins as J
from ..operators import windows as W
from ..sources.tables import kept, ledger_tokens, ledger_trades, stream_tokens, stream_trades, table
from .base import A, A_TRADES, B, B_TRADES, query
from .store import POSITIONS_SQL, positions

DAY = 86400.0
WHALE = 90.0

PULSE_SQL = f"""{B}, p0 AS (SELECT t.*, creator_id, row_number() OVER w AS rn, row_number() OVER (PARTITION BY t.entity_id, actor_id ORDER BY ts, event_id) = 1 AS new_actor,
 count(*) OVER l AS window_events, count(*) FILTER (side = 'buy') OVER l AS n_buys, coalesce(sum(amount) FILTER (side = 'buy') OVER l, 0) AS buy_volume, coalesce(max(amount) FILTER (side = 'sell') OVER l, 0) AS max_sell,
 coalesce(bool_or(side = 'sell' AND actor_id = creator_id) OVER l, false) AS creator_selling, list(CASE WHEN side = 'buy' THEN actor_id END) OVER (PARTITION BY t.entity_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS lb
 FROM trades t JOIN tokens USING (entity_id) WINDOW w AS (PARTITION BY t.entity_id ORDER BY ts, event_id), l AS (PARTITION BY t.entity_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
p1 AS (SELECT *, n_buys / window_events AS buy_rate, 1 - n_buys / window_events AS sell_rate, buy_volume / greatest(n_buys, 1) AS avg_buy, max_sell > {WHALE} AS whale_exit, CASE WHEN reserve > 0 THEN least(reserve / 85 * 100, 100) ELSE 0 END AS reserve_pct,
 CASE WHEN rn = 15 THEN len(list_distinct(lb)) ELSE (side = 'buy' AND new_actor)::INT END / greatest(n_buys, 1) AS new_actor_rate FROM p0 WHERE rn >= 15),
p2 AS (SELECT *, lag(buy_rate) OVER w AS pr, lag(avg_buy) OVER w AS pa, max(buy_rate) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak_rate FROM p1 WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)),
p3 AS (SELECT *, CASE WHEN pr IS NULL OR pr < 0.001 THEN 'stable' WHEN (buy_rate - pr) / pr > 0.15 THEN 'rising' WHEN (buy_rate - pr) / pr < -0.15 THEN 'declining' ELSE 'stable' END AS rate_trend,
 CASE WHEN pa IS NULL OR pa < 0.001 THEN 'stable' WHEN (avg_buy - pa) / pa > 0.15 THEN 'rising' WHEN (avg_buy - pa) / pa < -0.15 THEN 'declining' ELSE 'stable' END AS size_trend, CASE WHEN peak_rate > 0 THEN buy_rate / peak_rate ELSE 1 END AS of_peak FROM p2),
pulse AS (SELECT *, rn - coalesce(max(CASE WHEN rate_trend <> 'declining' THEN rn END) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 14) AS declining_run FROM p3)"""


def pulse(spark, sf_dir):
    t = stream_trades(spark, sf_dir).join(stream_tokens(spark, sf_dir).select("entity_id", "creator_id"), "entity_id")
    return W.pulse(t, WHALE, noise=0.0)  # the SQL compares doubles as they are


def _pulse(name: str, *columns: str, rounded: tuple[str, ...] = ()) -> None:
    query(f"WITH {PULSE_SQL} SELECT event_id, entity_id, {', '.join(columns)} FROM pulse", name, rounded)(lambda spark, sf_dir: pulse(spark, sf_dir).select("event_id", "entity_id", *columns))


_pulse("pulse_rates", "buy_rate", "sell_rate", "avg_buy", "buy_volume", "max_sell", "whale_exit", "creator_selling", "reserve_pct", "window_events", rounded=("sell_rate", "avg_buy", "buy_volume"))
_pulse("pulse_new_actor_rate", "new_actor_rate")
_pulse("pulse_trend", "rate_trend", "size_trend")
_pulse("pulse_declining_run", "declining_run")
_pulse("pulse_peak_drop", "peak_rate", "of_peak")

_CURVE_SQL = f"""{A_TRADES}, c0 AS (SELECT *, 30000.0 + sum(CASE WHEN side = 'buy' THEN amount ELSE -amount END) OVER w AS s FROM trades WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c1 AS (SELECT *, s + greatest(0, max(1e-9 - s) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS reserve_sim FROM c0),
c AS (SELECT *, reserve_sim * reserve_sim / 1e9 * 1000 AS mcap_sim FROM c1)"""


def curve(spark, sf_dir):
    return W.replayed_reserve(ledger_trades(spark, sf_dir), 30000.0, 1e9, 1000.0)


@query(f"WITH {_CURVE_SQL} SELECT event_id, entity_id, reserve_sim, mcap_sim FROM c", rounded=("reserve_sim", "mcap_sim"), digits=4)
def curve_replay(spark, sf_dir):
    return curve(spark, sf_dir).select("event_id", "entity_id", "reserve_sim", "mcap_sim")


def _stored(spark, sf_dir):
    return curve(spark, sf_dir).withColumn("st_mcap", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("mcap"))).withColumn("st_reserve", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("reserve")))


@query(f"WITH {_CURVE_SQL}, z AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 0 ELSE mcap END AS sm, CASE WHEN event_id % 4 = 0 THEN 0 ELSE reserve END AS sr FROM c) SELECT event_id, entity_id, CASE WHEN sm = 0 AND sr = 0 THEN reserve_sim ELSE sr END AS reserve_filled, CASE WHEN sm = 0 AND sr = 0 THEN mcap_sim ELSE sm END AS mcap_filled, sm = 0 AND sr = 0 AS was_filled FROM z")
def curve_fill_missing(spark, sf_dir):
    return W.filled(_stored(spark, sf_dir), "st_reserve", "st_mcap").select("event_id", "entity_id", "reserve_filled", "mcap_filled", "was_filled")


@query(f"WITH {_CURVE_SQL} SELECT entity_id, count(*) AS n, avg(abs(mcap_sim - mcap) / mcap * 100) AS mean_drift, max(abs(mcap_sim - mcap) / mcap * 100) AS max_drift FROM c WHERE mcap > 0 GROUP BY entity_id", rounded=("mean_drift", "max_drift"), digits=3)
def curve_verify(spark, sf_dir):
    return W.drift(curve(spark, sf_dir), "mcap", "mcap_sim")


for _name, _open in (("entities_last_5min", True), ("concurrent_observations", False)):
    query(f"WITH {A} SELECT t.entity_id, count(o.entity_id) AS n FROM tokens t LEFT JOIN tokens o ON o.insert_order < t.insert_order AND o.created_at < t.created_at AND o.created_at {'>' if _open else '>='} t.created_at - {3 * DAY} GROUP BY t.entity_id", _name)(
        lambda spark, sf_dir, open_=_open: J.ranged_count(ledger_tokens(spark, kept(spark, sf_dir)), 3 * DAY, open_)
    )


@query(f"WITH {A} SELECT entity_id, row_number() OVER (PARTITION BY creator_id, floor(created_at / 86400) ORDER BY insert_order) - 1 AS n_same_day FROM tokens")
def creator_same_day(spark, sf_dir):
    return W.same_day(ledger_tokens(spark, sf_dir))


@query(f"WITH {POSITIONS_SQL} SELECT id, config_id, sum(pnl) OVER (PARTITION BY config_id ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING) AS cum_pnl FROM positions WHERE status = 'closed'", rounded=("cum_pnl",))
def cumulative_pnl(spark, sf_dir):
    return W.cumulative(positions(spark, sf_dir).where("status = 'closed'"), ["config_id"], ["exit_time", "id"]).select("id", "config_id", "cum_pnl")


@query(
    f"""WITH {POSITIONS_SQL}, b AS (SELECT *, 100 + sum(pnl) OVER (PARTITION BY config_id ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING) AS v FROM positions WHERE status = 'closed'),
d AS (SELECT *, greatest(100, max(v) OVER (PARTITION BY config_id ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING)) AS peak FROM b), e AS (SELECT *, (peak - v) / peak * 100 AS dd FROM d)
SELECT config_id, first(dd ORDER BY exit_time DESC, id DESC) AS current_drawdown, max(dd) AS max_drawdown FROM e GROUP BY config_id""",
    rounded=("current_drawdown", "max_drawdown"),
)
def drawdown(spark, sf_dir):
    return W.drawdown(positions(spark, sf_dir).where("status = 'closed'"), ["config_id"], ["exit_time", "id"], 100.0)


@query(f"WITH {POSITIONS_SQL} SELECT id, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS avg_rank FROM positions")
def avg_rank(spark, sf_dir):
    return W.average_rank(positions(spark, sf_dir), "score").select("id", "score", "avg_rank")


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor((SELECT count(*) FROM events) * 0.8) THEN 'train' ELSE 'test' END AS split FROM events")
def chrono_split(spark, sf_dir):
    return W.chrono_split(stream_trades(spark, sf_dir).select("event_id", "ts"), "ts", 0.8, ("event_id",)).select("event_id", "split")


@query(f"WITH {B_TRADES}, f AS (SELECT actor_id, row_number() OVER (ORDER BY min(ts), actor_id) AS r, count(*) OVER () AS n FROM trades GROUP BY actor_id) SELECT event_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM trades JOIN f USING (actor_id)")
def grouped_chrono_split(spark, sf_dir):
    return W.grouped_split(stream_trades(spark, sf_dir).select("event_id", "actor_id", "ts"), "actor_id", "ts", 0.8).select("event_id", "split")


@query(f"WITH {B_TRADES}, x AS (SELECT min(ts) AS lo, max(ts) AS hi FROM trades) SELECT event_id, least(floor((ts - (lo + (hi - lo) * 0.1::DOUBLE)) / ((hi - (lo + (hi - lo) * 0.1::DOUBLE)) / 5)), 4)::INT AS fold FROM trades, x WHERE ts >= lo + (hi - lo) * 0.1::DOUBLE")
def time_folds(spark, sf_dir):
    return W.time_folds(stream_trades(spark, sf_dir), "ts", 5).select("event_id", "fold")


_SPLIT = 852076800.0


@query(f"WITH {A}, t AS (SELECT * FROM tokens WHERE created_at + {90 * DAY} < {_SPLIT}) SELECT entity_id, count(*) AS n_events FROM trades WHERE ts < {_SPLIT} AND entity_id IN (SELECT entity_id FROM t) GROUP BY entity_id")
def split_burn_in(spark, sf_dir):
    _, events = W.burn_in(ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir), _SPLIT, 90 * DAY)
    return events.groupBy("entity_id").agg(F.count("*").alias("n_events"))


@query(
    f"""WITH {POSITIONS_SQL}, n AS (SELECT count(*) // 4 AS k FROM positions), r AS (SELECT *, row_number() OVER (ORDER BY proba DESC, id) AS a, row_number() OVER (ORDER BY proba, id) AS b FROM positions)
SELECT 'top' AS tail, count(*) AS n, avg(pnl_pct) AS mean_outcome FROM r, n WHERE a <= k UNION ALL SELECT 'bottom', count(*), avg(pnl_pct) FROM r, n WHERE b <= k""",
    rounded=("mean_outcome",),
)
def quartile_outcome(spark, sf_dir):
    return W.tail_outcomes(positions(spark, sf_dir), "proba", "pnl_pct", "id")


# -- scalar functions ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, length(p_name) AS name_length, length(p_brand) AS symbol_length, p_type <> '' AS has_uri, regexp_matches(p_type, '^[A-Z]+$') AS all_caps, regexp_matches(p_name || p_brand, '[0-9]') AS has_digits FROM part")
def string_features(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *X.text_features("p_name", "p_brand", "p_type"))


@query("SELECT event_id, hour(ts) AS hour_utc, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM events", rounded=("hour_sin", "hour_cos"))
def time_features(spark, sf_dir):
    return stream_trades(spark, sf_dir).select("event_id", *X.hour_features("ts"))


@query(f"WITH {A_TRADES}, g AS (SELECT entity_id, count(*) FILTER (side = 'buy') AS b, count(*) FILTER (side = 'sell') AS s, sum(amount) AS v, max(amount) AS m FROM trades GROUP BY entity_id) SELECT entity_id, b / (s + 1) AS buy_sell, v / (b + 0.01::DOUBLE) AS volume_per_buy, m / (v + 0.001::DOUBLE) AS top_share FROM g", rounded=("volume_per_buy", "top_share"), digits=4)
def safe_ratios(spark, sf_dir):
    g = ledger_trades(spark, sf_dir).groupBy("entity_id").agg(F.count_if(F.col("side") == "buy").alias("b"), F.count_if(F.col("side") == "sell").alias("s"), F.sum("amount").alias("v"), F.max("amount").alias("m"))
    return g.select("entity_id", X.ratio("b", "s", 1.0).alias("buy_sell"), X.ratio("v", "b", 0.01).alias("volume_per_buy"), X.ratio("m", "v", 0.001).alias("top_share"))


@query("SELECT event_id, value AS x30, value * 0.5::DOUBLE AS x120, value + (value * 0.5::DOUBLE - value) / 3 AS x60, value * 0.5::DOUBLE - value AS delta FROM events", rounded=("x60",))
def interpolation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x30"), (F.col("value") * 0.5).alias("x120"))
    return e.select("*", X.between("x30", "x120", 30.0, 120.0, 60.0).alias("x60"), (F.col("x120") - F.col("x30")).alias("delta"))


@query(
    """WITH x AS (SELECT event_id, value + 1 AS e, value * 1.3::DOUBLE + 1 AS x FROM events)
SELECT event_id, (x * 0.99::DOUBLE - e * 1.01::DOUBLE) / (e * 1.01::DOUBLE) * 100 - 2 * 0.0005::DOUBLE / 0.1::DOUBLE * 100 AS pnl, (x * 0.99::DOUBLE * 0.97::DOUBLE - e * 1.01::DOUBLE * 1.02::DOUBLE) / (e * 1.01::DOUBLE * 1.02::DOUBLE) * 100 - 3 * 0.0005::DOUBLE / 0.1::DOUBLE * 100 AS realized FROM x""",
    rounded=("pnl", "realized"),
)
def pnl_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") + 1).alias("e"), (F.col("value") * 1.3 + 1).alias("x"))
    return e.select("event_id", X.pnl_pct(F.col("e"), F.col("x"), 0.1, fee=0.01, priority=0.0005).alias("pnl"), X.pnl_pct(F.col("e"), F.col("x"), 0.1, 0.02, 0.03, legs=2, fee=0.01, priority=0.0005).alias("realized"))


@query(f"WITH {B_TRADES}, w AS (SELECT *, coalesce(sum(amount) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS v FROM trades), s AS (SELECT *, least(0.01::DOUBLE + 10 / v * 0.5::DOUBLE, 0.15::DOUBLE) AS slip FROM w WHERE v > 0) SELECT event_id, slip, price * (1 + slip) AS buy_fill, price * (1 - slip) AS sell_fill FROM s", rounded=("slip", "buy_fill", "sell_fill"))
def fill_price(spark, sf_dir):
    return X.fills(stream_trades(spark, sf_dir), 10.0, base=0.01, slope=0.5, most=0.15).select("event_id", "slip", "buy_fill", "sell_fill")


@query("SELECT event_id, greatest(1, least(999, round_even((value - 50) * 10, 0) + 500))::INT AS code, (greatest(1, least(999, round_even((value - 50) * 10, 0) + 500)) - 500) / 10 AS decoded FROM events")
def score_codec(spark, sf_dir):
    code = X.encode_score(F.col("value") - 50)
    return table(spark, sf_dir, "events").select("event_id", code.alias("code"), X.decode_score(code).alias("decoded"))


@query("SELECT event_id, (1 + value / 100) * (1 - 0.02::DOUBLE) / (1 + 0.02::DOUBLE) - 1 AS after FROM events", rounded=("after",))
def slippage_adjust(spark, sf_dir):
    from ..operators.books import slipped

    return table(spark, sf_dir, "events").select("event_id", slipped(F.col("value") / 100, F.lit(0.02)).alias("after"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, props AS text, (props->>'$.k') || '/' || event_type AS label FROM events")
def json_map(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.element_at(m, "k").cast("long").alias("k"), F.regexp_replace(F.to_json(m), ':"(\\d+)"', ': $1').alias("text"), F.concat_ws("/", F.element_at(m, "k"), "event_type").alias("label"))


@query("SELECT p_partkey, sha256('{\"brand\":' || to_json(p_brand)::VARCHAR || ',\"size\":' || p_size || ',\"type\":' || to_json(p_type)::VARCHAR || '}') AS fingerprint FROM part")
def config_fingerprint(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    return p.select("p_partkey", X.fingerprint("size", "type", "brand").alias("fingerprint"))


_DIFF = " UNION ALL ".join(f"SELECT p_partkey, '{c}' AS field, o_{c}::VARCHAR AS old, {c}::VARCHAR AS new FROM w WHERE prev IS NOT NULL AND o_{c} IS DISTINCT FROM {c}" for c in ("p_name", "p_size", "p_type"))


@query(f"WITH w AS (SELECT *, lag(p_partkey) OVER w AS prev, lag(p_name) OVER w AS o_p_name, lag(p_size) OVER w AS o_p_size, lag(p_type) OVER w AS o_p_type FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) {_DIFF}")
def config_diff(spark, sf_dir):
    """Field by field, what changed from one version of a brand's configuration to the next."""
    return X.config_diff(table(spark, sf_dir, "part"), "p_brand", "p_partkey", ["p_name", "p_size", "p_type"])


@query(f"WITH {B_TRADES} SELECT event_id, entity_id || ':' || actor_id || ':' || floor(ts)::BIGINT || ':' || (round_even(amount * 100, 0) / 100)::DECIMAL(18,2) || ':' || side AS syn_key, 'sig' || (event_id // 3) AS sig_key FROM trades")
def dedup_keys(spark, sf_dir):
    t = stream_trades(spark, sf_dir)
    amount = (F.bround(F.col("amount") * 100) / 100).cast("decimal(18,2)")
    return t.select("event_id", X.synthetic_key(amount).alias("syn_key"), F.concat(F.lit("sig"), F.floor(F.col("event_id") / 3)).alias("sig_key"))


@query(f"WITH {A}, s AS (SELECT entity_id, count(*) OVER w AS n, avg(created_at) OVER w AS m FROM tokens WINDOW w AS (PARTITION BY creator_id ORDER BY insert_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT entity_id, n, CASE WHEN n > 0 THEN m END AS mean_or_null, coalesce(m, 0) AS mean_or_zero FROM s", rounded=("mean_or_null", "mean_or_zero"), digits=3)
def nullable_features(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("creator_id").orderBy("insert_order").rowsBetween(Window.unboundedPreceding, -1)
    s = ledger_tokens(spark, sf_dir).select("entity_id", F.count("*").over(w).alias("n"), F.avg("created_at").over(w).alias("m"))
    return s.select("entity_id", "n", X.null_if_solo("m", "n").alias("mean_or_null"), F.coalesce("m", F.lit(0.0)).alias("mean_or_zero"))
