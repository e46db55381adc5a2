"""Queries M: metrics of the ledger's entities over their first year (days stand in for seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import metrics as M
from ..sources.tables import events_in_window, ledger_tokens, ledger_trades
from .base import A, query

DAY = 86400.0
FULL, FAST = 365 * DAY, 30 * DAY
EARLY, ATTENTION, AGES = 10 * DAY, 30 * DAY, (30 * DAY, 60 * DAY, 90 * DAY)


def window(spark, sf_dir, span=FULL) -> DataFrame:
    return events_in_window(ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir), 0.0, span)


def events_sql(span=FULL) -> str:
    return f"""{A},
ev AS (SELECT trades.*, created_at, creator_id FROM trades JOIN tokens USING (entity_id) WHERE ts BETWEEN created_at AND created_at + {span}),
r0 AS (SELECT *, side = 'buy' AS is_buy, row_number() OVER w AS rn, count(*) OVER p AS n, count(*) FILTER (side = 'buy') OVER p AS n_buys, max(ts) OVER p AS e_last,
  CASE WHEN side = 'buy' THEN count(*) FILTER (side = 'buy') OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS buy_rn,
  lag(ts) OVER w AS prev_ts, ts - created_at AS age
  FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id), p AS (PARTITION BY entity_id)),
r AS (SELECT *, CASE WHEN is_buy THEN lag(ts) OVER (PARTITION BY entity_id, is_buy ORDER BY ts, event_id) END AS prev_buy_ts FROM r0)"""


_AT = "\n".join(
    f""", first(reserve ORDER BY ts DESC, event_id DESC) FILTER (age <= {a}) AS reserve_at_{i}, count(DISTINCT actor_id) FILTER (is_buy AND age <= {a}) AS unique_buyers_at_{i},
  count(*) FILTER (is_buy AND age <= {a}) / {a} AS buy_rate_at_{i}, coalesce(sum(amount) FILTER (is_buy AND age <= {a}), 0) AS buy_volume_at_{i}"""
    for i, a in enumerate(AGES, 1)
)
MSQL = (
    events_sql()
    + f""",
m0 AS (SELECT entity_id, count(*) AS n_events, count(*) FILTER (is_buy) AS buy_count, count(*) FILTER (NOT is_buy) AS sell_count,
  count(DISTINCT actor_id) FILTER (is_buy) AS unique_buyers, count(DISTINCT actor_id) FILTER (NOT is_buy) AS unique_sellers,
  coalesce(sum(amount) FILTER (is_buy), 0) AS buy_volume, coalesce(sum(amount) FILTER (NOT is_buy), 0) AS sell_volume, coalesce(max(amount) FILTER (is_buy), 0) AS max_buy,
  count(DISTINCT round_even(amount, 4)) FILTER (is_buy) AS buy_diversity, coalesce(bool_or(NOT is_buy AND actor_id = creator_id), false) AS creator_sold,
  coalesce(min(buy_rn) FILTER (actor_id = creator_id), 0) AS creator_buy_position,
  coalesce(avg(amount) FILTER (is_buy), 0) AS avg_buy, coalesce(median(amount) FILTER (is_buy), 0) AS median_buy, coalesce(stddev_samp(amount) FILTER (is_buy), 0) AS std_buy,
  coalesce(first(amount ORDER BY ts, event_id) FILTER (is_buy), 0) AS first_buy,
  CASE WHEN max(n_buys) >= 3 THEN median(ts - prev_buy_ts) ELSE 0 END AS median_gap,
  count(*) FILTER (buy_rn <= n_buys // 2) AS h1_n, count(*) FILTER (buy_rn > n_buys // 2) AS h2_n,
  max(ts) FILTER (buy_rn <= n_buys // 2) - min(ts) FILTER (buy_rn <= n_buys // 2) AS h1_span, max(ts) FILTER (buy_rn > n_buys // 2) - min(ts) FILTER (buy_rn > n_buys // 2) AS h2_span,
  avg(amount) FILTER (buy_rn <= n_buys // 2) AS h1_avg, avg(amount) FILTER (buy_rn > n_buys // 2) AS h2_avg,
  min(ts) AS first_ts, max(ts) AS last_ts, min(created_at) AS created_at,
  first(reserve ORDER BY ts, event_id) AS first_reserve, max(reserve) FILTER (rn = n // 2 + 1) AS mid_reserve, max(ts) FILTER (rn = n // 2 + 1) AS mid_ts,
  first(reserve ORDER BY ts DESC, event_id DESC) AS last_reserve, first(mcap ORDER BY ts DESC, event_id DESC) AS last_mcap,
  coalesce(first(amount / qty ORDER BY ts DESC, event_id DESC) FILTER (is_buy AND qty > 0 AND amount > 0), 0) AS last_price,
  CASE WHEN count(*) >= 21 THEN median(ts - prev_ts) FILTER (rn BETWEEN 2 AND 20) ELSE 0 END AS median_gap_first20,
  coalesce(sum(amount) FILTER (is_buy AND age <= {EARLY}), 0) AS buy_volume_early, count(DISTINCT actor_id) FILTER (is_buy AND age <= {ATTENTION}) AS unique_buyers_first,
  count(DISTINCT actor_id) FILTER (is_buy AND ts >= e_last - {ATTENTION}) AS unique_buyers_last
  {_AT} FROM r GROUP BY entity_id),
m1 AS (SELECT *, CASE WHEN buy_count >= 4 THEN h1_n / greatest(CASE WHEN h1_n > 1 THEN h1_span ELSE 1 END, 0.1) ELSE 0 END AS first_half_rate,
  CASE WHEN buy_count >= 4 THEN h2_n / greatest(CASE WHEN h2_n > 1 THEN h2_span ELSE 1 END, 0.1) ELSE 0 END AS second_half_rate FROM m0),
bv AS (SELECT entity_id, actor_id, sum(amount) AS v, count(*) AS c FROM ev WHERE side = 'buy' GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY v DESC, actor_id) AS r, sum(v) OVER (PARTITION BY entity_id) AS total FROM bv),
bm AS (SELECT entity_id, CASE WHEN count(*) >= 3 THEN sum(v) FILTER (r <= 3) / sum(v) * 100 ELSE -1 END AS top3_share, count(*) FILTER (c > 1) AS repeat_buyers,
  CASE WHEN count(*) >= 2 THEN sum(-(v / total) * log2(v / total)) / log2(count(*)) ELSE 0 END AS buyer_entropy FROM br GROUP BY entity_id),
m AS (SELECT m1.*, sell_count / greatest(buy_count, 1) AS sell_ratio, creator_buy_position > 0 AS creator_self_buy, CASE WHEN unique_buyers > 0 THEN buy_count / unique_buyers ELSE 0 END AS buys_per_unique,
  CASE WHEN buy_count >= 4 THEN second_half_rate / greatest(first_half_rate, 0.01) ELSE 0 END AS velocity_trend,
  CASE WHEN buy_count >= 4 THEN h1_avg ELSE 0 END AS first_half_avg, CASE WHEN buy_count >= 4 THEN h2_avg ELSE 0 END AS second_half_avg,
  CASE WHEN buy_count >= 4 THEN h2_avg / greatest(h1_avg, 1e-6) ELSE 0 END AS size_trend, greatest(first_ts - created_at, 0) AS first_delay, last_ts - first_ts AS window_span,
  CASE WHEN last_reserve > 0 THEN least(last_reserve / 85 * 100, 100) ELSE 0 END AS reserve_pct, greatest(85 - last_reserve, 0) AS to_graduation,
  CASE WHEN n_events > 1 AND last_ts > first_ts THEN (last_reserve - first_reserve) / (last_ts - first_ts) ELSE 0 END AS curve_velocity,
  CASE WHEN n_events >= 4 AND mid_ts > first_ts AND last_ts > mid_ts THEN (last_reserve - mid_reserve) / (last_ts - mid_ts) - (mid_reserve - first_reserve) / (mid_ts - first_ts) ELSE 0 END AS curve_acceleration,
  {", ".join(f"CASE WHEN coalesce(reserve_at_{i}, 0) > 0 THEN least(reserve_at_{i} / 85 * 100, 100) ELSE 0 END AS reserve_pct_at_{i}" for i in (1, 2, 3))},
  coalesce(top3_share, 0) AS top3_share, coalesce(repeat_buyers, 0) AS repeat_buyers, coalesce(buyer_entropy, 0) AS buyer_entropy
  FROM m1 LEFT JOIN bm USING (entity_id))"""
)


def full_metrics(spark, sf_dir) -> DataFrame:
    return M.entity_metrics(window(spark, sf_dir), EARLY, ATTENTION, AGES)


def _metric(name: str, *columns: str, rounded: tuple[str, ...] = ()) -> None:
    query(f"WITH {MSQL} SELECT entity_id, {', '.join(columns)} FROM m", name, rounded)(lambda spark, sf_dir: full_metrics(spark, sf_dir).select("entity_id", *columns))


_metric("metric_counts", "buy_count", "sell_count", "unique_buyers", "unique_sellers", "buy_volume", "sell_volume", "max_buy", "sell_ratio")
_metric("metric_diversity", "buy_diversity")
_metric("metric_creator_flags", "creator_sold", "creator_self_buy", "creator_buy_position")
_metric("metric_buy_stats", "avg_buy", "median_buy", "std_buy", "first_buy", rounded=("avg_buy", "std_buy"))
_metric("metric_top3_share", "top3_share")
_metric("metric_repeat_buyers", "repeat_buyers", "buys_per_unique")
_metric("metric_median_gap", "median_gap")
_metric("metric_entropy", "buyer_entropy")
_metric("metric_half_rates", "first_half_rate", "second_half_rate", "velocity_trend")
_metric("metric_half_sizes", "first_half_avg", "second_half_avg", "size_trend")
_metric("metric_first_delay", "first_delay")
_metric("metric_curve", "reserve_pct", "to_graduation", "last_mcap", "curve_velocity", "curve_acceleration")
_metric("metric_last_price", "last_price")
_metric("metric_bot_gap20", "median_gap_first20")
_metric("metric_early_late", "buy_volume_early", "unique_buyers_first", "unique_buyers_last")
_metric("metric_curve_at", "reserve_pct_at_1", "reserve_pct_at_2", "reserve_pct_at_3")
_metric("metric_at_ages", *(f"{c}_at_{i}" for i in (1, 2, 3) for c in ("unique_buyers", "buy_rate", "buy_volume")))
_metric("metric_window_span", "window_span")

_NS = (5, 10, 20)


@query(
    f"""WITH {events_sql()},
b AS (SELECT *, count(*) OVER w AS k, sum(amount) OVER w / sum(qty) OVER w AS a FROM ev WHERE side = 'buy' AND qty > 0 AND amount > 0
  WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT entity_id, first(amount / qty ORDER BY ts DESC, event_id DESC) AS p, {", ".join(f"max(a) FILTER (k = {n}) AS a{n}" for n in _NS)} FROM b GROUP BY entity_id)
SELECT entity_id, {", ".join(f"coalesce((p - a{n}) / a{n} * 100, 0) AS pnl_{n}" for n in _NS)} FROM g"""
)
def metric_nth_entry_pnl(spark, sf_dir):
    return M.nth_entry_pnl(window(spark, sf_dir), _NS)


@query(
    f"""WITH {MSQL.replace(f"created_at + {FULL}", f"created_at + {FAST}")}
SELECT entity_id, buy_count, sell_count, unique_buyers, buy_volume, buy_diversity, greatest(window_span, 0.1) AS elapsed, buy_count / greatest(window_span, 0.1) AS buy_rate, sell_ratio, reserve_pct,
  creator_sold, creator_self_buy, creator_buy_position, last_mcap FROM m"""
)
def fast_metrics(spark, sf_dir):
    return M.fast_metrics(window(spark, sf_dir, FAST))


@query(
    f"""WITH {events_sql()} SELECT entity_id, count(*) FILTER (is_buy) AS buy_count, count(*) FILTER (NOT is_buy) AS sell_count, count(DISTINCT actor_id) FILTER (is_buy) AS unique_buyers,
coalesce(sum(amount) FILTER (is_buy), 0) AS buy_volume, coalesce(list(amount ORDER BY ts, event_id) FILTER (is_buy), []) AS buy_amounts, coalesce(bool_or(NOT is_buy AND actor_id = creator_id), false) AS creator_sold,
CASE WHEN last(reserve ORDER BY ts, event_id) > 0 THEN least(last(reserve ORDER BY ts, event_id) / 85 * 100, 100) ELSE 0 END AS reserve_pct FROM r GROUP BY entity_id"""
)
def observation_metrics(spark, sf_dir):
    return M.observation_metrics(window(spark, sf_dir))


@query(f"WITH {events_sql()} SELECT entity_id, count(DISTINCT actor_id) FILTER (is_buy AND age >= 0 AND age < {5 * DAY}) AS n_buyers_first FROM r GROUP BY entity_id")
def n_buyers_first_5s(spark, sf_dir):
    return M.buyers_within(window(spark, sf_dir), 5 * DAY).withColumnRenamed("n", "n_buyers_first")


@query(
    f"""WITH {events_sql()}, v AS (SELECT entity_id, actor_id, sum(amount) AS volume FROM ev WHERE side = 'buy' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY volume DESC, actor_id) AS rank FROM v) SELECT entity_id, actor_id, volume, rank FROM k WHERE rank <= 10"""
)
def topn_buyers(spark, sf_dir):
    return M.top_buyers(window(spark, sf_dir), 10)


_SCORED = 700 * DAY


@query(
    f"""WITH {A}, t AS (SELECT entity_id, created_at + {_SCORED} AS s FROM tokens),
e AS (SELECT t.entity_id, t.s, x.ts, x.event_id, x.side, x.amount, x.qty FROM t LEFT JOIN trades x USING (entity_id)),
g AS (SELECT entity_id, count(*) FILTER (ts >= s) AS n, min(ts * 1.0) FILTER (ts >= s AND side = 'buy' AND amount <> 0 AND qty <> 0) AS entry_ts,
  first(amount / qty ORDER BY ts, event_id) FILTER (ts >= s AND side = 'buy' AND amount <> 0 AND qty <> 0) AS entry_price FROM e GROUP BY entity_id)
SELECT entity_id, entry_ts, entry_price, CASE WHEN n = 0 THEN 'doa_no_trades' WHEN entry_ts IS NULL THEN 'doa_no_entry' ELSE 'entered' END AS status FROM g"""
)
def entry_point(spark, sf_dir):
    return M.entry_points(ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir), _SCORED)
