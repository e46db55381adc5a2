"""Queries E: exit replay, datasets, sweeps and their reports, on the stream's entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exits as E
from ..operators import features as X
from ..operators import joins as J
from ..operators import metrics as M
from ..operators.actors import _shared
from ..operators.books import sweep_summary as summary
from ..operators.windows import time_folds
from ..sources.tables import kept, ledger_tokens, ledger_trades, stream_tokens, stream_trades
from ..streaming.live import folder
from .base import A, B, query
from .decisions import _FULL, decided
from .history import _CLASS_SQL, _CLUSTER_SQL, _HOLD_SQL, SNAP_SQL, actor_cluster_table, flags, holders, prior, snapshots
from .history import AGES as AGES_H
from .metrics import AGES as AGES_M
from .metrics import ATTENTION, EARLY, FAST, FULL, MSQL, window
from .store import POSITIONS_SQL, positions
from .windows import PULSE_SQL, WHALE

DAY = 86400.0
TICK = 6 * 3600.0
WAIT = 2 * DAY
#: In the order of exits.PARAMS.
CONFIGS = [
    ("tight", 80.0, 400.0, 150.0, 120.0, 8 * DAY, 0.05, 2.0, 1.0, 0.3, 0.3, 5.0, 99.5),
    ("loose", 97.0, 3000.0, 500.0, 480.0, 15 * DAY, 0.05, 4.0, 3.0, 0.2, 0.3, 21.0, 200.0),
    ("hold", 99.9, 9000.0, 9000.0, 9000.0, 12 * DAY, 0.0, 99.0, 99.0, 0.0, 0.3, 99.0, 200.0),
]
_COLS = [c.split()[0] for c in E.PARAMS.split(", ")]
_CONFIG_SQL = f"configs({', '.join(_COLS)}) AS (VALUES {', '.join('(' + ', '.join(repr(x) if isinstance(x, str) else f'{x}::DOUBLE' for x in r) + ')' for r in CONFIGS)})"
ENTRY_SQL = f"""{B}, entries AS (SELECT entity_id, creator_id, arg_min(ts, ts * 1e6 + event_id) AS entry_ts, arg_min(price, ts * 1e6 + event_id) AS entry_price FROM trades JOIN tokens USING (entity_id) WHERE side = 'buy' AND ts >= created_at + {WAIT} GROUP BY ALL)"""
_GAIN = "(price * 0.99::DOUBLE - entry_price * 1.01::DOUBLE) / (entry_price * 1.01::DOUBLE) * 100"
_PULSE_AFTER = PULSE_SQL.split("p0 AS", 1)[1].replace("FROM trades t JOIN tokens USING (entity_id)", "FROM after t").replace("SELECT t.*, creator_id,", "SELECT t.*,")
STATES_SQL = f"""{ENTRY_SQL}, after AS (SELECT t.*, entry_ts, entry_price, creator_id FROM trades t JOIN entries USING (entity_id) WHERE ts > entry_ts),
p0 AS{_PULSE_AFTER},
st0 AS (SELECT a.*, {_GAIN} AS pnl, lead(ts) OVER w AS next_ts, ts - entry_ts AS elapsed, row_number() OVER w AS ord FROM after a WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)),
st AS (SELECT st0.*, p.buy_rate, p.sell_rate, p.new_actor_rate, p.creator_selling, p.declining_run, p.peak_rate, p.of_peak, p.reserve_pct, p.window_events, ord >= 15 AS warm,
 CASE WHEN ord >= 15 AND (next_ts IS NULL OR entry_ts + {TICK} * (floor((ts - entry_ts) / {TICK}) + 1) <= next_ts) THEN entry_ts + {TICK} * (floor((ts - entry_ts) / {TICK}) + 1) END AS tick_ts,
 max(CASE WHEN ord >= 15 THEN pnl END) OVER (PARTITION BY st0.entity_id ORDER BY st0.ts, st0.event_id ROWS UNBOUNDED PRECEDING) AS peak_pnl FROM st0 LEFT JOIN (SELECT entity_id, event_id, buy_rate, sell_rate, new_actor_rate, creator_selling, declining_run, peak_rate, of_peak, reserve_pct, window_events FROM pulse) p USING (entity_id, event_id)),
{_CONFIG_SQL},
sig AS (SELECT *, CASE WHEN pnl < -stop THEN 'hard_stop' WHEN NOT warm THEN NULL WHEN creator_selling THEN 'creator_dump' WHEN buy_rate < dead_rate THEN 'pulse_dead' WHEN declining_run >= dying THEN 'trend_dying' WHEN sell_rate > buy_rate * pressure THEN 'sell_pressure'
 WHEN drop_ratio > 0 AND peak_rate >= drop_floor AND of_peak <= drop_ratio THEN 'buy_rate_drop' WHEN new_actor_rate = 0 AND window_events >= blood_events THEN 'no_new_blood' WHEN reserve_pct > near_grad THEN 'near_graduation' WHEN pnl >= take_profit THEN 'take_profit'
 WHEN peak_pnl >= trail_from AND peak_pnl - pnl >= trail_by THEN 'trailing_stop' WHEN elapsed > max_hold THEN 'timeout' END AS reason FROM st, configs),
ex AS (SELECT *, coalesce(reason, CASE WHEN tick_ts IS NOT NULL THEN CASE WHEN window_events >= blood_events THEN 'no_new_blood' WHEN tick_ts - entry_ts > max_hold THEN 'timeout' END END) AS why, CASE WHEN reason IS NOT NULL THEN ts ELSE tick_ts END AS at_ts FROM sig),
fe AS (SELECT config_id, entity_id, arg_min(at_ts, ord) AS exit_ts, arg_min(price, ord) AS exit_price, arg_min(why, ord) AS reason, arg_min(pnl, ord) AS pnl FROM ex WHERE why IS NOT NULL GROUP BY ALL),
la AS (SELECT config_id, entity_id, arg_max(price, ord) AS lp, arg_max(pnl, ord) AS lpnl, max(entry_ts) AS entry_ts, max(max_hold) AS mh FROM sig GROUP BY ALL),
sim0 AS (SELECT la.config_id, la.entity_id, entry_ts, coalesce(reason, 'timeout') AS reason, coalesce(exit_price, lp) AS exit_price, coalesce(pnl, lpnl) AS pnl, CASE WHEN reason IS NOT NULL THEN exit_ts - entry_ts ELSE mh + {TICK} END AS hold FROM la LEFT JOIN fe USING (config_id, entity_id)),
sim AS (SELECT s.config_id, s.entity_id, s.entry_ts, s.reason, s.exit_price, s.pnl, s.hold, count(*) FILTER (a.side = 'buy') AS n_buys, count(*) FILTER (a.side = 'sell') AS n_sells FROM sim0 s LEFT JOIN after a ON a.entity_id = s.entity_id AND a.ts <= s.entry_ts + s.hold GROUP BY ALL)"""


def entries(spark, sf_dir):
    t = stream_tokens(spark, sf_dir)
    e = stream_trades(spark, sf_dir).join(t.select("entity_id", "created_at", "creator_id"), "entity_id").where((F.col("side") == "buy") & (F.col("ts") >= F.col("created_at") + WAIT))
    g = e.groupBy("entity_id", "creator_id").agg(F.min(F.struct("ts", "event_id", "price")).alias("f"))
    return g.select("entity_id", "creator_id", F.col("f.ts").alias("entry_ts"), F.col("f.price").alias("entry_price"))


def kept_entries(spark, sf_dir):
    """The entries, written once: a row for each entity, and read with their size known, so that events need not be shuffled to meet few of them."""
    where = folder(spark)
    entries(spark, sf_dir).write.parquet(where, mode="overwrite")
    return spark.read.parquet(where)


def configs(spark):
    return spark.createDataFrame(CONFIGS, E.PARAMS)


def signal_rows(spark, sf_dir):
    return E.signals(E.states(stream_trades(spark, sf_dir), entries(spark, sf_dir), WHALE, TICK), configs(spark))


def simulation(spark, sf_dir):
    return E.simulated(stream_trades(spark, sf_dir), entries(spark, sf_dir), configs(spark), WHALE, TICK)


@query(f"WITH {STATES_SQL} SELECT config_id, entity_id, event_id, ord AS n, pnl, reason FROM sig", rounded=("pnl",))
def exit_signal_rows(spark, sf_dir):
    return signal_rows(spark, sf_dir).select("config_id", "entity_id", "event_id", F.col("order").alias("n"), "pnl", "reason")


@query(f"WITH {STATES_SQL} SELECT config_id, entity_id, arg_min(ts, ord) AS exit_ts, arg_min(reason, ord) AS reason FROM sig WHERE reason IS NOT NULL GROUP BY ALL")
def first_exit(spark, sf_dir):
    s = signal_rows(spark, sf_dir).where("reason is not null")
    return s.groupBy("config_id", "entity_id").agg(F.min_by("ts", "order").alias("exit_ts"), F.min_by("reason", "order").alias("reason"))


@query(f"WITH {STATES_SQL} SELECT entity_id, event_id, tick_ts FROM st WHERE tick_ts IS NOT NULL")
def tick_grid(spark, sf_dir):
    return E.states(stream_trades(spark, sf_dir), entries(spark, sf_dir), WHALE, TICK).where("tick_ts is not null").select("entity_id", "event_id", "tick_ts")


#: In the order of exits.partial_exits' parameters.
LEGS = {"profit_at": 200.0, "profit_share": 0.30, "weak_rate": 0.60, "weak_at": 50.0, "weak_share": 0.50, "moonbag": 0.10}


def legs_sql(rows: str) -> str:
    """A fold over the table `rows` (config_id, entity_id, ord, pnl, warm, buy_rate, reason, zone, share, passed, why) as CTEs that end in `legs`."""
    return f"""lr AS MATERIALIZED (SELECT config_id, entity_id, ord, pnl, warm, buy_rate, reason, zone, share, passed, why FROM {rows}),
lf AS (SELECT config_id, entity_id, 0::BIGINT AS ord, 1.0::DOUBLE AS rest, 0.0::DOUBLE AS got, false AS took, NULL::VARCHAR AS why, 0.0::DOUBLE AS last, 0.0::DOUBLE AS sold FROM (SELECT DISTINCT config_id, entity_id FROM lr)
 UNION ALL SELECT config_id, entity_id, ord, CASE WHEN w IS NOT NULL THEN 0 ELSE rest - part END, got + CASE WHEN w IS NOT NULL THEN rest ELSE part END * pnl, took OR strong, w, pnl, CASE WHEN w IS NOT NULL THEN rest - part ELSE 0 END FROM
 (SELECT *, coalesce(CASE WHEN quiet AND NOT strong AND NOT weak AND zone = 'SELL_ALL' THEN 'model_sell' END, why) AS w, CASE WHEN strong THEN least(0.30::DOUBLE, rest - 0.10::DOUBLE) WHEN weak AND zone <> 'HOLD_HARD' THEN least(0.50::DOUBLE, rest - 0.10::DOUBLE)
   WHEN can AND NOT weak AND zone = 'SELL_PARTIAL' THEN least(share, rest - 0.10::DOUBLE) ELSE 0 END AS part FROM
 (SELECT *, can AND NOT strong AND buy_rate < 0.60 AND pnl > 50 AS weak FROM (SELECT *, can AND pnl > 200 AND NOT took AS strong FROM (SELECT *, quiet AND rest - 0.10::DOUBLE > 0.01 AS can FROM
 (SELECT lr.config_id, lr.entity_id, lr.ord, lr.pnl, coalesce(lr.buy_rate, 1) AS buy_rate, lr.why, lr.zone, lr.share, lf.rest, lf.got, lf.took, lr.warm AND lr.reason IS NULL AND NOT lr.passed AS quiet FROM lf JOIN lr ON lr.config_id = lf.config_id AND lr.entity_id = lf.entity_id AND lr.ord = lf.ord + 1 WHERE lf.why IS NULL)))))),
legs AS (SELECT config_id, entity_id, arg_max(got + rest * last, ord) AS pnl, arg_max(rest, ord) AS rest, arg_max(sold, ord) AS sold, arg_max(why, ord) AS why, max(ord) AS ended FROM lf WHERE ord > 0 GROUP BY ALL)"""


_PLAIN = "(SELECT *, reason AS why, 'RULES' AS zone, 0.0::DOUBLE AS share, coalesce(warm AND pnl >= take_profit AND reason IS NULL, false) AS passed FROM sig)"


@query(f"WITH RECURSIVE {STATES_SQL}, {legs_sql(_PLAIN)} SELECT config_id, entity_id, pnl, rest AS remaining, coalesce(why, 'timeout') AS reason FROM legs", rounded=("pnl", "remaining"))
def partial_exits(spark, sf_dir):
    return E.partial_exits(signal_rows(spark, sf_dir), **LEGS)


@query(f"WITH {STATES_SQL} SELECT * FROM sim", rounded=("pnl", "exit_price"))
def simulate_exit(spark, sf_dir):
    return simulation(spark, sf_dir)


#: A model's view of each entity, made of its first event: probability, lower quantile, predicted hold.
_SCORES = f"""sc AS (SELECT entity_id, arg_min(amount, ts * 1e6 + event_id) / 100 AS proba, arg_min(reserve, ts * 1e6 + event_id) - 60 AS q25, arg_min(qty, ts * 1e6 + event_id) * {2 * DAY} AS max_hold_pred FROM trades GROUP BY entity_id)"""
_FULL_SIG = STATES_SQL[: STATES_SQL.index("sig AS (")] + f"""{_SCORES},
zn AS (SELECT st.*, configs.*, proba, q25, greatest(least(30, max_hold), least(max_hold_pred, max_hold)) AS longest, CASE WHEN proba >= 0.8 THEN 'SELL_ALL' WHEN proba >= 0.55 THEN 'SELL_PARTIAL' WHEN proba < 0.2 AND pnl >= -5 THEN 'HOLD_HARD' ELSE 'RULES' END AS view,
 CASE WHEN proba >= 0.75 THEN 0.7 WHEN proba >= 0.65 THEN 0.5 WHEN proba >= 0.55 THEN 0.3 ELSE 0 END::DOUBLE AS share FROM st JOIN sc USING (entity_id), configs),
sig AS (SELECT *, CASE WHEN view LIKE 'SELL%' AND elapsed < 15 THEN 'RULES' ELSE view END AS zone, CASE WHEN pnl < -stop THEN 'hard_stop' WHEN NOT warm THEN NULL WHEN creator_selling THEN 'creator_dump' WHEN buy_rate < dead_rate THEN 'pulse_dead' WHEN declining_run >= dying THEN 'trend_dying' WHEN sell_rate > buy_rate * pressure THEN 'sell_pressure'
 WHEN drop_ratio > 0 AND peak_rate >= drop_floor AND of_peak <= drop_ratio THEN 'buy_rate_drop' WHEN new_actor_rate = 0 AND window_events >= blood_events THEN 'no_new_blood' WHEN reserve_pct > near_grad THEN 'near_graduation'
 WHEN view LIKE 'SELL%' AND pnl <= -5 AND q25 BETWEEN -100 AND 0 AND q25 < -5 AND pnl > -stop THEN 'model_tighten'
 WHEN pnl >= take_profit THEN CASE WHEN NOT (view = 'HOLD_HARD' AND proba < 0.1 AND peak_pnl < 300 AND pnl < 500) THEN 'take_profit' END WHEN peak_pnl >= trail_from AND peak_pnl - pnl >= trail_by THEN 'trailing_stop' WHEN elapsed > longest THEN 'timeout' END AS reason FROM zn),
""" + STATES_SQL[STATES_SQL.index("ex AS (") :].replace("tick_ts - entry_ts > max_hold", "tick_ts - entry_ts > longest")
_SCORED = """sold AS (SELECT config_id, entity_id, ex.ts, ex.price FROM ex JOIN legs USING (config_id, entity_id) WHERE legs.why = 'model_sell' AND ex.ord = legs.ended),
after_sold AS (SELECT config_id, sold.entity_id, count(*) FILTER (a.side = 'buy') AS b, count(*) FILTER (a.side = 'sell') AS s FROM sold JOIN after a ON a.entity_id = sold.entity_id AND a.ts <= sold.ts GROUP BY ALL)"""


def scores(spark, sf_dir):
    first = stream_trades(spark, sf_dir).groupBy("entity_id").agg(F.min(F.struct("ts", "event_id", "amount", "reserve", "qty")).alias("f"))
    return first.select("entity_id", (F.col("f.amount") / 100).alias("proba"), (F.col("f.reserve") - 60).alias("q25"), (F.col("f.qty") * 2 * DAY).alias("max_hold_pred"))


@query(f"WITH RECURSIVE {_FULL_SIG}, {legs_sql('(SELECT *, coalesce(warm AND pnl >= take_profit AND reason IS NULL, false) AS passed FROM ex)')}, {_SCORED} SELECT sim.* REPLACE (legs.pnl AS pnl, CASE WHEN sold.ts IS NULL THEN reason ELSE 'model_sell' END AS reason, coalesce(sold.price, exit_price) AS exit_price, coalesce(sold.ts - entry_ts, hold) AS hold, coalesce(b, n_buys) AS n_buys, coalesce(s, n_sells) AS n_sells), legs.sold AS remaining FROM sim JOIN legs USING (config_id, entity_id) LEFT JOIN sold USING (config_id, entity_id) LEFT JOIN after_sold USING (config_id, entity_id)", rounded=("pnl", "exit_price", "remaining"))
def simulate_exit_scored(spark, sf_dir):
    """The replay with a model's overrides and partial sales, in the same pass."""
    return E.simulated(stream_trades(spark, sf_dir), entries(spark, sf_dir), configs(spark), WHALE, TICK, scores(spark, sf_dir), LEGS)


@query(f"WITH {STATES_SQL} SELECT t.entity_id, coalesce((s.pnl > 0)::INT, 0) AS label, s.pnl AS realized, s.entity_id IS NULL AS doa FROM tokens t LEFT JOIN (SELECT * FROM sim WHERE config_id = 'loose') s USING (entity_id)", rounded=("realized",))
def entry_labels(spark, sf_dir):
    s = simulation(spark, sf_dir).where("config_id = 'loose'").select("entity_id", "pnl")
    j = stream_tokens(spark, sf_dir).select("entity_id").join(s, "entity_id", "left")
    return j.select("entity_id", F.coalesce((F.col("pnl") > 0).cast("int"), F.lit(0)).alias("label"), F.col("pnl").alias("realized"), F.col("pnl").isNull().alias("doa"))


#: Features are made when an entity is scored, at the end of its window; its position is replayed on what comes after.
EARLY_SPAN, FIRST, NEAR = 30 * DAY, 5 * DAY, 3 * DAY
LEDGER_TICK = 30 * DAY
LEDGER_CONFIG = ("book", 60.0, 150.0, 80.0, 40.0, 900 * DAY, 0.05, 4.0, 3.0, 0.2, 0.3, 21.0, 200.0)


def _ledger_sim_sql(span: float, configs: list[tuple]) -> str:
    """CTEs up to `sim`: the replay of each entity of the ledger that is entered after its window, under each configuration."""
    values = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in configs)
    later = STATES_SQL[len(ENTRY_SQL) :].replace(_CONFIG_SQL, f"configs({', '.join(_COLS)}) AS (VALUES {values})").replace(str(TICK), str(LEDGER_TICK))
    later = later.replace("(SELECT entity_id, event_id, buy_rate", "(SELECT entity_id, event_id, ts, buy_rate").replace("USING (entity_id, event_id)),", "USING (entity_id, event_id, ts)),")
    return f"""{A}, entries AS (SELECT entity_id, creator_id, arg_min(ts, ts * 1e6 + event_id) AS entry_ts, arg_min(price, ts * 1e6 + event_id) AS entry_price FROM trades JOIN tokens USING (entity_id) WHERE {_usable(span)} GROUP BY ALL){later}"""


def _usable(span: float) -> str:
    return f"side = 'buy' AND amount <> 0 AND qty <> 0 AND ts >= created_at + {span}"


def _label_sql(span: float) -> str:
    """(entity_id, status, reason, pnl) of each entity's position in the ledger."""
    return f"""{_ledger_sim_sql(span, [LEDGER_CONFIG])},
stt AS (SELECT entity_id, CASE WHEN count(*) FILTER (ts >= created_at + {span}) = 0 THEN 'doa_no_trades' WHEN count(*) FILTER ({_usable(span)}) = 0 THEN 'doa_no_entry' END AS status FROM tokens LEFT JOIN trades USING (entity_id) GROUP BY entity_id)
SELECT entity_id, coalesce(status, reason, 'timeout') AS exit_reason, coalesce(CASE WHEN status IS NULL THEN pnl END, 0) AS realized FROM stt LEFT JOIN sim USING (entity_id)"""


def _dataset_sql(span: float, order: list[str]) -> str:
    msql = MSQL.replace(f"created_at + {FULL}", f"created_at + {span}")
    fast = MSQL.replace(f"created_at + {FULL}", f"created_at + {FAST}")
    top = _CLASS_SQL.replace(f"created_at + {365 * DAY}", f"created_at + {span}")
    ahead = lambda n: f"2 * {n}_2 - {n}_1"
    pct = ", ".join(f"CASE WHEN {ahead(n)} IS NOT NULL THEN greatest(0, least(100, {ahead(n)})) END AS {n}_3" for n in ("top1", "top5", "top10"))
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*X.HOLDERS_1, *X.HOLDERS_3))
    return f"""WITH me AS (SELECT * FROM (WITH {msql} SELECT * FROM m)), fa AS (SELECT * FROM (WITH {fast} SELECT entity_id, buy_count AS fast_buy_count, unique_buyers AS fast_unique_buyers, buy_volume AS fast_volume, buy_count / greatest(window_span, 0.1) AS fast_buy_rate, n_events AS fast_events, last_price AS fast_price FROM m)),
nr AS (SELECT * FROM (WITH {A} SELECT t.entity_id, t.created_at, t.creator_id, count(o.entity_id) FILTER (o.created_at > t.created_at - {NEAR}) AS entities_recent, count(o.entity_id) AS concurrent FROM tokens t LEFT JOIN tokens o ON o.insert_order < t.insert_order AND o.created_at < t.created_at AND o.created_at >= t.created_at - {NEAR} GROUP BY ALL)),
nb AS (SELECT * FROM (WITH {A} SELECT entity_id, count(DISTINCT actor_id) FILTER (side = 'buy' AND ts - created_at < {FIRST}) AS n_buyers_first FROM trades JOIN tokens USING (entity_id) WHERE ts >= created_at GROUP BY entity_id)),
h0 AS (SELECT * FROM (WITH {_HOLD_SQL} SELECT entity_id, {", ".join(f"max({c}) FILTER (age = {AGES_H[i - 1]}) AS {n}_{i}" for c, n in (("top1_pct", "top1"), ("top5_pct", "top5"), ("top10_pct", "top10"), ("holder_count", "holders")) for i in (1, 2))} FROM holders GROUP BY entity_id)),
h1 AS (SELECT *, {pct}, CASE WHEN {ahead("holders")} IS NOT NULL THEN greatest({ahead("holders")}, holders_1, holders_2) END AS holders_3 FROM h0),
h2 AS (SELECT *, top1_3 - top1_1 AS top1_delta, top5_3 - top5_1 AS top5_delta, top10_3 - top10_1 AS top10_delta, (holders_3 - holders_1) / 90 AS holder_velocity FROM h1),
ho AS (SELECT nr.entity_id, {zero} FROM nr LEFT JOIN h2 USING (entity_id)),
cs AS (SELECT * FROM (WITH {A}, {SNAP_SQL}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator_id, ref_ts ORDER BY entity_id DESC) AS q FROM snap) WHERE q = 1)
 SELECT p.entity_id, o.age_days AS creator_age_days, CASE WHEN o.n_prior >= 2 THEN o.median_peak END AS creator_median_peak, CASE WHEN o.n_prior >= 2 THEN o.mean_interval END AS creator_interval, CASE WHEN o.ref_ts IS NOT NULL THEN 0.0::DOUBLE END AS creator_balance
 FROM (SELECT *, created_at + {span} AS at FROM tokens) p ASOF LEFT JOIN o ON p.creator_id = o.creator_id AND o.ref_ts <= p.at)),
pr AS (SELECT * FROM (WITH {top}, x AS (SELECT p.*, n_prior > 0 AS has, n_closed > 0 AS closed, n_won / nullif(n_closed, 0) AS wr, CASE WHEN cutoff > fs THEN (cutoff - fs) / 86400 END AS ad FROM prior p LEFT JOIN (SELECT t.entity_id, t.actor_id, min(a.first_ts) AS fs FROM top t JOIN act a ON a.actor_id = t.actor_id AND a.last_ts < t.cutoff WHERE t.rank <= 10 GROUP BY ALL) USING (entity_id, actor_id))
 SELECT entity_id, (sum(n_prior) FILTER (has AND rank <= 3))::BIGINT AS top3_prior_entities, sum(sum_realized) FILTER (has AND rank <= 3) AS top3_prior_realized, avg(wr) FILTER (closed AND rank <= 3) AS top3_prior_winrate, max(sum_realized) FILTER (closed AND rank <= 3) AS top3_best_realized,
 avg(ad) FILTER (has AND rank <= 3) AS top3_age_days, CASE WHEN count(*) > 3 THEN avg(wr) FILTER (closed) END AS top10_prior_winrate, CASE WHEN count(*) > 3 THEN sum(sum_realized) FILTER (has) END AS top10_prior_realized FROM x GROUP BY entity_id)),
fg AS (SELECT * FROM (WITH RECURSIVE {top}, {_CLUSTER_SQL} SELECT entity_id, CASE WHEN count(fg.actor_id) > 0 THEN count(*) FILTER (is_sniper) END AS n_sniper, CASE WHEN count(fg.actor_id) > 0 THEN count(*) FILTER (is_smart) END AS n_smart, CASE WHEN count(fg.actor_id) > 0 THEN count(*) FILTER (is_bot) END AS n_bot,
 CASE WHEN count(fg.actor_id) > 0 THEN count(*) FILTER (cluster_size BETWEEN 3 AND 50) END AS n_small_cluster FROM top t LEFT JOIN fg USING (actor_id) LEFT JOIN cl USING (actor_id) WHERE rank <= 10 GROUP BY entity_id)),
la AS (SELECT * FROM (WITH {_label_sql(span)})),
al AS (SELECT me.* EXCLUDE (created_at), nr.created_at, coalesce(fast_buy_count, 0) AS fast_buy_count, coalesce(fast_unique_buyers, 0) AS fast_unique_buyers, coalesce(fast_volume, 0) AS fast_volume, coalesce(fast_buy_rate, 0) AS fast_buy_rate, coalesce(fast_events, 0) AS fast_events,
 CASE WHEN fast_price > 0 AND last_price > 0 THEN (last_price - fast_price) / fast_price * 100 ELSE 0 END AS pnl_at_fast_entry, entities_recent, concurrent, first_delay AS gap_to_first_event, 0.0::DOUBLE AS market_price, coalesce(n_buyers_first, 0) AS n_buyers_first,
 ho.* EXCLUDE (entity_id), cs.* EXCLUDE (entity_id), pr.* EXCLUDE (entity_id), fg.* EXCLUDE (entity_id), exit_reason, realized, hour(to_timestamp(nr.created_at) AT TIME ZONE 'UTC') * (2 * pi() / 24) AS angle
 FROM me JOIN nr USING (entity_id) LEFT JOIN fa USING (entity_id) LEFT JOIN nb USING (entity_id) LEFT JOIN ho USING (entity_id) LEFT JOIN cs USING (entity_id) LEFT JOIN pr USING (entity_id) LEFT JOIN fg USING (entity_id) LEFT JOIN la USING (entity_id)),
de AS (SELECT *, sin(angle) AS hour_sin, cos(angle) AS hour_cos, buy_volume / (sell_volume + 0.01::DOUBLE) AS volume_ratio, buy_count / (sell_count + 1) AS count_ratio, max_buy / (avg_buy + 0.001::DOUBLE) AS buy_size_growth, fast_volume / (buy_volume + 0.01::DOUBLE) AS fast_volume_share, fast_buy_rate / (buy_count / {span} + 0.001::DOUBLE) AS fast_rate_share,
 top5_3 - top1_3 AS top5_minus_top1, top10_3 - top5_3 AS top10_minus_top5, holders_3 / (holders_1 + 1) AS holder_growth, holders_1 / 30 AS holder_velocity_early, top1_1 + (top1_3 - top1_1) / 3 AS top1_at_2, (top1_3 - top1_1) / 3 AS top1_1_to_2, buy_rate_at_3 - buy_rate_at_2 AS buy_rate_2_to_3, unique_buyers_at_2 - unique_buyers_at_1 AS unique_buyers_1_to_2 FROM al)
SELECT entity_id, {", ".join(order)}, (realized > 0)::INT AS label, realized, exit_reason FROM de"""


def dataset_parts(spark, sf_dir):
    """What the feature vectors of all spans share, each part written once: early metrics, neighbours in time, holders, creators' pasts, actors' flags and clusters."""
    tokens = ledger_tokens(spark, sf_dir)
    fast = M.entity_metrics(window(spark, sf_dir, FAST)).select("entity_id", F.col("last_price").alias("fast_price"), F.col("buy_count").alias("fast_buy_count"), F.col("unique_buyers").alias("fast_unique_buyers"), F.col("buy_volume").alias("fast_volume"), (F.col("buy_count") / F.greatest("window_span", F.lit(0.1))).alias("fast_buy_rate"), F.col("n_events").alias("fast_events"))
    near = J.ranged_count(tokens, NEAR, True).withColumnRenamed("n", "entities_recent").join(J.ranged_count(tokens, NEAR, False).withColumnRenamed("n", "concurrent"), "entity_id")
    parts = {
        "fast": fast,
        "near": near,
        "first": M.buyers_within(window(spark, sf_dir, FIRST), FIRST).withColumnRenamed("n", "n_buyers_first"),
        "held": X.holder_features(holders(spark, sf_dir), *AGES_H[:2]),
        "observed": snapshots(spark, sf_dir).select("creator_id", F.col("ref_ts").alias("observed_at"), "n_prior", "median_peak", "mean_interval", "age_days", F.col("entity_id").alias("id")),
        "flags": flags(spark, sf_dir).select("actor_id", "is_sniper", "is_bot", "is_smart").join(actor_cluster_table(spark, sf_dir), "actor_id", "left"),
    }
    return {name: _shared(part) for name, part in parts.items()}


def dataset(spark, sf_dir, span, order, shared=None):
    """The features of `order` for every entity with events in its window, and what its position would have made.

    Every part, a row for each entity, is written before they are joined: in one stage their windows and sorts would hold their memory at the same time.
    shared: `dataset_parts` of the same kept ledger, where several datasets are made of it.
    """
    sf_dir = kept(spark, sf_dir)
    shared = shared or dataset_parts(spark, sf_dir)
    tokens, trades = ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir)
    m = M.entity_metrics(window(spark, sf_dir, span), EARLY, ATTENTION, AGES_M).drop("created_at")
    creator = J.asof(tokens.select("entity_id", "creator_id", (F.col("created_at") + span).alias("at")), shared["observed"], "creator_id", "at", "observed_at", ["n_prior", "median_peak", "mean_interval", "age_days"], tie="id")
    several = F.col("n_prior") >= 2
    creator = creator.select("entity_id", F.col("age_days").alias("creator_age_days"), F.when(several, F.col("median_peak")).alias("creator_median_peak"), F.when(several, F.col("mean_interval")).alias("creator_interval"), F.when(F.col("observed_at").isNotNull(), 0.0).alias("creator_balance"))
    top = _shared(M.top_buyers(window(spark, sf_dir, span), 10).select("entity_id", "actor_id", "rank"))
    buyers = X.buyer_features(prior(spark, sf_dir, span, top))
    known = F.count("is_sniper") > 0
    flagged = top.join(shared["flags"], "actor_id", "left")
    flagged = flagged.groupBy("entity_id").agg(*(F.when(known, F.count_if(f"is_{c}")).alias(f"n_{c}") for c in ("sniper", "smart", "bot")), F.when(known, F.count_if(F.col("cluster_size").between(3, 50))).alias("n_small_cluster"))
    points = _shared(M.entry_points(tokens, trades, span))
    inside = points.where("status = 'entered'").join(tokens.select("entity_id", "creator_id"), "entity_id")
    sim = E.simulated(trades, inside, spark.createDataFrame([LEDGER_CONFIG], E.PARAMS), WHALE, LEDGER_TICK).select("entity_id", "reason", "pnl")
    d = _shared(m).join(tokens.select("entity_id", "created_at"), "entity_id")
    for part in (*(shared[x] for x in ("near", "fast", "first", "held")), _shared(creator), _shared(buyers), _shared(flagged), points.select("entity_id", "status"), _shared(sim)):
        d = d.join(part, "entity_id", "left")
    gain = F.when((F.col("fast_price") > 0) & (F.col("last_price") > 0), (F.col("last_price") - F.col("fast_price")) / F.col("fast_price") * 100).otherwise(0.0)
    d = d.withColumns({"pnl_at_fast_entry": gain, "gap_to_first_event": F.col("first_delay"), "market_price": F.lit(0.0)})
    d = X.derived(d.fillna(0, ["fast_buy_count", "fast_unique_buyers", "fast_volume", "fast_buy_rate", "fast_events", "n_buyers_first"]), span)
    realized = F.coalesce(F.when(F.col("status") == "entered", F.col("pnl")), F.lit(0.0))
    why = F.coalesce(F.when(F.col("status") != "entered", F.col("status")), "reason", F.lit("timeout"))
    return X.in_order(d.withColumns({"label": (realized > 0).cast("int"), "realized": realized, "exit_reason": why}), [*order, "label", "realized", "exit_reason"], "entity_id")


#: Columns that are exact on both sides; all others are sums, or follow from some, and are rounded.
_EXACT = {"first_delay", "gap_to_first_event", "velocity_trend", "curve_velocity", "curve_acceleration", "sell_ratio", "count_ratio", "buys_per_unique", "fast_buy_rate", "fast_rate_share", "market_price", "creator_balance"}
_COUNTS = {c for c in X.FEATURE_ORDER if c.startswith(("unique_", "n_", "holders_", "buy_rate")) or c.endswith("_events") or c in ("buy_count", "sell_count", "buy_diversity", "repeat_buyers", "fast_buy_count", "fast_unique_buyers", "entities_recent", "concurrent", "top3_prior_entities")}


def _sums(order: list[str]) -> tuple[str, ...]:
    return (*(c for c in order if c not in _EXACT | _COUNTS), "realized")


@query(_dataset_sql(FULL, X.FEATURE_ORDER), rounded=_sums(X.FEATURE_ORDER), digits=4)
def entry_dataset(spark, sf_dir):
    return dataset(spark, sf_dir, FULL, X.FEATURE_ORDER)


@query(_dataset_sql(EARLY_SPAN, X.FEATURE_ORDER_EARLY), rounded=_sums(X.FEATURE_ORDER_EARLY), digits=4)
def entry_dataset_early(spark, sf_dir):
    return dataset(spark, sf_dir, EARLY_SPAN, X.FEATURE_ORDER_EARLY)


_SAMPLE_SQL = f"""{ENTRY_SQL}, af AS (SELECT t.entity_id, t.ts, t.event_id, t.price, t.side, entry_ts FROM trades t JOIN entries USING (entity_id) WHERE ts > entry_ts), sm AS (SELECT entity_id, i, entry_ts + i * {12 * 3600.0} AS t FROM entries JOIN (SELECT entity_id, max(ts) AS z FROM af GROUP BY entity_id) USING (entity_id), unnest(range(1, floor((z - entry_ts) / {12 * 3600.0})::BIGINT + 1)) u(i))
SELECT sm.entity_id, sm.i::INT AS i, arg_max(af.price, af.ts) FILTER (af.ts <= t) AS price, max(af.price) FILTER (af.ts <= t) AS peak, count(*) FILTER (af.side = 'buy' AND floor(af.ts) BETWEEN floor(t) - {int(DAY)} AND floor(t)) AS buys_back,
 coalesce(min(af.price) FILTER (floor(af.ts) BETWEEN floor(t) + 1 AND floor(t) + {int(DAY)}) <= arg_max(af.price, af.ts) FILTER (af.ts <= t) * (1 - 50 / 100), false)::INT AS label,
 (arg_max(af.price, af.ts) FILTER (floor(af.ts) <= floor(t) + {int(2 * DAY)}) - arg_max(af.price, af.ts) FILTER (af.ts <= t)) / arg_max(af.price, af.ts) FILTER (af.ts <= t) * 100 AS forward_return
FROM sm JOIN af USING (entity_id) GROUP BY sm.entity_id, sm.i HAVING count(*) FILTER (af.ts <= t) > 0"""


@query(f"WITH {_SAMPLE_SQL}", rounded=("forward_return",))
def exit_dataset(spark, sf_dir):
    return E.exit_samples(stream_trades(spark, sf_dir), kept_entries(spark, sf_dir), 12 * 3600.0, DAY, DAY, 2 * DAY, 50.0)


def many_starts_sql(starts: str) -> str:
    """STATES_SQL for many positions of an entity: `starts` is a CTE (entity_id, sid, entry_ts, entry_price, creator_id); results carry sid as entity_id."""
    sql = STATES_SQL.replace("after AS (SELECT t.*, entry_ts, entry_price, creator_id FROM trades t JOIN entries USING (entity_id) WHERE ts > entry_ts)", starts + ", after AS (SELECT t.* REPLACE (s.sid AS entity_id), s.entry_ts, s.entry_price, s.creator_id FROM trades t JOIN starts s ON s.entity_id = t.entity_id WHERE t.ts > s.entry_ts)")
    assert "starts s ON" in sql
    return sql


_START_SAMPLES = f"xs AS ({_SAMPLE_SQL.split('sm AS', 1)[1].replace('(SELECT entity_id, i', 'WITH sm AS (SELECT entity_id, i', 1)}), starts AS (SELECT entity_id, entity_id * 100000 + i AS sid, entry_ts + i * {12 * 3600.0} AS entry_ts, price AS entry_price, creator_id FROM xs JOIN entries USING (entity_id))"


@query(f"WITH {many_starts_sql('af AS (SELECT t.entity_id, t.ts, t.event_id, t.price, t.side, entry_ts FROM trades t JOIN entries USING (entity_id) WHERE ts > entry_ts), ' + _START_SAMPLES)} SELECT (entity_id // 100000)::BIGINT AS entity_id, (entity_id % 100000)::INT AS i, reason, hold, pnl FROM sim WHERE config_id = 'loose'", rounded=("pnl",))
def forward_hold(spark, sf_dir):
    """What entering at each sample of exit_dataset, at its price, would have come to: many positions on one copy of the events."""
    t, e = stream_trades(spark, sf_dir), entries(spark, sf_dir)
    s = E.exit_samples(t, e, 12 * 3600.0, DAY, DAY, 2 * DAY, 50.0).join(e.select("entity_id", "entry_ts", "creator_id"), "entity_id")
    s = s.select("entity_id", "i", (F.col("entry_ts") + F.col("i") * 12 * 3600.0).alias("entry_ts"), F.col("price").alias("entry_price"), "creator_id")
    return E.forward_holds(t, s, configs(spark).where("config_id = 'loose'"), WHALE, TICK)


AGES = (DAY, 2 * DAY, 4 * DAY)
_SNAPS = f"""sn AS (SELECT tk.entity_id, age::DOUBLE AS age, count(*) FILTER (ts <= created_at + age) AS n_events, CASE WHEN count(*) FILTER (ts <= created_at + age) > 0 THEN count(*) FILTER (ts <= created_at + age AND side = 'buy') END AS n_buys,
 CASE WHEN count(*) FILTER (ts <= created_at + age) > 0 THEN coalesce(sum(amount) FILTER (ts <= created_at + age AND side = 'buy'), 0) END AS buy_volume, CASE WHEN count(*) FILTER (ts <= created_at + age) > 0 THEN count(DISTINCT actor_id) FILTER (ts <= created_at + age AND side = 'buy') END AS unique_buyers,
 arg_max(price, ts) FILTER (ts <= created_at + age) AS price, arg_max(reserve, ts) FILTER (ts <= created_at + age) AS reserve FROM tokens tk LEFT JOIN trades t USING (entity_id), (VALUES ({AGES[0]}), ({AGES[1]}), ({AGES[2]})) v(age) GROUP BY tk.entity_id, v.age)"""


def snaps(spark, sf_dir):
    return E.snapshot_features(stream_trades(spark, sf_dir), stream_tokens(spark, sf_dir), AGES)


@query(f"WITH {B}, {_SNAPS} SELECT * FROM sn", rounded=("buy_volume",))
def snapshot_features(spark, sf_dir):
    return snaps(spark, sf_dir)


#: Results in percent below which an age is not worth entering, above which it is, and what waiting has to cost.
_LOST, _GAINED, _URGENT = -5.0, 5.0, 10.0
_STARTS = f"{_SNAPS}, starts AS (SELECT entity_id, entity_id * 10000000 + age AS sid, created_at + age AS entry_ts, price AS entry_price, creator_id FROM sn JOIN tokens USING (entity_id) WHERE price > 0)"


@query(
    f"""WITH {many_starts_sql(_STARTS)}, tl AS (SELECT sn.entity_id, sn.age, CASE WHEN sn.price > 0 THEN coalesce(sim.pnl, 0) END AS pnl_now FROM sn LEFT JOIN sim ON sim.config_id = 'loose' AND sim.entity_id = sn.entity_id * 10000000 + sn.age),
tm AS (SELECT *, lead(pnl_now) OVER (PARTITION BY entity_id ORDER BY age) AS pnl_next, lead(age) OVER (PARTITION BY entity_id ORDER BY age) IS NULL AS is_last FROM tl)
SELECT entity_id, age, pnl_now, pnl_next, CASE WHEN pnl_now IS NULL OR pnl_now < {_LOST} THEN 'SKIP' WHEN pnl_now <= {_GAINED} THEN 'WAIT' WHEN is_last OR pnl_now - pnl_next >= {_URGENT} THEN 'ENTER' ELSE 'WAIT' END AS label FROM tm""",
    rounded=("pnl_now", "pnl_next"),
)
def timing_labels(spark, sf_dir):
    return E.timing_labels(snaps(spark, sf_dir), stream_trades(spark, sf_dir), stream_tokens(spark, sf_dir), configs(spark).where("config_id = 'loose'"), WHALE, TICK, _LOST, _GAINED, _URGENT)


_HAZ = f"""{POSITIONS_SQL}, hz0 AS (SELECT id, config_id, greatest(ceil(least(hold_seconds, 50) / 5), 1)::INT AS n, status = 'closed' AND hold_seconds <= 50 AND pnl_pct < -3 AS dies FROM positions),
hz AS (SELECT id, config_id, bucket::INT AS bucket, (dies AND bucket = n - 1)::INT AS died FROM hz0, unnest(range(0, n)) u(bucket))"""


@query(f"WITH {_HAZ} SELECT id, bucket, died FROM hz")
def hazard_rows(spark, sf_dir):
    return E.hazard_rows(positions(spark, sf_dir), 5.0, 50.0, -3.0)


@query(
    f"""WITH {_HAZ}, h AS (SELECT config_id, bucket, avg(died) AS h FROM hz GROUP BY ALL), s AS (SELECT *, exp(sum(ln(1 - least(h, 0.999999))) OVER (PARTITION BY config_id ORDER BY bucket ROWS UNBOUNDED PRECEDING)) AS s FROM h)
SELECT config_id, (coalesce(min(bucket) FILTER (s < 0.7), max(bucket)) + 1) * 5.0::DOUBLE AS predicted_life, min(s) AS final_survival, avg(abs(h - 0.5)) * 2 AS confidence FROM s GROUP BY config_id""",
    rounded=("final_survival", "confidence"),
)
def survival_curve(spark, sf_dir):
    p = positions(spark, sf_dir)
    h = E.hazard_rows(p, 5.0, 50.0, -3.0).join(p.select("id", "config_id"), "id").groupBy("config_id", "bucket").agg(F.avg("died").alias("h"))
    return E.survival_curve(h, ["config_id"], 0.7, 5.0)


GRID = {"stop": [10, 15, 20], "lo": [1, 3, 5], "hi": [3, 6, 9], "mode": ["fast", "full"], "fast_score": [10, 20, 30]}


@query(
    f"""WITH {POSITIONS_SQL}, g AS (SELECT DISTINCT stop, lo, hi, mode, CASE WHEN mode = 'full' THEN 10 ELSE fast_score END AS fast_score FROM (VALUES (10), (15), (20)) a(stop), (VALUES (1), (3), (5)) b(lo), (VALUES (3), (6), (9)) c(hi), (VALUES ('fast'), ('full')) d(mode), (VALUES (10), (20), (30)) e(fast_score) WHERE lo < hi),
r AS (SELECT stop, lo, hi, mode, fast_score, count(*) AS trades, sum(greatest(pnl_pct, -stop)) AS pnl FROM positions JOIN g ON lower(entry_type) = mode AND entry_buyer_number BETWEEN lo AND hi AND (mode = 'full' OR score >= fast_score) WHERE status = 'closed' GROUP BY ALL)
SELECT stop, lo, hi, mode, fast_score, coalesce(trades, 0) AS trades, coalesce(pnl, 0) AS pnl FROM g LEFT JOIN r USING (stop, lo, hi, mode, fast_score)""",
    rounded=("pnl",),
)
def grid_combos(spark, sf_dir):
    """Every combination of a grid, run as rules over the closed positions; combinations without trades are kept."""
    g = E.grid_combos(spark, GRID, [("lo", "hi")], {"fast_score": ("mode", "full")})
    axes = list(GRID)
    p = positions(spark, sf_dir).where("status = 'closed'").withColumn("kind", F.lower("entry_type"))
    fits = (F.col("kind") == F.col("mode")) & F.col("entry_buyer_number").between(F.col("lo"), F.col("hi")) & ((F.col("mode") == "full") | (F.col("score") >= F.col("fast_score")))
    r = p.join(F.broadcast(g), fits).groupBy(*axes).agg(F.count("*").alias("trades"), F.sum(F.greatest("pnl_pct", -F.col("stop"))).alias("pnl"))  # the grid is a parameter
    return g.join(r, axes, "left").select(*axes, F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


@query()
def grid_sample(spark, sf_dir):
    """A sampled grid, run as thresholds over the table of positions."""
    g = E.grid_sample(spark, {"lo": list(range(0, 60, 5)), "hi": list(range(60, 120, 5)), "buyers": [1, 2, 3, 4]}, 40, 7)
    p = positions(spark, sf_dir).where("status = 'closed'")
    j = p.crossJoin(F.broadcast(g)).where((F.col("score") >= F.col("lo")) & (F.col("score") < F.col("hi")) & (F.col("entry_buyer_number") >= F.col("buyers")))
    return j.groupBy("lo", "hi", "buyers").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"))


def candidates(spark, sf_dir):
    p = positions(spark, sf_dir).where("status = 'closed'")
    return p.select("config_id", "id", F.col("entry_time").alias("entry_ts"), (F.col("entry_time") + F.col("hold_seconds") * 600).alias("exit_ts"), "pnl", (F.col("exit_reason") == "timeout").alias("by_tick"))


_LEFT = "p.x < c.entry_ts OR (p.x = c.entry_ts AND p.t)"


def _admission_sql(slots: int, cash: float, stake: float) -> str:
    """CTEs from candidates cd0 (config_id, id, entry_ts, exit_ts, pnl, by_tick) to `adm` (config_id, id, admitted): one step of recursion a candidate."""
    each = round(stake * 1e9)
    return f"""cd AS MATERIALIZED (SELECT config_id, id, entry_ts, exit_ts, round(pnl * {stake} * 1e9)::BIGINT AS gain, by_tick, row_number() OVER (PARTITION BY config_id ORDER BY entry_ts, id) AS k FROM cd0),
f AS (SELECT DISTINCT config_id, 0::BIGINT AS k, 0::BIGINT AS id, false AS admitted, {round(cash * 1e9)}::BIGINT AS cash, []::STRUCT(x DOUBLE, g BIGINT, t BOOLEAN)[] AS op FROM cd
UNION ALL SELECT config_id, k, id, ok, cash - CASE WHEN ok THEN {each} ELSE 0 END, CASE WHEN ok THEN list_append(still, {{'x': exit_ts, 'g': gain, 't': by_tick}}) ELSE still END FROM (SELECT *, len(still) < {slots} AND cash >= {each} AS ok FROM (
SELECT c.*, list_filter(f.op, lambda p: NOT ({_LEFT})) AS still, (f.cash + coalesce(list_sum(list_transform(list_filter(f.op, lambda p: {_LEFT}), lambda p: p.g + {each})), 0))::BIGINT AS cash FROM f JOIN cd c ON c.config_id = f.config_id AND c.k = f.k + 1) a) b),
adm AS (SELECT config_id, id, admitted FROM f WHERE k > 0)"""


@query(f"WITH RECURSIVE {POSITIONS_SQL}, cd0 AS (SELECT config_id, id, entry_time AS entry_ts, entry_time + hold_seconds * 600 AS exit_ts, pnl, exit_reason = 'timeout' AS by_tick FROM positions WHERE status = 'closed'), {_admission_sql(3, 1.0, 0.1)} SELECT * FROM adm")
def portfolio_admission(spark, sf_dir):
    return E.portfolio_admission(candidates(spark, sf_dir), 3, 1.0, 0.1)


#: Whole configurations: when to enter (score, buyers), how to leave (exits.PARAMS), each with a book of its own.
BOOKS = [
    (30, 3, ("a", 60.0, 150.0, 80.0, 40.0, 900 * DAY, 0.05, 4.0, 3.0, 0.2, 0.3, 21.0, 200.0)),
    (15, 4, ("b", 40.0, 60.0, 30.0, 20.0, 300 * DAY, 0.05, 2.0, 1.0, 0.3, 0.3, 5.0, 99.5)),
    (45, 2, ("c", 90.0, 900.0, 300.0, 200.0, 1500 * DAY, 0.0, 99.0, 99.0, 0.0, 0.3, 99.0, 200.0)),
]
_SLOTS, _CASH, _STAKE = 5, 1.0, 0.15


@query(
    f"""WITH RECURSIVE dec AS (SELECT * FROM (WITH {_FULL} SELECT entity_id, score, unique_buyers FROM decided WHERE gate IS NULL)),
si AS (SELECT * FROM (WITH {_ledger_sim_sql(FULL, [r for *_, r in BOOKS])} SELECT config_id, entity_id, entry_ts, reason, pnl, hold FROM sim)),
bk AS (SELECT si.* FROM si JOIN (VALUES {", ".join(f"('{r[0]}', {buy}, {buyers})" for buy, buyers, r in BOOKS)}) cf(config_id, buy, buyers) USING (config_id) JOIN dec USING (entity_id) WHERE score >= buy AND unique_buyers >= buyers),
cd0 AS (SELECT config_id, entity_id AS id, entry_ts, entry_ts + hold AS exit_ts, pnl / 100 AS pnl, reason = 'timeout' AS by_tick FROM bk), {_admission_sql(_SLOTS, _CASH, _STAKE)}
SELECT config_id, entity_id, entry_ts, reason, pnl, hold, admitted FROM bk JOIN adm USING (config_id) WHERE adm.id = bk.entity_id""",
    rounded=("pnl",),
)
def config_books(spark, sf_dir):
    """The same entities under whole configurations: each enters by its own thresholds, leaves by its own rules, and admits what its own book has room and cash for."""
    sf_dir = kept(spark, sf_dir)
    tokens, trades = ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir)
    entry = spark.createDataFrame([(r[0], buy, buyers) for buy, buyers, r in BOOKS], "config_id string, buy int, buyers int")  # a row per configuration
    wanted = decided(spark, sf_dir).where("gate is null").select("entity_id", "score", "unique_buyers")
    wanted = wanted.join(F.broadcast(entry), (F.col("score") >= F.col("buy")) & (F.col("unique_buyers") >= F.col("buyers"))).select("config_id", "entity_id")
    inside = M.entry_points(tokens, trades, FULL).where("status = 'entered'").join(tokens.select("entity_id", "creator_id"), "entity_id")
    book = E.simulated(trades, inside, spark.createDataFrame([r for *_, r in BOOKS], E.PARAMS), WHALE, LEDGER_TICK).join(wanted, ["config_id", "entity_id"])
    book = _shared(book.select("config_id", "entity_id", "entry_ts", "reason", "pnl", "hold"))
    found = book.select("config_id", F.col("entity_id").alias("id"), "entry_ts", (F.col("entry_ts") + F.col("hold")).alias("exit_ts"), (F.col("pnl") / 100).alias("pnl"), (F.col("reason") == "timeout").alias("by_tick"))
    admitted = E.portfolio_admission(found, _SLOTS, _CASH, _STAKE).withColumnRenamed("id", "entity_id")
    return book.join(admitted, ["config_id", "entity_id"])


@query(
    f"""WITH {ENTRY_SQL}, af AS (SELECT t.*, entry_ts, lead(ts) OVER (PARTITION BY t.entity_id ORDER BY ts, event_id) AS nx FROM trades t JOIN entries USING (entity_id) WHERE ts > entry_ts),
q AS (SELECT entity_id, min(ts) AS t FROM af WHERE nx IS NULL OR nx - ts > {DAY} GROUP BY entity_id) SELECT entity_id, coalesce(t, entry_ts) + {DAY} AS exit_ts, 'dead_token' AS reason FROM entries LEFT JOIN q USING (entity_id)"""
)
def inactivity_exit(spark, sf_dir):
    return E.inactivity_exit(stream_trades(spark, sf_dir), entries(spark, sf_dir), DAY)


_SW = ("avg_pnl", "win_rate", "tp_rate", "stop_rate", "timeout_rate", "trail_rate", "rate_up", "rate_down", "avg_winner", "top5_mean")


@query(
    f"""WITH {STATES_SQL}, r AS (SELECT config_id, reason AS exit_reason, pnl AS pnl_pct, row_number() OVER (PARTITION BY config_id ORDER BY pnl DESC, entity_id) AS k, count(*) OVER (PARTITION BY config_id) AS n FROM sim)
SELECT config_id, count(*) AS n, avg(pnl_pct) AS avg_pnl, avg((pnl_pct > 0)::INT) AS win_rate, avg((exit_reason = 'take_profit')::INT) AS tp_rate, avg((exit_reason = 'hard_stop')::INT) AS stop_rate, avg((exit_reason = 'timeout')::INT) AS timeout_rate, avg((exit_reason = 'trailing_stop')::INT) AS trail_rate,
avg((pnl_pct >= 30)::INT) AS rate_up, avg((pnl_pct <= -10)::INT) AS rate_down, avg(pnl_pct) FILTER (pnl_pct > 0) AS avg_winner, avg(pnl_pct) FILTER (k <= greatest(1, floor(0.05 * n))) AS top5_mean FROM r GROUP BY config_id""",
    rounded=_SW,
)
def sweep(spark, sf_dir):
    s = simulation(spark, sf_dir).select("config_id", F.col("entity_id").alias("id"), F.col("reason").alias("exit_reason"), F.col("pnl").alias("pnl_pct"))
    return summary(s, ["config_id"])


RUNS_SQL = f"{POSITIONS_SQL}, runs AS (SELECT config_id || '/' || (entry_buyer_number % 3) AS run_id, config_id AS a, (entry_buyer_number % 3)::VARCHAR AS b, count(*) AS trades, sum(pnl) AS pnl, sum(pnl) FILTER (id % 2 = 0) AS oos_pnl FROM positions WHERE status = 'closed' GROUP BY ALL)"


def runs(spark, sf_dir):
    p = positions(spark, sf_dir).where("status = 'closed'").withColumn("b", (F.col("entry_buyer_number") % 3).cast("string"))
    g = p.groupBy(F.concat_ws("/", "config_id", "b").alias("run_id"), F.col("config_id").alias("a"), "b").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"), F.sum(F.when(F.col("id") % 2 == 0, F.col("pnl"))).alias("oos_pnl"))
    return g.withColumn("params", F.create_map(F.lit("a"), "a", F.lit("b"), "b"))


@query(f"WITH {RUNS_SQL}, e AS (SELECT 'a' AS axis, a AS value, trades, pnl FROM runs UNION ALL SELECT 'b', b, trades, pnl FROM runs) SELECT axis, value, count(*) AS combos, sum(pnl * trades) / sum(trades) AS by_trades, avg(pnl) AS by_combos, sign(sum(pnl * trades) / sum(trades)) * sign(avg(pnl)) < 0 AS disagree FROM e GROUP BY ALL", rounded=("by_trades", "by_combos"))
def axis_marginals(spark, sf_dir):
    return E.axis_marginals(runs(spark, sf_dir))


@query()
def axis_bootstrap(spark, sf_dir):
    return E.axis_bootstrap(runs(spark, sf_dir), 200, 7)


@query()
def axis_verdicts(spark, sf_dir):
    """Which value of each axis of the runs is best, by trades and by combinations, with bootstrap bounds."""
    return E.axis_verdicts(runs(spark, sf_dir), 200, 7)


@query(f"WITH {RUNS_SQL} SELECT a, sum(pnl * trades) FILTER (b = '0') / sum(trades) FILTER (b = '0') AS b0, sum(pnl * trades) FILTER (b = '1') / sum(trades) FILTER (b = '1') AS b1, sum(pnl * trades) FILTER (b = '2') / sum(trades) FILTER (b = '2') AS b2 FROM runs GROUP BY a", rounded=("b0", "b1", "b2"))
def axis_interaction(spark, sf_dir):
    return E.axis_interaction(runs(spark, sf_dir), "a", "b", ["0", "1", "2"]).select("a", F.col("0").alias("b0"), F.col("1").alias("b1"), F.col("2").alias("b2"))


_SENSE = ("mean", "median", "trimmed", "std", "survival", "top_lift", "spread", "anova_f")


def _sensitivity_sql(axes: str, where: str = "true") -> str:
    return f"""WITH {POSITIONS_SQL}, ru AS (SELECT *, (entry_buyer_number % 3)::INT AS buyers FROM positions WHERE status = 'closed' AND {where}), r AS (SELECT {axes}, pnl, row_number() OVER (PARTITION BY {axes} ORDER BY pnl, id) AS k, count(*) OVER (PARTITION BY {axes}) AS m FROM ru), tl AS (SELECT quantile_cont(pnl, 0.99) AS cut FROM ru),
g AS (SELECT {axes}, count(*) AS n, avg(pnl) AS mean, median(pnl) AS median, avg(pnl) FILTER (k > floor(m * 0.1) AND k <= m - floor(m * 0.1)) AS trimmed, stddev_samp(pnl) AS std, avg((pnl > 0)::INT) AS survival, count(*) FILTER (pnl >= cut) AS top_count, sum(pnl * pnl) AS sq FROM r, tl GROUP BY {axes}),
t AS (SELECT sum(n) AS bn, count(*) AS bk, sum(mean * n) / sum(n) AS bm, sum(n * mean * mean) AS bs, sum(sq) AS bq, sum(top_count) AS bt, max(mean) - min(mean) AS spread FROM g)
SELECT {axes}, n, mean, median, trimmed, std, survival, top_count, (top_count / greatest(bt, 1)) / (n / bn) AS top_lift, spread, ((bs - bn * bm * bm) / (bk - 1)) / ((bq - bs) / (bn - bk)) AS anova_f FROM g, t"""


def _sense(spark, sf_dir, axes, where="true"):
    p = positions(spark, sf_dir).where(f"status = 'closed' and {where}").withColumn("buyers", (F.col("entry_buyer_number") % 3).cast("int"))
    return E.sensitivity(p.withColumnRenamed("id", "run_id"), axes, "pnl")


@query(_sensitivity_sql("config_id"), rounded=_SENSE)
def sensitivity(spark, sf_dir):
    return _sense(spark, sf_dir, ["config_id"])


@query(_sensitivity_sql("config_id, buyers"), rounded=_SENSE)
def sensitivity_pairs(spark, sf_dir):
    return _sense(spark, sf_dir, ["config_id", "buyers"])


@query(_sensitivity_sql("config_id", "exit_reason = 'timeout'"), rounded=_SENSE)
def sensitivity_conditional(spark, sf_dir):
    return _sense(spark, sf_dir, ["config_id"], "exit_reason = 'timeout'")


@query(f"WITH {RUNS_SQL}, g AS (SELECT median(trades) AS median_trades, count(*) FILTER (oos_pnl > 0) AS n_profitable, avg((oos_pnl < pnl * 0.2)::INT) AS collapse FROM runs) SELECT *, median_trades < 20 AS few_trades, n_profitable = 0 AS none_profitable, collapse >= 0.8 AS collapsed FROM g", rounded=("collapse",))
def overfit_guardrails(spark, sf_dir):
    return E.overfit_guardrails(runs(spark, sf_dir))


_FOLDS = f"{POSITIONS_SQL}, x AS (SELECT min(entry_time) AS lo, max(entry_time) AS hi FROM positions), fo AS (SELECT p.*, least(floor((entry_time - lo) / ((hi - lo) / 5)), 4)::INT AS fold FROM positions p, x WHERE status = 'closed')"


def folded(spark, sf_dir):
    from ..operators.windows import time_folds

    return time_folds(positions(spark, sf_dir), "entry_time", 5, 0.0).where("status = 'closed'")


@query(
    f"""WITH {_FOLDS}, g AS (SELECT config_id, fold, count(*) AS n, sum(pnl) AS pnl FROM fo GROUP BY ALL HAVING count(*) >= 10), h AS (SELECT *, (sign(pnl) * sign(lag(pnl) OVER (PARTITION BY config_id ORDER BY fold)) < 0)::INT AS flip FROM g)
SELECT config_id, count(*) AS folds, count(*) FILTER (pnl > 0) AS survived, min(pnl) AS worst, max(pnl) AS best, arg_max(fold, pnl) AS best_fold, coalesce(sum(flip), 0)::BIGINT AS flips FROM h GROUP BY config_id""",
    rounded=("worst", "best"),
)
def kfold_robustness(spark, sf_dir):
    return E.robustness(folded(spark, sf_dir), "config_id", "fold", 10)


@query(f"WITH {_FOLDS} SELECT config_id, sum(pnl) FILTER (fold < 4) AS train_pnl, sum(pnl) FILTER (fold = 4) AS test_pnl, (sum(pnl) FILTER (fold < 4) > 0) = (sum(pnl) FILTER (fold = 4) > 0) AS held FROM fo GROUP BY config_id", rounded=("train_pnl", "test_pnl"))
def walk_forward(spark, sf_dir):
    g = folded(spark, sf_dir).groupBy("config_id").agg(F.sum(F.when(F.col("fold") < 4, F.col("pnl"))).alias("train_pnl"), F.sum(F.when(F.col("fold") == 4, F.col("pnl"))).alias("test_pnl"))
    return g.withColumn("held", (F.col("train_pnl") > 0) == (F.col("test_pnl") > 0))


@query(
    f"""WITH {STATES_SQL}, lim AS (SELECT min(entry_ts) AS lo, (max(entry_ts) - min(entry_ts)) / 5 AS w FROM sim), fb AS (SELECT config_id, pnl, least(floor((entry_ts - lo) / w), 4)::INT AS fold FROM sim, lim),
g0 AS (SELECT config_id, fold, count(pnl) AS n, coalesce(sum(pnl), 0) AS s FROM (SELECT DISTINCT config_id FROM fb) CROSS JOIN (SELECT DISTINCT fold FROM fb) LEFT JOIN fb USING (config_id, fold) GROUP BY ALL),
g1 AS (SELECT *, coalesce(sum(n) OVER b, 0)::BIGINT AS train_n, coalesce(sum(s) OVER b, 0) AS ts FROM g0 WINDOW b AS (PARTITION BY config_id ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wh AS (SELECT fold, coalesce(sign(sum(s)) * sign(sum(ts)) < 0, false) AS regime_flip FROM g1 GROUP BY fold),
ch AS (SELECT *, ts / train_n AS train_mean, CASE WHEN n > 0 THEN s / n END AS test_mean, row_number() OVER (PARTITION BY fold ORDER BY round(ts / train_n, 9) DESC, config_id)::INT AS place FROM g1 WHERE fold > 0 AND train_n >= 10)
SELECT fold, place, config_id, train_n, train_mean, n AS test_n, test_mean, coalesce(test_mean > 0, false) AS survived, count(*) FILTER (coalesce(test_mean > 0, false)) OVER (PARTITION BY fold) AS n_survived, regime_flip FROM ch JOIN wh USING (fold) WHERE place <= 2""",
    rounded=("train_mean", "test_mean"),
)
def walk_forward_nested(spark, sf_dir):
    """The two configurations that earlier folds would have chosen, judged on the next fold by the exit replay."""
    return E.nested_walk_forward(time_folds(simulation(spark, sf_dir), "entry_ts", 5, 0.0), "config_id", "fold", "pnl", 10, 2)


@query(
    f"""WITH {POSITIONS_SQL}, g AS (SELECT count(*) AS n, avg((pnl > 0)::INT) AS wr, stddev_pop((pnl > 0)::INT) / sqrt(count(*)) AS wr_se, avg(pnl) AS avg_pnl, stddev_samp(pnl) / sqrt(count(*)) AS avg_se, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0) AS pf FROM positions WHERE status = 'closed'),
s AS (SELECT *, (wr < 0.55 - 2 * wr_se)::INT + (avg_pnl < 0.001 - 2 * avg_se)::INT + (pf < 0.9 * 1.0)::INT AS signs FROM g) SELECT *, CASE WHEN signs >= 2 THEN 'FAIL' WHEN signs = 1 THEN 'WARN' ELSE 'PASS' END AS verdict FROM s""",
    rounded=("wr", "wr_se", "avg_pnl", "avg_se", "pf"),
)
def regression_gate(spark, sf_dir):
    return E.regression_gate(positions(spark, sf_dir).where("status = 'closed'"), 0.55, 0.001, 1.0, 2.0, 0.9)


@query(f"WITH {_FULL} SELECT entity_id, score, decision FROM decided WHERE entity_id % 4 <> 0 AND n_events >= 3 AND buy_volume >= 50000")
def backfill_scoring(spark, sf_dir):
    sf_dir = kept(spark, sf_dir)
    have = ledger_tokens(spark, sf_dir).where("entity_id % 4 = 0").select("entity_id")
    d = decided(spark, sf_dir).join(have, "entity_id", "left_anti")
    return d.where("n_events >= 3 and buy_volume >= 50000").select("entity_id", "score", "decision")


@query(f"WITH {POSITIONS_SQL} SELECT entity_id, created_at FROM tokens WHERE entity_id IN (SELECT entity_id FROM positions WHERE status = 'closed' AND exit_reason = 'hard_stop') ORDER BY created_at DESC, entity_id DESC LIMIT 40")
def closed_entity_corpus(spark, sf_dir):
    p = positions(spark, sf_dir).where("status = 'closed' and exit_reason = 'hard_stop'").select("entity_id")
    return stream_tokens(spark, sf_dir).join(p, "entity_id", "left_semi").orderBy(F.desc("created_at"), F.desc("entity_id")).limit(40).select("entity_id", "created_at")
