"""Queries T and the streaming sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actors as C
from ..sources.tables import stream_tokens, stream_trades, write_dataset
from ..streaming import live as L
from ..streaming import timers as T
from .base import B, B_TRADES, query
from .windows import PULSE_SQL
from .windows import pulse as batch_pulse

DAY = 86400.0


@query(f"WITH {B_TRADES} SELECT event_id, entity_id, actor_id, side, amount, qty, ts FROM trades")
def ingest_stream(spark, sf_dir):
    return L.appended(L.event_stream(spark, sf_dir).select("event_id", "entity_id", "actor_id", "side", "amount", "qty", "ts"))


@query(f"WITH {B_TRADES} SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_event FROM trades GROUP BY 1")
def append_events(spark, sf_dir):
    where = L.folder(spark)
    t = stream_trades(spark, sf_dir).withColumn("day", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))
    for part in (0, 1):
        t.where(F.col("event_id") % 2 == part).write.mode("append").partitionBy("day").parquet(where)
    return spark.read.parquet(where).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"WITH {B} SELECT entity_id, created_at, creator_id FROM tokens")
def write_entities(spark, sf_dir):
    where = L.folder(spark)
    write_dataset(stream_tokens(spark, sf_dir).select("entity_id", "created_at", "creator_id"), where)
    return spark.read.parquet(where)


def _keyed(spark, sf_dir):
    """Two coarse keys, so that many events share one: by actor and day, and by number."""
    s = L.sliced_stream(spark, sf_dir)
    day = F.floor(F.col("ts") / DAY).cast("string")
    return s.withColumn("syn_key", F.concat_ws(":", F.col("actor_id") % 7, day, "side")).withColumn("sig_key", F.concat(F.lit("s"), F.floor(F.col("event_id") / 300), F.lit("-"), F.col("entity_id")))


@query(f"""WITH {B_TRADES}, k AS (SELECT event_id, entity_id, ts, (actor_id % 7) || ':' || floor(ts / 86400)::BIGINT || ':' || side AS syn_key, 's' || (event_id // 300) || '-' || entity_id AS sig_key FROM trades),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, syn_key ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY entity_id, sig_key ORDER BY ts, event_id) AS b FROM k) SELECT event_id, entity_id, syn_key, sig_key FROM r WHERE a = 1 AND b = 1""")
def stream_dedup(spark, sf_dir):
    return L.appended(L.deduplicated(_keyed(spark, sf_dir)))


@query(f"WITH {B_TRADES}, w AS (SELECT floor(ts / 86400) * 86400 AS start, entity_id, count(*) AS n, sum(amount) AS amount FROM trades GROUP BY 1, 2) SELECT start, entity_id, n, amount FROM w WHERE start + 86400 <= (SELECT max(ts) FROM trades) - 3600", rounded=("amount",))
def stream_watermark(spark, sf_dir):
    return L.appended(L.windowed(L.sliced_stream(spark, sf_dir), "1 hour", "1 day"))


_AGES = (DAY, 5 * DAY, 10 * DAY)


def _messages(spark, sf_dir, n: int = 4):
    """Creations and trades as one stream that arrives in n slices, each a micro-batch of its own."""
    trades = stream_trades(spark, sf_dir).select("entity_id", F.lit("trade").alias("kind"), "ts", "side", "amount")
    tokens = stream_tokens(spark, sf_dir).select("entity_id", F.lit("create").alias("kind"), F.col("created_at").alias("ts"), F.lit(None).cast("string").alias("side"), F.lit(0.0).alias("amount"))
    rows, where = trades.unionByName(tokens).withColumn("event_time", F.timestamp_seconds("ts")), L.folder(spark)
    for part in L.slices(rows, n):
        L.land(part, where)
    return L.file_stream(spark, where, rows.schema, L.FILES)


@query(f"""WITH {B}, v(age) AS (VALUES ({_AGES[0]}::DOUBLE), ({_AGES[1]}::DOUBLE), ({_AGES[2]}::DOUBLE)), g AS (SELECT max(ts) - 3600 AS watermark FROM trades)
SELECT entity_id, age, count(*) FILTER (ts <= created_at + age) AS n_events, count(*) FILTER (ts <= created_at + age AND side = 'buy') AS n_buys, coalesce(sum(amount) FILTER (ts <= created_at + age AND side = 'buy'), 0) AS buy_volume
FROM tokens LEFT JOIN trades USING (entity_id), v, g WHERE created_at + age <= watermark GROUP BY entity_id, age""", rounded=("buy_volume",))
def stream_entity_window(spark, sf_dir):
    """Every window that the watermark has passed, whether its entity still sends or not."""
    return T.timed(T.entity_windows(_messages(spark, sf_dir), _AGES, "1 hour"))


@query(f"WITH {PULSE_SQL} SELECT event_id, entity_id, buy_rate, max_sell, new_actor_rate, peak_rate FROM pulse")
def stream_pulse(spark, sf_dir):
    return L.appended(L.pulse(L.sliced_stream(spark, sf_dir)))


_GAP = 2 * DAY


@query(
    f"""WITH {B_TRADES}, en AS (SELECT entity_id, min(ts) AS entry_ts, arg_min(price, ts) AS entry_price FROM (SELECT *, min(ts) OVER (PARTITION BY entity_id) AS first FROM trades) WHERE side = 'buy' AND ts >= first + {DAY} GROUP BY entity_id),
af AS (SELECT entity_id, t.ts, t.price, entry_ts, entry_price, lag(t.ts) OVER w AS prev_ts, lag(t.price) OVER w AS prev_price, (t.price - entry_price) / entry_price * 100 AS gain FROM trades t JOIN en USING (entity_id) WHERE t.ts >= entry_ts WINDOW w AS (PARTITION BY entity_id ORDER BY t.ts)),
x AS (SELECT *, CASE WHEN ts - prev_ts > {_GAP} THEN 'dead_token' WHEN gain < -90 THEN 'hard_stop' WHEN gain >= 400 THEN 'take_profit' WHEN ts - entry_ts > {10 * DAY} THEN 'timeout' END AS why FROM af WHERE ts > entry_ts),
e AS (SELECT entity_id, ts, why, prev_ts, (prev_price - entry_price) / entry_price * 100 AS prev_gain, gain, row_number() OVER (PARTITION BY entity_id ORDER BY ts) AS q FROM x WHERE why IS NOT NULL),
quiet AS (SELECT entity_id, max(ts) AS last_ts, arg_max(gain, ts) AS gain FROM af WHERE entity_id NOT IN (SELECT entity_id FROM e) GROUP BY entity_id)
SELECT entity_id, CASE WHEN why = 'dead_token' THEN prev_ts + {_GAP} ELSE ts END AS exit_ts, why AS reason, CASE WHEN why = 'dead_token' THEN prev_gain ELSE gain END AS pnl FROM e WHERE q = 1
UNION ALL SELECT entity_id, last_ts + {_GAP}, 'dead_token', gain FROM quiet WHERE last_ts + {_GAP} < (SELECT max(ts) FROM trades) - 3600""",
    rounded=("pnl",),
)
def stream_exit(spark, sf_dir):
    return L.appended(L.exits(L.sliced_stream(spark, sf_dir), DAY, 90.0, 400.0, 10 * DAY, _GAP))


@query(f"""WITH {B_TRADES}, x AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY entity_id ORDER BY ts) > 43200, true) AS fresh FROM trades), y AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY entity_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x),
z AS (SELECT entity_id, min(ts) AS start, max(ts) + 43200 AS stop, count(*) AS n FROM y GROUP BY entity_id, s) SELECT entity_id, start, stop, n FROM z WHERE stop <= (SELECT max(ts) FROM trades) - 3600""")
def stream_session_end(spark, sf_dir):
    return L.appended(L.sessions(L.sliced_stream(spark, sf_dir), "1 hour", "12 hours"))


@query(f"WITH {B_TRADES} SELECT actor_id, entity_id, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(sum(amount) FILTER (side = 'buy'), 0) AS buy_amount, coalesce(sum(amount) FILTER (side = 'sell'), 0) AS sell_amount FROM trades GROUP BY actor_id, entity_id", rounded=("buy_amount", "sell_amount"))
def stream_activity_upsert(spark, sf_dir):
    return L.activity_upsert(L.sliced_stream(spark, sf_dir))


@query(f"WITH {B_TRADES}, w AS (SELECT floor(ts / 3600) * 3600 - o * 3600 AS start FROM trades, range(0, 6) r(o)) SELECT start::DOUBLE AS start, count(*) AS n FROM w WHERE start + 21600 <= (SELECT max(ts) FROM trades) - 3600 GROUP BY 1")
def stream_rate_5min(spark, sf_dir):
    return L.appended(L.rate(L.sliced_stream(spark, sf_dir), "1 hour", "6 hours", "1 hour"))


@query(f"WITH {B_TRADES} SELECT floor(ts / 86400) * 86400 AS start, side, count(*) AS n, max(ts) AS latest FROM trades WHERE floor(ts / 86400) * 86400 + 86400 <= (SELECT max(ts) FROM trades) - 3600 GROUP BY 1, 2")
def stream_source_health(spark, sf_dir):
    return L.appended(L.source_health(L.sliced_stream(spark, sf_dir), "1 hour", "1 day"))


_PATIENCE = 1.5 * DAY


@query(f"""WITH {B_TRADES}, x AS (SELECT 'user ' || actor_id AS source, ts, lead(ts) OVER (PARTITION BY actor_id ORDER BY ts, event_id) AS next FROM trades)
SELECT source, ts AS latest, ts + {_PATIENCE} AS stale_at FROM x WHERE next - ts > {_PATIENCE} OR next IS NULL AND ts + {_PATIENCE} <= (SELECT max(ts) FROM trades) - 3600""")
def stream_source_stale(spark, sf_dir):
    """Each actor is a source; one that sends nothing for a day and a half is stale, whether it comes back or not."""
    s = L.sliced_stream(spark, sf_dir).withColumn("source", F.concat(F.lit("user "), "actor_id"))
    return T.timed(T.silent_sources(s, _PATIENCE, "1 hour"))


@query(f"WITH {B} SELECT event_id, entity_id, ts - created_at AS age FROM trades JOIN tokens USING (entity_id) WHERE ts > created_at + {2 * DAY} AND ts <= created_at + {4 * DAY}")
def stream_extended_observation(spark, sf_dir):
    t = stream_tokens(spark, sf_dir).select("entity_id", "created_at")
    s = L.sliced_stream(spark, sf_dir).join(t, "entity_id").withColumn("age", F.col("ts") - F.col("created_at"))
    return L.appended(s.where((F.col("ts") > F.col("created_at") + 2 * DAY) & (F.col("ts") <= F.col("created_at") + 4 * DAY)).select("event_id", "entity_id", "age"))


@query(f"WITH {PULSE_SQL} SELECT count(*) AS n_rows, count(*) AS n_equal FROM pulse")
def stream_batch_parity(spark, sf_dir):
    live = L.appended(L.pulse(L.sliced_stream(spark, sf_dir))).alias("l")
    b = batch_pulse(spark, sf_dir).select("event_id", "entity_id", "buy_rate", "max_sell", "new_actor_rate", "peak_rate").alias("b")
    j = live.join(b, ["entity_id", "event_id"], "full")
    same = F.lit(True)
    for c in ("buy_rate", "max_sell", "new_actor_rate", "peak_rate"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}"))
    return j.agg(F.count("*").alias("n_rows"), F.count_if(same).alias("n_equal"))


@query(f"WITH {PULSE_SQL} SELECT event_id, entity_id, buy_rate, max_sell, new_actor_rate, peak_rate FROM pulse")
def stream_resume(spark, sf_dir):
    """Run on what is there, stop, let new files come, and run again from the same checkpoint: state goes on where it was."""
    where, source = L.folder(spark), L.folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first, *later = L.slices(events, 3)
    run = lambda: L.appended(L.pulse(L.as_trades(spark, L.file_stream(spark, source, events.schema, L.FILES))), where)
    L.land(first, source)
    run()
    for part in later:
        L.land(part, source)
    return run()


#: (config_id, stop, take, max_hold)
_BOOKS = [("tight", 60.0, 150.0, 6 * DAY), ("wide", 90.0, 400.0, 10 * DAY), ("hold", 99.0, 5000.0, 30 * DAY)]
_BOOKS_SQL = "cf(config_id, stop, take, max_hold) AS (VALUES " + ", ".join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE)" for c, a, b, d in _BOOKS) + ")"


def _positions_sql(until: str) -> str:
    """CTEs up to `px` (config_id, entity_id, entry_ts, exit_ts, reason, pnl), open positions with nulls, of the events before `until`."""
    return f"""{B_TRADES}, {_BOOKS_SQL}, tu AS (SELECT * FROM trades WHERE {until}), tf AS (SELECT *, min(ts) OVER (PARTITION BY entity_id) AS first FROM tu),
en AS (SELECT entity_id, min(ts) AS entry_ts, arg_min(price, ts) AS entry_price FROM tf WHERE side = 'buy' AND ts >= first + {DAY} GROUP BY entity_id),
af AS (SELECT entity_id, t.ts, t.price, entry_ts, entry_price, lag(t.ts) OVER w AS prev_ts, lag(t.price) OVER w AS prev_price, (t.price - entry_price) / entry_price * 100 AS gain FROM tu t JOIN en USING (entity_id) WHERE t.ts >= entry_ts WINDOW w AS (PARTITION BY entity_id ORDER BY t.ts)),
px0 AS (SELECT *, CASE WHEN ts - prev_ts > {_GAP} THEN 'dead_token' WHEN gain < -stop THEN 'hard_stop' WHEN gain >= take THEN 'take_profit' WHEN ts - entry_ts > max_hold THEN 'timeout' END AS why FROM af, cf WHERE ts > entry_ts),
px1 AS (SELECT *, row_number() OVER (PARTITION BY config_id, entity_id ORDER BY ts) AS q FROM px0 WHERE why IS NOT NULL),
pl AS (SELECT entity_id, entry_ts, max(ts) AS last_ts, arg_max(gain, ts) AS gain FROM af GROUP BY entity_id, entry_ts),
px AS (SELECT cf.config_id, pl.entity_id, pl.entry_ts, CASE WHEN why = 'dead_token' THEN prev_ts + {_GAP} WHEN why IS NOT NULL THEN ts WHEN last_ts + {_GAP} <= w THEN last_ts + {_GAP} END AS exit_ts,
 coalesce(why, CASE WHEN last_ts + {_GAP} <= w THEN 'dead_token' END) AS reason, CASE WHEN why = 'dead_token' THEN (prev_price - entry_price) / entry_price * 100 WHEN why IS NOT NULL THEN px1.gain WHEN last_ts + {_GAP} <= w THEN pl.gain END AS pnl
 FROM pl CROSS JOIN cf CROSS JOIN (SELECT max(ts) - 3600 AS w FROM tu) LEFT JOIN px1 ON px1.config_id = cf.config_id AND px1.entity_id = pl.entity_id AND q = 1)"""


def _resumed(spark, sf_dir):
    """Positions of the first half of the stream; then a new query over the second half that starts from what the first one held.

    (exits of both, what was held between them).
    """
    configs = spark.createDataFrame(_BOOKS, "config_id string, stop double, take double, max_hold double")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts, held, exits = L.slices(events, 4), None, []
    for half in (parts[:2], parts[2:]):
        source, where = L.folder(spark), L.folder(spark)
        for part in half:
            L.land(part, source)
        stream = L.as_trades(spark, L.file_stream(spark, source, events.schema, L.FILES))
        exits.append(T.timed(T.positions(stream, configs, DAY, _GAP, "1 hour", held), where))
        held = T.held_positions(spark, where) if held is None else held
    return exits[0].unionByName(exits[1]), held


_CUT = "ts < (SELECT min(ts) + 2 * ((max(ts) - min(ts)) / 4) FROM b0)"


@query(f"WITH {_positions_sql('true')} SELECT config_id, entity_id, entry_ts, exit_ts, reason, pnl FROM px WHERE reason IS NOT NULL", rounded=("pnl",))
def stream_resume_positions(spark, sf_dir):
    """Exits of a run that was stopped half-way and resumed from its open positions: those of an unbroken run."""
    return _resumed(spark, sf_dir)[0]


@query(f"WITH {_positions_sql(_CUT)} SELECT config_id, count(*) FILTER (reason IS NULL) AS n_open, count(*) FILTER (reason IS NOT NULL) AS n_closed FROM px GROUP BY config_id")
def stream_resume_open(spark, sf_dir):
    """Open and closed positions per configuration where the run goes on."""
    held = _resumed(spark, sf_dir)[1].where("entry is not null")
    return held.groupBy("config_id").agg(F.count_if(~F.col("closed")).alias("n_open"), F.count_if("closed").alias("n_closed"))


_HELD = f"""hb AS (SELECT entity_id, actor_id, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS bal FROM trades JOIN tokens USING (entity_id) WHERE ts <= created_at + {2 * DAY} GROUP BY ALL HAVING bal > 0),
hx AS (SELECT entity_id, max(bal) / sum(bal) * 100 AS holder_top1 FROM hb GROUP BY entity_id), an AS (SELECT actor_id, count(DISTINCT entity_id) AS n_entities, count(DISTINCT entity_id) >= 20 AS is_flagged FROM trades GROUP BY actor_id)"""


@query(f"WITH {B}, {_HELD}, p AS (SELECT entity_id, nullif(count(*) OVER (PARTITION BY creator_id ORDER BY insert_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_prior FROM tokens) SELECT event_id, entity_id, creator_id, n_prior, ts - created_at AS age, holder_top1, n_entities, is_flagged FROM trades JOIN tokens USING (entity_id) JOIN p USING (entity_id) LEFT JOIN hx USING (entity_id) LEFT JOIN an USING (actor_id)", rounded=("holder_top1",))
def stream_enrich(spark, sf_dir):
    tokens, trades = stream_tokens(spark, sf_dir), stream_trades(spark, sf_dir)
    held = C.holder_samples(tokens, trades, (2 * DAY,)).select("entity_id", F.col("top1_pct").alias("holder_top1"))
    n = F.count_distinct("entity_id")
    actors = trades.groupBy("actor_id").agg(n.alias("n_entities"), (n >= 20).alias("is_flagged"))
    return L.enriched(L.sliced_stream(spark, sf_dir), tokens, held, actors)
