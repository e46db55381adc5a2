"""Queries S, F, K, U: scans, store operators, filters, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as X
from ..operators import metrics as M
from ..operators import setops as U
from ..sources import tables as S
from ..sources.tables import ledger_tokens, ledger_trades, stream_tokens, stream_trades, table
from .base import A, A_TRADES, B, B_TRADES, query
from .metrics import FAST

DAY = 86400.0


@query(f"WITH {A} SELECT * FROM tokens")
def scan_entities(spark, sf_dir):
    return S.scan_entities(ledger_tokens(spark, sf_dir))


@query(f"WITH {A} SELECT * FROM tokens ORDER BY created_at DESC, insert_order DESC LIMIT 100")
def scan_entities_newest(spark, sf_dir):
    return S.scan_entities(ledger_tokens(spark, sf_dir), newest=100)


@query(f"WITH {B_TRADES} SELECT event_id, entity_id, actor_id, side, amount, ts, row_number() OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS rn FROM trades")
def scan_events_ordered(spark, sf_dir):
    from pyspark.sql import Window

    t = stream_trades(spark, sf_dir).select("event_id", "entity_id", "actor_id", "side", "amount", "ts")
    return t.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy("ts", "event_id")))


@query(
    f"""WITH {A}, x AS (SELECT entity_id, ts - created_at AS age, amount FROM trades JOIN tokens USING (entity_id))
SELECT entity_id, count(*) FILTER (age <= {FAST}) AS n_fast, count(*) FILTER (age <= {365 * DAY}) AS n_full, count(*) FILTER (age > {365 * DAY}) AS n_after FROM x GROUP BY entity_id"""
)
def events_in_window(spark, sf_dir):
    tokens, trades = ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir)
    e = S.events_in_window(tokens, trades, 0.0, 1e12)
    age = F.col("ts") - F.col("created_at")
    return e.groupBy("entity_id").agg(F.count_if(age <= FAST).alias("n_fast"), F.count_if(age <= 365 * DAY).alias("n_full"), F.count_if(age > 365 * DAY).alias("n_after"))


_RAW_PART = """SELECT to_json({'mint': 'p' || p_partkey, 'name': p_name, 'symbol': p_brand, 'traderPublicKey': 'c' || (p_partkey % 7), 'timestamp': p_size * 1000.0, 'uri': '',
 'pool': CASE WHEN p_partkey % 3 = 0 THEN 'pump' WHEN p_partkey % 3 = 1 THEN 'bonk' ELSE 'other' END, 'txType': CASE WHEN p_partkey % 5 = 0 THEN 'buy' ELSE 'create' END}) AS v FROM part"""


@query("""SELECT 'p' || p_partkey AS entity_id, p_name AS name, p_brand AS symbol, 'c' || (p_partkey % 7) AS creator_id, p_size * 1000.0::DOUBLE AS created_at, '' AS uri,
CASE WHEN p_partkey % 3 = 0 THEN 'pumpfun' WHEN p_partkey % 3 = 1 THEN 'letsbonk' ELSE 'other' END AS source FROM part WHERE p_partkey % 5 <> 0""")
def parse_create_event(spark, sf_dir):
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        F.to_json(
            F.struct(
                F.concat(F.lit("p"), k).alias("mint"),
                F.col("p_name").alias("name"),
                F.col("p_brand").alias("symbol"),
                F.concat(F.lit("c"), k % 7).alias("traderPublicKey"),
                (F.col("p_size") * 1000.0).alias("timestamp"),
                F.lit("").alias("uri"),
                F.when(k % 3 == 0, "pump").when(k % 3 == 1, "bonk").otherwise("other").alias("pool"),
                F.when(k % 5 == 0, "buy").otherwise("create").alias("txType"),
            )
        ).alias("value")
    )
    return S.parse_create(raw)


@query("""SELECT 'p' || l_partkey AS entity_id, 'w' || (l_suppkey % 50) AS actor_id, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
CASE WHEN l_extendedprice > 1000 THEN l_extendedprice / 1e9 ELSE l_extendedprice END AS amount, l_quantity AS qty,
CASE WHEN l_quantity * 40 > 1000 THEN l_quantity * 40 / 1e9 ELSE l_quantity * 40 END AS reserve, CASE WHEN l_extendedprice * 30 > 1000 THEN l_extendedprice * 30 / 1e9 ELSE l_extendedprice * 30 END AS mcap, l_linenumber * 1.0::DOUBLE AS ts,
(l_suppkey % 50) = (l_partkey % 50) AS is_creator, l_orderkey::VARCHAR AS signature, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 7 ELSE 0 END AS new_balance, 'k' || l_partkey AS curve_key, l_quantity * 1000 AS token_reserve FROM lineitem""")
def parse_trade_event(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.to_json(
            F.struct(
                F.concat(F.lit("p"), "l_partkey").alias("mint"),
                F.concat(F.lit("w"), F.col("l_suppkey") % 50).alias("traderPublicKey"),
                F.concat(F.lit("w"), F.col("l_partkey") % 50).alias("creator"),
                (F.col("l_linenumber") * 1.0).alias("timestamp"),
                F.when(F.col("l_returnflag") == "R", "sell").when(F.col("l_returnflag") == "A", "buy").alias("txType"),  # the rest has none
                F.col("l_extendedprice").alias("solAmount"),
                F.col("l_quantity").alias("tokenAmount"),
                (F.col("l_quantity") * 40).alias("vSolInBondingCurve"),
                (F.col("l_extendedprice") * 30).alias("marketCapSol"),
                F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 7).alias("newTokenBalance"),
                F.concat(F.lit("k"), "l_partkey").alias("bondingCurveKey"),
                (F.col("l_quantity") * 1000).alias("vTokensInBondingCurve"),
                F.col("l_orderkey").cast("string").alias("signature"),
            )
        ).alias("value")
    )
    return S.parse_trade(raw)


@query("SELECT entity_id, version, amount FROM (SELECT (props->>'$.k')::BIGINT AS entity_id, event_id AS version, value AS amount, row_number() OVER (PARTITION BY (props->>'$.k')::BIGINT ORDER BY event_id DESC) AS q FROM events) WHERE q = 1")
def upsert_latest(spark, sf_dir):
    t = stream_trades(spark, sf_dir).select("entity_id", F.col("event_id").alias("version"), "amount")
    return S.upsert_latest(t.where("version % 3 = 0"), t.where("version % 3 <> 0"), ["entity_id"], "version")


@query(f"""WITH {B_TRADES}, o AS (SELECT actor_id, min(event_id) AS event_id FROM trades WHERE event_id % 3 = 0 GROUP BY actor_id), n AS (SELECT actor_id, min(event_id) AS event_id FROM trades WHERE event_id % 3 <> 0 GROUP BY actor_id)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE actor_id NOT IN (SELECT actor_id FROM o)""")
def insert_ignore(spark, sf_dir):
    t = stream_trades(spark, sf_dir).select("actor_id", "event_id")
    old = t.where("event_id % 3 = 0").groupBy("actor_id").agg(F.min("event_id").alias("event_id"))
    return S.insert_ignore(old, t.where("event_id % 3 <> 0"), ["actor_id"], "event_id")


@query(f"""WITH {A_TRADES} SELECT actor_id, entity_id, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(sum(amount) FILTER (side = 'buy'), 0) AS buy_amount, coalesce(sum(amount) FILTER (side = 'sell'), 0) AS sell_amount
FROM trades GROUP BY actor_id, entity_id""", rounded=("buy_amount", "sell_amount"))
def upsert_merge_additive(spark, sf_dir):
    from ..operators.actors import activity

    t = ledger_trades(spark, sf_dir)
    cols = ["actor_id", "entity_id", "first_ts", "last_ts", "buy_amount", "sell_amount"]
    return S.merge_activity(activity(t.where("event_id % 2 = 0")).select(cols), activity(t.where("event_id % 2 = 1")).select(cols))


@query("SELECT 'part' AS table_name, count(*) AS n_source, count(*) AS n_target, true AS equal_counts FROM part UNION ALL SELECT 'orders', count(*), count(*), true FROM orders UNION ALL SELECT 'customer', count(*), count(*), true FROM customer")
def bulk_copy_validate(spark, sf_dir):
    pairs = {}
    for name in ("part", "orders", "customer"):
        source = table(spark, sf_dir, name)
        pairs[name] = (source, S.copy_common(source, source.columns[:3]))
    return S.count_report(pairs)


@query("SELECT * FROM (VALUES ('p_brand', 'string', NULL, 'missing'), ('p_extra', NULL, 'int', 'added'), ('p_size', 'int', 'bigint', 'retyped')) v(field, old_type, new_type, change) WHERE (SELECT count(*) FROM part) > 0")
def schema_diff(spark, sf_dir):
    old = table(spark, sf_dir, "part")
    new = old.drop("p_brand").withColumn("p_size", F.col("p_size").cast("long")).withColumn("p_extra", F.lit(1))
    return S.schema_diff(spark, old, new)


_GATES = [("errors", r"^\d\d:\d\d:\d\d error"), ("large", "value=[5-9][0-9]"), ("any_click", "click"), ("never", "no such phrase")]


@query("""WITH l AS (SELECT strftime(ts, '%H:%M:%S') || ' ' || event_type || ' value=' || floor(value)::BIGINT AS v FROM events),
g AS (SELECT CASE WHEN regexp_matches(v, '^\\d\\d:\\d\\d:\\d\\d error') THEN 'errors' WHEN regexp_matches(v, 'value=[5-9][0-9]') THEN 'large' WHEN regexp_matches(v, 'click') THEN 'any_click' END AS gate, left(v, 8) AS t FROM l),
n AS (SELECT gate, count(*) AS n, max(t) AS last_seen FROM g WHERE gate IS NOT NULL GROUP BY gate)
SELECT names.gate, coalesce(n, 0) AS n, last_seen, CASE WHEN n IS NULL THEN 'DEAD' ELSE 'ALIVE' END AS state FROM (VALUES ('errors'), ('large'), ('any_click'), ('never')) names(gate) LEFT JOIN n USING (gate)""")
def log_scan_gate_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    lines = e.select(F.concat_ws(" ", F.date_format("ts", "HH:mm:ss"), "event_type", F.concat(F.lit("value="), F.floor("value"))).alias("value"))
    return S.gate_counts(lines, _GATES)


# -- filters ------------------------------------------------------------------------------------------------------------

_SCORES_SQL = f"""{B}, scores AS (SELECT event_id, entity_id, ts AS scored_at, CASE WHEN event_id % 2 = 0 THEN 'live' ELSE 'backfill' END AS source, CASE WHEN amount > 60 THEN 'BUY' WHEN amount > 30 THEN 'BORDERLINE' ELSE 'SKIP' END AS decision,
 floor(amount)::BIGINT AS score, amount FROM trades)"""


def scores(spark, sf_dir):
    """A score for every stream event."""
    t = stream_trades(spark, sf_dir)
    decision = F.when(F.col("amount") > 60, "BUY").when(F.col("amount") > 30, "BORDERLINE").otherwise("SKIP")
    return t.select("event_id", "entity_id", F.col("ts").alias("scored_at"), F.when(F.col("event_id") % 2 == 0, "live").otherwise("backfill").alias("source"), decision.alias("decision"), F.floor("amount").alias("score"), "amount")


_T0 = 1704067200.0 + 10 * DAY  # the stream's eleventh day


@query(f"WITH {_SCORES_SQL} SELECT * FROM scores WHERE source = 'live' AND scored_at > {_T0} ORDER BY scored_at DESC LIMIT 50")
def filter_by_source_time(spark, sf_dir):
    return X.by_source_time(scores(spark, sf_dir), "live", _T0, 50)


@query(f"WITH {_SCORES_SQL} SELECT event_id, scored_at FROM scores WHERE scored_at >= {_T0} AND scored_at < {_T0 + DAY}")
def filter_by_date(spark, sf_dir):
    return X.by_date(scores(spark, sf_dir), "scored_at", "2024-01-11").select("event_id", "scored_at")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events ORDER BY day DESC LIMIT 30")
def available_dates(spark, sf_dir):
    return X.dates(scores(spark, sf_dir), "scored_at", 30)


POSITIONS_SQL = f"""{B}, positions AS (SELECT event_id AS id, entity_id, 'c' || (event_id % 4) AS config_id, CASE WHEN event_id % 10 = 0 THEN 'open' ELSE 'closed' END AS status,
 CASE event_id % 5 WHEN 0 THEN 'FULL' WHEN 1 THEN 'fast' WHEN 2 THEN NULL WHEN 3 THEN 'shadow' ELSE 'ml_override' END AS entry_type, (event_id % 7)::INT AS entry_buyer_number, ts AS entry_time, ts + qty * 10 AS exit_time, qty * 10 AS hold_seconds,
 CASE event_id % 6 WHEN 0 THEN 'hard_stop' WHEN 1 THEN 'timeout' WHEN 2 THEN 'take_profit' WHEN 3 THEN 'trailing_stop' WHEN 4 THEN 'pulse_dead' ELSE 'timeout' END AS exit_reason, amount - 50 AS pnl_pct, (amount - 50) / 1000 AS pnl, amount / 100 AS proba, reserve AS score FROM trades)"""


def positions(spark, sf_dir):
    """A position for every stream event."""
    t = stream_trades(spark, sf_dir)
    i = F.col("event_id")
    return t.select(
        i.alias("id"),
        "entity_id",
        F.concat(F.lit("c"), i % 4).alias("config_id"),
        F.when(i % 10 == 0, "open").otherwise("closed").alias("status"),
        F.when(i % 5 == 0, "FULL").when(i % 5 == 1, "fast").when(i % 5 == 3, "shadow").when(i % 5 == 4, "ml_override").alias("entry_type"),
        (i % 7).cast("int").alias("entry_buyer_number"),
        F.col("ts").alias("entry_time"),
        (F.col("ts") + F.col("qty") * 10).alias("exit_time"),
        (F.col("qty") * 10).alias("hold_seconds"),
        F.when(i % 6 == 0, "hard_stop").when(i % 6 == 2, "take_profit").when(i % 6 == 3, "trailing_stop").when(i % 6 == 4, "pulse_dead").otherwise("timeout").alias("exit_reason"),
        (F.col("amount") - 50).alias("pnl_pct"),
        ((F.col("amount") - 50) / 1000).alias("pnl"),
        (F.col("amount") / 100).alias("proba"),
        F.col("reserve").alias("score"),
    )


@query(f"WITH {POSITIONS_SQL} SELECT id, entry_type FROM positions WHERE (lower(coalesce(entry_type, '')) IN ('full', 'fast', 'ml_override') OR coalesce(entry_buyer_number, 0) > 0) AND entry_time >= {_T0}")
def real_position_filter(spark, sf_dir):
    return X.real_positions(positions(spark, sf_dir), ["full", "fast", "ml_override"], _T0).select("id", "entry_type")


@query(f"WITH {_SCORES_SQL} SELECT event_id FROM scores WHERE scored_at <= {_T0} - 660")
def label_maturity_filter(spark, sf_dir):
    return X.mature(scores(spark, sf_dir), _T0, 600.0, 60.0).select("event_id")


@query(f"WITH {A_TRADES} SELECT event_id, entity_id, CASE WHEN reserve > 0 THEN least(reserve / 85 * 100, 100) ELSE 0 END AS pct FROM trades")
def reserve_pct(spark, sf_dir):
    return ledger_trades(spark, sf_dir).select("event_id", "entity_id", M.reserve_pct(F.col("reserve")).alias("pct"))


@query(f"WITH {A} SELECT entity_id, name FROM tokens WHERE EXISTS (SELECT 1 FROM trades t WHERE t.entity_id = tokens.entity_id AND mcap >= 60)")
def exists_semi(spark, sf_dir):
    return X.reached(ledger_tokens(spark, sf_dir), ledger_trades(spark, sf_dir), 60.0).select("entity_id", "name")


@query(f"WITH {_SCORES_SQL} SELECT entity_id FROM tokens WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.entity_id = tokens.entity_id AND s.source = 'live' AND decision = 'BUY' AND s.scored_at < {_T0})")
def not_in_anti(spark, sf_dir):
    done = scores(spark, sf_dir).where((F.col("source") == "live") & (F.col("decision") == "BUY") & (F.col("scored_at") < _T0))
    return X.without(stream_tokens(spark, sf_dir), done, "entity_id").select("entity_id")


@query(f"WITH {POSITIONS_SQL} SELECT id, CASE lower(coalesce(entry_type, '')) WHEN 'fast' THEN 'FAST' WHEN 'full' THEN 'FULL' WHEN 'ml_override' THEN 'ML_OVERRIDE' ELSE '?' END AS path FROM positions")
def entry_path_label(spark, sf_dir):
    return positions(spark, sf_dir).select("id", X.entry_path(F.col("entry_type")).alias("path"))


@query("SELECT p_partkey, CASE WHEN length(f) > 12 THEN left(f, 11) || '…' ELSE f END AS reason FROM (SELECT p_partkey, trim(split_part(replace(p_name || ', ' || p_brand || ';' || p_type, ';', ','), ',', 1)) AS f FROM part)")
def first_reason(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.first_reason(F.concat("p_name", F.lit(", "), "p_brand", F.lit(";"), "p_type"), 12).alias("reason"))


@query(f"WITH {A_TRADES} SELECT DISTINCT entity_id FROM trades WHERE reserve = 0 AND entity_id % 3 = 0")
def zero_marker_keys(spark, sf_dir):
    wanted = ledger_tokens(spark, sf_dir).where("entity_id % 3 = 0").select("entity_id")
    return X.marked(ledger_trades(spark, sf_dir), wanted, "entity_id", F.col("reserve") == 0)


@query(f"""WITH {A}, f AS (SELECT entity_id, count(*) AS n, coalesce(sum(amount) FILTER (side = 'buy'), 0) AS v FROM trades JOIN tokens USING (entity_id) WHERE ts BETWEEN created_at AND created_at + {365 * DAY} GROUP BY entity_id)
SELECT entity_id FROM f WHERE n >= 5 AND v >= 100000""")
def min_activity_bar(spark, sf_dir):
    from .metrics import window

    return X.active(window(spark, sf_dir), 5, 100000.0)


# -- top-k and set operations ----------------------------------------------------------------------------------------

_RUNS_SQL = f"{POSITIONS_SQL}, runs AS (SELECT config_id || '-' || exit_reason AS run_id, count(*) AS n, sum(pnl) AS pnl FROM positions WHERE status = 'closed' GROUP BY 1)"


@query(f"WITH {_RUNS_SQL} SELECT run_id, n, round(pnl, 6) AS pnl FROM runs WHERE n >= 20 ORDER BY round(pnl, 6) DESC, run_id LIMIT 10")
def topk_runs(spark, sf_dir):
    runs = positions(spark, sf_dir).where("status = 'closed'").groupBy(F.concat_ws("-", "config_id", "exit_reason").alias("run_id")).agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 6).alias("pnl"))
    return runs.where("n >= 20").orderBy(F.desc("pnl"), "run_id").limit(10)


@query(f"WITH {POSITIONS_SQL} (SELECT 'winner' AS side, id, pnl_pct FROM positions ORDER BY pnl_pct DESC, id LIMIT 5) UNION ALL (SELECT 'loser', id, pnl_pct FROM positions ORDER BY pnl_pct, id LIMIT 5)")
def winners_losers(spark, sf_dir):
    return X.winners_losers(positions(spark, sf_dir), 5)


@query(
    f"""WITH {POSITIONS_SQL}, r AS (SELECT id, pnl_pct > 0 AS win, row_number() OVER (ORDER BY proba DESC, id) AS a, row_number() OVER (ORDER BY score DESC, id) AS b FROM positions)
SELECT n, count(*) FILTER (win AND a <= n) AS wins_a, count(*) FILTER (win AND b <= n) AS wins_b, count(*) FILTER (a <= n AND b <= n) AS overlap FROM r, (VALUES (50), (100), (500), (1500)) v(n) GROUP BY n"""
)
def topn_model_overlap(spark, sf_dir):
    return X.topn_overlap(positions(spark, sf_dir).withColumn("win", F.col("pnl_pct") > 0), "proba", "score", "id", [50, 100, 500, 1500])


@query(f"WITH {POSITIONS_SQL} SELECT entity_id, id, entry_time FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY entry_time DESC, id DESC) AS q FROM positions WHERE status = 'open') WHERE q = 1")
def latest_per_key(spark, sf_dir):
    return S.latest_per_key(positions(spark, sf_dir).where("status = 'open'"), ["entity_id"], ["entry_time", "id"]).select("entity_id", "id", "entry_time")


@query()
def random_sample(spark, sf_dir):
    return X.random_sample(ledger_tokens(spark, sf_dir), "entity_id", 200, seed=7)


@query(f"WITH {_SCORES_SQL} SELECT entity_id FROM scores WHERE source = 'live' AND decision = 'BUY' INTERSECT SELECT entity_id FROM scores WHERE source = 'backfill'")
def common_keys(spark, sf_dir):
    s = scores(spark, sf_dir)
    return U.common_keys(s.where("source = 'live' and decision = 'BUY'"), s.where("source = 'backfill'"), "entity_id")


@query(f"""WITH {B_TRADES}, o AS (SELECT DISTINCT actor_id FROM trades WHERE event_id % 3 = 0), n AS (SELECT DISTINCT actor_id FROM trades WHERE event_id % 3 = 1)
SELECT coalesce(o.actor_id, n.actor_id) AS actor_id, CASE WHEN n.actor_id IS NULL THEN 'only_old' WHEN o.actor_id IS NULL THEN 'only_new' ELSE 'shared' END AS part FROM o FULL JOIN n ON o.actor_id = n.actor_id""")
def feature_set_diff(spark, sf_dir):
    t = stream_trades(spark, sf_dir)
    return U.set_diff(t.where("event_id % 3 = 0"), t.where("event_id % 3 = 1"), "actor_id")


@query(
    f"""WITH {A_TRADES}, u AS (SELECT *, 'live' AS src FROM trades WHERE event_id % 3 <> 0 UNION ALL SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 0 ELSE mcap END AS mcap), 'backfill' FROM trades WHERE event_id % 2 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY entity_id, side, actor_id, round(amount, 9), round(qty, 3), floor(ts) ORDER BY (mcap > 0) DESC, ts, event_id, src DESC) AS q FROM u) SELECT entity_id, event_id, src, mcap FROM d WHERE q = 1"""
)
def dedupe_sources(spark, sf_dir):
    t = ledger_trades(spark, sf_dir)
    live = t.where("event_id % 3 <> 0").withColumn("src", F.lit("live"))
    back = t.where("event_id % 2 = 0").withColumn("mcap", F.lit(0.0)).withColumn("src", F.lit("backfill"))
    return U.dedupe_sources(live, back).select("entity_id", "event_id", "src", "mcap")


@query(f"""WITH {A_TRADES}, k AS (SELECT DISTINCT floor(ts) AS t, actor_id, side, round(amount, 6) AS a FROM trades WHERE event_id % 2 = 0)
SELECT event_id, entity_id FROM trades x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.t = floor(x.ts) AND k.actor_id = x.actor_id AND k.side = x.side AND k.a = round(x.amount, 6))""")
def existing_key_filter(spark, sf_dir):
    t = ledger_trades(spark, sf_dir)
    return U.new_only(t, t.where("event_id % 2 = 0")).select("event_id", "entity_id")


_TWO_SQL = f"{B_TRADES}, l AS (SELECT entity_id, count(*) AS n, max(side) AS side, floor(sum(amount))::BIGINT AS v FROM trades GROUP BY entity_id), p AS (SELECT entity_id, count(*) AS n, CASE WHEN entity_id % 4 = 0 THEN NULL ELSE max(side) END AS side, floor(sum(amount))::BIGINT + CASE WHEN entity_id % 5 = 0 THEN 1 ELSE 0 END AS v FROM trades GROUP BY entity_id)"


def _two(spark, sf_dir):
    g = stream_trades(spark, sf_dir).groupBy("entity_id").agg(F.count("*").alias("n"), F.max("side").alias("side"), F.floor(F.sum("amount")).alias("v"))
    k = F.col("entity_id")
    return g, g.select("entity_id", "n", F.when(k % 4 != 0, F.col("side")).alias("side"), (F.col("v") + (k % 5 == 0).cast("long")).alias("v"))


@query(f"""WITH {_TWO_SQL} SELECT entity_id, 'side' AS field, l.side AS a, p.side AS b FROM l JOIN p USING (entity_id) WHERE l.side IS DISTINCT FROM p.side
UNION ALL SELECT entity_id, 'v', l.v::VARCHAR, p.v::VARCHAR FROM l JOIN p USING (entity_id) WHERE l.v IS DISTINCT FROM p.v UNION ALL SELECT entity_id, 'n', l.n::VARCHAR, p.n::VARCHAR FROM l JOIN p USING (entity_id) WHERE l.n IS DISTINCT FROM p.n""")
def cell_mismatch(spark, sf_dir):
    return U.cell_mismatch(*_two(spark, sf_dir), "entity_id")


@query(f"WITH {_TWO_SQL} SELECT count(*) AS n_keys, avg((l.n IS NOT DISTINCT FROM p.n)::INT) AS n_rate, avg((l.side IS NOT DISTINCT FROM p.side)::INT) AS side_rate, avg((l.v IS NOT DISTINCT FROM p.v)::INT) AS v_rate FROM l JOIN p USING (entity_id)")
def match_rates(spark, sf_dir):
    return U.match_rates(*_two(spark, sf_dir), "entity_id", ["n", "side", "v"])
