"""Registering queries with their SQL, and the adapters as CTEs of that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_STATE = "amount / qty AS price, ((event_id * 37) % 101)::DOUBLE AS reserve, amount / qty / 30.0 AS mcap"
A_TRADES = f"""a0 AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_partkey AS entity_id, o_custkey AS actor_id, l_suppkey AS supplier_id,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_extendedprice AS amount, l_quantity AS qty, epoch(l_shipdate) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
trades AS (SELECT *, {_STATE} FROM a0)"""
A_TOKENS = """tk0 AS (SELECT entity_id, min(ts) AS created_at, arg_min(supplier_id, ts * 1e9 + event_id) AS creator_id FROM
  (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS q FROM trades) WHERE q = 1 GROUP BY entity_id),
tokens AS (SELECT entity_id, entity_id AS insert_order, p_name AS name, p_brand AS symbol, created_at, creator_id FROM tk0 JOIN part ON p_partkey = entity_id)"""
A = f"{A_TRADES},\n{A_TOKENS}"
B_TRADES = f"""b0 AS (SELECT event_id, (props->>'$.k')::BIGINT AS entity_id, user_id AS actor_id,
  CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'buy' ELSE 'sell' END AS side, value AS amount, (1 + event_id % 7)::DOUBLE AS qty, epoch(ts) AS ts FROM events),
trades AS (SELECT *, {_STATE} FROM b0)"""
B_TOKENS = "tokens AS (SELECT entity_id, min(ts) AS created_at, arg_min(actor_id, ts) AS creator_id, entity_id AS insert_order FROM trades GROUP BY entity_id)"
B = f"{B_TRADES},\n{B_TOKENS}"


def query(sql: str | None = None, name: str | None = None, rounded: tuple[str, ...] = (), digits: int = 6):
    """Register a function (spark, sf_dir) -> DataFrame, with SQL for the same rows.

    rounded: columns whose last bits depend on the order of additions; both sides round them.
    """

    def of(f):
        key = name or f.__name__
        QUERIES[key] = f
        if rounded:
            QUERIES[key] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.round(c, digits) for c in rounded})
        if sql is not None:
            SQL[key] = sql if not rounded else f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in rounded)}) FROM ({sql})"
        return f

    return of
