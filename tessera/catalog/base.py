"""What the named queries share: registration, panels as SQL, one way of rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    """Six decimals, the same way as ``q6`` does it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 1e6) / 1e6 + 0.0


def q6(x: str) -> str:
    return f"(round_even(({x}) * 1e6, 0) / 1e6 + 0.0)"


#: The monthly supplier panel (``raw``), its calendar (``cal``) and the dense panel (``p``).
PANEL_M = """
li AS (SELECT lpad(l_suppkey::VARCHAR, 8, '0') AS asset_id, date_trunc('month', l_shipdate)::TIMESTAMP AS datetime, l_extendedprice / l_quantity AS px, l_quantity AS qty, l_extendedprice AS amt,
       {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_extendedprice, 'f': l_quantity} AS o FROM lineitem),
raw AS (SELECT asset_id, datetime, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, sum(qty) AS volume, sum(amt) AS amount FROM li GROUP BY ALL),
cal AS (SELECT datetime, (row_number() OVER (ORDER BY datetime) - 1)::INTEGER AS t_idx FROM (SELECT DISTINCT datetime FROM raw)),
p AS (SELECT a.asset_id, c.datetime, c.t_idx, r.open, r.high, r.low, r.close, r.volume, r.amount
      FROM (SELECT DISTINCT asset_id FROM raw) a CROSS JOIN cal c LEFT JOIN raw r ON r.asset_id = a.asset_id AND r.datetime = c.datetime)"""

#: The same from the daily user panel.
PANEL_E = """
raw AS (SELECT lpad(user_id::VARCHAR, 8, '0') AS asset_id, date_trunc('day', ts)::TIMESTAMP AS datetime, arg_min(value, {'a': ts, 'b': event_id}) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, {'a': ts, 'b': event_id}) AS close, count(value)::DOUBLE AS volume, sum(value) AS amount FROM events GROUP BY ALL),
cal AS (SELECT datetime, (row_number() OVER (ORDER BY datetime) - 1)::INTEGER AS t_idx FROM (SELECT DISTINCT datetime FROM raw)),
p AS (SELECT a.asset_id, c.datetime, c.t_idx, r.open, r.high, r.low, r.close, r.volume, r.amount
      FROM (SELECT DISTINCT asset_id FROM raw) a CROSS JOIN cal c LEFT JOIN raw r ON r.asset_id = a.asset_id AND r.datetime = c.datetime)"""
