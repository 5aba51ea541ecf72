"""The registry of queries and the bars in DuckDB SQL that their oracles start from."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_KEY = "l_orderkey, l_linenumber, l_extendedprice, l_quantity"
#: Daily and hourly bars as common table expressions named d and h.
D = f"""d AS (SELECT symbol, ts, first(p ORDER BY {_KEY}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {_KEY}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""
H = """h AS (SELECT event_type AS symbol, date_trunc('hour', e.ts) AS ts, first(value ORDER BY e.ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY e.ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events e GROUP BY 1, 2)"""
WD, WH = f"WITH {D}", f"WITH {H}"
OV = "OVER (PARTITION BY symbol ORDER BY ts)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def fore(a: int, b: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


T = "epoch(ts)::BIGINT AS ts_s"


def r(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}"


def query(name: str, sql: str | None = None):
    def keep(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(f)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = shipped
        if sql:
            SQL[name] = sql
        return f

    return keep
