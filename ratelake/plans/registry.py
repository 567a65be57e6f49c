"""Where named queries and their SQL are kept, and the SQL parts they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BARS = """bars AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS bar_date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)"""
SERIES = "(PARTITION BY symbol ORDER BY bar_date)"
TRADES = "trades AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate::DATE AS day, round(l_extendedprice * (0.05 - l_discount), 4) AS pnl FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def prior(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def trailing(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def r(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)
