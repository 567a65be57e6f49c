"""Bars (symbol, bar_date or bar_time, open, high, low, close, volume) from event and order facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ohlcv(facts: DataFrame, keys: list[Column], value: str, order: Column) -> DataFrame:
    """One bar per key in a single aggregation: first and last value by ``order``, extremes and the number of facts."""
    return facts.groupBy(*keys).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("volume"))


def order_bars(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars of order prices by priority."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    return ohlcv(orders, [F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("bar_date")], "o_totalprice", F.col("o_orderkey"))


def event_bars(spark: SparkSession, root: str, unit: str = "hour") -> DataFrame:
    """Bars of event values by type and hour or day."""
    events = table(spark, root, "events").select("event_id", "event_type", "ts", "value")
    return ohlcv(events, [F.col("event_type").alias("symbol"), F.date_trunc(unit, "ts").alias("bar_time")], "value", F.struct("ts", "event_id"))
