"""Tests of a series' last rows for mean reversion: unit root, level stationarity, rescaled range, and the verdict of all.

Each symbol's window has n rows; everything is sums over windows and groups, so no group is held in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions.series import safe_ratio


def recent(bars: DataFrame, n: int) -> DataFrame:
    """(symbol, i, y, d): the n rows before the latest, numbered from 1, with their changes."""
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_date")))
    x = bars.select("symbol", "bar_date", F.col("close").alias("y"), back.alias("back")).where(f"back between 2 and {n + 1}")
    w = W.partitionBy("symbol").orderBy("bar_date")
    return x.select("symbol", F.row_number().over(w).alias("i"), "y", (F.col("y") - F.lag("y").over(w)).alias("d"))


def unit_root(x: DataFrame) -> DataFrame:
    """(symbol, adf_t, adf_reject): t of the level in a regression of changes on level, last change and a constant; rejected below -2.86."""
    w = W.partitionBy("symbol").orderBy("i")
    p = x.select("symbol", F.col("d").alias("z"), F.lag("y").over(w).alias("u"), F.lag("d").over(w).alias("v")).dropna()
    s = p.groupBy("symbol").agg(F.count("*").alias("n"), *(F.covar_pop(a, b).alias(a + b) for a, b in ("uu", "uv", "vv", "uz", "vz", "zz")))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    g = safe_ratio(F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv"), det)
    h = safe_ratio(F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv"), det)
    left = F.col("n") * (F.col("zz") - g * F.col("uz") - h * F.col("vz")) / (F.col("n") - 3)
    t = g / F.sqrt(left * F.col("vv") / (F.col("n") * det))
    return s.where("n > 10").select("symbol", t.alias("adf_t"), (t < -2.86).alias("adf_reject"))


def level_stationarity(x: DataFrame, lags: int = 10) -> DataFrame:
    """(symbol, kpss, kpss_reject): partial sums of the distances from the mean against their long-run variance; rejected above 0.463."""
    all_, w = W.partitionBy("symbol"), W.partitionBy("symbol").orderBy("i")
    e = x.select("symbol", "i", (F.col("y") - F.avg("y").over(all_)).alias("e"))
    e = e.select("symbol", "e", F.sum("e").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("sum"), *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)))
    tail = sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)) for k in range(1, lags + 1)), F.sum(F.col("e") * F.col("e")))
    s = e.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("sum") * F.col("sum")).alias("path"), tail.alias("variance"))
    stat = safe_ratio(F.col("path") / F.col("n"), F.col("variance"))
    return s.select("symbol", stat.alias("kpss"), (stat > 0.463).alias("kpss_reject"))


def rescaled_range(x: DataFrame, least: int = 8, sizes: int = 8) -> DataFrame:
    """(symbol, hurst): slope of the log of the mean rescaled range on the log of the chunk size, over sizes from ``least`` to half the changes, within 0 and 1."""
    w = W.partitionBy("symbol").orderBy("i")
    d = x.where("d is not null").select("symbol", "d", (F.row_number().over(w) - 1).alias("j"), F.count("*").over(W.partitionBy("symbol")).alias("n"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(sizes - 1)), lambda k: F.round(F.exp(F.log(F.lit(float(least))) + k / (sizes - 1) * (F.log(F.greatest(F.floor(F.col("n") / 2), F.lit(least))) - F.log(F.lit(float(least)))))).cast("int"))
    c = d.withColumn("size", F.explode(F.array_distinct(steps))).withColumn("chunk", F.floor(F.col("j") / F.col("size"))).where("(chunk + 1) * size <= n")
    chunk = W.partitionBy("symbol", "size", "chunk")
    c = c.withColumn("e", F.col("d") - F.avg("d").over(chunk)).withColumn("path", F.sum("e").over(chunk.orderBy("j").rowsBetween(W.unboundedPreceding, 0)))
    r = c.groupBy("symbol", "size", "chunk").agg((F.max("path") - F.min("path")).alias("r"), F.stddev_pop("d").alias("s")).where("s > 0")
    m = r.groupBy("symbol", "size").agg(F.log(F.avg(F.col("r") / F.col("s"))).alias("y"))
    g = m.groupBy("symbol").agg(F.count("*").alias("k"), F.regr_slope("y", F.log("size")).alias("slope")).where("k >= 4")
    return g.select("symbol", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "slope")).alias("hurst"))


def verdict(adf: str, kpss: str, ratio: str, least: float = 0.05):
    """clean, random_walk, drift, non_stationary or inconclusive, in this order."""
    away = F.abs(F.col(ratio) - 1)
    clean = F.col(adf) & ~F.col(kpss) & (away > least)
    return F.when(clean, "clean").when(away <= least, "random_walk").when(F.col(adf) & F.col(kpss), "drift").when(~F.col(adf), "non_stationary").otherwise("inconclusive")
