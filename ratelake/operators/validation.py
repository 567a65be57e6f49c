"""Folds of time, their training days after purge and embargo, and what each choice of test folds earns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions.series import safe_ratio


def purged_paths(trades: DataFrame, key: str, folds: int = 6, purge: int = 84, embargo: int = 7) -> DataFrame:
    """Per key and pair of test folds: trades and yearly Sharpe ratios in and out of sample, and whether a path above the median in sample is below it out of sample.

    ``trades`` has key, day and pnl. Folds are equal numbers of days, so trades are summed by day first and all else is
    bounded by the days. A training day is none within ``purge`` calendar days of a test fold, or ``embargo`` more behind it.
    Null days and values are left out; a ratio without deviation is null.
    """
    known = trades.where("day is not null and pnl is not null")
    days = known.groupBy(key, "day").agg(F.count("*").alias("n"), F.sum("pnl").alias("s"), F.sum(F.col("pnl") * F.col("pnl")).alias("q"))
    days = days.withColumn("fold", F.ntile(folds).over(W.partitionBy(key).orderBy("day")))
    ends = days.groupBy(key, "fold").agg(F.date_sub(F.min("day"), purge).alias("lo"), F.date_add(F.max("day"), purge + embargo).alias("hi"))
    one, other = (ends.withColumnsRenamed({"fold": f, "lo": f"{f}_lo", "hi": f"{f}_hi"}) for f in ("first", "second"))
    paths = one.join(other, key).where("first < second")
    x = days.join(paths, key)
    x = x.withColumn("part", F.expr("case when fold in (first, second) then 'test' when day between first_lo and first_hi or day between second_lo and second_hi then null else 'train' end"))
    sums = [F.sum(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("test", "train") for c in ("n", "s", "q")]
    g = x.groupBy(key, "first", "second").agg(*sums)
    for p in ("test", "train"):
        mean = safe_ratio(F.col(f"{p}_s"), F.col(f"{p}_n"))
        spread = F.sqrt(F.greatest(F.col(f"{p}_q") / F.col(f"{p}_n") - mean * mean, F.lit(0.0)))
        g = g.withColumn(f"{p}_sharpe", safe_ratio(mean, spread) * math.sqrt(252))
    middle = lambda c: F.median(c).over(W.partitionBy(key))
    overfit = (F.col("train_sharpe") > middle("train_sharpe")) & (F.col("test_sharpe") < middle("test_sharpe"))
    return g.select(key, "first", "second", F.col("test_n").alias("test_trades"), F.coalesce("train_n", F.lit(0)).alias("train_trades"), "test_sharpe", "train_sharpe", overfit.alias("overfit"))
