"""Bootstrap intervals, Sharpe ratios deflated by the number of trials, and the share of overfitted paths.

A draw gives every row a Poisson(1) count that follows from a hash of the row's id and the draw alone. So a draw is one
aggregation like any other: tasks add up counts times values as matrix products over blocks of rows, a row for each key and draw
leaves a task, and results do not depend on how rows are partitioned or on a task that runs twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The multipliers of a finalizer of 32 bits, the step between draws, Euler's constant.
MIX, STEP, EULER = (0x85EBCA6B, 0xC2B2AE35), 0x9E3779B9, 0.5772156649
#: The least of 65,536 equally likely numbers at which the count is 1, 2 and so on.
THRESHOLDS = [round(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
#: Rows of a block and keys that a task holds before it lets their sums go.
BLOCK, HELD = 2048, 256


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(MIX[0])
    h ^= h >> np.uint32(13)
    h *= np.uint32(MIX[1])
    return h ^ (h >> np.uint32(16))


def poisson_counts(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Counts of rows (down) in draws (across). Draw 0 is the sample itself: every count is 1."""
    table = np.searchsorted(THRESHOLDS, np.arange(65536), side="right").astype(np.float64)
    ids = ids.astype(np.int64).view(np.uint64)
    rows = _mix((ids & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ _mix((ids >> np.uint64(32)).astype(np.uint32)))
    keys = (np.arange(draws + 1, dtype=np.uint64) * np.uint64(STEP) + np.uint64(seed)).astype(np.uint32)
    out = table[_mix(rows[:, None] ^ keys[None, :]) >> np.uint32(16)]
    out[:, 0] = 1.0
    return out


def resampled_sums(rows: DataFrame, by: list[str], row_id: Column, parts: dict[str, Column], draws: int, seed: int) -> DataFrame:
    """by, draw (0: the sample itself) and, for each part, its sum over the rows weighed with their counts."""
    names = list(parts)
    used = rows.select(*by, row_id.cast("long").alias("_id"), *(c.cast("double").alias(k) for k, c in parts.items())).dropna(subset=["_id", *names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def told() -> Iterator[pd.DataFrame]:
            for key, sums in held.items():
                fixed = {c: [v] * (draws + 1) for c, v in zip(by, key)}
                yield pd.DataFrame(fixed | {"draw": np.arange(draws + 1)} | dict(zip(names, sums)))
            held.clear()

        for frame in frames:
            for key, part in frame.groupby(by, sort=False, dropna=False):
                key = tuple(None if pd.isna(v) else v for v in key)
                for at in range(0, len(part), BLOCK):
                    block = part.iloc[at : at + BLOCK]
                    sums = block[names].to_numpy(float).T @ poisson_counts(block["_id"].to_numpy(), draws, seed)
                    held[key] = held[key] + sums if key in held else sums
                if len(held) > HELD:
                    yield from told()
        yield from told()

    schema = T.StructType([*(used.schema[c] for c in by), T.StructField("draw", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    return used.mapInPandas(run, schema).groupBy(*by, "draw").agg(*(F.sum(c).alias(c) for c in names))


def bootstrap(rows: DataFrame, by: list[str], row_id: Column, parts: dict[str, Column], statistic: Column, draws: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by, value, low and high: a statistic of summed ``parts`` and the interval of its values over ``draws`` resamples.

    ``row_id`` (whole numbers) tells rows apart; rows that share one are drawn together, so an id of blocks gives a block
    bootstrap. Rows whose id or parts are null are left out; draws in which the statistic is null do not count.
    """
    sums = resampled_sums(rows, by, row_id, parts, draws, seed).withColumn("_v", statistic)
    drawn = F.when(F.col("draw") > 0, F.col("_v"))
    ends = F.percentile(drawn, [alpha / 2, 1 - alpha / 2])  # of ``draws`` values a key, however many its rows
    return sums.groupBy(*by).agg(F.max(F.when(F.col("draw") == 0, F.col("_v"))).alias("value"), ends.alias("_ends")).select(*by, "value", F.get("_ends", F.lit(0)).alias("low"), F.get("_ends", F.lit(1)).alias("high"))


def best_of_nothing(trials: int) -> float:
    """What the best of so many ratios of no skill is expected to be, in their deviations."""
    n = NormalDist()
    return (1 - EULER) * n.inv_cdf(1 - 1 / trials) + EULER * n.inv_cdf(1 - 1 / (trials * math.e))


def deflated_sharpe(ratio: Column, skewness: Column, kurtosis: Column, n: Column, trials: int) -> Column:
    """Chance that a ratio beats the best of ``trials`` without skill. Null for fewer than two trials or rows, or without a variance above 0.

    ``kurtosis`` is 3 for a normal sample.
    """
    if trials <= 1:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def normal(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2)))

    variance = F.when(n > 1, (1 - skewness * ratio + (kurtosis - 1) / 4 * ratio * ratio) / (n - 1))
    return normal(F.when(variance > 0, (ratio - best_of_nothing(trials)) / F.sqrt(variance)))


def overfit_share(paths: DataFrame, by: list[str], inside: str, outside: str) -> DataFrame:
    """by, paths, judged and share: of the paths in the upper half in sample, how many are in the lower half out of it.

    Halves are by mean rank over the number of known paths, as of ties; 0.5 itself is upper. Paths without both ratios are left out.
    Below two paths the share is null.
    """
    w = W.partitionBy(*by)
    known = paths.where(F.col(inside).isNotNull() & F.col(outside).isNotNull())
    place = lambda c: (F.rank().over(w.orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2) / F.count("*").over(w)
    x = known.withColumns({"_in": place(inside), "_out": place(outside)})
    upper = F.col("_in") >= 0.5
    judged = F.count_if(upper)
    share = F.when((F.count("*") >= 2) & (judged > 0), F.count_if(upper & (F.col("_out") < 0.5)) / judged)
    return x.groupBy(*by).agg(F.count("*").alias("paths"), judged.alias("judged"), share.alias("share"))
