"""Queries on how sure trade statistics are: resampled intervals, deflated ratios, overfitted paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.operators import resampling as R
from ratelake.plans.policy import purged_folds
from ratelake.plans.registry import ORACLE_SQL, TRADES, query, r
from ratelake.sources.bars import table

DRAWS, SEED, TRIALS = 200, 42, 18
M = 4294967295


def _mixed(x: str, name: str) -> str:
    """Columns that end in the finalizer's value of a number below 2**32."""
    a, b = R.MIX
    return f"xor({x}, ({x}) >> 16) * {a} & {M} AS {name}_1, xor({name}_1, {name}_1 >> 13) * {b} & {M} AS {name}_2, xor({name}_2, {name}_2 >> 16) AS {name}"


def _trades(spark, root):
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * (0.05 - F.col("l_discount")), 4).alias("pnl"))


SQL_RATIO = "CASE WHEN n > 0 AND q / n - (s / n) ** 2 > 0 THEN s / n / sqrt(q / n - (s / n) ** 2) * sqrt(252.0) END"


@query(f"""
WITH {TRADES}, h AS (
  SELECT l_returnflag, l_linestatus, pnl, (l_orderkey * 8 + l_linenumber)::UBIGINT AS id, id >> 32 AS top, {_mixed("top", "t")}, xor(id & {M}, t) AS folded, {_mixed("folded", "h")} FROM trades
), d AS (
  SELECT l_returnflag, l_linestatus, pnl, draw, (draw * {R.STEP} + {SEED})::UBIGINT & {M} AS k, xor(h, k) AS keyed, {_mixed("keyed", "u")}, u >> 16 AS v,
    CASE WHEN draw = 0 THEN 1 ELSE {" + ".join(f"(v >= {t})::INT" for t in R.THRESHOLDS)} END AS times
  FROM h, range({DRAWS + 1}) t(draw)
), s AS (
  SELECT l_returnflag, l_linestatus, draw, sum(times) AS n, sum(times * pnl) AS s, sum(times * pnl * pnl) AS q FROM d GROUP BY 1, 2, 3
), v AS (
  SELECT *, {SQL_RATIO} AS ratio FROM s
)
SELECT l_returnflag, l_linestatus, round(max(ratio) FILTER (draw = 0), 4) AS value, round(quantile_cont(ratio, 0.025) FILTER (draw > 0), 4) AS low, round(quantile_cont(ratio, 0.975) FILTER (draw > 0), 4) AS high FROM v GROUP BY 1, 2
""")
def sharpe_intervals(spark, root):
    """Yearly Sharpe ratios of trades by flag and status, with the interval that resampled trades give."""
    pnl, n, s, q = F.col("pnl"), F.col("n"), F.col("s"), F.col("q")
    spread = q / n - (s / n) ** 2
    ratio = F.when((n > 0) & (spread > 0), s / n / F.sqrt(spread) * (252**0.5))
    x = R.bootstrap(_trades(spark, root), ["l_returnflag", "l_linestatus"], F.col("l_orderkey") * 8 + F.col("l_linenumber"), {"n": F.lit(1), "s": pnl, "q": pnl * pnl}, ratio, DRAWS, seed=SEED)
    return x.select("l_returnflag", "l_linestatus", *(r(F.col(c), c, 4) for c in ("value", "low", "high")))


@query(f"""
WITH p AS ({ORACLE_SQL[purged_folds.__name__]}), k AS (
  SELECT * FROM p WHERE train_sharpe IS NOT NULL AND test_sharpe IS NOT NULL
), g AS (
  SELECT *, (rank() OVER (PARTITION BY l_returnflag ORDER BY train_sharpe) + (count(*) OVER (PARTITION BY l_returnflag, train_sharpe) - 1) / 2) / count(*) OVER (PARTITION BY l_returnflag) AS a,
    (rank() OVER (PARTITION BY l_returnflag ORDER BY test_sharpe) + (count(*) OVER (PARTITION BY l_returnflag, test_sharpe) - 1) / 2) / count(*) OVER (PARTITION BY l_returnflag) AS b FROM k
)
SELECT l_returnflag, count(*) AS paths, count(*) FILTER (a >= 0.5) AS judged, round(CASE WHEN count(*) >= 2 AND judged > 0 THEN count(*) FILTER (a >= 0.5 AND b < 0.5) / judged END, 6) AS share FROM g GROUP BY 1
""")
def overfit_paths(spark, root):
    """Of the cross-validation paths that look good in sample, the share that is poor out of it."""
    x = R.overfit_share(purged_folds(spark, root), ["l_returnflag"], "train_sharpe", "test_sharpe")
    return x.select("l_returnflag", "paths", "judged", r(F.col("share"), "share"))


@query()
def deflated_ratios(spark, root):
    """Chance that the trades of a flag and status have a ratio beyond what the best of as many setups as there are would show by luck."""
    g = _trades(spark, root).groupBy("l_returnflag", "l_linestatus").agg(F.count("pnl").alias("n"), F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("sd"), F.skewness("pnl").alias("skew"), (F.kurtosis("pnl") + 3).alias("kurt"))
    g = g.withColumn("ratio", F.try_divide("m", "sd"))
    chance = R.deflated_sharpe(F.col("ratio"), F.col("skew"), F.col("kurt"), F.col("n"), TRIALS)
    return g.select("l_returnflag", "l_linestatus", "n", r(F.col("ratio"), "ratio"), r(chance, "chance"))
