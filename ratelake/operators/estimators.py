"""Estimators that are aggregates: regression slopes, half-lives, variance ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions.series import ordered, safe_ratio


def half_life(bars: DataFrame, x: str = "close") -> DataFrame:
    """Per symbol: n, the slope of x on its prior value, and the half-life -ln 2 / ln slope where the slope lies in (0, 1)."""
    lagged = bars.select("symbol", F.col(x).alias("y"), F.lag(x).over(ordered()).alias("x")).where("x is not null")
    fit = lagged.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"))
    return fit.withColumn("half_life", F.when((F.col("slope") > 0) & (F.col("slope") < 1), -F.log(F.lit(2.0)) / F.log("slope")))


def variance_ratio(bars: DataFrame, q: int, x: str = "close") -> DataFrame:
    """Per symbol: variance of overlapping q-step changes over q times that of one-step changes."""
    w = ordered()
    d = bars.select("symbol", (F.col(x) - F.lag(x).over(w)).alias("d1"), (F.col(x) - F.lag(x, q).over(w)).alias("dq"))
    return d.groupBy("symbol").agg(F.count("d1").alias("n"), safe_ratio(F.var_samp("dq"), q * F.var_samp("d1")).alias("ratio"))


def weighted_regression(x: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: slope and R squared of y on x with weights w, from sums in one pass."""
    s = x.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(e).alias(a) for a, e in {"sw": F.col("w"), "sx": F.col("w") * F.col("x"), "sy": F.col("w") * F.col("y"), "sxx": F.col("w") * F.col("x") * F.col("x"), "sxy": F.col("w") * F.col("x") * F.col("y"), "syy": F.col("w") * F.col("y") * F.col("y")}.items()))
    xx, yy, xy = (F.col(f"s{a}{b}") - F.try_divide(F.col(f"s{a}") * F.col(f"s{b}"), F.col("sw")) for a, b in ("xx", "yy", "xy"))
    return s.select(*keys, "n", safe_ratio(xy, xx).alias("slope"), safe_ratio(xy * xy, xx * yy).alias("r_squared"))


def false_discoveries(tests: DataFrame, p: str, tie: str, alpha: float) -> DataFrame:
    """Benjamini-Hochberg: place by p, and whether it is not behind the last place i of n with p <= alpha * i / n.

    One row per test: few, whatever lies below them.
    """
    x = tests.withColumns({"place": F.row_number().over(W.partitionBy().orderBy(p, tie)), "_n": F.count("*").over(W.partitionBy())})
    last = F.max(F.when(F.col(p) <= alpha * F.col("place") / F.col("_n"), F.col("place"))).over(W.partitionBy())
    return x.withColumn("below", F.col("place") <= F.coalesce(last, F.lit(0))).drop("_n")


def lagged_fit(bars: DataFrame, n: int, least: int, x: str = "close") -> DataFrame:
    """Per symbol, over its last n rows before the latest: fit of x on its prior value and what follows from it for an Ornstein-Uhlenbeck process.

    Null below ``least`` pairs; kappa is 0 and the half-life null where the slope is not within (0, 1).
    """
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_date")))
    recent = bars.withColumn("_back", back).where((F.col("_back") > 1) & (F.col("_back") <= n + 1))
    pairs = recent.select("symbol", F.col(x).alias("y"), F.lag(x).over(ordered()).alias("x")).where("x is not null")
    fit = pairs.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("level"), F.regr_syy("y", "x").alias("syy"), F.regr_sxx("y", "x").alias("sxx")).where(F.col("n") >= least)
    b = F.col("slope")
    fit = fit.withColumn("inside", (b > 0) & (b < 1))
    kappa = F.when(F.col("inside"), -F.log("slope")).otherwise(0.0)
    left = F.greatest(F.col("syy") - b * b * F.col("sxx"), F.lit(0.0))
    return fit.select("symbol", "n", "slope", kappa.alias("kappa"), F.when(F.col("inside"), F.log(F.lit(2.0)) / -F.log("slope")).alias("half_life"), safe_ratio(F.col("level"), 1 - b).alias("mean"), F.sqrt(left / (F.col("n") - 2)).alias("sigma"), safe_ratio(b - 1, F.sqrt(F.try_divide(left, (F.col("n") - 2) * F.col("sxx")))).alias("t_unit_root"))


def variance_ratio_test(bars: DataFrame, n: int, q: int, least: int, x: str = "close") -> DataFrame:
    """Per symbol, over its last n rows: variance ratio of overlapping q-step changes, its z without heteroskedasticity, and whether |z| is beyond 1.96."""
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_date")))
    w = ordered()
    recent = bars.withColumn("_back", back).where(F.col("_back") <= n)
    d = recent.select("symbol", (F.col(x) - F.lag(x).over(w)).alias("d1"), (F.col(x) - F.lag(x, q).over(w)).alias("dq"))
    s = d.groupBy("symbol").agg(F.count("d1").alias("n"), F.avg("d1").alias("m"), F.sum(F.col("d1") * F.col("d1")).alias("s1"), F.sum(F.pow(F.col("dq"), 2)).alias("s2"), F.sum("dq").alias("sq"), F.count("dq").alias("k"))
    s = s.where(F.col("n") >= least)
    one = (F.col("s1") - F.col("n") * F.col("m") * F.col("m")) / (F.col("n") - 1)
    many = (F.col("s2") - 2 * q * F.col("m") * F.col("sq") + F.col("k") * (q * F.col("m")) ** 2) / (q * (F.col("n") - q + 1) * (1 - q / F.col("n")))
    s = s.withColumn("ratio", safe_ratio(many, one))
    z = (F.col("ratio") - 1) / F.sqrt(2 * (2 * q - 1) * (q - 1) / (3 * q * F.col("n")))
    return s.select("symbol", "n", "ratio", z.alias("z"), (F.abs(z) > 1.96).alias("reject"))


def robust_fit(x: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: slope of y on x with its error, t and R squared, share of rows whose sign the slope gives, and the score of the three."""
    fit = x.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r_squared"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.stddev_pop("y").alias("sy"), F.stddev_pop("x").alias("sx"), F.avg((F.signum("x") == F.signum("y")).cast("int")).alias("alike"), F.avg((F.signum("x") == -F.signum("y")).cast("int")).alias("unlike"))
    left = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0)) / (F.col("n") - 2)
    fit = fit.where("n > 2 and sxx > 0").withColumn("error", F.sqrt(left / F.col("sxx")))
    hit = F.when(F.col("slope") >= 0, F.col("alike")).otherwise(F.col("unlike"))
    beta = F.least(F.lit(1.0), F.abs(F.col("slope") * safe_ratio(F.col("sx"), F.col("sy"))))
    return fit.select(*keys, "n", "slope", "error", safe_ratio(F.col("slope"), F.col("error")).alias("t"), "r_squared", hit.alias("hit_rate"), (0.4 * beta + 0.3 * F.col("r_squared") + 0.3 * hit).alias("score"))
