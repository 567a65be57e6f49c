"""Least squares on several regressors per series, with errors that allow for autocorrelation.

Both the cross products and the lagged products of regressors times residuals are sums that Spark adds up; a series' row
then holds k * k of them, which numpy solves. The lags are a window over the series in order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Lags of the errors, rows that a series needs, fires below which a dummy is flagged.
LAGS, LEAST_ROWS, FEW = 5, 30, 30


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k) for b in range(a, k)]


def _square(values: list[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for v, (a, b) in zip(values, _pairs(k)):
        out[a, b] = out[b, a] = v
    return out


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _plus(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda u, v: u + weight * v)


def design(rows: DataFrame, by: list[str], at: str, y: str, regressors: list[str]) -> DataFrame:
    """by, at, y and x: 1 and the regressors. Rows that lack any are left out."""
    used = rows.dropna(subset=[at, y, *regressors])
    return used.select(*by, at, F.col(y).cast("double").alias("y"), F.array(F.lit(1.0), *(F.col(c).cast("double") for c in regressors)).alias("x"))


def hac_fit(d: DataFrame, by: list[str], at: str, k: int, lags: int = LAGS, least: int = LEAST_ROWS) -> DataFrame:
    """by, n, fires (sums of x), beta, error, p (two-sided, normal) and r_squared of each series of a design with at least ``least`` rows.

    Errors weigh the products of residuals h rows apart by 1 - h / (lags + 1). A regressor that is always 0 is left out: its beta, error and p are null.
    """

    @F.pandas_udf("beta array<double>, inverse array<double>")
    def solved(xx: pd.Series, xy: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(xx, xy):
            inverse = np.linalg.pinv(_square(a, k))
            out.append((inverse @ np.asarray(b, float), inverse.ravel()))
        return pd.DataFrame([(b.tolist(), i.tolist()) for b, i in out], columns=["beta", "inverse"])

    @F.pandas_udf("error array<double>, p array<double>")
    def judged(beta: pd.Series, inverse: pd.Series, omega: pd.Series) -> pd.DataFrame:
        out = []
        for b, i, o in zip(beta, inverse, omega):
            bread = np.asarray(i, float).reshape(k, k)
            variance = np.diag(bread @ _square(o, k) @ bread)
            error = [math.sqrt(v) if v > 0 else None for v in variance]
            out.append((error, [math.erfc(abs(v / e) / math.sqrt(2)) if e else None for v, e in zip(b, error)]))
        return pd.DataFrame(out, columns=["error", "p"])

    x, y = F.col("x"), F.col("y")
    sums = d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(x[a] * x[b]) for a, b in _pairs(k))).alias("xx"),
        F.array(*(F.sum(x[a] * y) for a in range(k))).alias("xy"),
        F.array(*(F.sum(x[a]) for a in range(k))).alias("fires"),
        F.var_pop("y").alias("spread"),
    )
    first = sums.where(F.col("n") >= least).withColumn("s", solved("xx", "xy")).select(*by, "n", "xx", "fires", "spread", "s.*")
    e = d.join(first.select(*by, "beta"), by).withColumn("e", y - _dot(F.col("beta"), x))
    e = e.withColumn("u", F.transform("x", lambda v: v * F.col("e")))
    w, zero = W.partitionBy(*by).orderBy(at), F.array(*[F.lit(0.0)] * k)
    s = zero
    for h in range(1, lags + 1):
        s = _plus(s, F.coalesce(F.lag("u", h).over(w), zero), 1.0 - h / (lags + 1.0))
    e = e.withColumn("s", s)
    u, s = F.col("u"), F.col("s")
    products = F.array(*(F.sum(u[a] * u[b] + u[a] * s[b] + s[a] * u[b]) for a, b in _pairs(k)))
    second = e.groupBy(*by).agg(products.alias("omega"), F.var_pop("e").alias("left"))
    f = first.join(second, by).withColumn("j", judged("beta", "inverse", "omega"))
    used = [_pairs(k).index((a, a)) for a in range(k)]
    present = F.array(*(F.col("xx")[i] > 0 for i in used))
    known = lambda c: F.zip_with(c, present, lambda v, there: F.when(there, v))
    r2 = F.when(F.col("spread") > 0, 1 - F.col("left") / F.col("spread")).otherwise(0.0)
    return f.select(*by, "n", "fires", known("beta").alias("beta"), known("j.error").alias("error"), known("j.p").alias("p"), r2.alias("r_squared"))


def coefficients(fit: DataFrame, by: list[str], regressors: list[str], few: int = FEW) -> DataFrame:
    """by, regressor, n, fires, low_sample, beta, error, p and r_squared: a row for each regressor of each series."""
    names = ["intercept", *regressors]
    rows = F.array(*(F.struct(F.lit(c).alias("regressor"), F.col("fires")[i].alias("fires"), F.col("beta")[i].alias("beta"), F.col("error")[i].alias("error"), F.col("p")[i].alias("p")) for i, c in enumerate(names)))
    return fit.select(*by, "n", "r_squared", F.inline(rows)).withColumn("low_sample", F.col("fires") < few)


def adjusted(d: DataFrame, fit: DataFrame, by: list[str], at: str) -> DataFrame:
    """by, at, y and adjusted: y less what its regressors do beyond their mean, so the mean stays and no regressor is left in it."""
    f = fit.select(*by, F.transform("beta", lambda b: F.coalesce(b, F.lit(0.0))).alias("beta"), F.transform("fires", lambda v: v / F.col("n")).alias("mean"))
    off = F.zip_with("x", "mean", lambda a, b: a - b)
    return d.join(f, by).select(*by, at, "y", (F.col("y") - _dot(F.col("beta"), off)).alias("adjusted"))
