"""Factor model of the changes of a panel: moments as aggregates, a small eigenproblem per window, and what follows from the last fit at hand.

A panel has keys ``by``, a time ``at`` and a value for each of a fixed list of nodes. The moments of a window are
differences of running sums, one window of rows per panel and moment, so they spread over panels and pairs of nodes; a
panel's rows are bounded by its calendar. Only the sums of a window, as many as the pairs of nodes, meet in one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The tenor in months that the third factor's sign looks at, and the least rows of a fit.
BELLY, LEAST_ROWS, LEAST_CHANGES = 24.0, 30, 20


def changes(panel: DataFrame, by: list[str], at: str, node: str, value: str, nodes: list[str]) -> DataFrame:
    """by, at, i (place from 0) and x: the changes of all nodes, in their order, since the row before. Rows that lack a node are left out; the first has no x."""
    wide = panel.groupBy(*by, at).pivot(node, nodes).agg(F.max(value)).dropna(subset=nodes)
    w = W.partitionBy(*by).orderBy(at)
    steps = F.array(*((F.col(f"`{n}`") - F.lag(f"`{n}`").over(w)).cast("double") for n in nodes))
    place = F.row_number().over(w) - 1
    return wide.select(*by, at, place.alias("i"), F.when(place > 0, steps).alias("x"))


def standardised(x: DataFrame, by: list[str], d: int) -> DataFrame:
    """Changes less their panel's mean, in its population deviations; those that never vary are left at their distance from the mean."""
    w = W.partitionBy(*by)
    scaled = []
    for k in range(d):
        v = F.col("x")[k]
        sd = F.stddev_pop(v).over(w)
        scaled.append((v - F.avg(v).over(w)) / F.when(sd > 1e-12, sd).otherwise(1.0))
    return x.withColumn("x", F.when(F.col("x").isNotNull(), F.array(*scaled)))


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d) for b in range(a, d)]


def window_moments(x: DataFrame, by: list[str], d: int, window: int, step: int) -> DataFrame:
    """by, i, n (changes), centre and sums of every refit: each ``step`` rows from the first full window on, and the last row.

    ``sums`` are those of x less ``centre``, then of the products of its pairs. A panel shorter than a window is fitted once, over all its rows.
    """
    last = F.max("i").over(W.partitionBy(*by))
    centre = F.array(*(F.coalesce(F.avg(F.col("x")[a]).over(W.partitionBy(*by)), F.lit(0.0)) for a in range(d)))
    y = x.select(*by, "i", "x", last.alias("last"), centre.alias("centre")).where("i > 0")
    y = y.withColumn("y", F.zip_with("x", "centre", lambda a, b: a - b))
    values = F.array(*(F.col("y")[a] for a in range(d)), *(F.col("y")[a] * F.col("y")[b] for a, b in _pairs(d)))
    long = y.select(*by, "i", "last", "centre", F.posexplode(values).alias("k", "v"))
    run = W.partitionBy(*by, "k").orderBy("i")
    long = long.withColumn("upto", F.sum("v").over(run.rowsBetween(W.unboundedPreceding, 0)))
    long = long.withColumn("total", F.col("upto") - F.coalesce(F.lag("upto", window).over(run), F.lit(0.0)))
    regular = (F.col("i") >= window) & ((F.col("i") - window) % step == 0)
    refit = F.when(F.col("last") < window, (F.col("i") == F.col("last")) & (F.col("i") + 1 >= LEAST_ROWS)).otherwise(regular | (F.col("i") == F.col("last")))
    kept = long.where(refit).groupBy(*by, "i").agg(F.first("centre").alias("centre"), F.sort_array(F.collect_list(F.struct("k", "total"))).alias("s"))
    return kept.select(*by, "i", F.least("i", F.lit(window)).alias("n"), "centre", F.col("s.total").alias("sums"))


def oriented(loadings: np.ndarray, tenors: np.ndarray) -> np.ndarray:
    """The first factor's loadings add up to more than 0, the second ends higher than it begins, the third is higher at the belly than on the wings."""
    out = loadings.copy()
    ends = out[:, 0], out[:, -1]
    measures = [out[0].sum()]
    if len(out) > 1:
        measures.append(ends[1][1] - ends[0][1])
    if len(out) > 2:
        measures.append(out[2, int(np.argmin(np.abs(tenors - BELLY)))] - (ends[0][2] + ends[1][2]) / 2)
    for k, m in enumerate(measures):
        if m < 0:
            out[k] = -out[k]
    return out


def principal_axes(sums: list[np.ndarray], counts: list[int], tenors: np.ndarray, components: int) -> list[tuple | None]:
    """(loadings, eigenvalues, shares, mean of the centred changes) of each set of sums; None where nothing varies."""
    d = len(tenors)
    upper = np.triu_indices(d)
    out = []
    for s, n in zip(sums, counts):
        mean, products = s[:d] / n, np.zeros((d, d))
        products[upper] = s[d:]
        products.T[upper] = s[d:]
        values, vectors = np.linalg.eigh((products - n * np.outer(mean, mean)) / max(1, n - 1))
        values, vectors = np.maximum(values[::-1], 0.0), vectors.T[::-1]
        if n < LEAST_CHANGES or values.sum() <= 0:
            out.append(None)
        else:
            out.append((oriented(vectors[:components], tenors), values[:components], values[:components] / values.sum(), mean))
    return out


def factor_fits(x: DataFrame, by: list[str], tenors: list[float], window: int = 252, step: int = 5, components: int = 3) -> DataFrame:
    """by, i, n, loadings, eigenvalues, shares and mean of every refit, the signs of each fit those that go with the fit before.

    A fit's sign is the fit's before turned over if their loadings point apart, so it follows from how many neighbours do: a running count.
    """
    d = len(tenors)

    @F.pandas_udf("loadings array<array<double>>, eigenvalues array<double>, shares array<double>, mean array<double>")
    def solved(sums: pd.Series, n: pd.Series, centre: pd.Series) -> pd.DataFrame:
        fits = principal_axes([np.asarray(s, float) for s in sums], n.tolist(), np.asarray(tenors, float), components)
        rows = [(None,) * 4 if f is None else ([r.tolist() for r in f[0]], f[1].tolist(), f[2].tolist(), (f[3] + np.asarray(c, float)).tolist()) for f, c in zip(fits, centre)]
        return pd.DataFrame(rows, columns=["loadings", "eigenvalues", "shares", "mean"])

    m = window_moments(x, by, d, window, step).withColumn("f", solved("sums", "n", "centre"))
    fits = m.select(*by, "i", "n", "f.*").where("loadings is not null")
    w = W.partitionBy(*by).orderBy("i")
    apart = [_dot(F.col("loadings")[k], F.lag("loadings").over(w)[k]) < 0 for k in range(components)]
    for k, flag in enumerate(apart):
        fits = fits.withColumn(f"_apart{k}", F.coalesce(flag, F.lit(False)))
    turned = F.array(*(1.0 - 2.0 * (F.count_if(F.col(f"_apart{k}")).over(w) % 2) for k in range(components)))
    fits = fits.withColumn("_turn", turned)
    aligned = F.zip_with("loadings", "_turn", lambda row, s: F.transform(row, lambda v: v * s))
    return fits.select(*by, "i", "n", aligned.alias("loadings"), "eigenvalues", "shares", "mean")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def factor_scores(x: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """The rows of changes with the last fit at or before them (the first fit before that one) and ``scores``, the factors of the change."""
    f = fits.select(*by, "i", F.struct("loadings", "mean").alias("fit"))
    y = x.join(f, [*by, "i"], "left")
    w = W.partitionBy(*by).orderBy("i")
    last = F.last("fit", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.first("fit", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    y = y.withColumn("fit", F.coalesce(last, first))
    off = F.zip_with("x", "fit.mean", lambda a, b: a - b)
    return y.withColumn("scores", F.when(F.col("x").isNotNull(), F.transform("fit.loadings", lambda row: _dot(row, off))))


def decomposed(scored: DataFrame, components: int = 3) -> DataFrame:
    """factor_scores() with contributions (one array a factor), residual, their shares of the summed sizes of the changes, ``explained`` and ``error``.

    Shares are null where nothing moved; explained is then 1. ``error`` is the residual's Euclidean length.
    """
    parts = F.zip_with("scores", "fit.loadings", lambda s, row: F.transform(row, lambda v: s * v))
    y = scored.where("scores is not null").withColumn("contributions", parts)
    fitted = F.aggregate("contributions", F.col("fit.mean"), lambda s, p: F.zip_with(s, p, lambda a, b: a + b))
    y = y.withColumn("residual", F.zip_with("x", fitted, lambda a, b: a - b))
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))
    moved = size(F.col("x"))
    y = y.withColumn("size", moved)
    share = lambda a: F.when(F.col("size") > 1e-9, size(a) / F.col("size"))
    shares = {f"share_{k + 1}": share(F.col("contributions")[k]) for k in range(components)} | {"share_residual": share(F.col("residual"))}
    y = y.withColumns(shares)
    explained = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("share_residual")))
    return y.withColumns({"explained": F.coalesce(explained, F.lit(1.0)), "error": F.sqrt(_dot(F.col("residual"), F.col("residual")))})
