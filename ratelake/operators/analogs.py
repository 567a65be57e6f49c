"""Days like a given one: shrunk covariance from sums, distances in whitened coordinates, weights by distance and age, weighted quantiles of what followed.

Queries are a stated set of days; each meets the earlier days of its own panel, whose number the calendar bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Neighbours, days of decay, days around the query that are left out.
NEIGHBOURS, DECAY_DAYS, EXCLUDED_DAYS = 50, 250.0, 60


def shrunk_covariance(points: DataFrame, x: str, d: int) -> tuple[np.ndarray, float]:
    """Sample covariance of the arrays x, drawn towards a multiple of the identity, and by how much (0 to 1).

    The draw weighs the variance of the products against the distance from the target; it needs the covariance and the
    mean fourth power of the rows' lengths, so two aggregations. Below two rows the identity, not drawn.
    """
    rows = points.where(F.col(x).isNotNull()).select(F.col(x).alias("x"))
    v = F.col("x")
    first = rows.agg(F.count("*").alias("n"), *(F.avg(v[a]).alias(f"m{a}") for a in range(d)), *(F.covar_samp(v[a], v[b]).alias(f"c{a}_{b}") for a in range(d) for b in range(a, d))).first()
    n = first["n"]
    if n < 2:
        return np.eye(d), 0.0
    s = np.array([[first[f"c{min(a, b)}_{max(a, b)}"] for b in range(d)] for a in range(d)])
    length2 = sum(((v[a] - first[f"m{a}"]) * (v[a] - first[f"m{a}"]) for a in range(1, d)), (v[0] - first["m0"]) * (v[0] - first["m0"]))
    fourth = rows.agg(F.avg(length2 * length2)).first()[0]
    target = np.trace(s) / d * np.eye(d)
    spread, apart = fourth - (n - 2) / n * float((s * s).sum()), float(((s - target) ** 2).sum())
    share = 1.0 if apart < 1e-12 else max(0.0, min(1.0, spread / apart / n))
    out = (1 - share) * s + share * target
    least = float(np.linalg.eigvalsh(out).min())
    return (out + (1e-6 - least) * np.eye(d) if least < 1e-8 else out), share


def whitened(x: str, covariance: np.ndarray) -> Column:
    """Coordinates in which the Euclidean distance is the one by the covariance."""
    root = np.linalg.inv(np.linalg.cholesky(covariance))
    return F.array(*(sum((float(c) * F.col(x)[i] for i, c in enumerate(row)), F.lit(0.0)) for row in root))


def analogs(history: DataFrame, queries: DataFrame, by: list[str], at: str, x: str, covariance: np.ndarray, k: int = NEIGHBOURS, decay: float = DECAY_DAYS, excluded: int = EXCLUDED_DAYS) -> DataFrame:
    """by, query_at, at, distance, weight and rank of the k days with the most weight, more than ``excluded`` days before each query, and eff_n of each query.

    The weight is exp(-distance / median distance) * exp(-days / decay); of equal weights the earlier day comes first. A query without such days gives no rows.
    """
    h = history.where(F.col(x).isNotNull()).select(*by, at, whitened(x, covariance).alias("h"))
    q = queries.where(F.col(x).isNotNull()).select(*by, F.col(at).alias("query_at"), whitened(x, covariance).alias("q"))
    squares = F.aggregate(F.zip_with("h", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    days = F.datediff("query_at", at)
    pairs = q.join(h, by).where(days > excluded).select(*by, "query_at", at, days.alias("days"), F.sqrt(squares).alias("distance"))
    each = [*by, "query_at"]
    middle = pairs.groupBy(*each).agg(F.median("distance").alias("middle"))
    pairs = pairs.join(middle, each)
    scale = F.when(F.col("middle") > 0, F.col("middle")).otherwise(1.0)
    pairs = pairs.withColumn("weight", F.exp(-F.col("distance") / scale) * F.exp(-F.col("days") / max(decay, 1.0)))
    best = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*each).orderBy(F.desc("weight"), at))).where(F.col("rank") <= k)
    w = W.partitionBy(*each)
    effective = F.pow(F.sum("weight").over(w), 2) / F.greatest(F.sum(F.col("weight") * F.col("weight")).over(w), F.lit(1e-12))
    return best.withColumn("eff_n", effective).select(*each, at, "distance", "weight", "rank", "eff_n")


def weighted_quantiles(x: DataFrame, by: list[str], value: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """by, n and for each name the least value up to which the weights reach that share of their sum. Rows without a value are left out."""
    w = W.partitionBy(*by)
    y = x.where(F.col(value).isNotNull()).withColumns({"_upto": F.sum(weight).over(w.orderBy(value).rangeBetween(W.unboundedPreceding, 0)), "_all": F.sum(weight).over(w)})
    # A hair of tolerance, as the sum of all weights depends on the order of adding.
    picks = [F.min(F.when(F.col("_upto") >= q * F.col("_all") * (1 - 1e-12), F.col(value))).alias(name) for name, q in quantiles.items()]
    return y.groupBy(*by).agg(F.count("*").alias("n"), *picks)
