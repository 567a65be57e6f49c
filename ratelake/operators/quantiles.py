"""Exact quantiles of groups of any size: counts by ever finer cells of the values, so that no task holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COARSE, FINE = 2048, 1 << 20  # parts of a unit of the logarithm, and of such a part
OUTER = 1000 * COARSE  # beyond the cell of any finite value


def _cells(x: DataFrame) -> DataFrame:
    """``_v`` with its two cells, both in the order of the values: whole parts of its signed logarithm, then parts of the rest.

    The logarithm of one more than a size never falls where the size grows, so equal values share their cells and no value passes another;
    sizes far below one share a cell, which costs balance and no result. Infinities and NaN (after all else, as Spark sorts it) have cells of their own.
    """
    v = F.col("_v")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    sign = F.when(v < 0, -1).otherwise(1)
    x = x.withColumn("_t", F.when(F.isnan(v), OUTER + COARSE).when(odd, OUTER).otherwise(F.log1p(F.abs(v)) * COARSE))
    whole = F.floor("_t")
    return x.withColumns({"_c1": sign * whole, "_c2": sign * F.floor((F.col("_t") - whole) * FINE)}).drop("_t")


def alike(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where null equals null; the keys are those of ``a``."""
    b = b.select(*(F.col(k).alias(f"_r_{k}") if k in keys else k for k in b.columns))
    return a.join(b, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)), how).drop(*(f"_r_{k}" for k in keys))


def _narrowed(cells: DataFrame, group: list[str], cell: str, wanted) -> DataFrame:
    """Of counted cells those that hold wanted ranks, with ``_left``: each rank and its place inside the cell."""
    w = W.partitionBy(*group).orderBy(cell)
    x = cells.withColumn("_upto", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = wanted(x)
    before = F.col("_upto") - F.col("_n")
    inside = F.filter("_left", lambda t: (t["at"] >= before) & (t["at"] < F.col("_upto")))
    x = x.withColumn("_left", F.transform(inside, lambda t: F.struct(t["rank"].alias("rank"), (t["at"] - before).alias("at"))))
    return x.where(F.size("_left") > 0).drop("_upto")


def quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], probs: dict[str, float], few: bool = False) -> DataFrame:
    """Per ``keys`` the quantiles of each value, between ranks by linear interpolation, as ``<value>_<prob>``.

    Nulls are left out; a group without a value has no row, and a value without any in its group is null. Null keys are a group. Names
    that begin with an underscore are kept for the operator.

    Three passes over ``rows``, each one aggregation with partial counts: by coarse cells, of which a group has 2,048 an e-fold
    at most; inside the coarse cells that hold a wanted rank, by fine cells, about a million at most; inside the fine cells that do, by
    value. A hot group is spread over its cells, and a value that repeats is one row after the partial count. Only the cells of one
    group, not its rows, meet in a task. The cells that hold wanted ranks are two a quantile and group at most. With ``few`` groups, whatever the
    number of rows, they are broadcast, and no pass shuffles more than its partial counts; else each of the last two passes shuffles the rows once.
    """
    melted = F.explode(F.array(*(F.struct(F.lit(n).alias("_of"), (c.cast("double") + 0.0).alias("_v")) for n, c in values.items())))
    x = _cells(rows.select(*keys, melted.alias("_x")).select(*keys, "_x.*").where("_v is not null"))
    group = [*keys, "_of"]
    sent = F.broadcast if few else lambda wanted: wanted
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in probs.values()))))

    def first(cells: DataFrame) -> DataFrame:
        y = cells.withColumn("_all", F.sum("_n").over(W.partitionBy(*group)))
        return y.withColumn("_left", F.transform(ranks, lambda k: F.struct(k.alias("rank"), k.alias("at"))))

    coarse = _narrowed(x.groupBy(*group, "_c1").agg(F.count("*").alias("_n")), group, "_c1", first).drop("_n")
    inner = [*group, "_c1"]
    found = alike(x, sent(coarse), inner).groupBy(*inner, "_c2").agg(F.count("*").alias("_n"), F.first("_left").alias("_left"), F.first("_all").alias("_all"))
    fine = _narrowed(found, inner, "_c2", lambda y: y).drop("_n")
    inmost = [*inner, "_c2"]
    found = alike(x, sent(fine), inmost).groupBy(*inmost, "_v").agg(F.count("*").alias("_n"), F.first("_left").alias("_left"), F.first("_all").alias("_all"))
    hit = _narrowed(found, inmost, "_v", lambda y: y).select(*group, "_all", "_v", F.explode("_left.rank").alias("_rank"))
    at = hit.groupBy(*group).agg(F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two entries a quantile

    def between(p: float) -> Column:
        low, high = F.floor(place(p)), F.ceil(place(p))
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(a == b, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    q = {label: between(p) for label, p in probs.items()}
    return at.groupBy(*keys).agg(*(F.max(F.when(F.col("_of") == n, c)).alias(f"{n}_{label}") for n in values for label, c in q.items()))
