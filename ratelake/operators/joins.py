"""Joins on time: as-of, bracketing, membership in a window, overlap of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, most_days: int | None = None) -> DataFrame:
    """Each left row with ``value`` of the latest right row of its keys at or before it, and that row's time in ``<value>_at``.

    Both sides meet in one shuffle on the keys and a running last value, so no pairs are made. Right rows have distinct (by, at).
    """
    keys = [*by, at]
    r = right.select(*keys, F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("_found"), F.lit(0).alias("_side"))
    l = left.withColumns({"_found": F.lit(None).cast(r.schema["_found"].dataType), "_side": F.lit(1)})  # noqa: E741
    last = F.last("_found", ignorenulls=True).over(W.partitionBy(*by).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0))
    x = l.unionByName(r, allowMissingColumns=True).withColumn("_last", last).where("_side = 1")
    fresh = F.lit(True) if most_days is None else F.datediff(F.col(at), F.col("_last.t")) <= most_days
    return x.select(*left.columns, F.when(fresh, F.col("_last.v")).alias(value), F.when(fresh, F.col("_last.t")).alias(f"{value}_at"))


def bracket(targets: DataFrame, chain: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each target with the chain's members just at or below and just above it, and the weight of the upper one."""
    keys = [*by, at]
    m = F.struct(F.col(at).alias("t"), F.col(value).alias("v"))
    c = chain.select(*keys, m.alias("_m"), F.lit(0).alias("_side"))
    t = targets.select(*keys, F.lit(None).cast(c.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_side"))
    w = W.partitionBy(*by).orderBy(at, "_side")
    lower = F.last("_m", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    upper = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    x = t.unionByName(c).select(*keys, "_side", lower.alias("lo"), upper.alias("hi")).where("_side = 1")
    weight = F.when(F.col("hi.t") > F.col("lo.t"), (F.col(at) - F.col("lo.t")) / (F.col("hi.t") - F.col("lo.t")))
    return x.select(*keys, F.col("lo.v").alias("lower"), F.col("hi.v").alias("upper"), F.coalesce(weight, F.when(F.col("lo").isNotNull() & F.col("hi").isNull(), 0.0), F.when(F.col("hi").isNotNull() & F.col("lo").isNull(), 1.0)).alias("weight"))


def within_days(anchors: DataFrame, facts: DataFrame, by: list[str], at: str, before: int, after: int) -> DataFrame:
    """Facts within days of an anchor of their keys, with the offset. Anchors are spread over the days they reach, so this is an equi-join."""
    days = F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")
    spread = anchors.select(*by, F.col(at).alias("anchor"), days).withColumn(at, F.date_add("anchor", F.col("offset")))
    return spread.join(facts, [*by, at])


def overlap_days(a_from, a_to, b_from, b_to):
    """Days that two half-open intervals share."""
    return F.greatest(F.datediff(F.least(a_to, b_to), F.greatest(a_from, b_from)), F.lit(0))
