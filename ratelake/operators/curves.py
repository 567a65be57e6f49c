"""Curves over chains of contracts: sections, carry, rolls and their adjustment, constant-maturity nodes, meeting outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions.series import safe_ratio

PACKS = ("Whites", "Reds", "Greens", "Blues", "Golds")


def sections(chain: DataFrame, by: str, at: str, front: int = 6, mid: int = 14) -> DataFrame:
    """The chain with each member's place, its section, and its pack of four."""
    x = chain.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(at)))
    section = F.when(F.col("place") <= front, "front").when(F.col("place") <= mid, "mid").otherwise("back")
    pack = F.coalesce(F.get(F.array(*map(F.lit, PACKS)), F.floor((F.col("place") - 1) / 4).cast("int")), F.lit("Later"))
    return x.withColumns({"section": section, "pack": pack})


def carry(by: str, at: str, value: str) -> Column:
    """Change to the next member of the chain, per unit of distance, times 100."""
    w = W.partitionBy(by).orderBy(at)
    return (F.lead(value).over(w) - F.col(value)) / (F.lead(at).over(w) - F.col(at)) * 100


def _end_slope(h: Column, h1: Column, d: Column, d1: Column) -> Column:
    s = safe_ratio((2 * h + h1) * d - h * d1, h + h1)
    return F.when(F.signum(s) != F.signum(d), 0.0).when((F.signum(d) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d)), 3 * d).otherwise(s)


def nodes(chain: DataFrame, by: str, at: list[float]) -> DataFrame:
    """(by, node, linear, shaped): the chain's curve (x, y) at each node within it, by straight lines and by a shape-preserving cubic.

    Slopes are weighted harmonic means of the neighbouring secants (0 where these change sign); both are computed by
    neighbours on the chain, so a series is as long as its chain.
    """
    w = W.partitionBy(by).orderBy("x")
    k = chain.withColumns({"h": F.lead("x").over(w) - F.col("x"), "_p1": F.lead("y").over(w)}).withColumn("d", (F.col("_p1") - F.col("y")) / F.col("h"))
    near = {f"{c}{i}": F.lag(c, i).over(w) for c in "hd" for i in (1, 2)} | {f"{c}_next": F.lead(c).over(w) for c in "hd"}
    k = k.withColumns(near)
    h, d, h0, d0 = (F.col(c) for c in ("h", "d", "h1", "d1"))
    inner = F.when(d0 * d <= 0, 0.0).otherwise(3 * (h0 + h) / ((2 * h + h0) / d0 + (h + 2 * h0) / d))
    slope = F.when(d0.isNull(), F.coalesce(_end_slope(h, F.col("h_next"), d, F.col("d_next")), d)).when(d.isNull(), F.coalesce(_end_slope(h0, F.col("h2"), d0, F.col("d2")), d0)).otherwise(inner)
    k = k.withColumn("slope", slope).withColumn("_s1", F.lead("slope").over(w))
    inside = F.filter(F.array(*(F.lit(float(x)) for x in at)), lambda v: (v >= F.col("x")) & (v < F.col("x") + h))
    e = k.where("h is not null").withColumn("node", F.explode(inside)).withColumn("t", (F.col("node") - F.col("x")) / h)
    t, y, p1 = F.col("t"), F.col("y"), F.col("_p1")
    shaped = (1 + 2 * t) * (1 - t) * (1 - t) * y + t * (1 - t) * (1 - t) * h * F.col("slope") + t * t * (3 - 2 * t) * p1 + t * t * (t - 1) * h * F.col("_s1")
    return e.select(by, "node", (y + t * (p1 - y)).alias("linear"), shaped.alias("shaped"))


def active(days: DataFrame, listed: DataFrame) -> DataFrame:
    """Contracts (symbol, first_bar, expiry) that trade on each day, nearest expiry first.

    A contract is spread over its own days, so this is an equi-join whose rows are the answer's.
    """
    spread = listed.withColumn("bar_date", F.explode(F.sequence("first_bar", "expiry")))
    x = spread.join(days, "bar_date").withColumn("days", F.datediff("expiry", "bar_date"))
    return x.select("bar_date", "symbol", "days", F.row_number().over(W.partitionBy("bar_date").orderBy("expiry")).alias("place"))


def rolls(bars: DataFrame, target: Column, sessions: int = 3) -> DataFrame:
    """Per contract k the first day from ``target`` on which the next one's volume has been larger for so many sessions in a row, the gap of closes there, and the sum of gaps from the last contract to it, which adjusts its history."""
    nxt = bars.select((F.col("k") - 1).alias("k"), "bar_date", F.col("close").alias("_new"), F.col("volume").alias("_volume"))
    w = W.partitionBy("k").orderBy("bar_date").rowsBetween(1 - sessions, 0)
    x = bars.join(nxt, ["k", "bar_date"]).withColumn("gap", F.col("_new") - F.col("close"))
    x = x.withColumn("held", F.min((F.col("_volume") > F.col("volume")).cast("int")).over(w) + F.when(F.count("*").over(w) < sessions, -1).otherwise(0))
    g = x.where((F.col("held") == 1) & (F.col("bar_date") >= target)).groupBy("k").agg(F.min("bar_date").alias("roll"), F.min_by("gap", "bar_date").alias("gap"))
    return g.withColumn("adjustment", F.sum("gap").over(W.partitionBy().orderBy(F.desc("k"))))  # a row per contract


def outcomes(meetings: DataFrame, rates: DataFrame, before: int, after: int, least: float) -> DataFrame:
    """Meetings with their blackout window, the next one, the last rate before and the first from it on, and HOLD, HIKE or CUT.

    Rates (at, rate) have a row a day and meetings a few a year: both run through one ordered pass of the calendar.
    """
    x = meetings.select(F.col("meeting").alias("at"), F.lit(None).cast("double").alias("rate"), F.lit(0).alias("side")).unionByName(rates.withColumn("side", F.lit(1)))
    w = W.partitionBy().orderBy("at", "side")
    x = x.withColumns({"before": F.last("rate", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "after": F.first("rate", True).over(w.rowsBetween(0, W.unboundedFollowing))}).where("side = 0")
    moved = F.col("after") - F.col("before")
    outcome = F.when(F.abs(moved) < least, "HOLD").when(moved > 0, "HIKE").when(moved < 0, "CUT")
    return x.select(F.col("at").alias("meeting"), F.date_sub("at", before).alias("blackout_from"), F.date_add("at", after).alias("blackout_to"), F.lead("at").over(W.partitionBy().orderBy("at")).alias("next_meeting"), "before", "after", outcome.alias("outcome"))
