"""Columns over the rows of one series, in time order. ``by`` names the series, ``at`` the time."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(by: str = "symbol", at: str = "bar_date") -> WindowSpec:
    return W.partitionBy(by).orderBy(at)


def prior(n: int, by: str = "symbol", at: str = "bar_date") -> WindowSpec:
    """The n rows strictly before the current one."""
    return ordered(by, at).rowsBetween(-n, -1)


def trailing(n: int, by: str = "symbol", at: str = "bar_date") -> WindowSpec:
    """The n rows that end with the current one."""
    return ordered(by, at).rowsBetween(1 - n, 0)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.when(b != 0, a / b)


def prior_z(x: str, n: int, least: int = 2) -> Column:
    """Distance from the mean of the prior n rows in their sample deviations."""
    w = prior(n)
    return F.when(F.count(x).over(w) >= least, safe_ratio(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def prior_rank(x: str, n: int) -> Column:
    """Percent of the prior n values that lie strictly below."""
    seen = F.collect_list(x).over(prior(n))
    return F.when(F.size(seen) > 0, 100.0 * F.size(F.filter(seen, lambda v: v < F.col(x))) / F.size(seen))


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def mean_if(x: str, n: int, least: int) -> Column:
    """Mean of the last n rows once there are ``least`` of them."""
    w = trailing(n)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def bar_strength() -> Column:
    """Where the close stands between low and high."""
    return safe_ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low"))


def guarded(agg: Column, x: str, w: WindowSpec, least: int) -> Column:
    """A window aggregate where the window has at least so many values."""
    return F.when(F.count(x).over(w) >= least, agg)


def window_z(x: str, n: int, least: int, population: bool = False) -> Column:
    """Distance from the mean of the last n rows, the current one among them, in their deviations."""
    w = trailing(n)
    sd = F.stddev_pop(x) if population else F.stddev_samp(x)
    return guarded(safe_ratio(F.col(x) - F.avg(x).over(w), sd.over(w)), x, w, least)


def rolling_rank(x: str, n: int) -> Column:
    """Percent of the other values of the last n rows that lie below, from max(5, n / 4) values on."""
    seen, w = F.collect_list(x).over(prior(n - 1)), trailing(n)
    return guarded(100.0 * F.size(F.filter(seen, lambda v: v < F.col(x))) / F.nullif(F.size(seen), F.lit(0)), x, w, max(5, n // 4))


def middle(n: int) -> Column:
    """Mean of the highest high and the lowest low of n rows."""
    w = trailing(n)
    return F.when(F.count("high").over(w) >= n, (F.max("high").over(w) + F.min("low").over(w)) / 2)


def swing(x: str, sign: int, k: int = 5) -> Column:
    """Whether a value is strictly beyond those of k rows on either side, all of which must exist."""
    before, after = ordered().rowsBetween(-k, -1), ordered().rowsBetween(1, k)
    v = sign * F.col(x)
    full = (F.count(x).over(before) == k) & (F.count(x).over(after) == k)
    return full & (v > F.max(v).over(before)) & (v > F.max(v).over(after))


def streaks(x, flag: str, by: str = "symbol", at: str = "bar_date"):
    """The table with ``streak``: how many rows in a row, up to this one, have had the flag; 0 where it is not set."""
    place = F.row_number().over(ordered(by, at))
    x = x.withColumn("_place", place)
    last_off = F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col("_place"))).over(ordered(by, at).rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("streak", F.col("_place") - F.coalesce(last_off, F.lit(0))).drop("_place")


def touches(x: str, n: int, reach: Column, high: bool) -> Column:
    """How many of the prior n values lie within ``reach`` of their own extreme."""
    seen = F.collect_list(x).over(prior(n))
    ends = F.array_max(seen) if high else F.array_min(seen)
    return F.size(F.filter(seen, lambda v: F.abs(v - ends) <= reach))
