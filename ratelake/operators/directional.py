"""The directional system and the bands and oscillators beside it, each a window over the bars of a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.functions import series as S

#: Keeps a ratio finite where its denominator is 0.
TINY = 1e-9


def _full(agg: Column, x: str, n: int) -> Column:
    """A window aggregate over the last n rows once all of them have a value."""
    w = S.trailing(n)
    return F.when(F.count(x).over(w) == n, agg.over(w))


def directional(bars: DataFrame) -> DataFrame:
    """bars with atr_5, atr_10, atr_14, atr_20, di_plus, di_minus, dx and adx (14 bars, plain means).

    A move counts on the side on which it is larger, and only if it widens the range; the first bar has none.
    """
    w = S.ordered()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    x = bars.withColumns({"tr": S.true_range(), "_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_down": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    x = x.withColumns({f"atr_{n}": _full(F.avg("tr"), "tr", n) for n in (5, 10, 14, 20)})
    x = x.withColumns({"di_plus": 100 * S.safe_ratio(_full(F.sum("_up"), "_up", 14), F.col("atr_14")), "di_minus": 100 * S.safe_ratio(_full(F.sum("_down"), "_down", 14), F.col("atr_14"))})
    x = x.withColumn("dx", 100 * F.abs(F.col("di_plus") - F.col("di_minus")) / (F.col("di_plus") + F.col("di_minus") + TINY))
    return x.withColumn("adx", _full(F.avg("dx"), "dx", 14)).drop("_up", "_down")


def oscillators(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars with aroon_up, aroon_down, aroon, cci, obv and the range of 20 bars in units of atr_20; needs atr_20.

    Of equal extremes the earliest counts. CCI is null before 20 bars.
    """
    w = S.trailing(n + 1)
    place = F.row_number().over(S.ordered())
    x = bars.withColumn("_i", place)
    full = F.count("high").over(w) == n + 1
    since = lambda c, sign: F.col("_i") - F.min(F.struct((sign * F.col(c)).alias("v"), F.col("_i").alias("i"))).over(w)["i"]
    x = x.withColumns({"aroon_up": F.when(full, 100.0 * (n - since("high", -1)) / n), "aroon_down": F.when(full, 100.0 * (n - since("low", 1)) / n)})
    x = x.withColumns({"aroon": F.col("aroon_up") - F.col("aroon_down"), "_typical": (F.col("high") + F.col("low") + F.col("close")) / 3})
    mean, seen = _full(F.avg("_typical"), "_typical", 20), F.collect_list("_typical").over(S.trailing(20))
    x = x.withColumns({"_mean": mean, "_seen": seen})
    spread = F.aggregate("_seen", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("_mean"))) / 20
    before = F.lag("close").over(S.ordered())
    flow = F.when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0)
    x = x.withColumns({"cci": (F.col("_typical") - F.col("_mean")) / (0.015 * spread + TINY), "_flow": flow})
    x = x.withColumn("obv", F.sum("_flow").over(S.ordered()))
    wide = _full(F.max("high"), "high", 20) - _full(F.min("low"), "low", 20)
    return x.withColumn("range_20_over_atr", wide / (F.col("atr_20") + TINY)).drop("_i", "_typical", "_mean", "_seen", "_flow")


def bands(bars: DataFrame, multiples: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """bars with the bands of 20 closes (bb_up, bb_down, bb_width, bb_place) and those around the middle of the bar (st_up, st_down) at multiples of deviation and of atr_10."""
    mean, sd = _full(F.avg("close"), "close", 20), _full(F.stddev_samp("close"), "close", 20)
    x = bars.withColumns({"_m": mean, "_s": sd, "_h": (F.col("high") + F.col("low")) / 2})
    out = {}
    for k in multiples:
        out |= {f"bb_up_{k}": F.col("_m") + k * F.col("_s"), f"bb_down_{k}": F.col("_m") - k * F.col("_s"), f"bb_width_{k}": S.safe_ratio(2 * k * F.col("_s"), F.col("_m"))}
        out |= {f"bb_place_{k}": (F.col("close") - F.col("_m") + k * F.col("_s")) / (2 * k * F.col("_s") + TINY)}
        out |= {f"st_up_{k}": F.col("_h") + k * F.col("atr_10"), f"st_down_{k}": F.col("_h") - k * F.col("atr_10")}
    return x.withColumns(out).drop("_m", "_s", "_h")
