"""Trading setups: every bar of every symbol gets each setup's state, side and levels in one pass.

``setup_panel`` adds the indicators: recursions as one ordered fold (a key's rows in batches, none held whole), all else
as windows of at most 90 rows. ``setup_states`` is then a projection: conditions are expressions on the panel's columns,
so a replay over the whole history costs no more than the latest bar's scan does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.functions import levels as L
from ratelake.functions import series as S
from ratelake.operators import directional
from ratelake.operators.folds import ordered_fold

# Periods of the means, of the two means and the signal of their difference, of relative strength.
MEANS, FAST, SLOW, SIGNAL, STRENGTH = (5, 10, 20, 30, 50, 100), 12, 26, 9, 14
TINY = 1e-9


def recursive_indicators(bars: DataFrame) -> DataFrame:
    """bars with ema_<n>, wilder_200, macd_hist and rsi_14, from the first bar on. Bars without symbol, date or close are left out.

    Expects one bar a symbol and date. rsi_14 is 0 until a first rise.
    """
    columns = [*(f"ema_{n}" for n in MEANS), "wilder_200", "macd_hist", "rsi_14"]

    def step(state: dict, part: pd.DataFrame) -> pd.DataFrame:
        def smooth(name: str, x: np.ndarray, alpha: float) -> np.ndarray:
            known = np.concatenate([[state[name]], x]) if name in state else x
            out = pd.Series(known).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-len(x) :]
            state[name] = out[-1]
            return out

        close = part["close"].to_numpy(float)
        change = np.diff(close, prepend=state.get("close", close[0]))
        state["close"] = close[-1]
        out = {f"ema_{n}": smooth(f"ema_{n}", close, 2 / (n + 1)) for n in MEANS}
        out["wilder_200"] = smooth("wilder_200", close, 1 / 200)
        gap = smooth("fast", close, 2 / (FAST + 1)) - smooth("slow", close, 2 / (SLOW + 1))
        out["macd_hist"] = gap - smooth("signal", gap, 2 / (SIGNAL + 1))
        up, down = (smooth(name, np.maximum(x, 0.0), 1 / STRENGTH) for name, x in (("up", change), ("down", -change)))
        out["rsi_14"] = 100 - 100 / (1 + up / (down + TINY))
        return part.assign(**out)

    known = bars.dropna(subset=["symbol", "bar_date", "close"])
    schema = T.StructType([*known.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    return ordered_fold(known, ["symbol"], ["bar_date"], dict, step, schema)


def setup_panel(bars: DataFrame) -> DataFrame:
    """bars with all that the setups read. What is called prior leaves the bar itself out; z20 and z50 do not."""
    x = directional.bands(directional.directional(recursive_indicators(bars)), (2, 3))
    w, n = S.ordered(), S.trailing
    before = lambda c, k=1: F.lag(c, k).over(w)
    over = lambda f, c, k: f(c).over(S.prior(k))
    x = x.withColumns({"i": F.row_number().over(w), "before": before("close"), "tenkan": S.middle(9), "kijun": S.middle(26), "_wide": S.middle(52)})
    x = x.withColumns({"kc_up": F.col("ema_20") + 2 * F.col("atr_20"), "kc_down": F.col("ema_20") - 2 * F.col("atr_20"), "_return": F.col("close") / F.col("before") - 1})
    x = x.withColumn("_inside", F.coalesce((F.col("bb_up_2") <= F.col("kc_up")) & (F.col("bb_down_2") >= F.col("kc_down")), F.lit(False)).cast("int"))
    x = x.withColumn("_rank", S.rolling_rank("bb_width_2", 90))
    z = lambda c, k: S.guarded((F.col(c) - F.avg(c).over(n(k))) / (F.stddev_samp(c).over(n(k)) + TINY), c, n(k), k)
    x = x.withColumns(
        {
            "high_20": over(F.max, "high", 20), "low_20": over(F.min, "low", 20), "volume_20": over(F.avg, "volume", 20),
            "top_5": over(F.max, "close", 5), "bottom_5": over(F.min, "close", 5), "top_20": over(F.max, "close", 20), "bottom_20": over(F.min, "close", 20),
            "top_55": over(F.max, "close", 55), "bottom_55": over(F.min, "close", 55), "inside_10": over(F.sum, "_inside", 10), "inside_20": over(F.sum, "_inside", 20),
            "sd_20": over(F.stddev_samp, "close", 20), "mean_60": over(F.avg, "close", 60), "sd_60": over(F.stddev_samp, "close", 60),
            "mean_20": S.guarded(F.avg("close").over(n(20)), "close", n(20), 20), "z20": z("close", 20), "z50": z("close", 50), "z_return": z("_return", 5),
            "volume_z": S.window_z("volume", 90, 22), "range_z": S.window_z("tr", 90, 22), "width_rank": before("_rank"),
            "span_a": before((F.col("tenkan") + F.col("kijun")) / 2, 26), "span_b": before("_wide", 26), "close_26": before("close", 26),
            "hist_before": before("macd_hist"), "ema_50_before": before("ema_50"), "wilder_before": before("wilder_200"), "di_plus_before": before("di_plus"), "di_minus_before": before("di_minus"),
            "st_up_before": before("st_up_2"), "st_down_before": before("st_down_2"),
            "_low": F.min(F.struct("close", "bar_date", "rsi_14")).over(S.prior(19)), "_high": F.min(F.struct((-F.col("close")).alias("v"), "bar_date", "rsi_14")).over(S.prior(19)),
            "_slope": F.regr_slope("close", "before").over(S.prior(89)),
        }
    )
    slope, long_enough = F.col("_slope"), F.col("i") > 20
    x = x.withColumns(
        {
            "bullish": long_enough & (F.col("close") <= F.col("_low.close")) & (F.col("rsi_14") > F.col("_low.rsi_14")),
            "bearish": long_enough & (F.col("close") >= -F.col("_high.v")) & (F.col("rsi_14") < F.col("_high.rsi_14")),
            "half_life": F.when((slope > 0) & (slope < 1), -F.log(F.lit(2.0)) / F.log(slope)),
            "z60": S.safe_ratio(F.col("close") - F.col("mean_60"), F.col("sd_60")),
            "place": F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5),
            "body": (F.col("close") - F.col("open")) / F.greatest(F.col("high") - F.col("low"), F.lit(TINY)),
        }
    )
    ribbon = lambda sign: sum((F.expr(f"int(ema_{a} {sign} ema_{b})") for a, b in zip(MEANS, MEANS[1:])), F.lit(0))
    x = x.withColumns({"rising": ribbon(">"), "falling": ribbon("<")})
    x = x.withColumns({"rising_before": before("rising"), "falling_before": before("falling")})
    return x.drop("_wide", "_return", "_inside", "_rank", "_low", "_high", "_slope")


@dataclass(frozen=True)
class Setup:
    """A setup as expressions on the panel; pairs are (long, short).

    With ``met``, the state follows from how many of a side's conditions hold; else it is the first of ``fired``,
    ``approaching`` and ``near`` that holds. The better side counts, long if they tie. ``history``: bars that must come before.
    ``first`` and ``second`` are multiples of the distance to the stop, pairs of prices, or nothing.
    """

    name: str
    history: int
    needs: tuple[str, ...]
    stop: tuple[str, str]
    first: float | tuple[str, str]
    second: float | tuple[str, str] | None = None
    met: tuple[tuple[str, ...], tuple[str, ...]] | None = None
    fired: tuple[str, str] = ("false", "false")
    approaching: tuple[str, str] = ("false", "false")
    near: tuple[str, str] = ("false", "false")


def _atrs(k: float) -> tuple[str, str]:
    return f"close - {k} * atr_14", f"close + {k} * atr_14"


def _stretch(name: str, history: int, z: str, ok: str, mean: str, sd: str) -> Setup:
    """Against a stretch of 2 deviations, near from 1.5 and approaching from 1, where ``ok`` holds: back to the mean, out at three deviations."""
    return Setup(
        name, history, (z, mean), (f"{mean} - 3 * {sd}", f"{mean} + 3 * {sd}"), (mean, mean),
        fired=(f"{ok} and {z} < -2", f"{ok} and {z} > 2"), near=(f"{ok} and {z} between -2 and -1.5", f"{ok} and {z} between 1.5 and 2"),
        approaching=(f"{ok} and {z} > -1.5 and {z} < -1", f"{ok} and {z} > 1 and {z} < 1.5"),
    )


_up, _down = "(ema_50_before <= wilder_before and ema_50 > wilder_200)", "(ema_50_before >= wilder_before and ema_50 < wilder_200)"
_st_up, _st_down = "(before <= st_down_before and close > st_down_2)", "(before >= st_up_before and close < st_up_2)"
_st_quiet = f"not coalesce({_st_up}, false) and not coalesce({_st_down}, false) and least(greatest(st_down_2 - close, 0), greatest(close - st_up_2, 0)) <= 0.5 * atr_14"
_st_long = "greatest(st_down_2 - close, 0) < greatest(close - st_up_2, 0)"
_wilder_quiet = f"not {_up} and not {_down} and abs(ema_50 - wilder_200) <= 0.5 * atr_14"
_outside = "bb_up_2 > kc_up or bb_down_2 < kc_down"
_atr = ("adx", "atr_14")


def _cross_of_moves(name: str, n: int) -> Setup:
    long = ("di_plus_before <= di_minus_before and di_plus > di_minus", "adx > 20", f"close > ema_{n}")
    short = ("di_plus_before >= di_minus_before and di_plus < di_minus", "adx > 20", f"close < ema_{n}")
    return Setup(name, n + 5, ("di_plus", *_atr), _atrs(2), 1.5, met=(long, short))


# The setups' thresholds.
SETUPS = (
    Setup("A1", 22, _atr, _atrs(2), 1.0, 2.0, met=(("close > high_20", "adx > 20", "close > ema_50", "volume > 1.5 * volume_20"), ("close < low_20", "adx > 20", "close < ema_50", "volume > 1.5 * volume_20"))),
    Setup("A2", 110, ("atr_14",), _atrs(1.5), 1.0, met=(("close > ema_100", "close < ema_20", "rsi_14 < 45"), ("close < ema_100", "close > ema_20", "rsi_14 > 55"))),
    Setup("A3", 92, ("atr_14", "bb_width_2"), ("bottom_5", "top_5"), 2.0, 3.0, met=(("width_rank < 25", "inside_10 >= 5", "close > top_5", "volume >= 2 * volume_20"), ("width_rank < 25", "inside_10 >= 5", "close < bottom_5", "volume >= 2 * volume_20"))),
    Setup("A4", 20, ("atr_14", "bb_up_2", "kc_up"), ("greatest(close - 2 * atr_14, kc_down)", "least(close + 2 * atr_14, kc_up)"), 1.0, 2.0,
          met=(("inside_20 >= 3", _outside, "macd_hist > 0 and macd_hist > hist_before"), ("inside_20 >= 3", _outside, "macd_hist < 0 and macd_hist < hist_before"))),
    Setup("A5", 56, ("atr_14",), _atrs(2), ("bottom_20", "top_20"), fired=("close > top_55", "close < bottom_55"),
          near=("least(top_55 - close, close - bottom_55) <= 0.5 * atr_14 and top_55 - close <= close - bottom_55", "least(top_55 - close, close - bottom_55) <= 0.5 * atr_14")),
    Setup("A6", 205, _atr, _atrs(3), 1.5, fired=(f"{_up} and adx > 18", f"{_down} and adx > 18"), approaching=(_up, _down), near=(f"{_wilder_quiet} and ema_50 > wilder_200", _wilder_quiet)),
    Setup("A8", 80, ("atr_14", "span_a", "span_b"), ("kijun", "kijun"), ("close + 0.5 * abs(span_a - span_b)", "close - 0.5 * abs(span_a - span_b)"), ("close + abs(span_a - span_b)", "close - abs(span_a - span_b)"),
          met=(("close > greatest(span_a, span_b)", "tenkan > kijun", "close > close_26"), ("close < least(span_a, span_b)", "tenkan < kijun", "close < close_26"))),
    Setup("A10", 110, ("atr_14",), ("ema_50", "ema_50"), 1.5, fired=("rising = 5 and rising_before < 5", "falling = 5 and falling_before < 5"), near=("rising = 4", "falling = 4"), approaching=("rising in (3, 5)", "falling in (3, 5)")),
    Setup("A11", 20, _atr, ("st_up_2", "st_down_2"), 2.0, fired=(f"{_st_up} and adx > 18", f"{_st_down} and adx > 18"), approaching=(_st_up, _st_down), near=(f"{_st_quiet} and {_st_long}", _st_quiet)),
    _cross_of_moves("A12a", 20),
    _cross_of_moves("A12b", 50),
    Setup("B1", 22, ("adx", "bb_up_2"), ("bb_down_3", "bb_up_3"), ("mean_20", "mean_20"), ("bb_up_2", "bb_down_2"), met=(("close <= bb_down_2", "adx < 20", "bullish"), ("close >= bb_up_2", "adx < 20", "bearish"))),
    Setup("B3", 22, ("atr_14",), _atrs(1.5), 1.0, met=(("close <= bottom_20", "bullish", "body >= 0.5"), ("close >= top_20", "bearish", "body <= -0.5"))),
    Setup("B5", 52, ("adx", "z20", "z50", "sd_20"), ("mean_20 - 3 * sd_20", "mean_20 + 3 * sd_20"), ("mean_20", "mean_20"), met=(("z20 < -2", "z50 < -1.5", "adx < 25"), ("z20 > 2", "z50 > 1.5", "adx < 25"))),
    Setup("B6", 10, ("atr_14", "z_return"), _atrs(2), 1.0, fired=("z_return < -2.5", "z_return > 2.5"), near=("z_return between -2.5 and -2", "z_return between 2 and 2.5"), approaching=("z_return > -2 and z_return <= -1.5", "z_return >= 1.5 and z_return < 2")),
    Setup("B10", 92, ("volume_z", "range_z", "bb_up_2"), ("low", "high"), ("ema_20", "ema_20"), met=(("volume_z >= 3", "range_z >= 2", "place <= 0.25", "close < bb_down_2"), ("volume_z >= 3", "range_z >= 2", "place >= 0.75", "close > bb_up_2"))),
    _stretch("B11", 62, "z60", "half_life < 30", "mean_60", "sd_60"),
    Setup("C4", 2, ("z60",), ("mean_60 - 3 * sd_60", "mean_60 + 3 * sd_60"), ("mean_60", "mean_60"), fired=("z60 <= -2", "z60 >= 2"), near=("z60 <= -1.5", "z60 >= 1.5"), approaching=("z60 > -1.5 and z60 <= -1", "z60 >= 1 and z60 < 1.5")),
)


def _holds(c: str) -> Column:
    return F.coalesce(F.expr(c), F.lit(False))


def _grades(s: Setup) -> list[Column]:
    """What holds on a side: how many conditions, or 3 for fired, 2 for approaching, 1 for near."""
    if s.met:
        return [sum((_holds(c).cast("int") for c in side), F.lit(0)) for side in s.met]
    return [F.when(_holds(a), 3).when(_holds(b), 2).when(_holds(c), 1).otherwise(0) for a, b, c in zip(s.fired, s.approaching, s.near)]


def _facts(s: Setup) -> Column:
    """A setup's part of a bar: all that state, side and levels then follow from, in the same columns for every setup."""
    ready = F.col("i") > s.history
    for c in s.needs:
        ready = ready & F.col(c).isNotNull()
    long, short = _grades(s)
    prices = {"stops": s.stop} | {f"{k}_prices": v for k, v in (("first", s.first), ("second", s.second)) if isinstance(v, tuple)}
    fixed = {f"{k}_prices": F.lit(None).cast("array<double>") for k in ("first", "second") if f"{k}_prices" not in prices}
    multiples = {f"{k}_multiple": F.lit(None if isinstance(v, tuple) else v).cast("double") for k, v in (("first", s.first), ("second", s.second))}
    facts = {"setup": F.lit(s.name), "ready": ready, "total": F.lit(len(s.met[0]) if s.met else None).cast("int"), "long": long, "short": short}
    facts |= {k: F.array(*(F.expr(c).cast("double") for c in v)) for k, v in prices.items()} | fixed | multiples
    return F.struct(*(facts[k].alias(k) for k in ("setup", "ready", "total", "long", "short", "stops", "first_prices", "second_prices", "first_multiple", "second_multiple")))


def setup_states(panel: DataFrame, multiplier: Column | None = None, setups: tuple[Setup, ...] = SETUPS) -> DataFrame:
    """symbol, bar_date, setup, state, side, entry, stop, first and second: a row per bar and setup.

    State is FIRED, NEAR, APPROACHING or FAR, and N/A while history or an indicator lacks. Side is null where state is FAR
    or N/A. Levels belong to what fired, and are null where the stop is not beyond the entry; with a ``multiplier`` (basis
    points a unit of price) they are rounded to half a basis point, entry and stop before targets are taken from them.
    """
    ticks = (lambda c: c) if multiplier is None else (lambda c: L.round_to_tick(c, F.col("_multiplier")))
    kept = [F.col("close").cast("double").alias("close")] + ([] if multiplier is None else [multiplier.alias("_multiplier")])
    x = panel.select("symbol", "bar_date", *kept, F.inline(F.array(*(_facts(s) for s in setups))))
    better, total = F.greatest("long", "short"), F.col("total")
    counted = F.when(better == total, "FIRED").when(better == total - 1, "NEAR").when(better >= F.floor((total + 1) / 2), "APPROACHING").otherwise("FAR")
    staged = F.when(better == 3, "FIRED").when(better == 2, "APPROACHING").when(better == 1, "NEAR").otherwise("FAR")
    is_long = F.col("long") >= F.col("short")
    x = x.withColumn("state", F.when(~F.col("ready"), "N/A").when(total.isNotNull(), counted).otherwise(staged))
    x = x.withColumns({"side": F.when(~F.col("state").isin("N/A", "FAR"), F.when(is_long, "LONG").otherwise("SHORT")), "_k": F.when(is_long, 0).otherwise(1)})
    x = x.withColumns({"entry": ticks(F.col("close")), "stop": ticks(F.get("stops", "_k"))})
    beyond = (F.col("state") == "FIRED") & F.when(is_long, F.col("entry") > F.col("stop")).otherwise(F.col("entry") < F.col("stop"))
    target = lambda k: ticks(F.coalesce(F.get(f"{k}_prices", "_k"), F.col("entry") + F.col(f"{k}_multiple") * (F.col("entry") - F.col("stop"))))
    levels = {"entry": F.col("entry"), "stop": F.col("stop"), "first": target("first"), "second": target("second")}
    return x.select("symbol", "bar_date", "setup", "state", "side", *(F.when(beyond, v).alias(k) for k, v in levels.items()))
