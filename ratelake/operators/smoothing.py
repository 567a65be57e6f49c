"""Exponential smoothing and what is built on it: recursions, so each series is one group of a grouped map.

A group holds one symbol's bars, whose number is bounded by the calendar, not by the facts below them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def smoothed(bars: DataFrame, column: str = "close", periods: tuple[int, ...] = (20,)) -> DataFrame:
    """symbol, bar_date and ema_<p> with the weight 1/p for the newest row, from the first row on."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bar_date")
        return pd.DataFrame({"symbol": x["symbol"], "bar_date": x["bar_date"]} | {f"ema_{p}": x[column].ewm(alpha=1 / p, adjust=False).mean() for p in periods})

    return bars.select("symbol", "bar_date", column).groupBy("symbol").applyInPandas(run, "symbol string, bar_date date, " + ", ".join(f"ema_{p} double" for p in periods))


def relative_strength(bars: DataFrame, period: int = 14) -> DataFrame:
    """symbol, bar_date and rsi: smoothed gains against smoothed losses, 50 where there was no loss, null in the first ``period`` rows."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bar_date")
        change = x["close"].diff().fillna(0.0)
        up, down = (s.ewm(alpha=1 / period, adjust=False).mean() for s in (change.clip(lower=0), -change.clip(upper=0)))
        rsi = (100 - 100 / (1 + up / down.where(down != 0))).fillna(50.0)
        rsi.iloc[:period] = None
        return pd.DataFrame({"symbol": x["symbol"], "bar_date": x["bar_date"], "rsi": rsi})

    return bars.select("symbol", "bar_date", "close").groupBy("symbol").applyInPandas(run, "symbol string, bar_date date, rsi double")


def stack(bars: DataFrame) -> DataFrame:
    """symbol, bar_date, ema_200 (weight 1/200, from 100 rows on), ema_50 (weight 2/51), rsi_14 and rsi_2.

    An RSI starts with the first change, needs max(2, half its period) of them, and is 50 where it has no value.
    """

    def strength(close: pd.Series, period: int) -> pd.Series:
        change = close.diff()
        least = max(2, period // 2)
        up, down = (x.ewm(alpha=1 / period, adjust=False, min_periods=least).mean() for x in (change.clip(lower=0), -change.clip(upper=0)))
        return (100 - 100 / (1 + up / down.where(down != 0))).fillna(50.0)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bar_date")
        close = x["close"]
        return pd.DataFrame({"symbol": x["symbol"], "bar_date": x["bar_date"], "ema_200": close.ewm(alpha=1 / 200, adjust=False, min_periods=100).mean(), "ema_50": close.ewm(span=50, adjust=False).mean(), "rsi_14": strength(close, 14), "rsi_2": strength(close, 2)})

    return bars.select("symbol", "bar_date", "close").groupBy("symbol").applyInPandas(run, "symbol string, bar_date date, ema_200 double, ema_50 double, rsi_14 double, rsi_2 double")
