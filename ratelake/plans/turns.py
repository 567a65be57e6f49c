"""Queries on the directional system, on the turns of the calendar and on what they do to changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.functions import calendar as C
from ratelake.functions import series as S
from ratelake.operators import directional, regression
from ratelake.plans.registry import BARS, SERIES, query, r, trailing
from ratelake.sources.bars import order_bars


def _full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {trailing(n)} = {n} THEN {f} OVER {trailing(n)} END"


COLUMNS = ["atr_14", "di_plus", "di_minus", "adx", "aroon_up", "aroon_down", "cci", "range_20_over_atr", "bb_up_2", "bb_place_2", "st_up_3", "st_down_3"]


@query(f"""
WITH {BARS}, m AS (
  SELECT *, high - lag(high) OVER {SERIES} AS up, lag(low) OVER {SERIES} - low AS down, row_number() OVER {SERIES} AS i, (high + low + close) / 3 AS typical, lag(close) OVER {SERIES} AS before,
    greatest(high - low, abs(high - lag(close) OVER {SERIES}), abs(low - lag(close) OVER {SERIES})) AS tr
  FROM bars
), d AS (
  SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm, {", ".join(f"{_full('avg(tr)', 'tr', n)} AS atr_{n}" for n in (10, 14, 20))},
    {_full("avg(close)", "close", 20)} AS m, {_full("stddev_samp(close)", "close", 20)} AS s, {_full("avg(typical)", "typical", 20)} AS tm, list(typical) OVER {trailing(20)} AS seen
  FROM m
), e AS (
  SELECT *, 100 * ({_full("sum(pdm)", "pdm", 14)}) / nullif(atr_14, 0) AS di_plus, 100 * ({_full("sum(mdm)", "mdm", 14)}) / nullif(atr_14, 0) AS di_minus FROM d
), g AS (
  SELECT *, 100 * abs(di_plus - di_minus) / (di_plus + di_minus + 1e-9) AS dx FROM e
), h AS (
  SELECT *, {_full("avg(dx)", "dx", 14)} AS adx,
    CASE WHEN count(*) OVER {trailing(15)} = 15 THEN 100.0 * (14 - (i - arg_min(i, (-high, i)) OVER {trailing(15)})) / 14 END AS aroon_up,
    CASE WHEN count(*) OVER {trailing(15)} = 15 THEN 100.0 * (14 - (i - arg_min(i, (low, i)) OVER {trailing(15)})) / 14 END AS aroon_down,
    (typical - tm) / (0.015 * list_sum(list_transform(seen, lambda v: abs(v - tm))) / 20 + 1e-9) AS cci,
    ({_full("max(high)", "high", 20)} - {_full("min(low)", "low", 20)}) / (atr_20 + 1e-9) AS range_20_over_atr,
    m + 2 * s AS bb_up_2, (close - m + 2 * s) / (4 * s + 1e-9) AS bb_place_2, (high + low) / 2 + 3 * atr_10 AS st_up_3, (high + low) / 2 - 3 * atr_10 AS st_down_3,
    sum(CASE WHEN close > before THEN volume WHEN close < before THEN -volume ELSE 0 END) OVER {SERIES} AS obv
  FROM g
)
SELECT symbol, bar_date, obv::BIGINT AS obv, {", ".join(f"round({c}, 4) AS {c}" for c in COLUMNS)} FROM h
""")
def directional_system(spark, root):
    """True ranges, directional movement, Aroon, CCI, volume flow and bands of every bar."""
    x = directional.bands(directional.oscillators(directional.directional(order_bars(spark, root))))
    return x.select("symbol", "bar_date", "obv", *(r(F.col(c), c, 4) for c in COLUMNS))


TURNS = {"quarter": C.quarter_turn, "year": C.year_turn, "payroll": C.payroll_week}


@query("""
WITH d AS (
  SELECT DISTINCT o_orderdate::DATE AS day FROM orders
), c AS (
  SELECT day, last_day(day) AS ends, date_trunc('month', day)::DATE AS begins FROM d
), n AS (
  SELECT *, (SELECT count(*) FROM range(day::TIMESTAMP, ends + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS to_come, (SELECT count(*) FROM range(begins::TIMESTAMP, day + INTERVAL 1 DAY, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS gone FROM c
)
SELECT day, month(day) IN (3, 6, 9) AND isodow(day) < 6 AND to_come <= 5 AS quarter, isodow(day) < 6 AND (month(day) = 12 AND to_come <= 10 OR month(day) = 1 AND gone <= 5) AS year, day(date_trunc('week', day) + INTERVAL 4 DAY) <= 7 AS payroll FROM n
""")
def turn_calendar(spark, root):
    """Days of orders at the turns of quarters and years, and in the weeks of the monthly jobs report."""
    days = order_bars(spark, root).select(F.col("bar_date").alias("day")).distinct()
    return days.select("day", *(f(F.col("day")).alias(c) for c, f in TURNS.items()))


def turn_design(spark, root):
    w = S.ordered()
    x = order_bars(spark, root).withColumn("change", (F.col("close") - F.lag("close").over(w)) / 1000)
    x = x.withColumns({c: f(F.col("bar_date")).cast("int") for c, f in TURNS.items()})
    return regression.design(x, ["symbol"], "bar_date", "change", list(TURNS))


@query()
def turn_effects(spark, root):
    """What the calendar's turns do to a series' changes, with errors that allow for autocorrelation."""
    fit = regression.hac_fit(turn_design(spark, root), ["symbol"], "bar_date", 1 + len(TURNS))
    x = regression.coefficients(fit, ["symbol"], list(TURNS))
    return x.select("symbol", "regressor", "n", F.col("fires").cast("long").alias("fires"), "low_sample", *(r(F.col(c), c) for c in ("beta", "error", "p", "r_squared")))


@query()
def turn_adjusted_changes(spark, root):
    """Changes of every bar without what the calendar's turns do to them."""
    d = turn_design(spark, root)
    fit = regression.hac_fit(d, ["symbol"], "bar_date", 1 + len(TURNS))
    x = regression.adjusted(d, fit, ["symbol"], "bar_date")
    return x.select("symbol", "bar_date", r(F.col("y"), "change", 4), r(F.col("adjusted"), "adjusted", 4))
