"""The setups of every bar as a query, and how they fared, with their SQL.

The SQL computes all indicators on its own, the recursions row by row; the thresholds are the ones of ``operators.setups``,
which a test holds against plain loops.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.operators import setups as O
from ratelake.plans.registry import BARS, SERIES, prior, query, r, trailing
from ratelake.sources.bars import order_bars

ALPHAS = {f"ema_{n}": f"2.0 / {n + 1}" for n in O.MEANS} | {"wilder_200": "1.0 / 200", "fast": "2.0 / 13", "slow": "2.0 / 27"}


def _full(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {trailing(n)} = {n} THEN {f} OVER {trailing(n)} END"


def _next(name: str) -> str:
    return f"(e.{name} + (n.close - e.{name}) * {ALPHAS[name]})"


def _z(x: str, n: int, least: int, tiny: bool) -> str:
    below = f"(stddev_samp({x}) OVER {trailing(n)} + 1e-9)" if tiny else f"nullif(stddev_samp({x}) OVER {trailing(n)}, 0)"
    return f"CASE WHEN count({x}) OVER {trailing(n)} >= {least} THEN ({x} - avg({x}) OVER {trailing(n)}) / {below} END"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {SERIES}"


def _ribbon(sign: str) -> str:
    return " + ".join(f"(ema_{a} {sign} ema_{b})::INT" for a, b in zip(O.MEANS, O.MEANS[1:]))


PANEL = f"""WITH RECURSIVE {BARS}, n AS (
  SELECT *, row_number() OVER {SERIES} AS i, coalesce(close - {_lag("close")}, 0) AS change FROM bars
), e AS (
  SELECT symbol, i, {", ".join(f"close AS {c}" for c in ALPHAS)}, 0::DOUBLE AS signal, 0::DOUBLE AS up, 0::DOUBLE AS down FROM n WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.i, {", ".join(f"{_next(c)} AS {c}" for c in ALPHAS)}, e.signal + ({_next("fast")} - {_next("slow")} - e.signal) * 0.2,
    e.up + (greatest(n.change, 0) - e.up) / 14, e.down + (greatest(-n.change, 0) - e.down) / 14
  FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1
), b AS (
  SELECT n.*, e.* EXCLUDE (symbol, i, up, down, fast, slow, signal), fast - slow - signal AS macd_hist, 100 - 100 / (1 + up / (down + 1e-9)) AS rsi_14, {_lag("close")} AS before,
    greatest(high - low, abs(high - {_lag("close")}), abs(low - {_lag("close")})) AS tr, high - {_lag("high")} AS rise, {_lag("low")} - low AS fall
  FROM n JOIN e USING (symbol, i)
), d AS (
  SELECT *, CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0 END AS pdm, CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0 END AS mdm, close / before - 1 AS gain,
    {", ".join(f"{_full('avg(tr)', 'tr', n)} AS atr_{n}" for n in (10, 14, 20))}, {_full("avg(close)", "close", 20)} AS mean_20, {_full("stddev_samp(close)", "close", 20)} AS s,
    {", ".join(f"{_full(f'(max(high) OVER {trailing(n)} + min(low)', 'high', n).replace(f'min(low) OVER {trailing(n)}', f'min(low) OVER {trailing(n)}) / 2')} AS {name}" for name, n in (("tenkan", 9), ("kijun", 26), ("wide", 52)))}
  FROM b
), g AS (
  SELECT *, 100 * ({_full("sum(pdm)", "pdm", 14)}) / nullif(atr_14, 0) AS di_plus, 100 * ({_full("sum(mdm)", "mdm", 14)}) / nullif(atr_14, 0) AS di_minus,
    {", ".join(f"mean_20 + {k} * s AS bb_up_{k}, mean_20 - {k} * s AS bb_down_{k}" for k in (2, 3))}, 4 * s / nullif(mean_20, 0) AS bb_width_2, ema_20 + 2 * atr_20 AS kc_up, ema_20 - 2 * atr_20 AS kc_down,
    (high + low) / 2 + 2 * atr_10 AS st_up_2, (high + low) / 2 - 2 * atr_10 AS st_down_2, {_ribbon(">")} AS rising, {_ribbon("<")} AS falling
  FROM d
), h AS (
  SELECT *, 100 * abs(di_plus - di_minus) / (di_plus + di_minus + 1e-9) AS dx, coalesce(bb_up_2 <= kc_up AND bb_down_2 >= kc_down, false)::INT AS inside, list(bb_width_2) OVER {prior(89)} AS widths FROM g
), k AS (
  SELECT *, {_full("avg(dx)", "dx", 14)} AS adx, CASE WHEN count(bb_width_2) OVER {trailing(90)} >= 22 THEN 100.0 * len(list_filter(widths, lambda v: v < bb_width_2)) / nullif(len(list_filter(widths, lambda v: v IS NOT NULL)), 0) END AS rank FROM h
), p AS (
  SELECT *, max(high) OVER {prior(20)} AS high_20, min(low) OVER {prior(20)} AS low_20, avg(volume) OVER {prior(20)} AS volume_20,
    {", ".join(f"max(close) OVER {prior(n)} AS top_{n}, min(close) OVER {prior(n)} AS bottom_{n}" for n in (5, 20, 55))}, sum(inside) OVER {prior(10)} AS inside_10, sum(inside) OVER {prior(20)} AS inside_20,
    stddev_samp(close) OVER {prior(20)} AS sd_20, avg(close) OVER {prior(60)} AS mean_60, stddev_samp(close) OVER {prior(60)} AS sd_60,
    {_z("close", 20, 20, True)} AS z20, {_z("close", 50, 50, True)} AS z50, {_z("gain", 5, 5, True)} AS z_return, {_z("volume", 90, 22, False)} AS volume_z, {_z("tr", 90, 22, False)} AS range_z,
    {_lag("rank")} AS width_rank, lag((tenkan + kijun) / 2, 26) OVER {SERIES} AS span_a, {_lag("wide", 26)} AS span_b, {_lag("close", 26)} AS close_26,
    {", ".join(f"{_lag(c)} AS {name}" for c, name in {"macd_hist": "hist_before", "ema_50": "ema_50_before", "wilder_200": "wilder_before", "di_plus": "di_plus_before", "di_minus": "di_minus_before", "st_up_2": "st_up_before", "st_down_2": "st_down_before", "rising": "rising_before", "falling": "falling_before"}.items())},
    min(close) OVER {prior(19)} AS lowest, arg_min(rsi_14, (close, i)) OVER {prior(19)} AS rsi_low, max(close) OVER {prior(19)} AS highest, arg_min(rsi_14, (-close, i)) OVER {prior(19)} AS rsi_high, regr_slope(close, before) OVER {prior(89)} AS slope
  FROM k
), x AS (
  SELECT *, i > 20 AND close <= lowest AND rsi_14 > rsi_low AS bullish, i > 20 AND close >= highest AND rsi_14 < rsi_high AS bearish, CASE WHEN slope > 0 AND slope < 1 THEN -ln(2) / ln(slope) END AS half_life,
    (close - mean_60) / nullif(sd_60, 0) AS z60, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS place, (close - open) / greatest(high - low, 1e-9) AS body
  FROM p
)"""


def _count(conditions: tuple[str, ...]) -> str:
    return " + ".join(f"coalesce({c}, false)::INT" for c in conditions)


def _row(s: O.Setup) -> str:
    if s.met:
        long, short, n = *(f"({_count(c)})" for c in s.met), len(s.met[0])
        state = f"CASE greatest({long}, {short}) WHEN {n} THEN 'FIRED' WHEN {n - 1} THEN 'NEAR' ELSE CASE WHEN greatest({long}, {short}) >= {(n + 1) // 2} THEN 'APPROACHING' ELSE 'FAR' END END"
        side = f"CASE WHEN {long} >= {short} THEN 'LONG' ELSE 'SHORT' END"
    else:
        stages = [(stage, getattr(s, stage)) for stage in ("fired", "approaching", "near")]
        state = "CASE " + " ".join(f"WHEN ({a}) OR ({b}) THEN '{stage.upper()}'" for stage, (a, b) in stages) + " ELSE 'FAR' END"
        side = "CASE " + " ".join(f"WHEN {a} THEN 'LONG' WHEN {b} THEN 'SHORT'" for _, (a, b) in stages) + " END"
    ready = " AND ".join([f"i > {s.history}", *(f"{c} IS NOT NULL" for c in s.needs)])
    target = lambda rule: "NULL::DOUBLE, NULL::DOUBLE" if rule is None else ", ".join(rule) if isinstance(rule, tuple) else ", ".join(f"close + {rule} * (close - ({c}))" for c in s.stop)
    return f"{{'setup': '{s.name}', 'ready': {ready}, 'state': {state}, 'side': {side}, 'stops': [{', '.join(s.stop)}], 'firsts': [{target(s.first)}], 'seconds': [{target(s.second)}]}}"


LEVELS = ("entry", "stop", "first", "second")


@query(
    PANEL
    + f""", u AS (
  SELECT symbol, bar_date, close, unnest([{", ".join(_row(s) for s in O.SETUPS)}]) AS f FROM x
), v AS (
  SELECT symbol, bar_date, f.setup AS setup, f.state AS state, f.side AS side, close AS entry, CASE f.side WHEN 'LONG' THEN 1 ELSE 2 END AS k, f.stops[k] AS stop, f.firsts[k] AS first, f.seconds[k] AS second,
    f.state = 'FIRED' AND CASE f.side WHEN 'LONG' THEN close > f.stops[k] ELSE close < f.stops[k] END AS levels
  FROM u WHERE f.ready AND f.state <> 'FAR'
)
SELECT symbol, bar_date, setup, state, side, {", ".join(f"round(CASE WHEN levels THEN {c} END::DECIMAL(24, 7), 4)::DOUBLE AS {c}" for c in LEVELS)} FROM v"""
)
def setup_scan(spark, root):
    """Every bar at which a setup has fired, is near or approaches, with the levels of what fired."""
    x = O.setup_states(O.setup_panel(order_bars(spark, root))).where("state in ('FIRED', 'NEAR', 'APPROACHING')")
    return x.select("symbol", "bar_date", "setup", "state", "side", *(r(F.round(c, 7), c, 4) for c in LEVELS))
