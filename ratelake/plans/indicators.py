"""Queries on indicators of bars: rolling statistics, smoothed indicators, proximity to extremes, momentum, correlation, detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.functions import levels as L
from ratelake.functions import series as S
from ratelake.operators import smoothing
from ratelake.plans.registry import BARS, SERIES, prior, query, r, trailing
from ratelake.sources.bars import order_bars

P = "PARTITION BY symbol ORDER BY bar_date"
TR = f"t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {SERIES}), abs(low - lag(close) OVER {SERIES})) AS tr FROM bars)"


def mid(n: int) -> str:
    return f"CASE WHEN count(*) OVER {trailing(n)} >= {n} THEN (max(high) OVER {trailing(n)} + min(low) OVER {trailing(n)}) / 2 END"


def far(x: str, sign: str) -> str:
    before, after = (f"({P} ROWS BETWEEN {a})" for a in ("5 PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND 5 FOLLOWING"))
    f = "max" if sign == ">" else "min"
    return f"(count(*) OVER {before} = 5 AND count(*) OVER {after} = 5 AND coalesce({x} {sign} {f}({x}) OVER {before} AND {x} {sign} {f}({x}) OVER {after}, false))"


@query(f"""WITH {BARS}, {TR}, x AS (SELECT *, {mid(9)} AS tenkan, {mid(26)} AS kijun, {mid(52)} AS wide, list(close) OVER {prior(89)} AS seen, avg(close) OVER {trailing(20)} AS m20, stddev_samp(close) OVER {trailing(20)} AS s20, avg(tr) OVER {trailing(20)} AS a20 FROM t), y AS (SELECT *, coalesce(m20 + 2 * s20 <= m20 + 1.5 * a20, false)::INT AS inside FROM x) SELECT symbol, bar_date, round(CASE WHEN len(seen) >= 21 THEN 100.0 * len(list_filter(seen, lambda v: v < close)) / len(seen) END, 4) AS rank_90, round(CASE WHEN count(tr) OVER {trailing(90)} >= 22 AND stddev_samp(tr) OVER {trailing(90)} <> 0 THEN (tr - avg(tr) OVER {trailing(90)}) / stddev_samp(tr) OVER {trailing(90)} END, 4) AS tr_z, round(tenkan, 4) AS tenkan, round(kijun, 4) AS kijun, round(lag((tenkan + kijun) / 2, 26) OVER {SERIES}, 4) AS span_a, round(lag(wide, 26) OVER {SERIES}, 4) AS span_b, lead(close, 26) OVER {SERIES} AS chikou, CASE WHEN count(*) OVER {trailing(55)} >= 27 THEN max(close) OVER {trailing(55)} END AS high_55, CASE WHEN count(*) OVER {trailing(55)} >= 27 THEN min(close) OVER {trailing(55)} END AS low_55, sum(inside) OVER {trailing(10)} AS squeeze, {far('high', '>')} AS swing_high, {far('low', '<')} AS swing_low FROM y""")
def indicator_stack(spark, root):
    x = order_bars(spark, root).withColumn("tr", S.true_range())
    w20, w55 = S.trailing(20), S.trailing(55)
    x = x.withColumns({"tenkan": S.middle(9), "kijun": S.middle(26), "wide": S.middle(52), "m": F.avg("close").over(w20), "s": F.stddev_samp("close").over(w20), "a": F.avg("tr").over(w20)})
    x = x.withColumn("inside", F.coalesce(F.col("m") + 2 * F.col("s") <= F.col("m") + 1.5 * F.col("a"), F.lit(False)).cast("int"))
    back = lambda c: F.lag(c, 26).over(S.ordered())
    return x.select("symbol", "bar_date", r(S.rolling_rank("close", 90), "rank_90", 4), r(S.window_z("tr", 90, 22), "tr_z", 4), r(F.col("tenkan"), "tenkan", 4), r(F.col("kijun"), "kijun", 4), r(back((F.col("tenkan") + F.col("kijun")) / 2), "span_a", 4), r(back("wide"), "span_b", 4), F.lead("close", 26).over(S.ordered()).alias("chikou"), S.guarded(F.max("close").over(w55), "close", w55, 27).alias("high_55"), S.guarded(F.min("close").over(w55), "close", w55, 27).alias("low_55"), F.sum("inside").over(S.trailing(10)).alias("squeeze"), S.swing("high", 1).alias("swing_high"), S.swing("low", -1).alias("swing_low"))


def wilder(name: str, x: str, p: int) -> str:
    return f"e.{name} * (1 - 1 / {p}) + n.{x} / {p}"


@query(f"""WITH RECURSIVE {BARS}, {TR}, n AS (SELECT symbol, bar_date, close, tr, row_number() OVER {SERIES} AS i, greatest(close - lag(close) OVER {SERIES}, 0) AS up, greatest(lag(close) OVER {SERIES} - close, 0) AS down FROM t), e AS (SELECT symbol, bar_date, i, close AS e200, close AS e50, 0::DOUBLE AS u14, 0::DOUBLE AS d14, 0::DOUBLE AS u2, 0::DOUBLE AS d2 FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.bar_date, n.i, {wilder('e200', 'close', 200)}, e.e50 * (1 - 2 / 51) + n.close * 2 / 51, CASE WHEN n.i = 2 THEN n.up ELSE {wilder('u14', 'up', 14)} END, CASE WHEN n.i = 2 THEN n.down ELSE {wilder('d14', 'down', 14)} END, CASE WHEN n.i = 2 THEN n.up ELSE {wilder('u2', 'up', 2)} END, CASE WHEN n.i = 2 THEN n.down ELSE {wilder('d2', 'down', 2)} END FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) SELECT symbol, bar_date, round(CASE WHEN i >= 100 THEN e200 END, 4) AS ema_200, round(e50, 4) AS ema_50, round(CASE WHEN i - 1 >= 7 AND d14 <> 0 THEN 100 - 100 / (1 + u14 / d14) ELSE 50 END, 4) AS rsi_14, round(CASE WHEN i - 1 >= 2 AND d2 <> 0 THEN 100 - 100 / (1 + u2 / d2) ELSE 50 END, 4) AS rsi_2 FROM e""")
def wilder_stack(spark, root):
    return smoothing.stack(order_bars(spark, root)).select("symbol", "bar_date", r(F.nanvl("ema_200", F.lit(None)), "ema_200", 4), r(F.col("ema_50"), "ema_50", 4), r(F.col("rsi_14"), "rsi_14", 4), r(F.col("rsi_2"), "rsi_2", 4))


@query(f"""WITH {BARS}, {TR}, a AS (SELECT *, CASE WHEN count(tr) OVER {trailing(14)} >= 7 THEN avg(tr) OVER {trailing(14)} END AS atr0 FROM t), b AS (SELECT *, lag(atr0) OVER {SERIES} AS atr, max(close) OVER {prior(20)} AS hi, min(close) OVER {prior(20)} AS lo, max(close) OVER {prior(20)} - min(close) OVER {prior(20)} AS span, max(close) OVER ({P} ROWS BETWEEN 40 PRECEDING AND 21 PRECEDING) - min(close) OVER ({P} ROWS BETWEEN 40 PRECEDING AND 21 PRECEDING) AS span0, list(close) OVER {prior(20)} AS seen FROM a), c AS (SELECT *, (hi - close) / atr AS away, (close - lo) / span AS position FROM b), d AS (SELECT *, coalesce(abs(away) <= 0.5, false) AS near_high, row_number() OVER {SERIES} AS i FROM c) SELECT symbol, bar_date, round(away, 4) AS high_distance, round((close - lo) / atr, 4) AS low_distance, round(CASE WHEN span <> 0 THEN position END, 4) AS position, CASE WHEN away < 0 THEN 'BROKEN' WHEN away <= 0.25 THEN 'AT' WHEN away <= 0.5 THEN 'NEAR' WHEN away <= 1 THEN 'APPROACHING' ELSE 'FAR' END AS high_flag, round((lag(away, 5) OVER {SERIES} - away) / 5, 4) + 0.0 AS velocity, coalesce(len(list_filter(seen, lambda v: abs(v - hi) <= 0.25 * atr)), 0)::INTEGER AS touches, coalesce(max(near_high::INT) OVER {prior(3)}, 0) = 1 AND coalesce(away >= 0.5, false) AS failed_break, round(CASE WHEN span0 <> 0 THEN span / span0 END, 4) AS expansion, (i - coalesce(max(CASE WHEN NOT near_high THEN i END) OVER ({P} ROWS UNBOUNDED PRECEDING), 0))::INTEGER AS streak FROM d""")
def proximity_panel(spark, root):
    x = order_bars(spark, root).withColumn("tr", S.true_range()).withColumn("atr0", S.mean_if("tr", 14, 7))
    w, before = S.prior(20), S.ordered().rowsBetween(-40, -21)
    x = x.withColumns({"atr": F.lag("atr0").over(S.ordered()), "hi": F.max("close").over(w), "lo": F.min("close").over(w), "span0": F.max("close").over(before) - F.min("close").over(before)})
    x = x.withColumns({"span": F.col("hi") - F.col("lo"), "away": S.safe_ratio(F.col("hi") - F.col("close"), F.col("atr")), "touches": S.touches("close", 20, 0.25 * F.col("atr"), True)})
    x = S.streaks(x.withColumn("near_high", F.coalesce(F.abs("away") <= 0.5, F.lit(False))), "near_high")
    flag = F.when(F.col("away") < 0, "BROKEN").when(F.col("away") <= 0.25, "AT").when(F.col("away") <= 0.5, "NEAR").when(F.col("away") <= 1, "APPROACHING").otherwise("FAR")
    failed = (F.coalesce(F.max(F.col("near_high").cast("int")).over(S.prior(3)), F.lit(0)) == 1) & F.coalesce(F.col("away") >= 0.5, F.lit(False))
    return x.select("symbol", "bar_date", r(F.col("away"), "high_distance", 4), r(S.safe_ratio(F.col("close") - F.col("lo"), F.col("atr")), "low_distance", 4), r(S.safe_ratio(F.col("close") - F.col("lo"), F.col("span")), "position", 4), flag.alias("high_flag"), r((F.lag("away", 5).over(S.ordered()) - F.col("away")) / 5, "velocity", 4), "touches", failed.alias("failed_break"), r(S.safe_ratio(F.col("span"), F.col("span0")), "expansion", 4), F.col("streak").cast("int").alias("streak"))


@query(f"""WITH {BARS}, d AS (SELECT *, close - lag(close) OVER {SERIES} AS change, lag(close, 21) OVER {SERIES} / lag(close, 252) OVER {SERIES} - 1 AS momentum FROM bars) SELECT symbol, bar_date, round(momentum, 6) AS momentum, round(CASE WHEN count(momentum) OVER {trailing(252)} >= 20 AND stddev_samp(momentum) OVER {trailing(252)} <> 0 THEN (momentum - avg(momentum) OVER {trailing(252)}) / stddev_samp(momentum) OVER {trailing(252)} END, 4) AS momentum_z, {", ".join(f"round(CASE WHEN count(change) OVER {trailing(n)} = {n} THEN sum(change) OVER {trailing(n)} END, 4) AS trend_{n}, round(CASE WHEN count(change) OVER {trailing(n)} = {n} AND stddev_pop(change) OVER {trailing(n)} <> 0 THEN (change - avg(change) OVER {trailing(n)}) / stddev_pop(change) OVER {trailing(n)} END, 4) AS trend_z_{n}" for n in (21, 63))}, {", ".join(f"round(CASE WHEN count(change) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) = {n} THEN sum(change) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) END, 4) AS forward_{n}" for n in (5, 20))}, coalesce(avg(sign(change)) OVER {trailing(5)} < 0.55 AND avg(sign(change)) OVER {trailing(20)} >= 0.6, false) AS transition, coalesce(count(change) OVER {trailing(252)} >= 30 AND abs(change) > quantile_cont(abs(change), 0.99) OVER {trailing(252)}, false) AS outlier, round(CASE WHEN count(*) OVER ({P} ROWS BETWEEN 126 PRECEDING AND 125 FOLLOWING) = 252 THEN avg(close) OVER ({P} ROWS BETWEEN 126 PRECEDING AND 125 FOLLOWING) END, 4) AS centered FROM d""")
def momentum_panel(spark, root):
    x = order_bars(spark, root).withColumns({"change": F.col("close") - F.lag("close").over(S.ordered()), "momentum": F.lag("close", 21).over(S.ordered()) / F.lag("close", 252).over(S.ordered()) - 1})
    x = x.withColumns({"sign": F.signum("change"), "size": F.abs("change")})
    trend = [c for n in (21, 63) for c in (r(S.guarded(F.sum("change").over(S.trailing(n)), "change", S.trailing(n), n), f"trend_{n}", 4), r(S.window_z("change", n, n, True), f"trend_z_{n}", 4))]
    on = lambda n: S.ordered().rowsBetween(1, n)
    forward = [r(S.guarded(F.sum("change").over(on(n)), "change", on(n), n), f"forward_{n}", 4) for n in (5, 20)]
    mean = lambda n: F.avg("sign").over(S.trailing(n))
    far_out = S.guarded(F.percentile("size", F.lit(0.99)).over(S.trailing(252)), "change", S.trailing(252), 30)
    around = S.ordered().rowsBetween(-126, 125)
    false = F.lit(False)
    return x.select("symbol", "bar_date", r(F.col("momentum"), "momentum"), r(S.window_z("momentum", 252, 20), "momentum_z", 4), *trend, *forward, F.coalesce((mean(5) < 0.55) & (mean(20) >= 0.6), false).alias("transition"), F.coalesce(F.col("size") > far_out, false).alias("outlier"), r(S.guarded(F.avg("close").over(around), "close", around, 252), "centered", 4))


@query(f"""WITH {BARS}, c AS (SELECT symbol, bar_date, close - lag(close) OVER {SERIES} AS d FROM bars), p AS (SELECT a.symbol, a.bar_date, a.d AS x, b.d AS y FROM c a JOIN c b ON a.bar_date = b.bar_date AND b.symbol = '1-URGENT' AND a.symbol <> b.symbol), k AS (SELECT symbol, bar_date, round(CASE WHEN count(*) OVER {trailing(63)} = 63 THEN corr(x, y) OVER {trailing(63)} END, 6) AS corr FROM p), g AS (SELECT *, CASE WHEN corr > 0.2 THEN 'POSITIVE' WHEN corr < -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS regime FROM k), i AS (SELECT *, row_number() OVER {SERIES} - row_number() OVER (PARTITION BY symbol, regime ORDER BY bar_date) AS island FROM g) SELECT symbol, bar_date, corr, coalesce(abs(corr) > 0.3, false) AS breakdown, regime, (row_number() OVER (PARTITION BY symbol, regime, island ORDER BY bar_date))::INTEGER AS days FROM i""")
def correlation_regimes(spark, root):
    c = order_bars(spark, root).select("symbol", "bar_date", (F.col("close") - F.lag("close").over(S.ordered())).alias("d"))
    base = c.where("symbol = '1-URGENT'").select("bar_date", F.col("d").alias("y"))
    w = S.trailing(63)
    x = c.where("symbol <> '1-URGENT'").join(base, "bar_date").select("symbol", "bar_date", F.when(F.count("*").over(w) == 63, F.round(F.corr("d", "y").over(w), 6)).alias("corr"))
    x = x.withColumn("regime", F.when(F.col("corr") > 0.2, "POSITIVE").when(F.col("corr") < -0.2, "NEGATIVE").otherwise("NEUTRAL"))
    x = x.withColumn("same", F.coalesce(F.col("regime") == F.lag("regime").over(S.ordered()), F.lit(False)))
    return S.streaks(x, "same").select("symbol", "bar_date", "corr", F.coalesce(F.abs("corr") > 0.3, F.lit(False)).alias("breakdown"), "regime", (F.col("streak") + 1).cast("int").alias("days"))


DETECT = f"""WITH {BARS}, {TR}, w AS (SELECT *, max(high) OVER {prior(20)} AS h20, min(low) OVER {prior(20)} AS l20, max(close) OVER {prior(55)} AS h55, min(close) OVER {prior(55)} AS l55, avg(volume) OVER {trailing(20)} AS v20, CASE WHEN count(*) OVER {trailing(90)} >= 22 AND stddev_samp(volume) OVER {trailing(90)} <> 0 THEN (volume - avg(volume) OVER {trailing(90)}) / stddev_samp(volume) OVER {trailing(90)} END AS vz, avg(close) OVER {trailing(20)} AS m20, stddev_samp(close) OVER {trailing(20)} AS s20, avg(close) OVER {trailing(50)} AS m50, avg(close) OVER {trailing(100)} AS m100, close - lag(close, 5) OVER {SERIES} AS r5, CASE WHEN count(*) OVER {prior(20)} >= 2 AND stddev_samp(close) OVER {prior(20)} <> 0 THEN (close - avg(close) OVER {prior(20)}) / stddev_samp(close) OVER {prior(20)} END AS z20, CASE WHEN count(*) OVER {prior(60)} >= 2 AND stddev_samp(close) OVER {prior(60)} <> 0 THEN (close - avg(close) OVER {prior(60)}) / stddev_samp(close) OVER {prior(60)} END AS z60 FROM t), x AS (SELECT *, lag(m50) OVER {SERIES} AS m50_1, lag(m100) OVER {SERIES} AS m100_1, CASE WHEN count(r5) OVER {prior(60)} >= 2 AND stddev_samp(r5) OVER {prior(60)} <> 0 THEN (r5 - avg(r5) OVER {prior(60)}) / stddev_samp(r5) OVER {prior(60)} END AS zr FROM w)"""


@query(f"""{DETECT}, f AS (SELECT symbol, bar_date, unnest([{{'setup': 'breakout_20', 'long': close > h20 AND volume > 1.5 * v20, 'short': close < l20 AND volume > 1.5 * v20}}, {{'setup': 'pullback', 'long': close > m100 AND close < m20, 'short': close < m100 AND close > m20}}, {{'setup': 'donchian_55', 'long': close > h55, 'short': close < l55}}, {{'setup': 'mean_cross', 'long': m50 > m100 AND m50_1 <= m100_1, 'short': m50 < m100 AND m50_1 >= m100_1}}, {{'setup': 'band_touch', 'long': close < m20 - 2 * s20, 'short': close > m20 + 2 * s20}}, {{'setup': 'z_price', 'long': z20 < -2 AND z60 < -1.5, 'short': z20 > 2 AND z60 > 1.5}}, {{'setup': 'z_return', 'long': zr < -2.5, 'short': zr > 2.5}}, {{'setup': 'volume_climax', 'long': vz >= 3 AND close - low <= 0.25 * (high - low), 'short': vz >= 3 AND high - close <= 0.25 * (high - low)}}, {{'setup': 'z_spread', 'long': z60 <= -2, 'short': z60 >= 2}}]) AS s FROM x) SELECT symbol, bar_date, s.setup AS setup, CASE WHEN s.long THEN 'LONG' ELSE 'SHORT' END AS side FROM f WHERE coalesce(s.long, false) OR coalesce(s.short, false)""")
def detector_fires(spark, root):
    """Every bar at which a setup fires: nine detectors as columns of one pass, unpivoted."""
    x = order_bars(spark, root).withColumn("tr", S.true_range())
    ends = lambda f, c, n: f(c).over(S.prior(n))
    mean = lambda c, n: F.avg(c).over(S.trailing(n))
    x = x.withColumns({"h20": ends(F.max, "high", 20), "l20": ends(F.min, "low", 20), "h55": ends(F.max, "close", 55), "l55": ends(F.min, "close", 55), "v20": mean("volume", 20), "vz": S.window_z("volume", 90, 22), "m20": mean("close", 20), "s20": F.stddev_samp("close").over(S.trailing(20)), "m50": mean("close", 50), "m100": mean("close", 100), "r5": F.col("close") - F.lag("close", 5).over(S.ordered()), "z20": S.prior_z("close", 20), "z60": S.prior_z("close", 60)})
    x = x.withColumns({"m50_1": F.lag("m50").over(S.ordered()), "m100_1": F.lag("m100").over(S.ordered()), "zr": S.prior_z("r5", 60)})
    setups = {
        "breakout_20": ("close > h20 and volume > 1.5 * v20", "close < l20 and volume > 1.5 * v20"),
        "pullback": ("close > m100 and close < m20", "close < m100 and close > m20"),
        "donchian_55": ("close > h55", "close < l55"),
        "mean_cross": ("m50 > m100 and m50_1 <= m100_1", "m50 < m100 and m50_1 >= m100_1"),
        "band_touch": ("close < m20 - 2 * s20", "close > m20 + 2 * s20"),
        "z_price": ("z20 < -2 and z60 < -1.5", "z20 > 2 and z60 > 1.5"),
        "z_return": ("zr < -2.5", "zr > 2.5"),
        "volume_climax": ("vz >= 3 and close - low <= 0.25 * (high - low)", "vz >= 3 and high - close <= 0.25 * (high - low)"),
        "z_spread": ("z60 <= -2", "z60 >= 2"),
    }
    side = lambda long, short: F.when(F.expr(long), "LONG").when(F.expr(short), "SHORT")
    fires = F.explode(F.array(*(F.struct(F.lit(k).alias("setup"), side(*v).alias("side")) for k, v in setups.items()))).alias("s")
    return x.select("symbol", "bar_date", fires).where("s.side is not null").select("symbol", "bar_date", "s.setup", "s.side")


@query(f"""
WITH {BARS}, z AS (
  SELECT symbol, bar_date, close, {", ".join(f"CASE WHEN count(*) OVER {prior(n)} >= 2 AND stddev_samp(close) OVER {prior(n)} <> 0 THEN (close - avg(close) OVER {prior(n)}) / stddev_samp(close) OVER {prior(n)} END AS z{n}" for n in (5, 15, 60))} FROM bars
), l AS (
  SELECT symbol, bar_date, [z5, z15, z60] AS z, list_transform([z5, z15, z60], lambda v: abs(v)) AS a FROM z
)
SELECT symbol, bar_date, CASE
  WHEN len(list_filter(z, lambda v: v IS NULL)) = 3 THEN 'MIXED'
  WHEN len(list_filter(a, lambda v: v >= 1)) = 0 THEN 'STABLE'
  WHEN len(list_filter(z, lambda v: v IS NULL)) > 0 THEN 'MIXED'
  WHEN a[1] >= 1.5 AND a[2] < 1 AND a[3] < 1 THEN 'FRESH'
  WHEN a[1] < 1 AND a[2] >= 1.5 AND a[3] >= 1.5 AND sign(z[2]) = sign(z[3]) THEN 'DRIFTED'
  WHEN a[1] >= 1 AND a[3] >= 1 AND sign(z[1]) <> sign(z[3]) THEN 'REVERTING'
  WHEN least(a[1], a[2], a[3]) < 1 OR sign(z[1]) <> sign(z[2]) OR sign(z[2]) <> sign(z[3]) THEN 'MIXED'
  WHEN a[1] >= a[2] - 1e-9 AND a[2] >= a[3] - 1e-9 AND NOT (a[1] <= a[2] + 1e-9 AND a[2] <= a[3] + 1e-9) THEN 'ACCELERATING'
  WHEN a[1] <= a[2] + 1e-9 AND a[2] <= a[3] + 1e-9 AND NOT (a[1] >= a[2] - 1e-9 AND a[2] >= a[3] - 1e-9) THEN 'DECELERATING'
  WHEN greatest(a[1], a[2], a[3]) - least(a[1], a[2], a[3]) < 0.75 THEN 'PERSISTENT' ELSE 'MIXED' END AS pattern
FROM l
""")
def z_patterns(spark, root):
    """How the scores of three windows, the shortest first, stand together."""
    x = order_bars(spark, root).withColumns({f"z{n}": S.prior_z("close", n) for n in (5, 15, 60)})
    return x.select("symbol", "bar_date", L.z_pattern([F.col(f"z{n}") for n in (5, 15, 60)]).alias("pattern"))


@query(f"""WITH {BARS}, l AS (SELECT symbol, bar_date, {", ".join(f"ln(close / lag(close, {n}) OVER {SERIES}) AS c{n}" for n in (20, 21, 30))} FROM bars), z AS (SELECT symbol, bar_date, {", ".join(f"CASE WHEN count(c{n}) OVER {trailing(252)} >= 60 AND stddev_samp(c{n}) OVER {trailing(252)} <> 0 THEN (c{n} - avg(c{n}) OVER {trailing(252)}) / stddev_samp(c{n}) OVER {trailing(252)} END AS z{n}" for n in (20, 21, 30))} FROM l), m AS (SELECT bar_date, avg(z21) AS blend, avg(z20) AS credit, max(abs(z30)) AS fx, count(z21) AS n FROM z GROUP BY 1) SELECT bar_date, n, round(blend, 4) AS blend, CASE WHEN blend < -1 THEN 'RISK_OFF' WHEN blend < -0.3 THEN 'CAUTIOUS' WHEN blend <= 0.3 THEN 'NEUTRAL' WHEN blend <= 1 THEN 'RISK_ON' WHEN blend > 1 THEN 'EUPHORIC' END AS regime, round(1 / (1 + exp(-credit)), 4) AS stress, round(fx, 4) AS widest FROM m""")
def risk_regimes(spark, root):
    """Standardised log changes of all series, blended by day into a regime."""
    x = order_bars(spark, root).withColumns({f"c{n}": F.log(F.col("close") / F.lag("close", n).over(S.ordered())) for n in (20, 21, 30)})
    z = x.select("bar_date", *(S.window_z(f"c{n}", 252, 60).alias(f"z{n}") for n in (20, 21, 30)))
    m = z.groupBy("bar_date").agg(F.avg("z21").alias("b"), F.avg("z20").alias("credit"), F.max(F.abs("z30")).alias("fx"), F.count("z21").alias("n"))
    b = F.col("b")
    regime = F.when(b < -1, "RISK_OFF").when(b < -0.3, "CAUTIOUS").when(b <= 0.3, "NEUTRAL").when(b <= 1, "RISK_ON").when(b > 1, "EUPHORIC")
    return m.select("bar_date", "n", r(b, "blend", 4), regime.alias("regime"), r(1 / (1 + F.exp(-F.col("credit"))), "stress", 4), r(F.col("fx"), "widest", 4))


@query(f"""WITH {BARS}, z AS (SELECT symbol, bar_date, CASE WHEN stddev_samp(close) OVER {prior(20)} <> 0 THEN (close - avg(close) OVER {prior(20)}) / stddev_samp(close) OVER {prior(20)} END AS z FROM bars), f AS (SELECT *, max((abs(z) >= 2)::INT) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS later FROM z) SELECT t::DOUBLE AS threshold, count(*) AS near, count(*) FILTER (later = 1) AS fired, round(count(*) FILTER (later = 1) / count(*), 6) AS rate FROM f, (SELECT unnest([0.5, 0.75, 1, 1.25, 1.5]) AS t) WHERE abs(z) >= t AND abs(z) < 2 GROUP BY 1""")
def near_conversions(spark, root):
    """Of bars near a threshold, how many fire within five bars, by five levels of nearness."""
    x = order_bars(spark, root).withColumn("z", F.abs(S.prior_z("close", 20)))
    x = x.withColumn("later", F.max((F.col("z") >= 2).cast("int")).over(S.ordered().rowsBetween(1, 5))).where("z < 2")
    near = F.explode(F.filter(F.array(*map(F.lit, (0.5, 0.75, 1.0, 1.25, 1.5))), lambda t: F.col("z") >= t)).alias("threshold")
    return x.select(near, "later").groupBy("threshold").agg(F.count("*").alias("near"), F.count_if(F.col("later") == 1).alias("fired")).withColumn("rate", F.round(F.col("fired") / F.col("near"), 6))
