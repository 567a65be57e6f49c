"""Queries of research: tests of series, regressions, event studies, trades and their metrics, depth and staleness of tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions import levels as L
from ratelake.functions import series as S
from ratelake.operators import estimators, stationarity, trades
from ratelake.plans.registry import BARS, QUERIES, SERIES, TRADES, prior, query, r
from ratelake.sources.bars import order_bars, table

LAST = "row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS back"


@query(f"""WITH {BARS}, w AS (SELECT symbol, bar_date, close, {LAST} FROM bars), p AS (SELECT symbol, close AS y, lag(close) OVER {SERIES} AS x FROM w WHERE back BETWEEN 2 AND 91), f AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS syy, regr_sxx(y, x) AS sxx FROM p WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) >= 20) SELECT symbol, n, round(b, 6) AS slope, round(CASE WHEN b > 0 AND b < 1 THEN -ln(b) ELSE 0 END, 6) AS kappa, round(CASE WHEN b > 0 AND b < 1 THEN ln(2) / -ln(b) END, 4) AS half_life, round(a / (1 - b), 2) AS mean, round(sqrt(greatest(syy - b * b * sxx, 0) / (n - 2)), 2) AS sigma, round((b - 1) / sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx), 4) AS t_unit_root, (b - 1) / sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx) < -2.86 AS reverts FROM f""")
def reversion_fit(spark, root):
    f = estimators.lagged_fit(order_bars(spark, root), 90, 20)
    return f.select("symbol", "n", r(F.col("slope"), "slope"), r(F.col("kappa"), "kappa"), r(F.col("half_life"), "half_life", 4), r(F.col("mean"), "mean", 2), r(F.col("sigma"), "sigma", 2), r(F.col("t_unit_root"), "t_unit_root", 4), (F.col("t_unit_root") < -2.86).alias("reverts"))


@query(f"""WITH {BARS}, w AS (SELECT symbol, bar_date, close, {LAST} FROM bars), d AS (SELECT symbol, close - lag(close) OVER {SERIES} AS d1, close - lag(close, 4) OVER {SERIES} AS dq FROM w WHERE back <= 90), m AS (SELECT symbol, avg(d1) AS m FROM d GROUP BY 1), s AS (SELECT d.symbol, count(d1) AS n, sum((d1 - m) * (d1 - m)) / (count(d1) - 1) AS one, sum((dq - 4 * m) * (dq - 4 * m)) / (4 * (count(d1) - 3) * (1 - 4 / count(d1))) AS many FROM d JOIN m ON m.symbol = d.symbol GROUP BY 1 HAVING count(d1) >= 40) SELECT symbol, n, round(many / one, 6) AS ratio, round((many / one - 1) / sqrt(42 / (12 * n)), 4) AS z, abs((many / one - 1) / sqrt(42 / (12 * n))) > 1.96 AS reject FROM s""")
def variance_ratio_tests(spark, root):
    return estimators.variance_ratio_test(order_bars(spark, root), 90, 4, 40).select("symbol", "n", r(F.col("ratio"), "ratio"), r(F.col("z"), "z", 4), "reject")


SURPRISE = "s AS (SELECT event_type, user_id % 4 AS market, event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS k, lead(value) OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS next FROM events WINDOW w AS (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)), x AS (SELECT event_type, market, CASE WHEN k >= 4 AND sd > 0 THEN (value - m) / sd END AS x, next - value AS y, event_id FROM s)"


def surprises(spark, root):
    """Events standardised by the twelve before them (four at least), and the change to the next."""
    x = table(spark, root, "events").select("event_id", "event_type", (F.col("user_id") % 4).alias("market"), "ts", "value")
    w = W.partitionBy("event_type", "market").orderBy("ts", "event_id")
    before = w.rowsBetween(-12, -1)
    z = F.when(F.count("value").over(before) >= 4, S.safe_ratio(F.col("value") - F.avg("value").over(before), F.when(F.stddev_pop("value").over(before) > 0, F.stddev_pop("value").over(before))))
    return x.select("event_id", "event_type", "market", z.alias("x"), (F.lead("value").over(w) - F.col("value")).alias("y"))


@query(f"""WITH {SURPRISE}, f AS (SELECT event_type, market, count(*) AS n, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, stddev_pop(x) AS sx, stddev_pop(y) AS sy, avg((sign(x) = sign(y))::INT) AS alike, avg((sign(x) = -sign(y))::INT) AS unlike FROM x WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 2), g AS (SELECT *, sqrt(greatest(syy - b * b * sxx, 0) / (n - 2) / sxx) AS error, CASE WHEN b >= 0 THEN alike ELSE unlike END AS hit FROM f) SELECT event_type, market, n, round(b, 4) AS slope, round(error, 4) AS error, round(b / error, 3) AS t, round(r2, 6) AS r_squared, round(hit, 6) AS hit_rate, round(0.4 * least(1, abs(b * sx / sy)) + 0.3 * r2 + 0.3 * hit, 5) AS score FROM g""")
def event_responses(spark, root):
    f = estimators.robust_fit(surprises(spark, root).where("x is not null and y is not null"), ["event_type", "market"])
    return f.select("event_type", "market", "n", r(F.col("slope"), "slope", 4), r(F.col("error"), "error", 4), r(F.col("t"), "t", 3), r(F.col("r_squared"), "r_squared"), r(F.col("hit_rate"), "hit_rate"), r(F.col("score"), "score", 5))


@query(f"""WITH {SURPRISE}, t AS (SELECT *, CASE WHEN y = 0 THEN 'FLAT' ELSE (CASE WHEN y > 0 THEN 'UP' ELSE 'DOWN' END) || '_' || (CASE WHEN x > 0 THEN 'POS' ELSE 'NEG' END) || '_' || (CASE WHEN abs(y) <= 50 THEN 'small' ELSE 'large' END) END AS state FROM x WHERE x IS NOT NULL AND y IS NOT NULL) SELECT event_type, state, count(*) AS n, round(median(y), 4) AS median, round(quantile_cont(y, 0.25), 4) AS p25, round(quantile_cont(y, 0.75), 4) AS p75, round(avg((abs(y) > 100)::INT), 6) AS large_share, array_to_string(list_reverse(list_sort(list(event_id))[-3:]), ',') AS latest FROM t GROUP BY 1, 2""")
def event_states(spark, root):
    x = surprises(spark, root).where("x is not null and y is not null").withColumn("state", L.sign_state(F.col("y"), F.lit(50.0), F.col("x")))
    p = lambda q: F.percentile("y", F.lit(q))
    latest = F.row_number().over(W.partitionBy("event_type", "state").orderBy(F.desc("event_id")))
    last = x.withColumn("k", latest).where("k <= 3").groupBy("event_type", "state").agg(F.array_join(F.sort_array(F.collect_list("event_id"), False), ",").alias("latest"))
    g = x.groupBy("event_type", "state").agg(F.count("*").alias("n"), r(p(0.5), "median", 4), r(p(0.25), "p25", 4), r(p(0.75), "p75", 4), r(F.avg((F.abs("y") > 100).cast("int")), "large_share"))
    return g.join(last, ["event_type", "state"])


SIM = f"""n AS (SELECT *, row_number() OVER {SERIES} AS i, max(close) OVER {prior(55)} AS up, min(close) OVER {prior(55)} AS down FROM bars), f AS (SELECT symbol, i, CASE WHEN close > up THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN close > up THEN 1 ELSE -1 END AS s, 0.3 * close AS risk FROM n WHERE close > up OR close < down), e AS (SELECT f.*, b.open AS entry FROM f JOIN n b ON b.symbol = f.symbol AND b.i = f.i + 1), p AS (SELECT e.symbol, e.i, e.side, b.i - e.i - 1 AS k, CASE WHEN s > 0 THEN entry - low ELSE high - entry END / risk AS against, CASE WHEN s > 0 THEN high - entry ELSE entry - low END / risk AS along, s * (close - entry) / risk AS at_close FROM e JOIN n b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 2 AND e.i + 61), q AS (SELECT *, CASE WHEN against >= 1 THEN 'stop' WHEN along >= 2 THEN 'target_2' WHEN along >= 1 THEN 'target_1' WHEN k = 60 THEN 'time' END AS reason FROM p), z AS (SELECT *, min(CASE WHEN reason IS NOT NULL THEN k END) OVER (PARTITION BY symbol, i, side) AS ended FROM q), sim AS (SELECT symbol, i, side, max(k) AS held, coalesce(max_by(reason, k) FILTER (reason IS NOT NULL), 'open') AS reason, max_by(CASE reason WHEN 'stop' THEN -1 WHEN 'target_2' THEN 2 WHEN 'target_1' THEN 1 ELSE at_close END, k) AS gain, max(against) AS worst, max(along) AS best FROM z WHERE k <= coalesce(ended, k) GROUP BY 1, 2, 3)"""


def simulated(spark, root):
    """Breakouts of 55 closes, both ways, with a risk of three tenths of the close."""
    bars = order_bars(spark, root).withColumns({"i": F.row_number().over(S.ordered()), "up": F.max("close").over(S.prior(55)), "down": F.min("close").over(S.prior(55))})
    fires = bars.select("symbol", "i", F.when(F.col("close") > F.col("up"), "LONG").when(F.col("close") < F.col("down"), "SHORT").alias("side"), (0.3 * F.col("close")).alias("risk")).where("side is not null")
    return trades.simulate(fires, bars.select("symbol", "i", "open", "high", "low", "close"), 60)


@query(f"""WITH {BARS}, {SIM} SELECT symbol, i, side, held::INTEGER AS held, reason, round(gain, 4) AS gain, round(worst, 4) AS worst, round(best, 4) AS best FROM sim""")
def simulated_trades(spark, root):
    return simulated(spark, root).select("symbol", "i", "side", "held", "reason", r(F.col("gain"), "gain", 4), r(F.col("worst"), "worst", 4), r(F.col("best"), "best", 4))


@query(f"""WITH {BARS}, {SIM} SELECT symbol, side, reason, count(*) AS trades, round(avg((gain > 0)::INT), 6) AS hit_rate, round(avg(gain), 4) AS mean, round(median(gain), 4) AS median, round(sum(gain), 4) AS total, round(avg(held), 4) AS days, round(CASE WHEN stddev_samp(gain) <> 0 THEN avg(gain) / stddev_samp(gain) END, 4) AS ratio FROM sim GROUP BY GROUPING SETS ((symbol), (side), (reason), (symbol, side), ())""")
def trades_by_source(spark, root):
    x = simulated(spark, root)
    sets = x.groupingSets([("symbol",), ("side",), ("reason",), ("symbol", "side"), ()], "symbol", "side", "reason")
    return sets.agg(F.count("*").alias("trades"), r(F.avg((F.col("gain") > 0).cast("int")), "hit_rate"), r(F.avg("gain"), "mean", 4), r(F.median("gain"), "median", 4), r(F.sum("gain"), "total", 4), r(F.avg("held"), "days", 4), r(S.safe_ratio(F.avg("gain"), F.stddev_samp("gain")), "ratio", 4))


FULL = {"win_pct": "100.0 * count(*) FILTER (pnl > 0) / count(*)", "total": "sum(pnl)", "median": "median(pnl) + 1e-7", "deviation": "stddev_pop(pnl)", "gain": "sum(pnl) FILTER (pnl > 0)", "loss": "-sum(pnl) FILTER (pnl < 0)", "mean_win": "avg(pnl) FILTER (pnl > 0)", "mean_loss": "-avg(pnl) FILTER (pnl < 0)", "best": "max(pnl)", "worst": "min(pnl)", "profit_factor": "sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0)", "payoff": "-avg(pnl) FILTER (pnl > 0) / avg(pnl) FILTER (pnl < 0)", "sharpe": "avg(pnl) / stddev_pop(pnl) * sqrt(252.0)", "sortino": "avg(pnl) / sqrt(avg(least(pnl, 0) * least(pnl, 0))) * sqrt(252.0)", "mean_r": "avg(pnl / risk)", "median_r": "median(pnl / risk) + 1e-7", "total_r": "sum(pnl / risk)", "deviation_r": "stddev_pop(pnl / risk)", **{f"p{q}": f"quantile_cont(pnl, {q / 100}) + 1e-7" for q in (5, 25, 75, 95)}}
COUNTS = {"trades": "count(*)", "wins": "count(*) FILTER (pnl > 0)", "losses": "count(*) FILTER (pnl < 0)", "even": "count(*) FILTER (pnl = 0)", "above_1r": "count(*) FILTER (pnl / risk >= 1)", "above_2r": "count(*) FILTER (pnl / risk >= 2)", "below_1r": "count(*) FILTER (pnl / risk <= -1)"}


@query(f"""WITH {TRADES} SELECT window_days, l_returnflag, {", ".join(f"{v} AS {k}" for k, v in COUNTS.items())}, {", ".join(f"round({v}, 4) + 0.0 AS {k}" for k, v in FULL.items())} FROM (SELECT *, 1000.0 AS risk FROM trades), (SELECT unnest([0, 730, 365, 180, 30]) AS window_days) WHERE window_days = 0 OR day > DATE '1998-08-02' - window_days::INTEGER GROUP BY 1, 2""")
def trailing_metrics(spark, root):
    """The metric pack by flag over trailing windows of days (0: all)."""
    x = table(spark, root, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * (0.05 - F.col("l_discount")), 4).alias("pnl"), F.lit(1000.0).alias("risk"))
    ago = F.datediff(F.lit("1998-08-02").cast("date"), "day")
    x = x.withColumn("window_days", F.explode(F.filter(F.array(*map(F.lit, (0, 730, 365, 180, 30))), lambda d: (d == 0) | (ago < d))))
    g = trades.full_metric_pack(x, ["window_days", "l_returnflag"], few=True)
    return g.select("window_days", "l_returnflag", *COUNTS, *(r(F.col(c) + (1e-7 if "1e-7" in FULL[c] else 0), c, 4) for c in FULL))  # so that both round a quantile halfway between two the same way


@query(f"""WITH {TRADES}, b AS (SELECT *, CASE WHEN c <= 0.2 THEN '0-20' WHEN c <= 0.4 THEN '20-40' WHEN c <= 0.6 THEN '40-60' WHEN c <= 0.8 THEN '60-80' ELSE '80-100' END AS bucket FROM (SELECT pnl, l_linestatus, (l_linenumber / 7.0) AS c FROM trades)), g AS (SELECT l_linestatus, bucket, count(*) AS trades, avg((pnl > 0)::INT) AS hit FROM b GROUP BY 1, 2) SELECT l_linestatus, bucket, trades, round(hit, 6) AS hit_rate, round(greatest(0, hit - (1 - hit) / 1.5) * 0.25, 6) AS kelly, (rank() OVER (PARTITION BY l_linestatus ORDER BY round(hit, 6) DESC))::INTEGER AS place FROM g""")
def trades_by_conviction(spark, root):
    x = table(spark, root, "lineitem").select("l_linestatus", F.round(F.col("l_extendedprice") * (0.05 - F.col("l_discount")), 4).alias("pnl"), (F.col("l_linenumber") / 7.0).alias("c"))
    c = F.col("c")
    bucket = F.when(c <= 0.2, "0-20").when(c <= 0.4, "20-40").when(c <= 0.6, "40-60").when(c <= 0.8, "60-80").otherwise("80-100")
    g = x.groupBy("l_linestatus", bucket.alias("bucket")).agg(F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("int")).alias("hit"))
    g = g.withColumn("hit_rate", F.round("hit", 6))
    return g.select("l_linestatus", "bucket", "trades", "hit_rate", r(L.kelly(F.col("hit"), F.lit(1.5)), "kelly"), F.rank().over(W.partitionBy("l_linestatus").orderBy(F.desc("hit_rate"))).alias("place"))


@query("""SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last, round((epoch(max(ts)) - epoch(min(ts))) / 86400 / 365.25, 6) AS years, (DATE '2030-01-01' - max(ts)::DATE)::INTEGER AS stale_days, count(DISTINCT user_id) AS users, round(avg(value) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 60 DAY), 6) AS recent, (rank() OVER (ORDER BY count(DISTINCT user_id) DESC, event_type))::INTEGER AS place FROM events GROUP BY 1""")
def table_depth(spark, root):
    """Rows, range, staleness and recent mean by type, ranked by distinct users."""
    x = table(spark, root, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    latest = x.agg(F.max("ts").alias("m")).scalar()
    g = x.withColumn("m", latest).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("user_id").alias("users"), r(F.avg(F.when(F.col("ts") >= F.col("m") - F.expr("interval 60 days"), F.col("value"))), "recent"))
    years = (F.unix_micros("last") - F.unix_micros("first")) / 1e6 / 86400 / 365.25
    return g.select("event_type", "n", "first", "last", r(years, "years"), F.datediff(F.lit("2030-01-01").cast("date"), "last").alias("stale_days"), "users", "recent", F.rank().over(W.partitionBy().orderBy(F.desc("users"), "event_type")).alias("place"))  # a row per type


RECENT = f"""w AS (SELECT symbol, bar_date, close, {LAST} FROM bars), v AS (SELECT symbol, row_number() OVER {SERIES} AS i, close AS y, close - lag(close) OVER {SERIES} AS d FROM w WHERE back BETWEEN 2 AND 91)"""
BY_I = "(PARTITION BY symbol ORDER BY i)"


@query(f"""WITH {BARS}, {RECENT}, p AS (SELECT symbol, d AS z, lag(y) OVER {BY_I} AS u, lag(d) OVER {BY_I} AS v FROM v), s AS (SELECT symbol, count(*) AS n, covar_pop(u, u) AS uu, covar_pop(u, v) AS uv, covar_pop(v, v) AS vv, covar_pop(u, z) AS uz, covar_pop(v, z) AS vz, covar_pop(z, z) AS zz FROM p WHERE u IS NOT NULL AND v IS NOT NULL AND z IS NOT NULL GROUP BY 1), g AS (SELECT *, uu * vv - uv * uv AS det, (uz * vv - vz * uv) / (uu * vv - uv * uv) AS g, (vz * uu - uz * uv) / (uu * vv - uv * uv) AS h FROM s WHERE n > 10), adf AS (SELECT symbol, g / sqrt(n * (zz - g * uz - h * vz) / (n - 3) * vv / (n * det)) AS adf_t FROM g), e AS (SELECT symbol, i, y - avg(y) OVER (PARTITION BY symbol) AS e FROM v), k AS (SELECT symbol, e, sum(e) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS path, {", ".join(f"lag(e, {k}) OVER {BY_I} AS e{k}" for k in range(1, 11))} FROM e), kpss AS (SELECT symbol, sum(path * path) / count(*) / (sum(e * e) + {" + ".join(f"2 * (1 - {k} / 11) * coalesce(sum(e * e{k}), 0)" for k in range(1, 11))}) AS kpss FROM k GROUP BY 1), d AS (SELECT symbol, d, row_number() OVER {BY_I} - 1 AS j, count(*) OVER (PARTITION BY symbol) AS n FROM v WHERE d IS NOT NULL), c0 AS (SELECT *, unnest(list_distinct(list_transform(range(8), lambda k: round(exp(ln(8) + k / 7 * (ln(greatest(n // 2, 8)) - ln(8))))::INTEGER))) AS size FROM d), c AS (SELECT *, j // size AS chunk, d - avg(d) OVER (PARTITION BY symbol, size, j // size) AS e FROM c0 WHERE (j // size + 1) * size <= n), q AS (SELECT *, sum(e) OVER (PARTITION BY symbol, size, chunk ORDER BY j ROWS UNBOUNDED PRECEDING) AS path FROM c), r AS (SELECT symbol, size, chunk, (max(path) - min(path)) / stddev_pop(d) AS rs FROM q GROUP BY 1, 2, 3 HAVING stddev_pop(d) > 0), h AS (SELECT symbol, greatest(0, least(1, regr_slope(y, ln(size)))) AS hurst FROM (SELECT symbol, size, ln(avg(rs)) AS y FROM r GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 4) SELECT adf.symbol AS symbol, round(adf_t, 4) AS adf_t, adf_t < -2.86 AS adf_reject, round(kpss, 6) AS kpss, kpss > 0.463 AS kpss_reject, round(hurst, 6) AS hurst FROM adf JOIN kpss ON kpss.symbol = adf.symbol JOIN h ON h.symbol = adf.symbol""")
def stationarity_tests(spark, root):
    x = stationarity.recent(order_bars(spark, root), 90)
    found = stationarity.unit_root(x).join(stationarity.level_stationarity(x), "symbol").join(stationarity.rescaled_range(x), "symbol")
    return found.select("symbol", r(F.col("adf_t"), "adf_t", 4), "adf_reject", r(F.col("kpss"), "kpss"), "kpss_reject", r(F.col("hurst"), "hurst"))


def reversion_verdicts(spark, root):
    """All tests of a series, the verdict of three of them, and the score for reverting."""
    bars = order_bars(spark, root)
    x = stationarity.recent(bars, 90)
    found = stationarity.unit_root(x).join(stationarity.level_stationarity(x), "symbol").join(stationarity.rescaled_range(x), "symbol")
    found = found.join(estimators.variance_ratio_test(bars, 90, 4, 40).select("symbol", "ratio"), "symbol").join(estimators.lagged_fit(bars, 90, 20).select("symbol", "half_life"), "symbol", "left")
    z = bars.select("symbol", "bar_date", S.prior_z("close", 90).alias("z")).groupBy("symbol").agg(F.max_by("z", "bar_date").alias("z"))
    found = found.join(z, "symbol").withColumn("score", L.reversion_score(F.col("z"), F.col("half_life"), F.col("hurst"), F.col("adf_reject")))
    return found.select("symbol", stationarity.verdict("adf_reject", "kpss_reject", "ratio").alias("verdict"), r(F.col("score"), "reversion_score", 4))


QUERIES["reversion_verdicts"] = reversion_verdicts
