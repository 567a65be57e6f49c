"""Named queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions import series as S
from ratelake.operators import estimators, joins, smoothing, trades
from ratelake.operators.nearest import nearest
from ratelake.plans import contracts, factors, impact, indicators, neighbours, policy, resampling, sequences, setups, studies, turns  # noqa: F401  they register their queries
from ratelake.plans.registry import BARS, ORACLE_SQL, QUERIES, SERIES, TRADES, prior, query, r, trailing  # noqa: F401
from ratelake.sources.bars import event_bars, order_bars, table

FLAGSHIP = "prior_z_score"
@query("""SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def hourly_bars(spark, root):
    return event_bars(spark, root)


@query(f"""WITH {BARS} SELECT symbol, bar_date, close, round(CASE WHEN count(close) OVER w >= 2 AND stddev_samp(close) OVER w <> 0 THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END, 6) AS z FROM bars WINDOW w AS {prior(20)}""")
def prior_z_score(spark, root):
    return order_bars(spark, root).select("symbol", "bar_date", "close", r(S.prior_z("close", 20), "z"))


@query(f"""WITH {BARS} SELECT symbol, bar_date, round(CASE WHEN len(l) > 0 THEN 100.0 * len(list_filter(l, lambda x: x < close)) / len(l) END, 6) AS rank_pct FROM (SELECT *, list(close) OVER {prior(60)} AS l FROM bars)""")
def prior_percentile_rank(spark, root):
    return order_bars(spark, root).select("symbol", "bar_date", r(S.prior_rank("close", 60), "rank_pct"))


@query(f"""WITH {BARS} SELECT symbol, bar_date, close, max(close) OVER w AS upper, min(close) OVER w AS lower, CASE WHEN close > max(close) OVER w THEN 'LONG' WHEN close < min(close) OVER w THEN 'SHORT' ELSE 'NONE' END AS signal FROM bars WINDOW w AS {prior(55)}""")
def donchian_breakout(spark, root):
    w = S.prior(55)
    upper, lower = F.max("close").over(w), F.min("close").over(w)
    return order_bars(spark, root).select("symbol", "bar_date", "close", upper.alias("upper"), lower.alias("lower"), F.when(F.col("close") > upper, "LONG").when(F.col("close") < lower, "SHORT").otherwise("NONE").alias("signal"))


@query(f"""WITH {BARS} SELECT symbol, bar_date, {", ".join(f"round(quantile_cont(close, {p / 100}) OVER w, 6) AS p{p}" for p in (5, 25, 50, 75, 95))} FROM bars WINDOW w AS {prior(60)}""")
def percentile_bands(spark, root):
    return order_bars(spark, root).select("symbol", "bar_date", *(r(F.percentile("close", F.lit(p / 100)).over(S.prior(60)), f"p{p}") for p in (5, 25, 50, 75, 95)))


@query(f"""WITH {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {SERIES}), abs(low - lag(close) OVER {SERIES})) AS tr FROM bars) SELECT symbol, bar_date, round(tr, 6) AS tr, round(CASE WHEN count(tr) OVER w >= 7 THEN avg(tr) OVER w END, 6) AS atr FROM t WINDOW w AS {trailing(14)}""")
def average_true_range(spark, root):
    x = order_bars(spark, root).withColumn("tr", S.true_range())
    return x.select("symbol", "bar_date", r(F.col("tr"), "tr"), r(S.mean_if("tr", 14, 7), "atr"))


@query(f"""WITH {BARS} SELECT symbol, bar_date, round(CASE WHEN high <> low THEN (close - low) / (high - low) END, 6) AS ibs, round(CASE WHEN count(*) OVER w >= 22 AND stddev_samp(volume) OVER w <> 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w END, 6) AS volume_z FROM bars WINDOW w AS {trailing(90)}""")
def bar_strength_and_volume(spark, root):
    w = S.trailing(90)
    z = F.when(F.count("*").over(w) >= 22, S.safe_ratio(F.col("volume") - F.avg("volume").over(w), F.stddev_samp("volume").over(w)))
    return order_bars(spark, root).select("symbol", "bar_date", r(S.bar_strength(), "ibs"), r(z, "volume_z"))


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER {SERIES} AS i FROM bars) SELECT symbol, bar_date, round(CASE WHEN count(*) OVER w = 20 THEN regr_slope(close, i) OVER w END, 4) AS slope FROM n WINDOW w AS {trailing(20)}""")
def rolling_slope(spark, root):
    x = order_bars(spark, root).withColumn("i", F.row_number().over(S.ordered()))
    w = S.trailing(20)
    return x.select("symbol", "bar_date", r(F.when(F.count("*").over(w) == 20, F.regr_slope("close", "i").over(w)), "slope", 4))


@query(f"""WITH {BARS} SELECT symbol, bar_date, round(avg(close) OVER {trailing(20)}, 6) AS middle, round(stddev_samp(close) OVER {trailing(20)}, 6) AS deviation, CASE WHEN avg(close) OVER {trailing(50)} > avg(close) OVER {trailing(200)} THEN 'GOLDEN' ELSE 'DEATH' END AS cross_state FROM bars""")
def bollinger_and_cross(spark, root):
    mean = lambda n: F.avg("close").over(S.trailing(n))
    return order_bars(spark, root).select("symbol", "bar_date", r(mean(20), "middle"), r(F.stddev_samp("close").over(S.trailing(20)), "deviation"), F.when(mean(50) > mean(200), "GOLDEN").otherwise("DEATH").alias("cross_state"))


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, bar_date, close, row_number() OVER {SERIES} AS i FROM bars), e AS (SELECT symbol, bar_date, i, close AS fast, close AS slow FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.bar_date, n.i, e.fast * (1 - 1 / 20) + n.close / 20, e.slow * (1 - 1 / 100) + n.close / 100 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) SELECT symbol, bar_date, round(fast, 4) AS fast, round(slow, 4) AS slow FROM e""")
def exponential_means(spark, root):
    return smoothing.smoothed(order_bars(spark, root), "close", (20, 100)).select("symbol", "bar_date", r(F.col("ema_20"), "fast", 4), r(F.col("ema_100"), "slow", 4))


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, bar_date, coalesce(close - lag(close) OVER {SERIES}, 0) AS d, row_number() OVER {SERIES} AS i FROM bars), e AS (SELECT symbol, bar_date, i, greatest(d, 0) AS up, greatest(-d, 0) AS down FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.bar_date, n.i, e.up * (1 - 1 / 14) + greatest(n.d, 0) / 14, e.down * (1 - 1 / 14) + greatest(-n.d, 0) / 14 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) SELECT symbol, bar_date, CASE WHEN i > 14 THEN round(CASE WHEN down = 0 THEN 50 ELSE 100 - 100 / (1 + up / down) END, 4) END AS rsi FROM e""")
def relative_strength_index(spark, root):
    return smoothing.relative_strength(order_bars(spark, root), 14).select("symbol", "bar_date", r(F.nanvl("rsi", F.lit(None)), "rsi", 4))


@query(f"""WITH {BARS}, c AS (SELECT x.symbol, x.bar_date, x.close AS a, y.close AS b FROM bars x JOIN bars y ON y.bar_date = x.bar_date AND y.symbol = '1-URGENT' AND x.symbol <> y.symbol), m AS (SELECT symbol, lag, corr(a, b) AS c FROM (SELECT symbol, unnest(range(-10, 11)) AS lag, a, bar_date FROM c) q JOIN (SELECT symbol AS s, b, bar_date AS d, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS j FROM c) y ON y.s = q.symbol AND y.d = q.bar_date + lag::INTEGER GROUP BY ALL) SELECT symbol, lag::INTEGER AS lag, round(c, 6) AS corr FROM m""")
def lead_lag_correlation(spark, root):
    bars = order_bars(spark, root).select("symbol", "bar_date", "close")
    base = bars.where("symbol = '1-URGENT'").select("bar_date", F.col("close").alias("b"))
    c = bars.where("symbol <> '1-URGENT'").join(base, "bar_date").select("symbol", "bar_date", F.col("close").alias("a"), "b")
    shifted = c.select("symbol", F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("lag"), "a", "bar_date").withColumn("bar_date", F.date_add("bar_date", F.col("lag")))
    return shifted.join(c.select("symbol", "bar_date", "b"), ["symbol", "bar_date"]).groupBy("symbol", "lag").agg(r(F.corr("a", "b"), "corr"))


@query(f"""WITH {BARS} SELECT o.o_orderkey, o.o_orderdate::DATE AS bar_date, CASE WHEN o.o_orderdate::DATE - b.bar_date <= 14 THEN b.close END AS close, CASE WHEN o.o_orderdate::DATE - b.bar_date <= 14 THEN b.bar_date END AS close_at FROM (SELECT *, o_orderdate::DATE AS d FROM orders) o ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = '1-URGENT' AND volume > 1) b ON o.d >= b.bar_date""")
def as_of_close(spark, root):
    bars = order_bars(spark, root).where("symbol = '1-URGENT' and volume > 1").select("bar_date", "close")
    orders = table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("bar_date"))
    # One row for each day of the calendar, so orders meet it in a join on the day, whatever their number.
    days = joins.as_of(orders.select(F.lit(1).alias("market"), "bar_date").distinct(), bars.withColumn("market", F.lit(1)), ["market"], "bar_date", "close", 14)
    return orders.join(days.drop("market"), "bar_date", "left").select("o_orderkey", "bar_date", "close", "close_at")


@query("""WITH chain AS (SELECT p_brand, p_size, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1, 2), targets AS (SELECT b.p_brand, t.p_size FROM (SELECT DISTINCT p_brand FROM chain) b, (SELECT unnest([1, 5, 10, 17, 22, 30, 45, 50]) AS p_size) t) SELECT t.p_brand, t.p_size, round(lo.price, 4) AS lower, round(hi.price, 4) AS upper, round(CASE WHEN hi.p_size > lo.p_size THEN (t.p_size - lo.p_size) / (hi.p_size - lo.p_size) WHEN lo.p_size IS NOT NULL AND hi.p_size IS NULL THEN 0 WHEN hi.p_size IS NOT NULL AND lo.p_size IS NULL THEN 1 END, 6) AS weight FROM targets t LEFT JOIN chain lo ON lo.p_brand = t.p_brand AND lo.p_size = (SELECT max(c.p_size) FROM chain c WHERE c.p_brand = t.p_brand AND c.p_size <= t.p_size) LEFT JOIN chain hi ON hi.p_brand = t.p_brand AND hi.p_size = (SELECT min(c.p_size) FROM chain c WHERE c.p_brand = t.p_brand AND c.p_size > t.p_size)""")
def tenor_brackets(spark, root):
    chain = table(spark, root, "part").groupBy("p_brand", "p_size").agg(r(F.avg("p_retailprice"), "price", 4))
    targets = chain.select("p_brand").distinct().withColumn("p_size", F.explode(F.array(*map(F.lit, (1, 5, 10, 17, 22, 30, 45, 50)))))
    return joins.bracket(targets, chain, ["p_brand"], "p_size", "price").select("p_brand", "p_size", "lower", "upper", r(F.col("weight"), "weight"))


@query(f"""WITH {BARS}, a AS (SELECT symbol, max(bar_date) AS anchor FROM bars GROUP BY symbol, date_trunc('quarter', bar_date)) SELECT a.symbol, a.anchor, count(*) AS bars, round(sum(CASE WHEN b.bar_date < a.anchor THEN b.close END), 2) AS sum_before, round(sum(CASE WHEN b.bar_date > a.anchor THEN b.close END), 2) AS sum_after FROM a JOIN bars b ON b.symbol = a.symbol AND b.bar_date BETWEEN a.anchor - 5 AND a.anchor + 5 GROUP BY 1, 2""")
def event_windows(spark, root):
    bars = order_bars(spark, root)
    anchors = bars.groupBy("symbol", F.date_trunc("quarter", "bar_date").alias("quarter")).agg(F.max("bar_date").alias("bar_date"))
    x = joins.within_days(anchors, bars.select("symbol", "bar_date", "close"), ["symbol"], "bar_date", 5, 5)
    side = lambda cond: F.sum(F.when(cond, F.col("close")))
    return x.groupBy("symbol", "anchor").agg(F.count("*").alias("bars"), r(side(F.col("offset") < 0), "sum_before", 2), r(side(F.col("offset") > 0), "sum_after", 2))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, (SELECT max(l_shipdate)::DATE FROM lineitem WHERE l_orderkey = o_orderkey) AS b FROM orders) SELECT o_orderkey, q AS quarter, greatest(date_diff('day', greatest(a, q), least(b, (q + INTERVAL 3 MONTH)::DATE)), 0)::INTEGER AS days FROM (SELECT *, unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), INTERVAL 3 MONTH))::DATE AS q FROM o WHERE b > a)""")
def quarter_overlap(spark, root):
    shipped = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("b"))
    o = table(spark, root, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a")).join(shipped, "o_orderkey").where("b > a")
    o = o.withColumn("quarter", F.explode(F.expr("sequence(to_date(date_trunc('quarter', a)), to_date(date_trunc('quarter', b)), interval 3 months)")))
    return o.select("o_orderkey", "quarter", joins.overlap_days(F.col("a"), F.col("b"), F.col("quarter"), F.add_months("quarter", 3)).alias("days"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')""")
def expired_customers(spark, root):
    active = table(spark, root, "orders").where("o_orderdate >= timestamp'1998-01-01'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, root, "customer").select("c_custkey", "c_mktsegment").join(active, "c_custkey", "left_anti")


@query(f"""WITH {BARS}, p AS (SELECT bar_date, max(close) FILTER (symbol = '1-URGENT') AS a, max(close) FILTER (symbol = '2-HIGH') AS b, max(close) FILTER (symbol = '3-MEDIUM') AS c, max(high) FILTER (symbol = '1-URGENT') AS ah, max(low) FILTER (symbol = '2-HIGH') AS bl FROM bars GROUP BY 1) SELECT bar_date, round(a - b, 4) AS spread, round(ah - bl, 4) AS spread_high, round(a - 2 * b + c, 4) AS fly FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def spread_and_fly(spark, root):
    x = order_bars(spark, root).where(F.col("symbol").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    leg = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    p = x.groupBy("bar_date").agg(leg("1-URGENT", "close").alias("a"), leg("2-HIGH", "close").alias("b"), leg("3-MEDIUM", "close").alias("c"), leg("1-URGENT", "high").alias("ah"), leg("2-HIGH", "low").alias("bl")).dropna(subset=["a", "b", "c"])
    return p.select("bar_date", r(F.col("a") - F.col("b"), "spread", 4), r(F.col("ah") - F.col("bl"), "spread_high", 4), r(F.col("a") - 2 * F.col("b") + F.col("c"), "fly", 4))


def trade_rows(spark, root):
    x = table(spark, root, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * (0.05 - F.col("l_discount")), 4).alias("pnl"))


PACK = "count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 4) AS win_pct, round(sum(pnl), 4) AS total, round(avg(pnl), 6) AS mean, round(CASE WHEN -sum(pnl) FILTER (pnl < 0) > 0 THEN sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) END, 6) AS profit_factor, round(CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(252.0) END, 6) AS sharpe"
MEAN = "round(avg(pnl), 6) AS mean, "
DIGITS = {"win_pct": 4, "total": 4, "mean": 6, "profit_factor": 6, "sharpe": 6}


def rounded_pack(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in DIGITS.items()})


@query(f"""WITH {TRADES} SELECT l_returnflag, l_linestatus, {PACK} FROM trades GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))""")
def metrics_grid(spark, root):
    return rounded_pack(trade_rows(spark, root).cube("l_returnflag", "l_linestatus").agg(*trades.metric_pack()))


@query(f"""WITH {TRADES} SELECT year(day)::INTEGER AS year, month(day)::INTEGER AS month, dayname(day) AS weekday, {PACK.replace(MEAN, '')} FROM trades GROUP BY 1, 2, 3""")
def calendar_slices(spark, root):
    x = trade_rows(spark, root).groupBy(F.year("day").alias("year"), F.month("day").alias("month"), F.date_format("day", "EEEE").alias("weekday"))
    return rounded_pack(x.agg(*trades.metric_pack())).drop("mean")  # of a few trades it may lie between two rounded values


@query(f"""WITH {TRADES}, d AS (SELECT l_returnflag, day, sum(pnl) AS pnl FROM trades GROUP BY 1, 2), e AS (SELECT *, sum(pnl) OVER (PARTITION BY l_returnflag ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM d), p AS (SELECT *, equity - max(equity) OVER (PARTITION BY l_returnflag ORDER BY day ROWS UNBOUNDED PRECEDING) AS dd, equity - min(equity) OVER (PARTITION BY l_returnflag ORDER BY day ROWS UNBOUNDED PRECEDING) AS ud FROM e) SELECT l_returnflag, round(min(dd), 4) AS worst, round(max(ud), 4) AS best, round(avg(dd) FILTER (dd < -0.005), 2) AS mean_down, count(*) AS days FROM p GROUP BY 1""")
def drawdown_stats(spark, root):
    daily = trade_rows(spark, root).groupBy("l_returnflag", "day").agg(F.sum("pnl").alias("pnl"))
    x = trades.drawdowns(daily, "l_returnflag", "day")
    return x.groupBy("l_returnflag").agg(r(F.min("drawdown"), "worst", 4), r(F.max("updraw"), "best", 4), r(F.avg(F.when(F.col("drawdown") < -0.005, F.col("drawdown"))), "mean_down", 2), F.count("*").alias("days"))


@query(f"""WITH {BARS}, f AS (SELECT symbol, bar_date, close > open AS up, row_number() OVER {SERIES} - row_number() OVER (PARTITION BY symbol, close > open ORDER BY bar_date) AS island FROM bars), n AS (SELECT symbol, up, count(*) AS k FROM f GROUP BY symbol, up, island) SELECT symbol, coalesce(max(k) FILTER (up), 0) AS longest_true, coalesce(max(k) FILTER (NOT up), 0) AS longest_false FROM n GROUP BY 1""")
def longest_runs(spark, root):
    return trades.longest_runs(order_bars(spark, root).withColumn("up", F.col("close") > F.col("open")), "symbol", "bar_date", "up")


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER {SERIES} AS i FROM bars), e AS (SELECT symbol, i, close * 0.5 AS stop, close * 1.5 AS target FROM n), p AS (SELECT e.symbol, e.i, b.i - e.i AS k, CASE WHEN low <= stop THEN 'stop' WHEN high >= target THEN 'target' WHEN b.i - e.i = 10 THEN 'time' END AS reason, CASE WHEN low <= stop THEN stop WHEN high >= target THEN target ELSE close END AS price FROM e JOIN n b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 1 AND e.i + 10) SELECT symbol, i, min(k)::INTEGER AS held, min_by(reason, k) AS reason, round(min_by(price, k), 4) AS exit_price FROM p WHERE reason IS NOT NULL GROUP BY 1, 2""")
def trade_exits(spark, root):
    bars = order_bars(spark, root).withColumn("i", F.row_number().over(S.ordered()))
    entries = bars.select("symbol", "i", (F.col("close") * 0.5).alias("stop"), (F.col("close") * 1.5).alias("target"))
    return trades.first_touch(entries, bars, 10).withColumn("exit_price", F.round("exit_price", 4))


@query(f"""WITH {BARS}, l AS (SELECT symbol, close AS y, lag(close) OVER {SERIES} AS x FROM bars), f AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b FROM l WHERE x IS NOT NULL GROUP BY 1) SELECT symbol, n, round(b, 6) AS slope, round(CASE WHEN b > 0 AND b < 1 THEN -ln(2) / ln(b) END, 4) AS half_life FROM f""")
def reversion_half_life(spark, root):
    return estimators.half_life(order_bars(spark, root)).select("symbol", "n", r(F.col("slope"), "slope"), r(F.col("half_life"), "half_life", 4))


@query(f"""WITH {BARS}, d AS (SELECT symbol, close - lag(close) OVER {SERIES} AS d1, close - lag(close, 4) OVER {SERIES} AS dq FROM bars) SELECT symbol, count(d1) AS n, round(var_samp(dq) / (4 * var_samp(d1)), 6) AS ratio FROM d GROUP BY 1""")
def variance_ratios(spark, root):
    return estimators.variance_ratio(order_bars(spark, root), 4).select("symbol", "n", r(F.col("ratio"), "ratio"))


@query("""WITH s AS (SELECT p_brand, l_returnflag, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM (SELECT p_brand, l_returnflag, l_quantity AS x, l_extendedprice AS y, 1 + l_tax AS w FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2) SELECT p_brand, l_returnflag, n, round((sxy - sx * sy / sw) / (sxx - sx * sx / sw), 4) AS slope, round((sxy - sx * sy / sw) * (sxy - sx * sy / sw) / ((sxx - sx * sx / sw) * (syy - sy * sy / sw)), 6) AS r_squared FROM s""")
def weighted_slopes(spark, root):
    x = table(spark, root, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (1 + F.col("l_tax")).alias("w"))
    x = x.join(table(spark, root, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return estimators.weighted_regression(x, ["p_brand", "l_returnflag"]).select("p_brand", "l_returnflag", "n", r(F.col("slope"), "slope", 4), r(F.col("r_squared"), "r_squared"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda s: (s[1]::DOUBLE - s[2]::DOUBLE) * (s[1]::DOUBLE - s[2]::DOUBLE))), 6) AS d2 FROM q JOIN embeddings ON vec_id <> query_id) SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id))::INTEGER AS place FROM d QUALIFY place <= 10""")
def analog_neighbours(spark, root):
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 50 = 0"), vectors, 10)


@query("""WITH m AS (SELECT n_name, c_mktsegment, count(*) AS n, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.25) AS p25, quantile_cont(o_totalprice, 0.75) AS p75, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0 END) AS share FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) SELECT n_name, c_mktsegment, n, round(median, 4) AS median, round(p25, 4) AS p25, round(p75, 4) AS p75, round(share, 6) AS share FROM m""")
def state_quartiles(spark, root):
    x = table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    x = x.join(table(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    p = lambda q: F.percentile("o_totalprice", F.lit(q))
    return x.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), r(p(0.5), "median", 4), r(p(0.25), "p25", 4), r(p(0.75), "p75", 4), r(F.avg(F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0)), "share"))


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 20), 19) END::BIGINT AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1""")
def value_histogram(spark, root):
    x = table(spark, root, "events").select("value").where("value is not null")
    ends = x.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("e"))
    x = x.withColumn("e", ends.scalar())
    bin_ = F.least(F.floor(S.safe_ratio(F.col("value") - F.col("e.lo"), F.col("e.hi") - F.col("e.lo")) * 20), F.lit(19))
    return x.groupBy(F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {BARS}, z AS (SELECT symbol, bar_date, close, (close - avg(close) OVER w) / stddev_samp(close) OVER w AS z, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS back FROM bars WINDOW w AS {prior(50)}) SELECT symbol, bar_date, round(z, 6) AS z, CASE WHEN z < -1.5 THEN 'LONG' WHEN z > 1.5 THEN 'SHORT' ELSE 'NEAR' END AS state FROM z WHERE back <= 60 ORDER BY abs(z) DESC, symbol, bar_date LIMIT 25""")
def scan_extremes(spark, root):
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_date")))
    x = order_bars(spark, root).select("symbol", "bar_date", S.prior_z("close", 50).alias("z"), back.alias("back")).where("back <= 60")
    x = x.orderBy(F.desc(F.abs("z")), "symbol", "bar_date").limit(25)
    return x.select("symbol", "bar_date", r(F.col("z"), "z"), F.when(F.col("z") < -1.5, "LONG").when(F.col("z") > 1.5, "SHORT").otherwise("NEAR").alias("state"))


@query("""SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_hour FROM events""")
def hourly_throttle(spark, root):
    w = W.partitionBy("user_id", "event_type").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, root, "events").select("event_id", "user_id", "ts", F.count("*").over(w).alias("in_hour"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k""")
def user_sessions(spark, root):
    x = table(spark, root, "events").select("ts", "user_id")
    return x.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events")


@query("""WITH t AS (SELECT c_mktsegment, n, 2 * (1 - 1 / (1 + exp(-1.702 * abs(mean - m) / (sd / sqrt(n))))) AS p FROM (SELECT c_mktsegment || '/' || c_nationkey AS c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY ALL HAVING count(*) > 1 AND stddev_samp(c_acctbal) > 0), (SELECT avg(c_acctbal) AS m FROM customer)), k AS (SELECT c_mktsegment, n, round(p, 6) AS p, (row_number() OVER (ORDER BY round(p, 6), c_mktsegment))::INTEGER AS place, count(*) OVER () AS tests FROM t) SELECT c_mktsegment, n, p, place, place <= coalesce((SELECT max(place) FROM k WHERE p <= 0.2 * place / tests), 0) AS below FROM k""")
def false_discovery_steps(spark, root):
    x = table(spark, root, "customer").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("c_mktsegment"), "c_acctbal")
    middle = x.agg(F.avg("c_acctbal").alias("m"))
    g = x.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sd")).where("n > 1 and sd > 0").withColumn("m", middle.scalar())
    p = 2 * (1 - 1 / (1 + F.exp(-1.702 * F.abs(F.col("mean") - F.col("m")) / (F.col("sd") / F.sqrt("n")))))
    return estimators.false_discoveries(g.select("c_mktsegment", "n", r(p, "p")), "p", "c_mktsegment", 0.2)
