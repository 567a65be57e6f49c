"""Queries that carry a state from row to row: throttled alerts, sequences of trades, change-points, segments, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.functions import series as S
from ratelake.operators import changepoints, factors, regimes, throttle, trades
from ratelake.plans.registry import BARS, SERIES, prior, query, r
from ratelake.sources.bars import order_bars, table


@query("""
WITH e AS (
  SELECT event_type AS setup, event_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL
), l AS (
  SELECT setup, list([event_id, t] ORDER BY t, event_id) AS l FROM e GROUP BY setup
), k AS (
  SELECT setup, list_reduce(list_transform(l, lambda v: [v]), lambda acc, v: CASE WHEN len(acc) >= 5 AND acc[-5][2] >= v[1][2] - 3600000000 THEN acc ELSE list_concat(acc, v) END) AS kept FROM l
)
SELECT setup, event_id, true AS recorded FROM (SELECT setup, unnest(kept)[1] AS event_id FROM k)
UNION ALL
SELECT setup, event_id, false FROM e WHERE event_id NOT IN (SELECT unnest(kept)[1] FROM k)
""")
def alert_throttle(spark, root):
    """Events as alerts of their type: five recorded in an hour, the rest held back."""
    x = table(spark, root, "events").select(F.col("event_type").alias("setup"), "event_id", "ts")
    return throttle.throttled(x, ["setup"], "ts", ["event_id"]).select("setup", "event_id", "recorded")


HORIZON, COOLDOWN = 60, 3


@query(f"""
WITH {BARS}, b AS (
  SELECT symbol, row_number() OVER {SERIES} AS i, open, high, low, close, lead(open) OVER {SERIES} AS next_open, count(*) OVER (PARTITION BY symbol) AS last,
    max(close) OVER {prior(20)} AS up, min(close) OVER {prior(20)} AS down
  FROM bars
), f AS (
  SELECT 'breakout' AS setup, symbol, i, CASE WHEN close > up THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN close > up THEN 1 ELSE -1 END AS s, close * CASE WHEN close > up THEN 0.7 ELSE 1.3 END AS stop
  FROM b WHERE close > up OR close < down
), e AS (
  SELECT f.*, b.open AS entry, abs(b.open - f.stop) AS risk, least({HORIZON}, b.last - b.i) AS room,
    CASE WHEN f.s * (b.open - f.stop) > 0 THEN b.open + f.s * abs(b.open - f.stop) END AS t1, CASE WHEN f.s * (b.open - f.stop) > 0 THEN b.open + 2 * f.s * abs(b.open - f.stop) END AS t2
  FROM f JOIN b ON b.symbol = f.symbol AND b.i = f.i + 1 WHERE b.open <> f.stop
), p AS (
  SELECT e.*, b.i - e.i - 1 AS k, b.close, b.next_open, CASE WHEN e.s > 0 THEN b.high ELSE -b.low END AS best, CASE WHEN e.s > 0 THEN b.low ELSE -b.high END AS worst, o.i IS NOT NULL AS turns
  FROM e JOIN b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 1 AND e.i + 1 + e.room LEFT JOIN f o ON o.symbol = e.symbol AND o.i = b.i AND o.side <> e.side
), q AS (
  SELECT *, coalesce(CASE WHEN k = 0 THEN NULL WHEN worst <= s * stop THEN 'stop' WHEN best >= s * t2 THEN 't2' WHEN best >= s * t1 THEN 't1' WHEN turns AND next_open IS NOT NULL THEN 'reversal' END, CASE WHEN k = room THEN 'time' END) AS reason FROM p
), x AS (
  SELECT setup, symbol, i, side, any_value(entry) AS entry, any_value(s) AS s, any_value(risk) AS risk, min(k) FILTER (reason IS NOT NULL) AS k,
    arg_min(reason, k) FILTER (reason IS NOT NULL) AS reason,
    arg_min(CASE reason WHEN 'stop' THEN stop WHEN 't2' THEN t2 WHEN 't1' THEN t1 WHEN 'reversal' THEN next_open ELSE close END, k) FILTER (reason IS NOT NULL) AS exit_price
  FROM q GROUP BY 1, 2, 3, 4
), y AS (
  SELECT *, k + (reason = 'reversal')::INTEGER AS held, i + 1 + k + (reason = 'reversal')::INTEGER AS exit_i FROM x
), l AS (
  SELECT setup, symbol, side, list([i, exit_i] ORDER BY i) AS l FROM y GROUP BY 1, 2, 3
), kept AS (
  SELECT setup, symbol, side, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda acc, v: CASE WHEN v[1][1] - acc[-1][2] > {COOLDOWN} THEN list_concat(acc, v) ELSE acc END))[1] AS i FROM l
), m AS (
  SELECT q.symbol, q.i, q.side, least(0, min((worst - s * entry) / risk) FILTER (q.k > 0)) AS mae_r, greatest(0, max((best - s * entry) / risk) FILTER (q.k > 0)) AS mfe_r
  FROM (SELECT q.*, y.k AS ended FROM q JOIN y USING (setup, symbol, i, side)) q WHERE q.k <= ended GROUP BY 1, 2, 3
)
SELECT symbol, i::INTEGER AS i, side, exit_i::INTEGER AS exit_i, reason, held::INTEGER AS held, round(exit_price, 4) AS exit_price, round(s * (exit_price - entry) / risk, 4) AS gain_r, round(coalesce(mae_r, 0), 4) AS mae_r, round(coalesce(mfe_r, 0), 4) AS mfe_r
FROM y JOIN kept USING (setup, symbol, side, i) JOIN m USING (symbol, side, i)
""")
def trade_sequences(spark, root):
    """Breakouts of 20 closes, traded one at a time with a pause after each, opposite breakouts closing them."""
    up, down = F.max("close").over(S.prior(20)), F.min("close").over(S.prior(20))
    bars = order_bars(spark, root).withColumns({"i": F.row_number().over(S.ordered()), "up": up, "down": down})
    side = F.when(F.col("close") > F.col("up"), "LONG").when(F.col("close") < F.col("down"), "SHORT")
    nothing = F.lit(None).cast("double")
    fires = bars.select(F.lit("breakout").alias("setup"), "symbol", "i", side.alias("side"), (F.col("close") * F.when(side == "LONG", 0.7).otherwise(1.3)).alias("stop"), nothing.alias("t1"), nothing.alias("t2")).where("side is not null")
    x = trades.sequenced(trades.exits(fires, bars, ["setup"], HORIZON), ["setup"], COOLDOWN)
    return x.select("symbol", "i", "side", "exit_i", "reason", "held", *(r(F.col(c), c, 4) for c in ("exit_price", "gain_r", "mae_r", "mfe_r")))


@query()
def change_points(spark, root):
    """The probability, at every bar, that the level of a series' changes has shifted within five bars."""
    x = order_bars(spark, root).withColumn("d", F.log(F.col("close") / F.lag("close").over(S.ordered()))).where("d is not null")
    x = x.select("symbol", "bar_date", F.array(F.col("d")).alias("x"))
    p = changepoints.change_probabilities(x, "symbol", "bar_date", "x", 1)
    return p.select("symbol", "bar_date", r(F.col("p_change"), "p_change"))


@query()
def level_segments(spark, root):
    """Breaks in the mean of weekly volumes by return flag."""
    x = table(spark, root, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.date_trunc("week", "l_shipdate").alias("week")).agg(F.sum("l_quantity").cast("double").alias("volume"))
    return changepoints.level_breaks(x, "symbol", "week", "volume")


# Line numbers as nodes and the tenors in months that they stand for.
LINES = {"1": 1.0, "2": 6.0, "3": 12.0, "4": 24.0, "5": 36.0}


@query()
def regime_states(spark, root):
    """Six hidden states of the factors of weekly changes in mean price by line number, smoothed along the calendar and named."""
    week = F.date_trunc("week", "l_shipdate").alias("week")
    prices = table(spark, root, "lineitem").groupBy(week, F.col("l_linenumber").cast("string").alias("line")).agg(F.avg("l_extendedprice").alias("price"))
    x = factors.standardised(factors.changes(prices.withColumn("panel", F.lit("lines")), ["panel"], "week", "line", "price", list(LINES)), ["panel"], len(LINES))
    fits = factors.factor_fits(x, ["panel"], list(LINES.values()), window=1_000_000)
    points = factors.factor_scores(x, fits, ["panel"]).where("scores is not null").select("panel", "week", "scores").persist()
    mixture = regimes.fit_mixture(points, "scores", k=6)
    days = regimes.regime_days(points, ["panel"], "week", "scores", mixture)
    order = regimes.matched(mixture.means, None)
    entropy = {row["state"]: row["entropy"] for row in regimes.state_runs(days, ["panel"], "week").collect()}
    names = regimes.named(mixture.means[order], [entropy[s] for s in range(6)])
    points.unpersist()
    named = F.element_at(F.array(*map(F.lit, names)), F.col("state") + 1)
    return days.select("week", "state", named.alias("state_name"), r(F.col("top"), "top", 4), regimes.degraded().alias("degraded"))
