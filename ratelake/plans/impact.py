"""Queries of what releases did to instruments: largest events of a type and New York day as releases, hourly bars of all types as instruments."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions import levels as L
from ratelake.operators import impact as I
from ratelake.plans.registry import query, r
from ratelake.sources.bars import event_bars, table

RECENT = {"5d": 5, "10d": 10, "20d": 20}  # the tables hold one month
KEYS = ["ticker", "symbol", "state"]

LOCAL = "timezone('America/New_York', timezone('UTC', {}))"
SQL_ANCHORS = {
    "before_open": "arg_max(close, (day, -epoch(t))) FILTER (day < release_day)",
    "before_close": "arg_max(close, t) FILTER (day < release_day)",
    "open": "arg_min(close, t) FILTER (day = release_day)",
    "close": "arg_max(close, t) FILTER (day = release_day)",
    "after_open": "arg_min(close, t) FILTER (day > release_day)",
    "after_close": "arg_min(close, (day, -epoch(t))) FILTER (day > release_day)",
    **{n: f"max(close) FILTER (t = date_trunc('hour', released) + INTERVAL ({h}) HOUR)" for n, h in I.HOURS.items()},
}
SQL_MOVES = f"""
b AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS t, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2
), bars AS (
  SELECT *, {LOCAL.format("t")} AS wall, wall::DATE AS day FROM b
), c AS (
  SELECT event_type AS ticker, ts AS released, event_id, value, {LOCAL.format("ts")}::DATE AS release_day FROM events WHERE event_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_type, release_day ORDER BY value DESC, ts, event_id) = 1
), e AS (
  SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS k, value - lag(value) OVER (PARTITION BY ticker ORDER BY released) AS change
  FROM c WINDOW w AS (PARTITION BY ticker ORDER BY released ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)
), releases AS (
  SELECT ticker, released, release_day, CASE WHEN k >= 4 AND sd > 0 AND change IS NOT NULL THEN CASE WHEN change = 0 THEN 'FLAT' ELSE
    (CASE WHEN change > 0 THEN 'UP' ELSE 'DOWN' END) || '_' || (CASE WHEN value > m THEN 'POS' ELSE 'NEG' END) || '_' || (CASE WHEN abs((value - m) / sd) < 1 THEN 'small' ELSE 'large' END) END END AS state FROM e
), seen AS (
  SELECT ticker, released, release_day, state, bars.* FROM releases JOIN bars ON wall >= release_day - INTERVAL 60 HOUR AND wall < release_day + INTERVAL 84 HOUR
), anchors AS (
  SELECT ticker, released, release_day, state, symbol, {", ".join(f'{v} AS "{k}"' for k, v in SQL_ANCHORS.items())},
    max(day) FILTER (day < release_day) AS day_before, count(*) FILTER (day = release_day) < 12 AS partial_t, count(*) FILTER (day = release_day + 1) < 12 AS partial_tp1 FROM seen GROUP BY 1, 2, 3, 4, 5
), prior AS (
  SELECT s.ticker, s.released, s.symbol, s.high, s.low, s.close, row_number() OVER w AS k, lead(s.close) OVER w AS p, count(*) OVER (PARTITION BY s.ticker, s.released, s.symbol) AS n
  FROM seen s JOIN anchors a ON a.ticker = s.ticker AND a.released = s.released AND a.symbol = s.symbol AND s.day < a.day_before WINDOW w AS (PARTITION BY s.ticker, s.released, s.symbol ORDER BY s.t DESC)
), ranges AS (
  SELECT ticker, released, symbol, avg(greatest(high - low, abs(high - p), abs(low - p))) FILTER (p IS NOT NULL) AS atr FROM prior WHERE n >= 5 AND k <= 20 GROUP BY 1, 2, 3
), moves AS (
  SELECT a.*, atr, CASE WHEN atr > 0 THEN greatest(atr, 0.005) * 100 END AS unit, coalesce(atr > 0 AND atr < 0.005, false) AS floored,
    {", ".join(f'("{end}" - "{begin}") * 100 AS {m}_bp, ("{end}" - "{begin}") * 100 / unit AS {m}_norm' for m, (end, begin) in I.MEASURES.items())}
  FROM anchors a LEFT JOIN ranges g ON g.ticker = a.ticker AND g.released = a.released AND g.symbol = a.symbol
)"""
SQL_STATES = f"""{SQL_MOVES}, long AS (
  {" UNION ALL ".join(f"SELECT ticker, symbol, state, release_day, '{m}' AS measure, {m}_bp AS bp, {m}_norm AS norm FROM moves WHERE state IS NOT NULL AND {m}_norm IS NOT NULL" for m in I.MEASURES)}
), windowed AS (
  SELECT long.*, w.name AS win FROM long, (SELECT max(release_day) AS newest FROM releases), (VALUES ('full', 1000000), {", ".join(f"('{n}', {d})" for n, d in RECENT.items())}) w(name, back) WHERE newest - release_day <= back
), states AS (
  SELECT ticker, symbol, state, measure, win, count(*) AS n, median(norm) AS median, quantile_cont(norm, 0.25) AS p25, quantile_cont(norm, 0.75) AS p75, median(bp) AS median_bp, avg((abs(norm) > 1)::INT) AS above_one,
    array_to_string(list_sort(list_reverse_sort(list(strftime(release_day, '%Y-%m-%d')))[1:3]), ';') AS latest FROM windowed GROUP BY 1, 2, 3, 4, 5
)"""


def calendar(spark, root):
    """The largest event of a type and New York day; its state follows from the change since the last and the surprise against twelve before (four at least)."""
    x = table(spark, root, "events").where("event_type is not null").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("released"), "event_id", "value")
    x = x.withColumn("release_day", F.to_date(F.from_utc_timestamp("released", I.ZONE)))
    x = x.groupBy("ticker", "release_day").agg(F.min_by(F.struct("released", "value"), F.struct(-F.col("value"), "released", "event_id")).alias("e")).select("ticker", "e.*")
    w = W.partitionBy("ticker").orderBy("released")  # a row per ticker and day
    before, value = w.rowsBetween(-12, -1), F.col("value")
    spread = F.stddev_pop("value").over(before)
    z = F.when((F.count("value").over(before) >= 4) & (spread > 0), (value - F.avg("value").over(before)) / F.when(spread > 0, spread))
    x = x.select("ticker", "released", z.alias("z"), (value - F.lag("value").over(w)).alias("change"))
    size = F.when(F.abs("z") < 1, F.abs("change")).otherwise(-1.0)  # small where the surprise is below one deviation
    return x.select("ticker", "released", F.when(F.col("z").isNotNull() & F.col("change").isNotNull(), L.sign_state(F.col("change"), size, F.col("z"))).alias("state"))


def moves(spark, root):
    return I.release_moves(calendar(spark, root), event_bars(spark, root), ["ticker", "state"], "released")


def states(spark, root):
    x = moves(spark, root)
    asof = calendar(spark, root).agg(F.max(F.to_date(F.from_utc_timestamp("released", I.ZONE))).alias("asof")).scalar()
    return I.state_summary(x.withColumn("asof", asof), KEYS, F.col("asof"), RECENT)


@query(f"WITH {SQL_MOVES} SELECT ticker, released, symbol, state, round(atr, 6) AS atr, floored, partial_t, partial_tp1, {', '.join(f'round({m}_bp, 4) AS {m}_bp, round({m}_norm, 6) AS {m}_norm' for m in I.MEASURES)} FROM moves")
def release_moves(spark, root):
    """Each release against each instrument: eleven moves in basis points and in hourly ranges."""
    measures = [r(F.col(f"{m}_{u}"), f"{m}_{u}", d) for m in I.MEASURES for u, d in (("bp", 4), ("norm", 6))]
    return moves(spark, root).select("ticker", "released", "symbol", "state", r(F.col("atr"), "atr"), "floored", "partial_t", "partial_tp1", *measures)


@query(f"WITH {SQL_STATES} SELECT ticker, symbol, state, measure, win AS period, n, round(median, 4) AS median, round(p25, 4) AS p25, round(p75, 4) AS p75, round(median_bp, 4) AS median_bp, round(above_one, 6) AS above_one, latest, n < 3 AS low_sample FROM states")
def release_states(spark, root):
    """Medians and quartiles of the moves by ticker, instrument, state, measure and window."""
    shown = [r(F.col(c), c, 4) for c in ("median", "p25", "p75", "median_bp")]
    return states(spark, root).select(*KEYS, "measure", F.col("window").alias("period"), "n", *shown, r(F.col("above_one"), "above_one"), "latest", "low_sample")


@query(f"""WITH {SQL_STATES}, wide AS (
  SELECT ticker, symbol, state, measure, {", ".join(f"max(median) FILTER (win = '{w}') AS median_{w}, max(n) FILTER (win = '{w}') AS n_{w}" for w in (*RECENT, "full"))},
    max(p75) FILTER (win = 'full') - max(p25) FILTER (win = 'full') AS span FROM states GROUP BY 1, 2, 3, 4
), far AS (
  SELECT *, {", ".join(f"CASE WHEN span > 0 THEN round((median_{w} - median_full) / span, 9) END AS far_{w}" for w in RECENT)} FROM wide
)
SELECT ticker, symbol, state, measure, {", ".join(f"round(median_{w}, 4) AS median_{w}, n_{w}" for w in (*RECENT, "full"))}, {", ".join(f"round(far_{w}, 4) AS recency_{w}" for w in RECENT)},
  CASE WHEN far_10d IS NULL THEN 'STABLE' WHEN sign(median_10d) * sign(median_full) < 0 THEN 'REVERSING' WHEN abs(far_10d) > 1 THEN 'GROWING' WHEN abs(far_10d) < 0.5 AND abs(median_full) > 0.1 THEN 'FADING' ELSE 'STABLE' END AS tag FROM far""")
def release_drift(spark, root):
    """Medians of recent windows against the full one, with a tag for how the response drifts."""
    x = I.drift_tags(states(spark, root), KEYS, "10d", RECENT)
    return x.select(*KEYS, "measure", *(c for w in (*RECENT, "full") for c in (r(F.col(f"median_{w}"), f"median_{w}", 4), F.col(f"n_{w}"))), *(r(F.col(f"recency_{w}"), f"recency_{w}", 4) for w in RECENT), "tag")
