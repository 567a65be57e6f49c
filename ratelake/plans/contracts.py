"""Queries on contracts: symbols, calendars, levels, chains and constant-maturity nodes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.functions import calendar as C
from ratelake.functions import levels as L
from ratelake.functions import series as S
from ratelake.operators import curves
from ratelake.plans.registry import BARS, SERIES, query, r
from ratelake.sources.bars import order_bars, table

WED = "(date_trunc('month', {0})::DATE + ((10 - isodow(date_trunc('month', {0})))::INTEGER % 7) + 14)"
MONTHS = "months AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders)"
CODE = "'SRA' || substr('FGHJKMNQUVXZ', month(month)::INTEGER, 1) || strftime(month, '%y')"
END = WED.format("(month + INTERVAL 3 MONTH)::DATE")


def month_rows(spark, root):
    return table(spark, root, "orders").select(F.to_date(F.trunc("o_orderdate", "month")).alias("month")).distinct()


@query(f"""WITH {MONTHS} SELECT {CODE} AS symbol, month AS parsed, {WED.format('month')} AS period_from, {END} AS period_to, {END} - 1 AS last_trade, month(month) IN (3, 6, 9, 12) AS quarterly, month >= DATE '1995-08-01' AS after_cutover, 'SRA' AS base FROM months""")
def contract_calendar(spark, root):
    x = month_rows(spark, root).withColumn("symbol", C.symbol_of(F.lit("SRA"), F.col("month")))
    begin, end = C.reference_period(F.col("month"))
    return x.select("symbol", C.symbol_month(F.col("symbol"), "SRA").alias("parsed"), begin.alias("period_from"), end.alias("period_to"), C.last_trade(F.col("month")).alias("last_trade"), C.is_quarterly(F.col("symbol"), "SRA").alias("quarterly"), (F.col("month") >= F.lit("1995-08-01").cast("date")).alias("after_cutover"), C.base_of(F.col("symbol"), ["ER", "SRA", "SR"]).alias("base"))


@query(f"""WITH {MONTHS}, q AS (SELECT month, {CODE} AS a, lead({CODE}) OVER (ORDER BY month) AS b, lead({CODE}, 2) OVER (ORDER BY month) AS c FROM months WHERE month(month) IN (3, 6, 9, 12)) SELECT a || '-' || b[4:] || '-' || c[4:] AS symbol, a AS leg_1, b AS leg_2, c AS leg_3 FROM q WHERE c IS NOT NULL""")
def fly_symbols(spark, root):
    x = month_rows(spark, root).where(F.month("month").isin(3, 6, 9, 12)).withColumn("s", C.symbol_of(F.lit("SRA"), F.col("month")))
    w = W.partitionBy().orderBy("month")  # a row per quarter of the calendar
    x = x.withColumn("legs", F.array("s", F.lead("s").over(w), F.lead("s", 2).over(w))).where(F.col("legs")[2].isNotNull())
    x = x.withColumn("symbol", C.listed(F.col("legs"), "SRA")).withColumn("found", C.legs(F.col("symbol"), "SRA"))
    return x.select("symbol", *(F.col("found")[i].alias(f"leg_{i + 1}") for i in range(3)))


@query("""WITH d AS (SELECT DISTINCT l_shipdate::DATE AS a, DATE '1995-06-17' AS b FROM lineitem) SELECT a AS day, (CASE WHEN b >= a THEN (SELECT count(*) FROM range(b - a) t(i) WHERE isodow(a + i::INTEGER) < 6) ELSE -(SELECT count(*) FROM range(a - b) t(i) WHERE isodow(b + 1 + i::INTEGER) < 6) END)::INTEGER AS distance, (SELECT min(a + i::INTEGER) FROM range(1, 11) t(i) WHERE (SELECT count(*) FROM range(1, 11) u(j) WHERE j <= i AND isodow(a + j::INTEGER) < 6) = 5) AS later FROM d""")
def business_days(spark, root):
    x = table(spark, root, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return x.select("day", C.business_days(F.col("day"), F.lit("1995-06-17").cast("date")).alias("distance"), C.add_business_days(F.col("day"), 5).alias("later"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), s AS (SELECT day, (make_date(year(day), 4, 1) + ((7 - isodow(make_date(year(day), 4, 1)))::INTEGER % 7)) AS begin, (make_date(year(day), 10, 31) - (isodow(make_date(year(day), 10, 31)) % 7)::INTEGER) AS finish FROM d) SELECT day, day + CASE WHEN day >= begin AND day < finish THEN INTERVAL 750 MINUTE ELSE INTERVAL 810 MINUTE END AS release FROM s""")
def release_times(spark, root):
    """New York 8:30 in UTC; the SQL states the daylight saving of the years in the table (first Sunday of April to last of October)."""
    x = table(spark, root, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return x.select("day", C.eastern(F.col("day"), "08:30:00").alias("release"))


TICK = "round_even(close / 0.005, 0) * 0.005"


@query(f"""WITH {BARS}, p AS (SELECT symbol, bar_date, close / 10000 AS close, (close - lag(close) OVER {SERIES}) / 10000 AS change, open / 10000 AS open, low / 10000 AS low, volume FROM bars) SELECT symbol, bar_date, round(100 - close, 6) AS rate, round(change * 100, 4) AS change_bp, round({TICK}, 4) AS tick, CASE (close > open)::INT + (volume > 1)::INT + (coalesce(change, 0) > 0)::INT + (close > 15)::INT WHEN 4 THEN 'FIRED' WHEN 3 THEN 'NEAR' WHEN 2 THEN 'APPROACHING' ELSE 'FAR' END AS state, CASE WHEN close > low THEN least(greatest(floor(10000 / ((close - low) * 100 * 25)), 1), 1000) ELSE 0 END::BIGINT AS lots, round(close + (close - low), 6) AS t1, round(close + 2 * (close - low), 6) AS t2 FROM p""")
def price_levels(spark, root):
    p = order_bars(spark, root).select("symbol", "bar_date", *((F.col(c) / 10000).alias(c) for c in ("close", "open", "low")), ((F.col("close") - F.lag("close").over(S.ordered())) / 10000).alias("change"), "volume")
    multiplier = L.bp_multiplier(F.lit("price"))
    met = [F.col("close") > F.col("open"), F.col("volume") > 1, F.col("change") > 0, F.col("close") > 15]
    t1, t2 = L.r_levels(F.col("close"), F.col("low"), F.lit("LONG"))
    return p.select("symbol", "bar_date", r(L.implied_rate(F.col("close")), "rate"), r(F.col("change") * multiplier, "change_bp", 4), r(L.round_to_tick(F.col("close"), multiplier), "tick", 4), L.state_of(met).alias("state"), L.lots_at_risk((F.col("close") - F.col("low")) * multiplier).alias("lots"), r(t1, "t1"), r(t2, "t2"))


MEETINGS = f"meetings AS (SELECT DISTINCT {WED.format('month')} AS meeting FROM months WHERE month(month) IN (3, 6, 9, 12))"


@query(f"""WITH {BARS}, {MONTHS}, {MEETINGS}, rates AS (SELECT bar_date, close / 10000 AS rate FROM bars WHERE symbol = '1-URGENT') SELECT meeting, meeting - 12 AS blackout_from, meeting + 1 AS blackout_to, lead(meeting) OVER (ORDER BY meeting) AS next_meeting, round(b, 6) AS before, round(a, 6) AS after, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN abs(a - b) * 100 < 5 THEN 'HOLD' WHEN a > b THEN 'HIKE' ELSE 'CUT' END AS outcome FROM (SELECT meeting, (SELECT max_by(rate, bar_date) FROM rates WHERE bar_date < meeting) AS b, (SELECT min_by(rate, bar_date) FROM rates WHERE bar_date >= meeting) AS a FROM meetings)""")
def meeting_outcomes(spark, root):
    rates = order_bars(spark, root).where("symbol = '1-URGENT'").select(F.col("bar_date").alias("at"), (F.col("close") / 10000).alias("rate"))
    meetings = month_rows(spark, root).where(F.month("month").isin(3, 6, 9, 12)).select(C.third_wednesday(F.col("month")).alias("meeting"))
    return curves.outcomes(meetings, rates, 12, 1, 0.05).select("meeting", "blackout_from", "blackout_to", "next_meeting", r(F.col("before"), "before"), r(F.col("after"), "after"), "outcome")


CHAIN = f"""chain AS (SELECT p_size, p_brand AS series, {'round(avg(p_retailprice), 4)'} AS price FROM part GROUP BY 1, 2)"""


@query(f"""WITH {CHAIN}, n AS (SELECT series, p_size, price, row_number() OVER (PARTITION BY series ORDER BY p_size) AS i FROM chain) SELECT series, p_size, i::INTEGER AS place, CASE WHEN i <= 6 THEN 'front' WHEN i <= 14 THEN 'mid' ELSE 'back' END AS section, CASE ((i - 1) // 4)::INTEGER WHEN 0 THEN 'Whites' WHEN 1 THEN 'Reds' WHEN 2 THEN 'Greens' WHEN 3 THEN 'Blues' WHEN 4 THEN 'Golds' ELSE 'Later' END AS pack, round((lead(price) OVER w - price) / (lead(p_size) OVER w - p_size) * 100, 4) AS carry FROM n WINDOW w AS (PARTITION BY series ORDER BY p_size)""")
def chain_sections(spark, root):
    chain = table(spark, root, "part").groupBy(F.col("p_brand").alias("series"), "p_size").agg(r(F.avg("p_retailprice"), "price", 4))
    return curves.sections(chain, "series", "p_size").select("series", "p_size", "place", "section", "pack", r(curves.carry("series", "p_size", "price"), "carry", 4))


NODES = "nodes AS (SELECT unnest([3, 7.5, 12.25, 20, 33.5, 49]) AS x)"


@query(f"""WITH {CHAIN}, {NODES}, k AS (SELECT *, lead(p_size) OVER w - p_size AS h, (lead(price) OVER w - price) / (lead(p_size) OVER w - p_size) AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY series) AS n FROM chain WINDOW w AS (PARTITION BY series ORDER BY p_size)), m AS (SELECT *, lag(h) OVER w AS h0, lag(d) OVER w AS d0, lead(h) OVER w AS h1, lead(d) OVER w AS d1, lag(h, 2) OVER w AS h2, lag(d, 2) OVER w AS d2 FROM k WINDOW w AS (PARTITION BY series ORDER BY p_size)), s AS (SELECT *, CASE WHEN n = 2 THEN coalesce(d, d0) WHEN i = 1 THEN CASE WHEN sign(((2 * h + h1) * d - h * d1) / (h + h1)) <> sign(d) THEN 0 WHEN sign(d) <> sign(d1) AND abs(((2 * h + h1) * d - h * d1) / (h + h1)) > 3 * abs(d) THEN 3 * d ELSE ((2 * h + h1) * d - h * d1) / (h + h1) END WHEN i = n THEN CASE WHEN sign(((2 * h0 + h2) * d0 - h0 * d2) / (h0 + h2)) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(d2) AND abs(((2 * h0 + h2) * d0 - h0 * d2) / (h0 + h2)) > 3 * abs(d0) THEN 3 * d0 ELSE ((2 * h0 + h2) * d0 - h0 * d2) / (h0 + h2) END WHEN d0 * d <= 0 THEN 0 ELSE (3 * (h0 + h)) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) END AS slope FROM m), g AS (SELECT series, x, p_size, price, h, slope, lead(price) OVER (PARTITION BY series, x ORDER BY p_size) AS p1, lead(slope) OVER (PARTITION BY series, x ORDER BY p_size) AS s1 FROM s, nodes), e AS (SELECT *, (x - p_size) / h AS t FROM g WHERE x >= p_size AND x < p_size + h) SELECT series, x::DOUBLE AS node, round(price + t * (p1 - price) + 1e-7, 4) AS linear, round((1 + 2 * t) * (1 - t) * (1 - t) * price + t * (1 - t) * (1 - t) * h * slope + t * t * (3 - 2 * t) * p1 + t * t * (t - 1) * h * s1 + 1e-7, 4) AS shaped FROM e""")
def curve_nodes(spark, root):
    chain = table(spark, root, "part").groupBy(F.col("p_brand").alias("series"), F.col("p_size").cast("double").alias("x")).agg(r(F.avg("p_retailprice"), "y", 4))
    return curves.nodes(chain, "series", [3, 7.5, 12.25, 20, 33.5, 49]).select("series", "node", r(F.col("linear") + 1e-7, "linear", 4), r(F.col("shaped") + 1e-7, "shaped", 4))  # so that both round a value halfway between two the same way


LISTED = f"""listed AS (SELECT {CODE} AS symbol, {END} - 1 AS expiry, {END} - 400 AS first_bar, month FROM months WHERE month(month) IN (3, 6, 9, 12))"""


@query(f"""WITH {MONTHS}, {LISTED}, d AS (SELECT DISTINCT o_orderdate::DATE AS bar_date FROM orders) SELECT d.bar_date, symbol, (expiry - d.bar_date)::INTEGER AS days, (row_number() OVER (PARTITION BY d.bar_date ORDER BY expiry))::INTEGER AS place FROM d JOIN listed ON d.bar_date BETWEEN first_bar AND expiry""")
def active_chain(spark, root):
    listed = month_rows(spark, root).where(F.month("month").isin(3, 6, 9, 12)).select(C.symbol_of(F.lit("SRA"), F.col("month")).alias("symbol"), C.last_trade(F.col("month")).alias("expiry"))
    listed = listed.withColumn("first_bar", F.date_sub("expiry", 399))
    days = table(spark, root, "orders").select(F.to_date("o_orderdate").alias("bar_date")).distinct()
    return curves.active(days, listed)


@query(f"""WITH {BARS}, c AS (SELECT symbol, bar_date, close, volume, dense_rank() OVER (ORDER BY symbol) AS k FROM bars), p AS (SELECT a.k, a.bar_date, a.close AS old, b.close AS new, b.volume > a.volume AS more FROM c a JOIN c b ON b.k = a.k + 1 AND b.bar_date = a.bar_date), s AS (SELECT *, bool_and(more) OVER w AND count(*) OVER w = 3 AS sustained, min(bar_date) OVER w AS begun FROM p WINDOW w AS (PARTITION BY k ORDER BY bar_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), g AS (SELECT k, min(bar_date) AS roll, min_by(new - old, bar_date) AS gap FROM s WHERE sustained AND bar_date >= DATE '1993-01-01' GROUP BY k) SELECT k::INTEGER AS pair, roll, round(gap, 4) AS gap, round(sum(gap) OVER (ORDER BY k DESC), 4) AS adjustment FROM g""")
def roll_calendar(spark, root):
    """Series of neighbouring priorities stand for neighbouring contracts."""
    x = order_bars(spark, root)
    names = x.select("symbol").distinct().withColumn("k", F.dense_rank().over(W.partitionBy().orderBy("symbol")))  # a row per contract
    x = x.join(F.broadcast(names), "symbol").select("k", "bar_date", "close", "volume")
    rolls = curves.rolls(x, F.lit("1993-01-01").cast("date"))
    return rolls.select(F.col("k").alias("pair"), "roll", r(F.col("gap"), "gap", 4), r(F.col("adjustment"), "adjustment", 4))
