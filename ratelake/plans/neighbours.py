"""Queries on days like a given one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.functions import series as S
from ratelake.operators import analogs
from ratelake.plans.registry import BARS, SERIES, prior, query, r
from ratelake.sources.bars import order_bars

EVERY = 100


def _z(n: int) -> str:
    return f"CASE WHEN count(close) OVER {prior(n)} >= 2 AND stddev_samp(close) OVER {prior(n)} <> 0 THEN (close - avg(close) OVER {prior(n)}) / stddev_samp(close) OVER {prior(n)} END"


@query(f"""
WITH {BARS}, f AS (
  SELECT symbol, bar_date, row_number() OVER {SERIES} AS i, {_z(20)} AS a, {_z(60)} AS b, lead(close, 5) OVER {SERIES} / close - 1 AS after FROM bars
), x AS (
  SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL
), m AS (
  SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS aa, covar_samp(a, b) AS ab, covar_samp(b, b) AS bb FROM x
), s AS (
  SELECT any_value(m) AS m, avg(((a - ma) * (a - ma) + (b - mb) * (b - mb)) ** 2) AS fourth FROM x, m
), t AS (
  SELECT m.*, (m.aa + m.bb) / 2 AS mu, fourth - (m.n - 2) / m.n * (m.aa * m.aa + 2 * m.ab * m.ab + m.bb * m.bb) AS spread FROM s
), u AS (
  SELECT *, greatest(0, least(1, spread / ((aa - mu) * (aa - mu) + 2 * ab * ab + (bb - mu) * (bb - mu)) / n)) AS share FROM t
), c AS (
  SELECT (1 - share) * aa + share * mu AS p, (1 - share) * ab AS q, (1 - share) * bb + share * mu AS r FROM u
), pairs AS (
  SELECT k.symbol, k.bar_date AS query_at, h.bar_date, h.after, k.bar_date - h.bar_date AS days,
    sqrt((r * (h.a - k.a) * (h.a - k.a) - 2 * q * (h.a - k.a) * (h.b - k.b) + p * (h.b - k.b) * (h.b - k.b)) / (p * r - q * q)) AS distance
  FROM x k JOIN x h ON h.symbol = k.symbol AND k.bar_date - h.bar_date > 60, c WHERE k.i % {EVERY} = 0
), w AS (
  SELECT *, exp(-distance / median(distance) OVER (PARTITION BY symbol, query_at)) * exp(-days / 250.0) AS weight FROM pairs
), best AS (
  SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY symbol, query_at ORDER BY weight DESC, bar_date) <= 50
), e AS (
  SELECT *, sum(weight) OVER (PARTITION BY symbol, query_at) ** 2 / sum(weight * weight) OVER (PARTITION BY symbol, query_at) AS eff_n FROM best
), v AS (
  SELECT *, sum(weight) OVER (PARTITION BY symbol, query_at ORDER BY after) AS upto, sum(weight) OVER (PARTITION BY symbol, query_at) AS whole FROM e WHERE after IS NOT NULL
)
SELECT symbol, query_at, count(*) AS n, round(any_value(eff_n), 4) AS eff_n, {", ".join(f"round(min(after) FILTER (upto >= {q} * whole * (1 - 1e-12)), 6) AS {name}" for name, q in (("low", 0.25), ("middle", 0.5), ("high", 0.75)))}
FROM v GROUP BY 1, 2
""")
def analog_bands(spark, root):
    """What followed, within five bars, the days most like every hundredth one: weighted quartiles and the effective number of days."""
    x = order_bars(spark, root).withColumns({"i": F.row_number().over(S.ordered()), "a": S.prior_z("close", 20), "b": S.prior_z("close", 60), "after": F.lead("close", 5).over(S.ordered()) / F.col("close") - 1})
    x = x.where("a is not null and b is not null").select("symbol", "bar_date", "i", "after", F.array("a", "b").alias("x"))
    covariance, _ = analogs.shrunk_covariance(x, "x", 2)
    found = analogs.analogs(x, x.where(F.col("i") % EVERY == 0), ["symbol"], "bar_date", "x", covariance)
    known = found.join(x.select("symbol", "bar_date", "after"), ["symbol", "bar_date"])
    bands = analogs.weighted_quantiles(known, ["symbol", "query_at", "eff_n"], "after", "weight", {"low": 0.25, "middle": 0.5, "high": 0.75})
    return bands.select("symbol", "query_at", "n", r(F.col("eff_n"), "eff_n", 4), *(r(F.col(c), c) for c in ("low", "middle", "high")))
