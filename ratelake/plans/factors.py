"""Queries on the factors of curve changes, on hidden regimes, change-points and breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.operators import factors
from ratelake.plans.registry import BARS, query, r
from ratelake.sources.bars import order_bars

# Nodes of the panel and the tenors in months that they stand for.
NODES = {"1-URGENT": 3.0, "2-HIGH": 12.0, "3-MEDIUM": 24.0, "4-NOT SPECIFIED": 36.0, "5-LOW": 60.0}
WINDOW, STEP = 252, 5


def order_changes(spark, root):
    """Changes of the panel of order prices, in thousands, of days that have every node."""
    bars = order_bars(spark, root).select(F.lit("orders").alias("panel"), "bar_date", "symbol", (F.col("close") / 1000).alias("price"))
    return factors.changes(bars, ["panel"], "bar_date", "symbol", "price", list(NODES))


_LETTERS = "abcde"
WIDE = f"wide AS (SELECT bar_date, {', '.join(f"max(close) FILTER (symbol = '{s}') / 1000 AS {c}" for c, s in zip(_LETTERS, NODES))} FROM bars GROUP BY 1)"
STEPS = f"""steps AS (
  SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS i, count(*) OVER () - 1 AS last, {', '.join(f'{c} - lag({c}) OVER (ORDER BY bar_date) AS {c}' for c in _LETTERS)}
  FROM wide WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _LETTERS)}
)"""
_PAIRS = [(a, b) for k, a in enumerate(_LETTERS) for b in _LETTERS[k:]]


@query(f"""
WITH {BARS}, {WIDE}, {STEPS}, m AS (
  SELECT i, last, bar_date, {', '.join(f'covar_samp({a}, {b}) OVER w AS {a}{b}' for a, b in _PAIRS)}
  FROM steps WHERE i > 0 WINDOW w AS (ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)
), refits AS (
  SELECT * FROM m WHERE CASE WHEN last < {WINDOW} THEN i = last AND last >= 29 ELSE i >= {WINDOW} AND ((i - {WINDOW}) % {STEP} = 0 OR i = last) END
)
SELECT i::INTEGER AS i, pair, round(covariance, 2) AS covariance FROM refits UNPIVOT (covariance FOR pair IN ({', '.join(f'{a}{b}' for a, b in _PAIRS)}))
""")
def factor_moments(spark, root):
    """Covariances of the panel's changes in every window of the rolling factor model."""
    d = len(NODES)
    m = factors.window_moments(order_changes(spark, root), ["panel"], d, WINDOW, STEP)
    n, s = F.col("n"), F.col("sums")
    entries = []
    for k, (a, b) in enumerate(factors._pairs(d)):
        covariance = (s[d + k] - s[a] * s[b] / n) / (n - 1)
        entries.append(F.struct(F.lit(_LETTERS[a] + _LETTERS[b]).alias("pair"), r(covariance, "covariance", 2)))
    return m.select("i", F.inline(F.array(*entries)))


@query()
def factor_days(spark, root):
    """Every day's factors by the fit at hand, what they explain of its change, and the residual's size."""
    x = order_changes(spark, root)
    fits = factors.factor_fits(x, ["panel"], list(NODES.values()), WINDOW, STEP)
    y = factors.decomposed(factors.factor_scores(x, fits, ["panel"]))
    scores = [r(F.col("scores")[k], f"pc{k + 1}", 4) for k in range(3)]
    return y.select("bar_date", *scores, *(r(F.col(c), c) for c in ("share_1", "share_2", "share_3", "share_residual", "explained")), r(F.col("error"), "error", 4))
