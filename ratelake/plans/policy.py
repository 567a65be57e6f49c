"""Queries on meeting odds, hedge weights, position sizes and validation by purged folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelake.functions import levels as L
from ratelake.functions import series as S
from ratelake.operators import validation
from ratelake.plans.registry import BARS, SERIES, TRADES, query, r
from ratelake.sources.bars import order_bars, table

# The lattice of moves in basis points.
LATTICE = {"m50": -50.0, "m25": -25.0, "zero": 0.0, "p25": 25.0, "p50": 50.0}


@query(f"""WITH {BARS}, c AS (SELECT symbol, bar_date, (close - lag(close) OVER {SERIES}) / 2000 AS move FROM bars), b AS (SELECT *, greatest(-50, least(50, move)) AS m FROM c WHERE move IS NOT NULL) SELECT symbol, bar_date, {", ".join(f"round(greatest(0, 1 - abs(m - ({v})) / 25), 6) AS {k}" for k, v in LATTICE.items())}, round(m, 6) + 0.0 AS expected FROM b""")
def meeting_odds(spark, root):
    """A change in basis points as chances of the two moves of the lattice around it; beyond its ends the end is certain."""
    x = order_bars(spark, root).select("symbol", "bar_date", ((F.col("close") - F.lag("close").over(S.ordered())) / 2000).alias("move")).where("move is not null")
    odds = L.lattice_odds(F.col("move"), list(LATTICE.values()))
    return x.select("symbol", "bar_date", *(r(c, k) for k, c in zip(LATTICE, odds)), (F.round(L.bounded(F.col("move"), -50.0, 50.0), 6) + 0.0).alias("expected"))


@query(f"""WITH {BARS}, w AS (SELECT bar_date, max(close) FILTER (symbol = '1-URGENT') AS a, max(close) FILTER (symbol = '2-HIGH') AS b, max(close) FILTER (symbol = '3-MEDIUM') AS c FROM bars GROUP BY 1) SELECT bar_date, round(-b / (a + c), 6) AS wing, 1.0::DOUBLE AS belly, round(a / c, 6) AS back, round(abs(a * -b / (a + c) + b + c * -b / (a + c)), 6) AS exposure FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""")
def hedge_weights(spark, root):
    """Weights of a fly and of a pair that leave no exposure, from the sensitivities of three legs on each day that all have."""
    legs = order_bars(spark, root).groupBy("bar_date").pivot("symbol", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.max("close")).toDF("bar_date", "a", "b", "c").dropna()
    wing, back = L.neutral_weights(F.col("a"), F.col("b"), F.col("c"))
    return legs.select("bar_date", r(wing, "wing"), F.lit(1.0).alias("belly"), r(back, "back"), r(F.abs(F.col("a") * wing + F.col("b") + F.col("c") * wing), "exposure"))


@query(f"""WITH {TRADES}, g AS (SELECT l_returnflag, avg((pnl > 0)::INT) AS win, avg(pnl) FILTER (pnl > 0) AS up, -avg(pnl) FILTER (pnl < 0) AS down, stddev_pop(pnl) AS dev FROM trades GROUP BY 1), s AS (SELECT l_returnflag, unnest([{{'method': 'kelly', 'notional': 1e6 * greatest(0, win - (1 - win) / (up / down)) * 0.25, 'lots': 1e6 * greatest(0, win - (1 - win) / (up / down)) * 0.25 / 25}}, {{'method': 'target_deviation', 'notional': 1e6 * 1000 / dev, 'lots': 1e6 * 1000 / dev / 25}}, {{'method': 'fixed_fraction', 'notional': 1e6 * 0.01 / (down / 100 * 25) * 25 * 100, 'lots': 1e6 * 0.01 / (down / 100 * 25)}}]) AS s FROM g) SELECT l_returnflag, s.method AS method, round(s.notional, 4) AS notional, round(s.lots, 4) AS lots FROM s""")
def position_sizes(spark, root):
    """Three ways to size a position, side by side: a quarter of Kelly, a target deviation, a fixed share at risk."""
    x = table(spark, root, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * (0.05 - F.col("l_discount")), 4).alias("pnl"))
    pnl = F.col("pnl")
    g = x.groupBy("l_returnflag").agg(F.avg((pnl > 0).cast("int")).alias("win"), F.avg(F.when(pnl > 0, pnl)).alias("up"), (-F.avg(F.when(pnl < 0, pnl))).alias("down"), F.stddev_pop(pnl).alias("dev"))
    sizes = {"kelly": 1e6 * L.kelly(F.col("win"), S.safe_ratio(F.col("up"), F.col("down"))), "target_deviation": S.safe_ratio(F.lit(1e9), F.col("dev")), "fixed_fraction": S.safe_ratio(F.lit(1e6), F.col("down") / 100 * 25) * 25}
    s = g.select("l_returnflag", F.explode(F.array(*(F.struct(F.lit(k).alias("method"), v.alias("notional"), (v / (2500 if k == "fixed_fraction" else 25)).alias("lots")) for k, v in sizes.items()))).alias("s"))
    return s.select("l_returnflag", "s.method", r(F.col("s.notional"), "notional", 4), r(F.col("s.lots"), "lots", 4))


@query(f"""WITH {TRADES}, d AS (SELECT l_returnflag, day, count(*) AS n, sum(pnl) AS s, sum(pnl * pnl) AS q FROM trades GROUP BY 1, 2), f AS (SELECT *, ntile(6) OVER (PARTITION BY l_returnflag ORDER BY day) AS fold FROM d), e AS (SELECT l_returnflag, fold, min(day) - 84 AS lo, max(day) + 91 AS hi FROM f GROUP BY 1, 2), x AS (SELECT f.*, a.fold AS first, b.fold AS second, CASE WHEN f.fold IN (a.fold, b.fold) THEN 'test' WHEN day BETWEEN a.lo AND a.hi OR day BETWEEN b.lo AND b.hi THEN NULL ELSE 'train' END AS part FROM f JOIN e a ON a.l_returnflag = f.l_returnflag JOIN e b ON b.l_returnflag = f.l_returnflag AND a.fold < b.fold), g AS (SELECT l_returnflag, first, second, {", ".join(f"sum({c}) FILTER (part = '{p}') AS {p}_{c}" for p in ("test", "train") for c in ("n", "s", "q"))} FROM x GROUP BY 1, 2, 3), h AS (SELECT *, {", ".join(f"{p}_s / {p}_n / sqrt({p}_q / {p}_n - ({p}_s / {p}_n) * ({p}_s / {p}_n)) * sqrt(252.0) AS {p}_sharpe" for p in ("test", "train"))} FROM g) SELECT l_returnflag, first::INTEGER AS first, second::INTEGER AS second, test_n::BIGINT AS test_trades, coalesce(train_n, 0)::BIGINT AS train_trades, round(test_sharpe, 4) AS test_sharpe, round(train_sharpe, 4) AS train_sharpe, train_sharpe > median(train_sharpe) OVER (PARTITION BY l_returnflag) AND test_sharpe < median(test_sharpe) OVER (PARTITION BY l_returnflag) AS overfit FROM h""")
def purged_folds(spark, root):
    """Combinatorial cross-validation of trades by flag: all pairs of six folds as test, purged training days, and the paths that look overfitted."""
    x = table(spark, root, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * (0.05 - F.col("l_discount")), 4).alias("pnl"))
    p = validation.purged_paths(x, "l_returnflag")
    return p.select("l_returnflag", "first", "second", "test_trades", "train_trades", r(F.col("test_sharpe"), "test_sharpe", 4), r(F.col("train_sharpe"), "train_sharpe", 4), "overfit")
