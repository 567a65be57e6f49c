"""Odds, weights and purged folds on small rows: ends, nulls, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from ratelake.functions import levels as L
from ratelake.operators import validation


def test_odds_sum_to_one_and_keep_the_move(spark):
    points = [-50.0, -25.0, 0.0, 25.0, 50.0]
    df = spark.createDataFrame([(-80.0,), (-50.0,), (-10.0,), (0.0,), (12.5,), (50.0,), (99.0,)], "m double")
    for row in df.select("m", F.array(*L.lattice_odds(F.col("m"), points)).alias("p")).collect():
        assert abs(sum(row.p) - 1) < 1e-12
        assert abs(sum(a * b for a, b in zip(row.p, points)) - max(-50, min(50, row.m))) < 1e-9


def test_weights_without_a_solution(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (1.0, 2.0, -1.0), (1.0, 2.0, 0.0)], "a double, b double, c double")
    found = [tuple(r) for r in df.select(*L.neutral_weights(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert found == [(-0.5, 1.0), (0.0, -1.0), (-2.0, 0.0)]


def test_folds_purge_the_days_around_a_test_fold(spark):
    start = dt.date(2020, 1, 1)
    rows = [("a", start + dt.timedelta(30 * i), float(i % 3) - 0.5) for i in range(36)] + [("a", None, 1.0), ("a", start, None)]
    trades = spark.createDataFrame(rows, "k string, day date, pnl double")
    found = {(r["first"], r["second"]): r for r in validation.purged_paths(trades, "k").collect()}
    assert len(found) == 15
    days = [start + dt.timedelta(30 * i) for i in range(36)]
    for (a, b), row in found.items():
        near = []
        for f in (a, b):
            own = days[6 * (f - 1) : 6 * f]
            near.append((own[0] - dt.timedelta(84), own[-1] + dt.timedelta(91)))
        assert row.test_trades == 12
        assert row.train_trades == sum(not any(lo <= d <= hi for lo, hi in near) for d in days)
    assert validation.purged_paths(trades.limit(0), "k").count() == 0
    flat = validation.purged_paths(trades.withColumn("pnl", F.lit(1.0)), "k").collect()
    assert all(r.test_sharpe is None for r in flat)
