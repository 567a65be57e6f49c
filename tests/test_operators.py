"""Edge cases: nulls and ties inside windows, constant series, missing as-of rows, bars that touch both sides, streams."""

import datetime as dt

from pyspark.sql import functions as F

from ratelake.functions import series as S
from ratelake.operators import joins, smoothing, trades
from ratelake.streaming import bars as streams

DAY = dt.date(2024, 1, 1)


def days(values, symbol="a"):
    return [(symbol, DAY + dt.timedelta(i), v) for i, v in enumerate(values)]


def test_prior_windows_skip_nulls_and_constant_series(spark):
    x = spark.createDataFrame(days([1.0, None, 3.0, 5.0, 5.0]) + days([2.0] * 4, "b"), "symbol string, bar_date date, close double")
    z = {(r[0], r[1].day): r[2] for r in x.select("symbol", "bar_date", S.prior_z("close", 2)).collect()}
    assert z["a", 1] is None and z["a", 4] is None and z["a", 5] == 1 / 2**0.5
    assert all(z["b", i] is None for i in range(1, 5))
    rank = {(r[0], r[1].day): r[2] for r in x.select("symbol", "bar_date", S.prior_rank("close", 3)).collect()}
    assert rank["a", 1] is None and rank["a", 4] == 100 and rank["a", 5] == 50


def test_as_of_respects_ties_age_and_absence(spark):
    left = spark.createDataFrame([(k, "m", DAY + dt.timedelta(d)) for k, d in ((1, -1), (2, 0), (3, 5), (4, 30))] + [(5, "none", DAY)], "k int, by string, at date")
    right = spark.createDataFrame([("m", DAY, 1.0), ("m", DAY + dt.timedelta(4), 2.0)], "by string, at date, v double")
    found = {r["k"]: r["v"] for r in joins.as_of(left, right, ["by"], "at", "v", 14).collect()}
    assert found == {1: None, 2: 1.0, 3: 2.0, 4: None, 5: None}


def test_brackets_at_below_and_beyond_the_chain(spark):
    chain = spark.createDataFrame([("c", 10, 1.0), ("c", 20, 3.0)], "by string, at int, v double")
    targets = spark.createDataFrame([("c", t) for t in (5, 10, 15, 20, 25)], "by string, at int")
    found = {r["at"]: (r["lower"], r["upper"], r["weight"]) for r in joins.bracket(targets, chain, ["by"], "at", "v").collect()}
    assert found == {5: (None, 1.0, 1.0), 10: (1.0, 3.0, 0.0), 15: (1.0, 3.0, 0.5), 20: (3.0, None, 0.0), 25: (3.0, None, 0.0)}


def test_a_bar_that_touches_both_is_a_stop_and_missing_bars_end_nothing(spark):
    bars = spark.createDataFrame([("a", i, lo, hi, 10.0) for i, (lo, hi) in enumerate([(9.0, 11.0), (9.0, 11.0), (5.0, 20.0)])], "symbol string, i int, low double, high double, close double")
    entries = spark.createDataFrame([("a", 0, 6.0, 15.0), ("a", 2, 6.0, 15.0)], "symbol string, i int, stop double, target double")
    assert [tuple(r) for r in trades.first_touch(entries, bars, 5).collect()] == [("a", 0, 2, "stop", 6.0)]


def test_smoothing_of_short_series(spark):
    x = spark.createDataFrame(days([1.0, 2.0]), "symbol string, bar_date date, close double")
    assert [r["ema_2"] for r in smoothing.smoothed(x, periods=(2,)).orderBy("bar_date").collect()] == [1.0, 1.5]
    assert [r["rsi"] for r in smoothing.relative_strength(x).collect()] in ([None, None],)


def test_streamed_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.limit(300).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.bars(streams.event_stream(spark, str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = streams.bars(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, batch.collect()))


def test_metric_pack_over_grouping_sets(spark):
    rows = [("a", "x", 2.0), ("a", "y", -1.0), ("b", "x", 4.0), ("b", "x", 0.0)]
    got = spark.createDataFrame(rows, "k string, l string, pnl double").cube("k", "l").agg(*trades.metric_pack()).collect()
    found = {(r["k"], r["l"]): (r["trades"], r["wins"], r["win_pct"], r["total"], r["mean"], r["profit_factor"]) for r in got}
    assert len(got) == len(found) == 8 and found[None, None] == (4, 2, 50.0, 5.0, 1.25, 6.0)
    assert found["a", None] == (2, 1, 50.0, 1.0, 0.5, 2.0) and found["b", "x"] == (2, 1, 50.0, 4.0, 2.0, None)
