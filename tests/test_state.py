"""Change-points and throttles: plain versions, streams against their batch twins, restarts from a checkpoint, late rows."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.operators import changepoints, throttle
from ratelake.streaming import stateful

T0 = dt.datetime(2024, 3, 1, 9)


def plain_change(x, hazard=0.01, horizon=5):
    """Every run length at every row, one at a time."""
    d = x.shape[1]
    weights, stats, out = [1.0], [(np.zeros(d), 1.0, 1.0, np.ones(d))], []
    for row in x:
        chances = []
        for mean, kappa, alpha, beta in stats:
            df, scale = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
            chances.append(math.exp(sum(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi * s) - (df + 1) / 2 * math.log(1 + (v - m) ** 2 / (df * s)) for v, m, s in zip(row, mean, scale))))
        mass = [w * c for w, c in zip(weights, chances)]
        weights = [hazard * sum(mass), *((1 - hazard) * m for m in mass)]
        weights = [w / sum(weights) for w in weights]
        stats = [(np.zeros(d), 1.0, 1.0, np.ones(d))] + [((k * m + row) / (k + 1), k + 1, a + 0.5, b + k * (row - m) ** 2 / (2 * (k + 1))) for m, k, a, b in stats]
        out.append(sum(weights[:horizon]))
    return out


def shifting(seed, n=120):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 2)) + np.where(np.arange(n)[:, None] >= n // 2, 4.0, 0.0)


def test_run_lengths_equal_the_plain_version():
    x = shifting(1)
    state = changepoints.RunLengths(2)
    found = [state.observe(row) for row in x]
    assert np.allclose(found, plain_change(x), atol=1e-9)
    assert found[61] > 0.5 > found[55]
    bounded = changepoints.RunLengths(2, most=30)
    assert np.allclose([bounded.observe(row) for row in x], found, atol=1e-3) and len(bounded.runs) == 30
    again = changepoints.RunLengths(2).load(*state.dump())
    assert again.observe(x[0]) == state.observe(x[0])


def series(spark, keys=("a", "b")):
    rows = [(k, T0 + dt.timedelta(minutes=10 * t), row.tolist()) for i, k in enumerate(keys) for t, row in enumerate(shifting(i))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x array<double>")


def test_batch_keeps_the_order_over_batches_and_keys(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        x = series(spark).union(series(spark).where("symbol = 'a'").withColumn("symbol", F.lit(None).cast("string"))).repartition(5)
        found = changepoints.change_probabilities(x, "symbol", "ts", "x", 2).orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for key, seed in (("a", 0), ("b", 1), (None, 0)):
        assert np.allclose([r["p_change"] for r in found if r["symbol"] == key], plain_change(shifting(seed)), atol=1e-9)
    assert changepoints.change_probabilities(x.limit(0), "symbol", "ts", "x", 2).count() == 0


def plain_breaks(y, most, least):
    n = len(y)
    cost = lambda a, b: ((y[a:b] - y[a:b].mean()) ** 2).sum()
    best, chosen = n * math.log(cost(0, n) / n) + math.log(n), []
    for m in range(1, most + 1):
        options = []
        for cuts in itertools.combinations(range(least, n - least + 1), m):
            edges = (0, *cuts, n)
            if all(b - a >= least for a, b in itertools.pairwise(edges)):
                options.append((sum(cost(a, b) for a, b in itertools.pairwise(edges)), cuts))
        if options:
            total, cuts = min(options)
            criterion = n * math.log(total / n) + (m + 1) * math.log(n)
            if criterion < best and 1 - total / cost(0, n) > 0.02:
                best, chosen = criterion, [c - 1 for c in cuts]
    return chosen


def test_breaks_equal_trying_all(spark):
    rng = np.random.default_rng(2)
    for levels in ([0, 3, 0], [0, 1], [0, 0.1], [0, 4, 8, 1], [2]):
        y = np.concatenate([np.full(36 // len(levels), v, float) for v in levels])
        y = y + rng.normal(size=len(y))
        assert changepoints.best_breaks(y, 3) == plain_breaks(y, 3, max(5, int(0.15 * len(y))))
    assert changepoints.best_breaks(np.zeros(50)) == [] and changepoints.best_breaks(np.arange(20.0)) == []
    y = np.concatenate([np.zeros(40), np.full(40, 9.0)]) + rng.normal(size=80)
    rows = [("a", T0.date() + dt.timedelta(i), float(v)) for i, v in enumerate(y)] + [("b", T0.date(), 1.0), ("a", T0.date() + dt.timedelta(99), None)]
    found = changepoints.level_breaks(spark.createDataFrame(rows, "symbol string, day date, y double"), "symbol", "day", "y").collect()
    want = [T0.date() + dt.timedelta(i) for i in changepoints.best_breaks(y)]
    assert T0.date() + dt.timedelta(39) in want and sorted(map(tuple, found)) == [("a", d) for d in want]


def plain_throttle(times, most=5, span=3600):
    kept, out = [], []
    for t in times:
        ok = sum(k >= t - span for k in kept) < most
        if ok:
            kept.append(t)
        out.append(ok)
    return out


def alerts(n=60, seed=3):
    rng = np.random.default_rng(seed)
    gaps = rng.choice([0, 60, 300, 900, 3600], n, p=[0.1, 0.4, 0.3, 0.15, 0.05])
    return np.cumsum(gaps).tolist()


def alert_rows(spark, setups=("s1", "s2")):
    rows = [(s, 1000 * k + i, T0 + dt.timedelta(seconds=t)) for k, s in enumerate(setups) for i, t in enumerate(alerts(seed=k))]
    return spark.createDataFrame(rows, "setup string, alert_id long, ts timestamp")


def test_throttle_equals_counting_the_recorded(spark):
    found = throttle.throttled(alert_rows(spark).repartition(4), ["setup"], "ts", ["alert_id"]).orderBy("alert_id").collect()
    for k, s in enumerate(("s1", "s2")):
        want = plain_throttle(alerts(seed=k))
        assert [r["recorded"] for r in found if r["setup"] == s] == want and not all(want)
    edge = spark.createDataFrame([("e", i, T0 + dt.timedelta(seconds=t)) for i, t in enumerate([0, 0, 0, 0, 0, 3600, 3601])] + [("e", 9, None)], "setup string, alert_id long, ts timestamp")
    assert [r["recorded"] for r in throttle.throttled(edge, ["setup"], "ts", ["alert_id"]).orderBy("alert_id").collect()] == [True] * 5 + [False, True]


def run_stream(spark, build, schema, files, where, out):
    """Write the files one after the other, the query started anew for each from the same checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    try:
        for k, rows in enumerate(files):
            rows.coalesce(1).write.mode("append").parquet(f"{where}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
            q = build(stream).writeStream.format("parquet").option("path", f"{where}/{out}").option("checkpointLocation", f"{where}/at").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{where}/{out}")


def test_a_restarted_stream_throttles_like_a_batch(spark, tmp_path):
    x = alert_rows(spark)
    end = spark.createDataFrame([("end", 1, T0 + dt.timedelta(days=2))], x.schema)
    # Rows come in mixed order within the delay, one of them twice, and one far too late.
    part = F.floor((F.unix_seconds("ts") + 400 * (F.col("alert_id") % 2)) / 9000)
    parts = [r[0] for r in x.select(part.alias("p")).distinct().orderBy("p").collect()]
    files = [x.where(part == p) for p in parts]
    files[1] = files[1].union(files[0].orderBy(F.desc("ts")).limit(1))
    late = spark.createDataFrame([("s1", 77, T0)], x.schema)
    build = lambda s: stateful.throttled_stream(s, late="30 minutes")
    found = run_stream(spark, build, x.schema, [*files, end, late], f"file://{tmp_path}", "out")
    want = throttle.throttled(x, ["setup"], "ts", ["alert_id"])
    key = lambda r: (r["setup"], r["alert_id"], r["ts"], r["recorded"])
    assert sorted(map(key, found.where("setup <> 'end'").collect())) == sorted(map(key, want.collect()))


def test_a_restarted_stream_finds_changes_like_a_batch(spark, tmp_path):
    x = series(spark)
    end = spark.createDataFrame([("end", T0 + dt.timedelta(days=9), [0.0, 0.0])], x.schema)
    minutes = F.unix_seconds("ts") / 60
    cut = (T0 + dt.timedelta(minutes=700)).replace(tzinfo=dt.timezone.utc).timestamp() / 60
    files = [x.where(minutes < cut), x.where(minutes >= cut), end]
    found = run_stream(spark, lambda s: stateful.change_stream(s, 2), x.schema, files, f"file://{tmp_path}", "out").where("symbol <> 'end'")
    want = {(r["symbol"], r["ts"]): r["p_change"] for r in changepoints.change_probabilities(x, "symbol", "ts", "x", 2).collect()}
    got = {(r["symbol"], r["ts"]): r["p_change"] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("times", [[], [0], [0] * 9])
def test_recorded_in_small(times):
    state = throttle.Recorded()
    assert [state.take(t) for t in times] == [True] * min(len(times), 5) + [False] * max(0, len(times) - 5)
