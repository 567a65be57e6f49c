"""The tests of a series against plain numpy versions, on a random walk, a reverting and a constant series."""

import datetime as dt

import numpy as np

from ratelake.functions import levels as L
from ratelake.operators import estimators, stationarity
from pyspark.sql import functions as F


def series(spark):
    rng = np.random.default_rng(4)
    walk, noise = np.cumsum(rng.normal(size=120)), rng.normal(size=120)
    back = [0.0]
    for e in noise[1:]:
        back.append(0.5 * back[-1] + e)
    values = {"walk": walk, "back": np.array(back), "flat": np.full(120, 3.0), "short": walk[:15]}
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for k, x in values.items() for i, v in enumerate(x)]
    return values, spark.createDataFrame(rows, "symbol string, bar_date date, close double")


def test_against_numpy(spark):
    values, bars = series(spark)
    x = stationarity.recent(bars, 90)
    adf = {r["symbol"]: r["adf_t"] for r in stationarity.unit_root(x).collect()}
    kpss = {r["symbol"]: r["kpss"] for r in stationarity.level_stationarity(x).collect()}
    hurst = {r["symbol"]: r["hurst"] for r in stationarity.rescaled_range(x).collect()}
    for name in ("walk", "back"):
        y = values[name][-91:-1]
        d = np.diff(y)
        a = np.column_stack([np.ones(len(d) - 1), y[1:-1], d[:-1]])
        b, *_ = np.linalg.lstsq(a, d[1:], rcond=None)
        e = d[1:] - a @ b
        error = np.sqrt(e @ e / (len(e) - 3) * np.linalg.inv(a.T @ a)[1, 1])
        assert abs(adf[name] - b[1] / error) < 1e-6
        c = y - y.mean()
        long_run = c @ c + 2 * sum((1 - k / 11) * (c[k:] @ c[:-k]) for k in range(1, 11))
        assert abs(kpss[name] - (np.cumsum(c) ** 2).sum() / len(c) / long_run) < 1e-9
        points = []
        for size in sorted({int(round(s)) for s in np.exp(np.linspace(np.log(8), np.log(len(d) // 2), 8))}):
            chunks = d[: len(d) // size * size].reshape(-1, size)
            path = np.cumsum(chunks - chunks.mean(1, keepdims=True), 1)
            points.append((np.log(size), np.log(np.mean((path.max(1) - path.min(1)) / chunks.std(1)))))
        assert abs(hurst[name] - np.clip(np.polyfit(*zip(*points), 1)[0], 0, 1)) < 1e-6
    assert adf["back"] < -2.86 < adf["walk"] and "flat" not in hurst and adf["flat"] is None and kpss["flat"] is None


def test_fits_and_ratio_at_their_floors(spark):
    values, bars = series(spark)
    fit = {r["symbol"]: r for r in estimators.lagged_fit(bars, 90, 20).collect()}
    y = values["back"][-91:-1]
    slope, level = np.polyfit(y[:-1], y[1:], 1)
    assert "short" not in fit and abs(fit["back"]["slope"] - slope) < 1e-9 and abs(fit["back"]["mean"] - level / (1 - slope)) < 1e-6
    ratios = {r["symbol"]: r for r in estimators.variance_ratio_test(bars, 90, 4, 40).collect()}
    assert "short" not in ratios and ratios["flat"]["ratio"] is None and ratios["back"]["reject"]


def test_false_discoveries_keep_all_up_to_the_last_that_passes(spark):
    x = spark.createDataFrame([("a", 0.04), ("b", 0.045), ("c", 0.9), ("d", 0.05)], "k string, p double")
    found = {r["k"]: r["below"] for r in estimators.false_discoveries(x, "p", "k", 0.07).collect()}
    assert found == {"a": True, "b": True, "c": False, "d": True}


def test_levels(spark):
    x = spark.createDataFrame([(10.0, 9.0, "LONG"), (10.0, 11.0, "SHORT"), (10.0, 10.0, "LONG")], "entry double, stop double, side string")
    t = [tuple(r) for r in x.select(*L.r_levels(F.col("entry"), F.col("stop"), F.col("side")), L.lots_at_risk(F.abs(F.col("entry") - F.col("stop")) * 100)).collect()]
    assert t == [(11.0, 12.0, 4), (9.0, 8.0, 4), (10.0, 10.0, 0)]
