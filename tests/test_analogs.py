"""Shrunk covariance, neighbours and weighted quantiles against numpy."""

import datetime as dt

import numpy as np

from ratelake.operators import analogs

DAY = dt.date(2020, 1, 1)


def plain_shrunk(x):
    n, d = x.shape
    off = x - x.mean(0)
    s = off.T @ off / (n - 1)
    target = np.trace(s) / d * np.eye(d)
    spread = sum(((np.outer(row, row) - s) ** 2).sum() for row in off) / n
    share = max(0.0, min(1.0, spread / ((s - target) ** 2).sum() / n))
    return (1 - share) * s + share * target, share


def test_shrunk_covariance_equals_its_definition(spark):
    rng = np.random.default_rng(1)
    for n in (8, 300):
        x = rng.normal(size=(n, 3)) @ np.array([[2.0, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]]) + 5
        df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,)], "x array<double>").repartition(3)
        found, share = analogs.shrunk_covariance(df, "x", 3)
        want, expected = plain_shrunk(x)
        assert np.allclose(found, want, rtol=1e-9) and abs(share - expected) < 1e-9
    flat, _ = analogs.shrunk_covariance(spark.createDataFrame([([1.0, 1.0],)] * 4, "x array<double>"), "x", 2)
    assert np.linalg.eigvalsh(flat).min() > 0
    assert analogs.shrunk_covariance(df.limit(0), "x", 2)[1] == 0.0


def test_neighbours_and_bands_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x, after = rng.normal(size=(200, 3)), rng.choice([-1.0, 0.0, 0.5, 2.0], 200)
    covariance, _ = plain_shrunk(x)
    rows = [("p", DAY + dt.timedelta(2 * t), row.tolist(), float(v)) for t, (row, v) in enumerate(zip(x, after))]
    h = spark.createDataFrame([*rows, ("other", DAY, [0.0] * 3, 1.0), ("p", DAY + dt.timedelta(1), None, 1.0)], "panel string, day date, x array<double>, after double")
    asked = [10, 35, 120, 199]
    q = h.where(h.panel == "p").where(h.day.isin([DAY + dt.timedelta(2 * t) for t in asked]))
    found = analogs.analogs(h, q, ["panel"], "day", "x", covariance, k=20).persist()
    inverse = np.linalg.inv(covariance)
    bands = {r["query_at"]: r for r in analogs.weighted_quantiles(found.join(h, ["panel", "day"]), ["panel", "query_at"], "after", "weight", {"low": 0.25, "high": 0.75}).collect()}
    for t in asked:
        at = DAY + dt.timedelta(2 * t)
        own = sorted((r for r in found.collect() if r["query_at"] == at), key=lambda r: r["rank"])
        open_ = [s for s in range(200) if 2 * (t - s) > 60]
        if not open_:
            assert not own
            continue
        off = x[open_] - x[t]
        distance = np.sqrt(np.einsum("ij,jk,ik->i", off, inverse, off))
        weight = np.exp(-distance / np.median(distance)) * np.exp(-2 * (t - np.array(open_)) / 250)
        order = np.argsort(-weight)[:20]
        assert [r["day"] for r in own] == [DAY + dt.timedelta(2 * open_[i]) for i in order]
        assert np.allclose([r["weight"] for r in own], weight[order]) and np.allclose([r["distance"] for r in own], distance[order])
        assert abs(own[0]["eff_n"] - weight[order].sum() ** 2 / (weight[order] ** 2).sum()) < 1e-9
        values = after[np.array(open_)[order]]
        for name, share in (("low", 0.25), ("high", 0.75)):
            want = min(v for v in values if weight[order][values <= v].sum() >= share * weight[order].sum() - 1e-12)
            assert bands[at][name] == want
