"""The rolling factor model against numpy's singular values on each window."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.operators import factors

NODES, TENORS = ["3", "12", "24", "60"], [3.0, 12.0, 24.0, 60.0]
DAY = dt.date(2020, 1, 1)


def walk(n, seed):
    rng = np.random.default_rng(seed)
    shapes = np.array([[1, 1, 1, 1], [-1, -0.3, 0.2, 1], [-0.5, 0.6, 0.7, -0.8]])
    return 300 + np.cumsum(rng.normal(size=(n, 3)) * [3, 1.5, 0.7] @ shapes + rng.normal(size=(n, 4)) * 0.2 + 0.1, axis=0)


def frame(spark, panels):
    rows = [(p, DAY + dt.timedelta(t), node, float(v)) for p, levels in panels.items() for t, row in enumerate(levels) for node, v in zip(NODES, row)]
    return spark.createDataFrame(rows, "panel string, day date, node string, level double")


def plain_fits(levels, window, step):
    """{row: (loadings, eigenvalues, shares, mean)} with each fit's rows turned towards the fit before."""
    n = len(levels)
    at = list(range(window, n, step)) if n > window else ([n - 1] if n >= 30 else [])
    if at and at[-1] != n - 1:
        at.append(n - 1)
    out, before = {}, None
    for i in at:
        x = np.diff(levels[max(0, i - window) : i + 1], axis=0)
        mean = x.mean(0)
        _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
        values = s**2 / (len(x) - 1)
        rows = vt[:3].copy()
        rows[0] *= -1 if rows[0].sum() < 0 else 1
        rows[1] *= -1 if rows[1, -1] < rows[1, 0] else 1
        rows[2] *= -1 if rows[2, 2] < (rows[2, 0] + rows[2, -1]) / 2 else 1
        if before is not None:
            rows *= np.where((rows * before).sum(1) < 0, -1.0, 1.0)[:, None]
        before = rows
        out[i] = rows, values[:3], values[:3] / values.sum(), mean
    return out


@pytest.fixture(scope="module")
def panels():
    return {"long": walk(173, 1), "short": walk(31, 2), "tiny": walk(12, 3), "exact": walk(61, 4)}


def test_fits_scores_and_shares_equal_numpy(spark, panels):
    x = factors.changes(frame(spark, panels), ["panel"], "day", "node", "level", NODES)
    fits = factors.factor_fits(x, ["panel"], TENORS, window=60, step=7).persist()
    found = {(r["panel"], r["i"]): r for r in fits.collect()}
    want = {p: plain_fits(levels, 60, 7) for p, levels in panels.items()}
    assert set(found) == {(p, i) for p, f in want.items() for i in f}
    assert {i for p, i in found if p == "short"} == {30} and not want["tiny"]
    for (p, i), row in found.items():
        for name, expected in zip(("loadings", "eigenvalues", "shares", "mean"), want[p][i]):
            assert np.allclose(np.array(row[name]), expected, rtol=1e-7, atol=1e-7), (p, i, name)
    days = {(r["panel"], r["i"]): r for r in factors.decomposed(factors.factor_scores(x, fits, ["panel"])).collect()}
    assert set(days) == {(p, i) for p in panels if want[p] for i in range(1, len(panels[p]))}
    for (p, i), row in days.items():
        fit = want[p][max((j for j in want[p] if j <= i), default=min(want[p]))]
        change = panels[p][i] - panels[p][i - 1]
        scores = fit[0] @ (change - fit[3])
        left = change - scores @ fit[0] - fit[3]
        assert np.allclose(row["scores"], scores, atol=1e-6)
        assert np.allclose(row["residual"], left, atol=1e-6)
        assert abs(row["error"] - np.linalg.norm(left)) < 1e-6
        assert abs(row["explained"] - min(1, max(0, 1 - np.abs(left).sum() / np.abs(change).sum()))) < 1e-6
        assert abs(row["share_2"] - np.abs(scores[1] * fit[0][1]).sum() / np.abs(change).sum()) < 1e-6


def test_a_gap_leaves_its_day_out_and_flat_panels_have_no_fit(spark):
    levels = walk(40, 5)
    holes = frame(spark, {"a": levels}).where(~((F.col("day") == DAY + dt.timedelta(20)) & (F.col("node") == "12")))
    x = factors.changes(holes, ["panel"], "day", "node", "level", NODES)
    assert x.count() == 39
    found = factors.factor_fits(x, ["panel"], TENORS, window=60).collect()
    (expected,) = plain_fits(np.delete(levels, 20, axis=0), 60, 5).values()
    assert np.allclose(np.array(found[0]["loadings"]), expected[0], atol=1e-7)
    flat = factors.changes(frame(spark, {"a": np.ones((40, 4))}), ["panel"], "day", "node", "level", NODES)
    assert factors.factor_fits(flat, ["panel"], TENORS).count() == 0
    none = factors.changes(frame(spark, {"a": levels}).limit(0), ["panel"], "day", "node", "level", NODES)
    assert factors.factor_fits(none, ["panel"], TENORS).count() == 0
