"""Resampled intervals against a plain bootstrap of the same counts; deflated ratios and overfitted paths against plain versions."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ratelake.operators import resampling as R


def means(rows, draws):
    """Intervals of the mean of x for each k."""
    return R.bootstrap(rows, ["k"], F.col("id"), {"n": F.lit(1), "s": F.col("x")}, F.col("s") / F.nullif(F.col("n"), F.lit(0.0)), draws=draws)


def plain_mix(h):
    h ^= h >> 16
    h = h * 0x85EBCA6B % 2**32
    h ^= h >> 13
    h = h * 0xC2B2AE35 % 2**32
    return h ^ (h >> 16)


def plain_count(i, draw, seed):
    i %= 2**64
    h = plain_mix(plain_mix(plain_mix(i >> 32) ^ (i % 2**32)) ^ ((draw * 0x9E3779B9 + seed) % 2**32)) >> 16
    return 1 if draw == 0 else sum(h >= t for t in R.THRESHOLDS)


def test_counts_are_poisson_and_follow_from_row_and_draw():
    ids = np.array([0, 1, -1, 2**40 + 7, 123456789])
    counts = R.poisson_counts(ids, 50, 42)
    assert [[plain_count(int(i), d, 42) for d in range(51)] for i in ids] == counts.tolist()
    many = R.poisson_counts(np.arange(20_000), 40, 7)[:, 1:]
    share = np.bincount(many.astype(int).ravel(), minlength=4) / many.size
    assert all(abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.003 for k in range(4))
    assert abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.03 and abs(np.corrcoef(many[:-1, 0], many[1:, 0])[0, 1]) < 0.03


def test_intervals_equal_a_plain_bootstrap_on_any_layout(spark):
    rng = np.random.default_rng(1)
    rows = [(("a", "b")[i % 2], i, float(x)) for i, x in enumerate(rng.normal(3, 2, 301))] + [("a", 999, None), (None, 7, 2.0), ("one", 5, 4.0), ("a", None, 1.0)]
    table = spark.createDataFrame(rows, "k string, id long, x double")
    got = [{r["k"]: r for r in means(table.repartition(n), 200).collect()} for n in (1, 5)]
    for k in ("a", "b"):
        mine = [(i, x) for key, i, x in rows if key == k and x is not None and i is not None]
        drawn = []
        for d in range(1, 201):
            counts = [plain_count(i, d, 42) for i, _ in mine]
            drawn.append(sum(c * x for c, (_, x) in zip(counts, mine)) / sum(counts))
        low, high = np.quantile(drawn, [0.025, 0.975])
        for g in got:
            assert abs(g[k]["low"] - low) < 1e-9 and abs(g[k]["high"] - high) < 1e-9 and abs(g[k]["value"] - np.mean([x for _, x in mine])) < 1e-9
    assert set(got[0]) == {"a", "b", None, "one"} and all((got[0]["one"][c], got[0][None][c]) == (4.0, 2.0) for c in ("value", "low", "high"))
    assert means(table.limit(0), 20).count() == 0


def test_intervals_cover_the_mean_about_as_often_as_they_say(spark):
    rng = np.random.default_rng(2)
    rows = [(s, s * 1000 + i, float(x)) for s in range(200) for i, x in enumerate(rng.exponential(1.0, 80))]
    x = means(spark.createDataFrame(rows, "k long, id long, x double"), 300)
    covered = x.where("low <= 1 and high >= 1").count()
    assert 176 <= covered <= 199


def test_more_keys_than_a_task_holds(spark):
    rows = [(i % 700, i, float(i)) for i in range(2100)]
    x = means(spark.createDataFrame(rows, "k long, id long, x double").repartition(2), 5)
    assert {r["k"]: r["value"] for r in x.collect()} == {k: float(k + 700) for k in range(700)}


def test_deflated_ratios_equal_the_formula(spark):
    cases = [(0.9, 0.3, 4.0, 252), (2.5, -0.5, 5.0, 60), (1.0, 0.0, 3.0, 1), (None, 0.0, 3.0, 50), (2.0, 3.0, 1.0, 40)]
    x = spark.createDataFrame(cases, "r double, s double, k double, n long")
    got = [row[0] for row in x.select(R.deflated_sharpe(F.col("r"), F.col("s"), F.col("k"), F.col("n"), 18)).collect()]
    best = (1 - 0.5772156649) * NormalDist().inv_cdf(1 - 1 / 18) + 0.5772156649 * NormalDist().inv_cdf(1 - 1 / (18 * math.e))
    for (r, s, k, n), v in zip(cases, got):
        variance = None if r is None or n < 2 else (1 - s * r + (k - 1) / 4 * r * r) / (n - 1)
        assert v is None if variance is None or variance <= 0 else abs(v - NormalDist().cdf((r - best) / math.sqrt(variance))) < 1e-9
    assert x.select(R.deflated_sharpe(F.col("r"), F.col("s"), F.col("k"), F.col("n"), 1)).first()[0] is None


def test_overfit_share_equals_pandas_ranks(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [15, 8, 1]), "i": rng.integers(0, 6, 24).astype(float), "o": rng.integers(0, 6, 24).astype(float)})
    got = {r["k"]: r for r in R.overfit_share(spark.createDataFrame(x).unionByName(spark.createDataFrame([("a", None, 1.0)], "k string, i double, o double")), ["k"], "i", "o").collect()}
    for k, g in x.groupby("k"):
        inside, outside = g["i"].rank(pct=True), g["o"].rank(pct=True)
        want = ((inside >= 0.5) & (outside < 0.5)).sum() / (inside >= 0.5).sum()
        assert got[k]["paths"] == len(g) and got[k]["judged"] == (inside >= 0.5).sum() and (got[k]["share"] is None if len(g) < 2 else abs(got[k]["share"] - want) < 1e-12)
