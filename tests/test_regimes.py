"""Mixtures, smoothing, matching and names: against plain versions, enumeration and all permutations."""

import datetime as dt
import itertools

import numpy as np
import pytest

from ratelake.operators import regimes

DAY = dt.date(2020, 1, 1)
CENTRES = np.array([[6.0, 0.0], [-6.0, 1.0], [0.0, 7.0]])


@pytest.fixture(scope="module")
def series():
    """States that last some 30 days, seen with noise."""
    rng = np.random.default_rng(4)
    states = np.zeros(600, int)
    for t in range(1, 600):
        states[t] = states[t - 1] if rng.random() < 0.97 else rng.integers(3)
    return states, CENTRES[states] + rng.normal(size=(600, 2)) @ np.array([[1.2, 0.4], [0.0, 0.8]])


@pytest.fixture(scope="module")
def points(spark, series):
    rows = [("p", DAY + dt.timedelta(t), x.tolist()) for t, x in enumerate(series[1])]
    return spark.createDataFrame([*rows, ("p", None, None)], "panel string, day date, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def mixture(points):
    return regimes.fit_mixture(points, "x", k=3, tolerance=1e-6)


def test_likelihood_never_falls_and_a_pass_changes_nothing_at_the_end(mixture, series):
    assert len(mixture.history) > 2 and mixture.rows == 600
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(mixture.history))
    x = series[1]
    assert abs(regimes.log_sum(mixture.joint(x)).mean() - mixture.history[-1]) < 1e-9
    again = regimes.from_sums(regimes.sufficient(x, mixture.joint(x)), 600, 3, 2, regimes.FLOOR)
    assert np.allclose(again.means, mixture.means, atol=0.02) and np.allclose(again.weights, mixture.weights, atol=0.005)
    assert mixture.bic > mixture.aic


def test_a_pass_equals_its_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2))
    m = regimes.Mixture(np.array([0.3, 0.7]), rng.normal(size=(2, 2)), np.array([np.eye(2), [[2.0, 0.5], [0.5, 1.0]]]))
    density = np.array([[np.exp(-0.5 * (p - mu) @ np.linalg.inv(c) @ (p - mu)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for mu, c in zip(m.means, m.covariances)] for p in x])
    share = density * m.weights
    assert np.allclose(np.log(share.sum(1)).sum(), regimes.sufficient(x, m.joint(x))[0])
    share /= share.sum(1, keepdims=True)
    after = regimes.from_sums(regimes.sufficient(x, m.joint(x)), 50, 2, 2, 0.01)
    for k in range(2):
        mean = (share[:, k, None] * x).sum(0) / share[:, k].sum()
        off = x - mean
        assert np.allclose(after.means[k], mean)
        assert np.allclose(after.covariances[k], (share[:, k, None] * off).T @ off / share[:, k].sum() + 0.01 * np.eye(2))


def test_posteriors_equal_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    log_b, moves, first = rng.normal(size=(6, 3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
    mass, total = np.zeros((6, 3)), 0.0
    for path in itertools.product(range(3), repeat=6):
        p = first[path[0]] * np.prod([moves[a, b] for a, b in itertools.pairwise(path)]) * np.exp(sum(log_b[t, s] for t, s in enumerate(path)))
        total += p
        mass[range(6), path] += p
    found, likelihood = regimes.smoothed_posteriors(log_b, moves, first)
    assert np.allclose(found, mass / total) and abs(likelihood - np.log(total)) < 1e-9
    alone, _ = regimes.smoothed_posteriors(log_b[:1], moves, first)
    assert np.allclose(alone, first * np.exp(log_b[0]) / (first * np.exp(log_b[0])).sum())


def test_matching_costs_least_of_all_permutations():
    rng = np.random.default_rng(5)
    for k in (1, 2, 5):
        for _ in range(20):
            new, old = rng.normal(size=(k, 3)), rng.normal(size=(k, 3))
            cost = lambda order: sum(np.linalg.norm(old[i] - new[j]) for i, j in enumerate(order))  # noqa: B023, E731
            assert abs(cost(regimes.matched(new, old)) - min(map(cost, itertools.permutations(range(k))))) < 1e-9
    assert regimes.matched(np.array([[1.0, 2.0], [3.0, 0.0], [1.0, 5.0]]), None).tolist() == [1, 2, 0]


def test_names():
    means = np.array([[5.0, 0], [4, 0], [3, 0], [2, 0], [1, 0], [0, 0]])[[3, 0, 5, 1, 2, 4]]
    assert regimes.named(means, np.array([0.9, 0, 0, 0, 0.1, 0])) == ["VOL_BREAKOUT", "TRENDING_HIKE_LATE", "TRENDING_CUT_LATE", "STEEPENING_RISK_ON", "RANGE_BOUND", "FLATTENING_FLIGHT"]
    assert regimes.named(np.array([[0.0, 1], [2, 0]]), np.zeros(2)) == ["S1", "S0"]


def test_days_states_and_their_quality(points, mixture, series):
    previous = CENTRES[[2, 0, 1]] + 0.3
    days = regimes.regime_days(points, ["panel"], "day", "x", mixture, previous).orderBy("day").collect()
    states = np.array([1, 2, 0])[series[0]]
    found = np.array([d["state"] for d in days])
    assert len(days) == 600 and (found == states).mean() > 0.99
    # The quality that a fit of regimes is held to: likely states on most days, runs of ten days, few flips after a refit.
    assert np.mean([d["top"] > 0.6 for d in days]) >= 0.7
    assert all(abs(sum(d["posteriors"]) - 1) < 1e-9 and d["top"] >= d["second"] for d in days)
    shorter = regimes.fit_mixture(points.where(f"day < date'{DAY + dt.timedelta(570)}'"), "x", k=3)
    again = regimes.regime_days(points, ["panel"], "day", "x", shorter, previous).orderBy("day").collect()
    assert np.mean([a["state"] != b["state"] for a, b in zip(days, again)]) < 0.05


def test_runs_of_states(spark, points, mixture):
    days = regimes.regime_days(points, ["panel"], "day", "x", mixture)
    rows = days.orderBy("day").collect()
    runs = [(s, len(list(g))) for s, g in itertools.groupby(d["state"] for d in rows)]
    found = {r["state"]: r for r in regimes.state_runs(days, ["panel"], "day").collect()}
    assert set(found) == {0, 1, 2}
    for s, r in found.items():
        own = [n for k, n in runs if k == s]
        assert (r["n_bars"], r["max_run_length"]) == (sum(own), max(own)) and abs(r["mean_run_length"] - np.mean(own)) < 1e-9
        p = np.array([d["posteriors"][s] for d in rows])
        assert abs(r["entropy"] + (p * np.log(p + 1e-12)).mean()) < 1e-9
    assert np.mean([r["mean_run_length"] for r in found.values()]) >= 10


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="too few"):
        regimes.fit_mixture(spark.createDataFrame([([1.0],), (None,)], "x array<double>"), "x", k=2)
