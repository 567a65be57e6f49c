"""Regressions with autocorrelated errors against numpy; indicators against plain loops."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from ratelake.operators import directional, regression

DAY = dt.date(2020, 1, 1)


def plain_fit(x, y, lags):
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    middle = np.zeros((x.shape[1],) * 2)
    for s in range(len(y)):
        for t in range(max(0, s - lags), min(len(y), s + lags + 1)):
            middle += (1 - abs(s - t) / (lags + 1)) * e[s] * e[t] * np.outer(x[s], x[t])
    return beta, np.sqrt(np.diag(inverse @ middle @ inverse)), 1 - e.var() / y.var()


def data(seed, n):
    rng = np.random.default_rng(seed)
    d = (rng.random((n, 2)) < [0.2, 0.4]).astype(float)
    noise = np.convolve(rng.normal(size=n + 2), [0.5, 0.3, 0.2], "valid")
    return d, 1.0 + d @ [2.0, -1.0] + noise


def test_betas_and_errors_equal_numpy(spark):
    sets = {"a": data(1, 200), "b": data(2, 41)}
    rows = [(s, DAY + dt.timedelta(t), float(v), *map(float, row), 0.0) for s, (d, y) in sets.items() for t, (row, v) in enumerate(zip(d, y))]
    rows += [("few", DAY + dt.timedelta(t), 1.0, 0.0, 1.0, 0.0) for t in range(20)] + [("a", DAY + dt.timedelta(900), None, 1.0, 1.0, 0.0)]
    table = spark.createDataFrame(rows, "symbol string, day date, y double, p double, q double, never double").repartition(3)
    d = regression.design(table, ["symbol"], "day", "y", ["p", "q", "never"])
    fit = regression.hac_fit(d, ["symbol"], "day", 4).persist()
    found = {(r["symbol"], r["regressor"]): r for r in regression.coefficients(fit, ["symbol"], ["p", "q", "never"]).collect()}
    assert {s for s, _ in found} == {"a", "b"}
    left = {}
    for r in regression.adjusted(d, fit, ["symbol"], "day").orderBy("day").collect():
        left.setdefault(r["symbol"], []).append(r["adjusted"])
    for s, (dummies, y) in sets.items():
        beta, error, r2 = plain_fit(np.column_stack([np.ones(len(y)), dummies]), y, 5)
        for k, c in enumerate(("intercept", "p", "q")):
            r = found[s, c]
            assert abs(r["beta"] - beta[k]) < 1e-9 and abs(r["error"] - error[k]) < 1e-9 and abs(r["r_squared"] - r2) < 1e-9
            assert abs(r["p"] - math.erfc(abs(beta[k] / error[k]) / math.sqrt(2))) < 1e-9
            assert r["fires"] == (len(y) if k == 0 else dummies[:, k - 1].sum()) and r["low_sample"] == (r["fires"] < 30)
        assert found[s, "never"]["beta"] is None and found[s, "never"]["error"] is None
        # The mean stays and nothing of the dummies is left.
        assert abs(np.mean(left[s]) - y.mean()) < 1e-9 and np.abs(np.cov(np.array(left[s]), dummies.T)[0, 1:]).max() < 1e-9
    assert regression.hac_fit(d.limit(0), ["symbol"], "day", 4).count() == 0


def test_directional_system_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0], 70))
    high, low = close + rng.choice([0.0, 0.5, 1.0], 70), close - rng.choice([0.0, 0.5, 1.0], 70)
    volume = rng.integers(1, 9, 70)
    rows = [("s", DAY + dt.timedelta(i), float(high[i]), float(low[i]), float(close[i]), int(volume[i])) for i in range(70)]
    bars = spark.createDataFrame([*rows, ("one", DAY, 2.0, 1.0, 1.5, 3)], "symbol string, bar_date date, high double, low double, close double, volume long")
    found = directional.bands(directional.oscillators(directional.directional(bars))).where("symbol = 's'").orderBy("bar_date").collect()
    tr = [high[0] - low[0]] + [max(high[i], close[i - 1]) - min(low[i], close[i - 1]) for i in range(1, 70)]
    plus, minus, flow, dx = [0.0], [0.0], [0.0], []
    for i in range(1, 70):
        up, down = high[i] - high[i - 1], low[i - 1] - low[i]
        plus.append(up if up > down and up > 0 else 0.0)
        minus.append(down if down > up and down > 0 else 0.0)
        flow.append(flow[-1] + np.sign(close[i] - close[i - 1]) * volume[i])
    for i, row in enumerate(found):
        near = lambda name, value: (row[name] is None) if value is None else abs(row[name] - value) < 1e-6  # noqa: B023, E731
        assert near("obv", flow[i])
        di = None
        if i >= 13:
            atr = np.mean(tr[i - 13 : i + 1])
            di = [100 * sum(v[i - 13 : i + 1]) / atr for v in (plus, minus)]
            dx.append(100 * abs(di[0] - di[1]) / (sum(di) + 1e-9))
            assert near("atr_14", atr) and near("di_plus", di[0]) and near("di_minus", di[1])
        assert di is not None or (near("atr_14", None) and near("di_plus", None))
        assert near("adx", np.mean(dx[-14:]) if len(dx) >= 14 else None)
        if i >= 14:
            window = range(i - 14, i + 1)
            top, bottom = (min(window, key=lambda j: (-high[j], j)), min(window, key=lambda j: (low[j], j)))
            assert near("aroon_up", 100 * (14 - (i - top)) / 14) and near("aroon_down", 100 * (14 - (i - bottom)) / 14)
        else:
            assert near("aroon_up", None)
        if i >= 19:
            typical = ((high + low + close) / 3)[i - 19 : i + 1]
            assert near("cci", (typical[-1] - typical.mean()) / (0.015 * np.abs(typical - typical.mean()).mean() + 1e-9))
            last = close[i - 19 : i + 1]
            assert near("bb_up_2", last.mean() + 2 * last.std(ddof=1)) and near("range_20_over_atr", (high[i - 19 : i + 1].max() - low[i - 19 : i + 1].min()) / (np.mean(tr[i - 19 : i + 1]) + 1e-9))
            assert near("bb_place_3", (close[i] - last.mean() + 3 * last.std(ddof=1)) / (6 * last.std(ddof=1) + 1e-9))
        else:
            assert near("cci", None) and near("bb_up_1", None)
        assert near("st_down_2", (high[i] + low[i]) / 2 - 2 * np.mean(tr[i - 9 : i + 1]) if i >= 9 else None)
    alone = directional.directional(bars).where("symbol = 'one'").first()
    assert alone["adx"] is None and alone["tr"] == 1.0
    assert directional.oscillators(directional.directional(bars.where(F.lit(False)))).count() == 0
