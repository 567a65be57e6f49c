"""Setups of every bar against plain loops over one series, bar by bar, that see the past only."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ratelake.operators import setups as O

DAY = dt.date(2020, 1, 1)
SCHEMA = "symbol string, bar_date date, open double, high double, low double, close double, volume long"


def series(seed, n=420):
    """A walk with trends, quiet spells and shocks, so that most setups fire."""
    rng = np.random.default_rng(seed)
    scale = np.repeat(rng.choice([0.1, 0.5, 2.0], n // 20 + 1), 20)[:n]
    drift = np.repeat(rng.choice([-0.6, 0.0, 0.6], n // 35 + 1), 35)[:n]
    close = 200 + np.cumsum(rng.normal(drift * scale, scale) * np.where(rng.random(n) < 0.04, 5, 1))
    opening = close - rng.normal(0, scale)
    high, low = np.maximum(close, opening) + rng.exponential(scale / 3), np.minimum(close, opening) - rng.exponential(scale / 3)
    volume = rng.integers(50, 150, n) * np.where(rng.random(n) < 0.08, 5, 1)
    return pd.DataFrame({"open": opening, "high": high, "low": low, "close": close, "volume": volume})


def rows(name, x):
    return [(name, DAY + dt.timedelta(i), float(r.open), float(r.high), float(r.low), float(r.close), int(r.volume)) for i, r in enumerate(x.itertuples())]


def plain(x):
    """(bar, setup) -> (state, side, entry, stop, first, second)."""
    o, h, lo, c, v = (x[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume"))
    s, n = x["close"], len(x)
    tr = np.array([h[0] - lo[0]] + [max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, n)])
    mean = lambda a, k: pd.Series(a).rolling(k).mean().to_numpy()
    atr, atr10, atr20 = mean(tr, 14), mean(tr, 10), mean(tr, 20)
    up, down = np.diff(h, prepend=np.nan), -np.diff(lo, prepend=np.nan)
    plus = 100 * pd.Series(np.where((up > down) & (up > 0), up, 0.0)).rolling(14).sum().to_numpy() / atr
    minus = 100 * pd.Series(np.where((down > up) & (down > 0), down, 0.0)).rolling(14).sum().to_numpy() / atr
    adx = mean(100 * np.abs(plus - minus) / (plus + minus + 1e-9), 14)
    ema = {k: s.ewm(span=k, adjust=False).mean().to_numpy() for k in (5, 10, 12, 20, 26, 30, 50, 100)}
    wilder = s.ewm(alpha=1 / 200, adjust=False).mean().to_numpy()
    macd = ema[12] - ema[26]
    hist = macd - pd.Series(macd).ewm(span=9, adjust=False).mean().to_numpy()
    delta = s.diff().fillna(0.0)
    gain, loss = (d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean().to_numpy() for d in (delta, -delta))
    rsi = 100 - 100 / (1 + gain / (loss + 1e-9))
    mid, sd = s.rolling(20).mean().to_numpy(), s.rolling(20).std().to_numpy()
    width = 4 * sd / mid
    kc_up, kc_down = ema[20] + 2 * atr20, ema[20] - 2 * atr20
    with np.errstate(invalid="ignore"):
        inside = (mid + 2 * sd <= kc_up) & (mid - 2 * sd >= kc_down)
    z = lambda a, k: ((pd.Series(a) - pd.Series(a).rolling(k).mean()) / (pd.Series(a).rolling(k).std() + 1e-9)).to_numpy()
    z20, z50, zret = z(c, 20), z(c, 50), z(s.pct_change().to_numpy(), 5)
    z90 = lambda a: ((pd.Series(a) - pd.Series(a).rolling(90, min_periods=22).mean()) / pd.Series(a).rolling(90, min_periods=22).std()).to_numpy()
    vz, rz = z90(v), z90(tr)
    st_up, st_down = (h + lo) / 2 + 2 * atr10, (h + lo) / 2 - 2 * atr10
    ribbon = [[e5 > e10 for e5, e10 in zip(row, row[1:])] for row in np.column_stack([ema[k] for k in O.MEANS])]
    fall = [[e5 < e10 for e5, e10 in zip(row, row[1:])] for row in np.column_stack([ema[k] for k in O.MEANS])]
    middle = lambda i, k: (h[i - k + 1 : i + 1].max() + lo[i - k + 1 : i + 1].min()) / 2
    out = {}

    def counted(i, name, history, long, short, stops, first, second=None):
        if i < history:
            out[i, name] = ("N/A", None)
            return
        a, b = sum(map(bool, long)), sum(map(bool, short))
        best, total = max(a, b), len(long)
        state = "FIRED" if best == total else "NEAR" if best == total - 1 else "APPROACHING" if best >= math.ceil(total / 2) else "FAR"
        put(i, name, state, "LONG" if a >= b else "SHORT", stops, first, second)

    def put(i, name, state, side, stops, first, second=None):
        if state != "FIRED":
            out[i, name] = (state, side if state != "FAR" else None)
            return
        k = 0 if side == "LONG" else 1
        stop = stops[k]
        if (c[i] - stop) * (1 if k == 0 else -1) <= 0:
            out[i, name] = (state, side)
            return
        price = lambda t: None if t is None else t[k] if isinstance(t, tuple) else c[i] + t * (c[i] - stop)
        out[i, name] = (state, side, c[i], stop, price(first), price(second))

    for i in range(n):
        atrs = lambda k: (c[i] - k * atr[i], c[i] + k * atr[i])  # noqa: B023, E731
        last = lambda a, k: a[max(0, i - k) : i]  # noqa: B023, E731
        if i < 130:  # the shortest histories are held against N/A below
            continue
        heavy = v[i] > 1.5 * last(v, 20).mean()
        counted(i, "A1", 22, [c[i] > last(h, 20).max(), adx[i] > 20, c[i] > ema[50][i], heavy], [c[i] < last(lo, 20).min(), adx[i] > 20, c[i] < ema[50][i], heavy], atrs(2), 1.0, 2.0)
        counted(i, "A2", 110, [c[i] > ema[100][i], c[i] < ema[20][i], rsi[i] < 45], [c[i] < ema[100][i], c[i] > ema[20][i], rsi[i] > 55], atrs(1.5), 1.0)
        others = width[i - 90 : i - 1]
        narrow = 100 * np.mean(others[~np.isnan(others)] < width[i - 1]) < 25
        five = last(c, 5)
        base = [narrow, last(inside, 10).sum() >= 5, v[i] >= 2 * last(v, 20).mean()]
        counted(i, "A3", 92, [*base, c[i] > five.max()], [*base, c[i] < five.min()], (five.min(), five.max()), 2.0, 3.0)
        base = [last(inside, 20).sum() >= 3, mid[i] + 2 * sd[i] > kc_up[i] or mid[i] - 2 * sd[i] < kc_down[i]]
        counted(i, "A4", 20, [*base, 0 < hist[i] > hist[i - 1]], [*base, 0 > hist[i] < hist[i - 1]], (max(atrs(2)[0], kc_down[i]), min(atrs(2)[1], kc_up[i])), 1.0, 2.0)
        top, bottom = last(c, 55).max(), last(c, 55).min()
        state = "FIRED" if c[i] > top or c[i] < bottom else "NEAR" if min(top - c[i], c[i] - bottom) <= 0.5 * atr[i] else "FAR"
        put(i, "A5", state, "LONG" if c[i] > top or (c[i] >= bottom and top - c[i] <= c[i] - bottom) else "SHORT", atrs(2), (last(c, 20).min(), last(c, 20).max()))
        if i >= 205:
            rise, drop = ema[50][i - 1] <= wilder[i - 1] and ema[50][i] > wilder[i], ema[50][i - 1] >= wilder[i - 1] and ema[50][i] < wilder[i]
            state = ("FIRED" if adx[i] > 18 else "APPROACHING") if rise or drop else "NEAR" if abs(ema[50][i] - wilder[i]) <= 0.5 * atr[i] else "FAR"
            put(i, "A6", state, "LONG" if ema[50][i] > wilder[i] else "SHORT", atrs(3), 1.5)
        a, b = (middle(i - 26, 9) + middle(i - 26, 26)) / 2, middle(i - 26, 52)
        t, k = middle(i, 9), middle(i, 26)
        cloud = abs(a - b)
        counted(i, "A8", 80, [c[i] > max(a, b), t > k, c[i] > c[i - 26]], [c[i] < min(a, b), t < k, c[i] < c[i - 26]], (k, k), (c[i] + cloud / 2, c[i] - cloud / 2), (c[i] + cloud, c[i] - cloud))
        a, b = sum(ribbon[i]), sum(fall[i])
        fresh = (a == 5 and not all(ribbon[i - 1])) or (b == 5 and not all(fall[i - 1]))
        state = "FIRED" if fresh else {5: "APPROACHING", 4: "NEAR", 3: "APPROACHING"}.get(max(a, b), "FAR")
        put(i, "A10", state, "LONG" if a >= b else "SHORT", (ema[50][i], ema[50][i]), 1.5)
        rise, drop = c[i - 1] <= st_down[i - 1] and c[i] > st_down[i], c[i - 1] >= st_up[i - 1] and c[i] < st_up[i]
        to_down, to_up = max(0, st_down[i] - c[i]), max(0, c[i] - st_up[i])
        state = ("FIRED" if adx[i] > 18 else "APPROACHING") if rise or drop else "NEAR" if min(to_down, to_up) <= 0.5 * atr[i] else "FAR"
        put(i, "A11", state, "LONG" if rise or (not drop and to_down < to_up) else "SHORT", (st_up[i], st_down[i]), 2.0)
        for name, period in (("A12a", 20), ("A12b", 50)):
            counted(i, name, period + 5, [plus[i - 1] <= minus[i - 1] and plus[i] > minus[i], adx[i] > 20, c[i] > ema[period][i]], [plus[i - 1] >= minus[i - 1] and plus[i] < minus[i], adx[i] > 20, c[i] < ema[period][i]], atrs(2), 1.5)
        window = range(i - 19, i)
        bullish = c[i] <= c[min(window, key=lambda j: (c[j], j))] and rsi[i] > rsi[min(window, key=lambda j: (c[j], j))]
        bearish = c[i] >= c[min(window, key=lambda j: (-c[j], j))] and rsi[i] < rsi[min(window, key=lambda j: (-c[j], j))]
        lower, upper = mid[i] - 2 * sd[i], mid[i] + 2 * sd[i]
        counted(i, "B1", 22, [c[i] <= lower, adx[i] < 20, bullish], [c[i] >= upper, adx[i] < 20, bearish], (mid[i] - 3 * sd[i], mid[i] + 3 * sd[i]), (mid[i], mid[i]), (upper, lower))
        big = abs(c[i] - o[i]) >= 0.5 * (h[i] - lo[i])
        counted(i, "B3", 22, [c[i] <= last(c, 20).min(), bullish, c[i] > o[i] and big], [c[i] >= last(c, 20).max(), bearish, c[i] < o[i] and big], atrs(1.5), 1.0)
        prior = last(c, 20).std(ddof=1)
        counted(i, "B5", 52, [z20[i] < -2, z50[i] < -1.5, adx[i] < 25], [z20[i] > 2, z50[i] > 1.5, adx[i] < 25], (mid[i] - 3 * prior, mid[i] + 3 * prior), (mid[i], mid[i]))
        size = abs(zret[i])
        put(i, "B6", "FIRED" if size > 2.5 else "NEAR" if size >= 2 else "APPROACHING" if size >= 1.5 else "FAR", "LONG" if zret[i] < 0 else "SHORT", atrs(2), 1.0)
        place = (c[i] - lo[i]) / (h[i] - lo[i]) if h[i] > lo[i] else 0.5
        counted(i, "B10", 92, [vz[i] >= 3, rz[i] >= 2, place <= 0.25, c[i] < lower], [vz[i] >= 3, rz[i] >= 2, place >= 0.75, c[i] > upper], (lo[i], h[i]), (ema[20][i], ema[20][i]))
        m60, s60 = last(c, 60).mean(), last(c, 60).std(ddof=1)
        z60 = (c[i] - m60) / s60
        past = last(c, 90)
        slope = np.polyfit(past[:-1], past[1:], 1)[0]
        quick = 0 < slope < 1 and -math.log(2) / math.log(slope) < 30
        levels, target = (m60 - 3 * s60, m60 + 3 * s60), (m60, m60)
        size = abs(z60)
        put(i, "B11", "FAR" if not quick else "FIRED" if size > 2 else "NEAR" if size >= 1.5 else "APPROACHING" if size > 1 else "FAR", "LONG" if z60 < 0 else "SHORT", levels, target)
        put(i, "C4", "FIRED" if size >= 2 else "NEAR" if size >= 1.5 else "APPROACHING" if size >= 1 else "FAR", "LONG" if z60 < 0 else "SHORT", levels, target)
    return out


def found(spark, bars, **more):
    return {(r["symbol"], (r["bar_date"] - DAY).days, r["setup"]): r for r in O.setup_states(O.setup_panel(bars), **more).collect()}


def test_states_sides_and_levels_equal_a_plain_loop(spark):
    sets = {f"s{k}": series(k) for k in range(3)}
    bars = spark.createDataFrame([r for name, x in sets.items() for r in rows(name, x)], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # the recursions must carry over batches
    try:
        got = found(spark, bars)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fired, stages = set(), set()
    for name, x in sets.items():
        for (i, setup), want in plain(x).items():
            r = got[name, i, setup]
            assert (r["state"], r["side"]) == want[:2], (name, i, setup, r, want)
            levels = [r[k] for k in ("entry", "stop", "first", "second")]
            wanted = list(want[2:]) or [None] * 4
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for a, b in zip(levels, wanted)), (name, i, setup, r, want)
            stages.add((setup, r["state"]))
            if r["state"] == "FIRED":
                fired.add(setup)
        for s in O.SETUPS:
            assert got[name, min(s.history, 12) - 1, s.name]["state"] == "N/A" and got[name, 419, s.name]["state"] != "N/A"
    assert {"A1", "A2", "A5", "A8", "A10", "C4"} <= fired and {s for s, _ in stages} == {s.name for s in O.SETUPS}


def test_ticks_gaps_and_empty_tables(spark):
    x = series(7, 300)
    known = spark.createDataFrame(rows("s", x), SCHEMA)
    broken = spark.createDataFrame([("s", DAY + dt.timedelta(900), 1.0, 1.0, 1.0, None, 1), (None, DAY, 1.0, 1.0, 1.0, 1.0, 1), ("flat", DAY, 5.0, 5.0, 5.0, 5.0, 0)], SCHEMA)
    got = found(spark, known.unionByName(broken), multiplier=F.lit(100.0))
    assert {k[0] for k in got} == {"s", "flat"} and ("s", 900, "A1") not in got
    assert all(r["state"] == "N/A" and r["side"] is None for (name, _, _), r in got.items() if name == "flat")
    levels = [r[k] for r in got.values() for k in ("entry", "stop", "first", "second") if r[k] is not None]
    assert levels and all(abs(v / 0.005 - round(v / 0.005)) < 1e-6 for v in levels)
    flat = spark.createDataFrame([("s", DAY + dt.timedelta(i), 5.0, 5.0, 5.0, 5.0, 1) for i in range(260)], SCHEMA)
    assert "FIRED" not in {r["state"] for r in found(spark, flat).values()}
    assert O.setup_states(O.setup_panel(known.limit(0))).count() == 0
