"""Moves around releases, their summary and drift against plain loops over bars."""

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from ratelake.operators import impact as I

UTC, NY = ZoneInfo("UTC"), ZoneInfo("America/New_York")
BARS = "symbol string, bar_time timestamp, high double, low double, close double"


def market(seed=5):
    """Hourly bars over the change to daylight saving, with weekends, holidays, thin days and missing hours."""
    rng, rows = np.random.default_rng(seed), []
    for s, gaps in (("aa", 0.1), ("bb", 0.6), ("cc", 0.0)):
        t, price = datetime(2024, 2, 26, tzinfo=UTC), 95.0
        for _ in range(24 * 24):
            t += timedelta(hours=1)
            price += rng.normal(0, 0.001 if s == "cc" else 0.05)
            day = t.astimezone(NY)
            if day.weekday() == 5 or (day.weekday() == 6 and day.hour < 18) or (day.month, day.day) in ((3, 6), (3, 7), (3, 14)) or rng.random() < gaps:
                continue
            rows.append((s, t, price + abs(rng.normal(0, 0.02)) * (s != "cc"), price - abs(rng.normal(0, 0.02)) * (s != "cc"), price))
    return rows


RELEASES = [("k", datetime(2024, 3, d, h, m, tzinfo=UTC)) for d, h, m in ((4, 13, 30), (5, 3, 0), (6, 15, 0), (8, 13, 30), (10, 23, 15), (11, 12, 30), (13, 12, 0), (15, 12, 30), (16, 12, 0), (18, 20, 59))]


def plain(rows, released):
    """The eleven measures of one symbol's bars around one release."""
    local = released.astimezone(NY).replace(tzinfo=None)
    midnight = local.replace(hour=0, minute=0)
    wall = lambda t: t.astimezone(NY).replace(tzinfo=None)
    seen = sorted((t, h, lo, c) for _, t, h, lo, c in rows if midnight - timedelta(days=1, hours=36) <= wall(t) < midnight + timedelta(days=2, hours=36))
    if not seen:
        return None
    on = lambda k: [b for b in seen if wall(b[0]).date() == (midnight + timedelta(days=k)).date()]
    before = next((x for k in range(-1, -6, -1) if (x := on(k))), [])
    after = next((x for k in range(1, 6) if (x := on(k))), [])
    close = {t: c for t, _, _, c in seen}
    hour = released.replace(minute=0)
    end = lambda x, i: x[i][3] if x else None
    a = {"before_open": end(before, 0), "before_close": end(before, -1), "open": end(on(0), 0), "close": end(on(0), -1), "after_open": end(after, 0), "after_close": end(after, -1)}
    a |= {n: close.get(hour + timedelta(hours=h)) for n, h in I.HOURS.items()}
    atr = None
    if before:
        prior = [b for b in seen if b[0] < before[0][0]][-21:]
        if len(prior) >= 5:
            atr = float(np.mean([max(b[1] - b[2], abs(b[1] - p[3]), abs(b[2] - p[3])) for p, b in zip(prior, prior[1:])]))
    bp = {m: None if a[e] is None or a[s] is None else (a[e] - a[s]) * 100 for m, (e, s) in I.MEASURES.items()}
    unit = max(atr, 0.005) * 100 if atr else None
    return atr, len(on(0)) < 12, len(on(1)) < 12, bp, {m: None if v is None or unit is None else v / unit for m, v in bp.items()}


def close_to(x, y):
    return x is y or (x is not None and y is not None and x == pytest.approx(y, abs=1e-9))


def test_moves_equal_a_plain_loop(spark):
    rows = market()
    bars = spark.createDataFrame([*rows, ("aa", RELEASES[0][1] + timedelta(minutes=90), None, None, None), (None, rows[0][1], 1.0, 1.0, 1.0)], BARS).repartition(5)
    releases = spark.createDataFrame([*RELEASES, RELEASES[0], ("k", None), ("far", datetime(2020, 1, 1, tzinfo=UTC))], "ticker string, at timestamp")
    got = {(x["released"].replace(tzinfo=UTC), x["symbol"]): x for x in I.release_moves(releases, bars, ["ticker"], "at").collect()}
    expected = {(t, s): p for _, t in RELEASES for s in ("aa", "bb", "cc") if (p := plain([b for b in rows if b[0] == s], t))}
    assert set(got) == set(expected)
    floors = walked = 0
    for k, (atr, t, tp1, bp, norm) in expected.items():
        x = got[k]
        assert close_to(x["atr"], atr) and (x["partial_t"], x["partial_tp1"]) == (t, tp1), k
        assert all(close_to(x[f"{m}_bp"], bp[m]) and close_to(x[f"{m}_norm"], norm[m]) for m in I.MEASURES), k
        assert x["floored"] == bool(atr and atr < 0.005)
        floors += x["floored"]
        walked += tp1 and bp["next_day_full"] is not None
    assert floors and walked and any(v[3]["anticipation_full"] is None for v in expected.values())
    assert I.release_moves(releases.limit(0), bars, ["ticker"], "at").count() == I.release_moves(releases, bars.limit(0), ["ticker"], "at").count() == 0


def test_summary_and_tags_equal_a_plain_version(spark):
    rng, day = np.random.default_rng(2), datetime(2024, 12, 31).date()
    names = [f"{m}_{u}" for m in I.MEASURES for u in ("bp", "norm")]
    rows = []
    for i in range(120):
        age = int(rng.integers(0, 700))
        mean = 0.4 - 0.4 * (i % 3) + 4 * (age < 90 and i % 4 == 1)
        values = [None if rng.random() < 0.2 else float(np.round(rng.normal(mean, 1), 1)) for _ in names]
        rows.append(("k", ("aa", "bb")[i % 2], (None, "UP", "DOWN", "FLAT")[i % 4], day - timedelta(days=age), *values))
    moves = spark.createDataFrame(rows, "ticker string, symbol string, state string, release_day date, " + ", ".join(f"{n} double" for n in names))
    keys = ["ticker", "symbol", "state"]
    summary = I.state_summary(moves, keys, "2024-12-31").cache()
    got = {(x["symbol"], x["state"], x["measure"], x["window"]): x for x in summary.collect()}
    expected = {}
    for s, state in {(r[1], r[2]) for r in rows if r[2]}:
        for m in I.MEASURES:
            b, n = 4 + names.index(f"{m}_bp"), 4 + names.index(f"{m}_norm")
            for w, back in {"full": 10**5, **I.WINDOWS}.items():
                g = [r for r in rows if r[1:3] == (s, state) and (day - r[3]).days <= back and r[n] is not None]
                if g:
                    bps = [r[b] for r in g if r[b] is not None]
                    expected[s, state, m, w] = (len(g), *np.percentile([r[n] for r in g], [50, 25, 75]), np.median(bps) if bps else None, np.mean([abs(r[n]) > 1 for r in g]), ";".join(str(d) for d in sorted(r[3] for r in g)[-3:]))
    assert set(got) == set(expected)
    for k, e in expected.items():
        x = got[k]
        assert x["n"] == e[0] and x["latest"] == e[6] and x["low_sample"] == (e[0] < 3)
        assert all(close_to(x[c], v) for c, v in zip(("median", "p25", "p75", "median_bp", "above_one"), e[1:6]))
    tags = {}
    for x in I.drift_tags(summary, keys, "3m").collect():
        k = (x["symbol"], x["state"], x["measure"])
        full, now = expected[(*k, "full")], expected.get((*k, "3m"))
        width = full[3] - full[2]
        index = (now[1] - full[1]) / width if now and width > 0 else None
        tag = "STABLE"
        if index is not None:
            if now[1] * full[1] < 0:
                tag = "REVERSING"
            elif abs(index) > 1 + 1e-9:
                tag = "GROWING"
            elif abs(index) < 0.5 - 1e-9 and abs(full[1]) > 0.1:
                tag = "FADING"
        assert x["tag"] == tag and x["n_full"] == full[0] and close_to(x["median_3m"], now[1] if now else None)
        tags[tag] = tags.get(tag, 0) + 1
    assert len(tags) == 4
    assert I.drift_tags(summary.limit(0), keys, "3m").count() == 0
