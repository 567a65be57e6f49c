"""Sequences of trades and patterns of scores against plain loops on random rows."""

import itertools
import random

from pyspark.sql import functions as F

from ratelake.functions import levels as L
from ratelake.operators import trades


def plain_exit(bars, fires, i, side, stop, t1, t2, horizon):
    if i + 1 >= len(bars):
        return None
    sign = 1 if side == "LONG" else -1
    entry = bars[i + 1]["open"]
    risk = abs(entry - stop)
    if risk == 0:
        return None
    if t1 is None and sign * (entry - stop) > 0:
        t1 = entry + sign * risk
        t2 = entry + 2 * sign * risk if t2 is None else t2
    worst, best, last = 0.0, 0.0, min(horizon, len(bars) - i - 2)
    for k in range(1, last + 1):
        b = bars[i + 1 + k]
        up, down = (b["high"], b["low"]) if sign > 0 else (-b["low"], -b["high"])
        worst, best = min(worst, (down - sign * entry) / risk), max(best, (up - sign * entry) / risk)
        if down <= sign * stop:
            return i + 1 + k, stop, "stop", k, worst, best
        if t2 is not None and up >= sign * t2:
            return i + 1 + k, t2, "t2", k, worst, best
        if t1 is not None and up >= sign * t1:
            return i + 1 + k, t1, "t1", k, worst, best
        if any(j == i + 1 + k and s != side for j, s in fires) and i + k + 2 < len(bars):
            return i + k + 2, bars[i + k + 2]["open"], "reversal", k + 1, worst, best
    return i + 1 + last, bars[i + 1 + last]["close"], "time", last, worst, best


def plain_sequence(bars, fires, horizon, cooldown):
    out, free = [], {"LONG": -1000, "SHORT": -1000}
    known = [(f[0], f[1]) for f in fires]
    for i, side, stop, t1, t2 in sorted(fires, key=lambda f: f[0]):
        if i - free[side] <= cooldown:
            continue
        found = plain_exit(bars, known, i, side, stop, t1, t2, horizon)
        if found:
            out.append((i, side, *found))
            free[side] = found[0]
    return out


def rows_of(seed):
    rng = random.Random(seed)
    bars, price = [], 100.0
    for _ in range(90):
        o = price + rng.choice([-0.5, 0, 0.5])
        c = o + rng.choice([-1, -0.5, 0, 0.5, 1, rng.choice([-6, -1, 1, 6])])
        bars.append({"open": o, "high": max(o, c) + rng.choice([0, 0.5]), "low": min(o, c) - rng.choice([0, 0.5]), "close": c})
        price = c
    fires = []
    for i in [*sorted(rng.sample(range(90), 30)), 89]:
        side = rng.choice(["LONG", "SHORT"])
        if any(f[0] == i for f in fires):
            continue
        sign = 1 if side == "LONG" else -1
        # Some stops stand at the entry, some on its wrong side, some targets are given.
        stop = bars[i]["close"] - sign * rng.choice([1, 2, 3, 0, -1])
        t1 = rng.choice([None, None, bars[i]["close"] + sign * 2])
        t2 = rng.choice([None, bars[i]["close"] + sign * 4])
        fires.append((i, side, stop, t1, t2))
    return bars, fires


def test_sequences_equal_a_plain_loop(spark):
    data = {f"s{k}": rows_of(k) for k in range(6)}
    bars = spark.createDataFrame([(s, i, *(b[c] for c in ("open", "high", "low", "close"))) for s, (bs, _) in data.items() for i, b in enumerate(bs)], "symbol string, i int, open double, high double, low double, close double")
    fires = spark.createDataFrame([("x", s, *f) for s, (_, fs) in data.items() for f in fs], "setup string, symbol string, i int, side string, stop double, t1 double, t2 double")
    twice = fires.union(fires.withColumn("setup", F.lit("y")))
    found = trades.sequenced(trades.exits(twice, bars, ["setup"], horizon=12), ["setup"], cooldown=3).collect()
    reasons = set()
    for setup, (symbol, (bs, fs)) in itertools.product("xy", data.items()):
        want = plain_sequence(bs, fs, 12, 3)
        own = sorted((r["i"], r["side"], r["exit_i"], r["exit_price"], r["reason"], r["held"], r["mae_r"], r["mfe_r"]) for r in found if r["setup"] == setup and r["symbol"] == symbol)
        assert [(*r[:6],) for r in own] == [(*w[:6],) for w in sorted(want)]
        assert all(abs(a - b) < 1e-9 for r, w in zip(own, sorted(want)) for a, b in zip(r[6:], w[6:]))
        reasons |= {r[4] for r in own}
    assert reasons == {"stop", "t1", "t2", "reversal", "time"}
    assert trades.sequenced(trades.exits(fires.limit(0), bars, ["setup"]), ["setup"]).count() == 0


def plain_pattern(scores):
    known = [abs(z) for z in scores if z is not None]
    if len(known) < len(scores):
        return "STABLE" if known and max(known) < 1 else "MIXED"
    a, positive = known, [z > 0 for z in scores]
    if max(a) < 1:
        return "STABLE"
    if a[0] >= 1.5 and max(a[1:]) < 1:
        return "FRESH"
    if a[0] < 1 and min(a[1:]) >= 1.5 and positive[1] == positive[2]:
        return "DRIFTED"
    if min(a[0], a[2]) >= 1 and positive[0] != positive[2]:
        return "REVERTING"
    if min(a) >= 1 and len(set(positive)) == 1:
        falls, rises = a[0] >= a[1] >= a[2], a[0] <= a[1] <= a[2]
        if falls != rises:
            return "ACCELERATING" if falls else "DECELERATING"
        if max(a) - min(a) < 0.75:
            return "PERSISTENT"
    return "MIXED"


def test_patterns_of_random_scores(spark):
    rng = random.Random(9)
    values = [None, 0.0, 0.4, -0.9, 1.0, 1.2, -1.2, 1.5, -1.5, 1.8, -2.5, 3.0]
    triples = [tuple(rng.choice(values) for _ in range(3)) for _ in range(3000)] + [(None, None, None), (1.2, 1.5, 1.3), (1.2, 1.2, 1.2)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "n int, a double, b double, c double")
    found = {r["n"]: r["p"] for r in df.select("n", L.z_pattern([F.col("a"), F.col("b"), F.col("c")]).alias("p")).collect()}
    want = {i: plain_pattern(t) for i, t in enumerate(triples)}
    assert found == want and set(want.values()) == {"STABLE", "FRESH", "DRIFTED", "REVERTING", "ACCELERATING", "DECELERATING", "PERSISTENT", "MIXED"}
