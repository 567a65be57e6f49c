"""Columns on prices, states and sizes."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied_rate(close: Column) -> Column:
    return 100 - close


def bp_multiplier(convention: Column) -> Column:
    """Basis points of one stored unit: 1 where stored in basis points, else 100."""
    return F.when(convention == "bp", 1.0).otherwise(100.0)


def round_to_tick(price: Column, multiplier: Column, tick_bp: float = 0.5) -> Column:
    """Nearest tick, halves to the even one."""
    tick = F.lit(tick_bp) / multiplier
    return F.bround(price / tick) * tick


def state_of(met: list[Column]) -> Column:
    """All conditions met, all but one, half of them or more, fewer."""
    n, total = sum((F.coalesce(c, F.lit(False)).cast("int") for c in met), F.lit(0)), len(met)
    return F.when(n == total, "FIRED").when(n == total - 1, "NEAR").when(n >= (total + 1) // 2, "APPROACHING").otherwise("FAR")


def lots_at_risk(stop_bp: Column, risk: float = 10_000.0, dollars: float = 25.0, most: int = 1000) -> Column:
    """Whole lots whose loss at the stop is within the risk, between 1 and ``most``; 0 without a stop."""
    return F.when(stop_bp > 0, F.least(F.greatest(F.floor(risk / (stop_bp * dollars)), F.lit(1)), F.lit(most))).otherwise(0)


def r_levels(entry: Column, stop: Column, side: Column, first: float = 1.0, second: float = 2.0) -> tuple[Column, Column]:
    """Targets at multiples of the distance to the stop."""
    sign = F.when(side == "SHORT", -1).otherwise(1)
    return tuple(entry + sign * k * F.abs(entry - stop) for k in (first, second))


def bounded(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def reversion_score(z: Column, half_life: Column, hurst: Column, adf: Column) -> Column:
    """0.50 |z| / 2 (at most 1), 0.25 (1 - H), 0.15 * 10 / half-life (from 1), 0.10 if a unit root is rejected."""
    return 0.5 * F.least(F.lit(1.0), F.abs(z) / 2) + 0.25 * (1 - hurst) + F.coalesce(0.15 * F.least(F.lit(1.0), 10 / F.greatest(F.lit(1.0), half_life)), F.lit(0.0)) + 0.1 * adf.cast("int")


def kelly(win: Column, ratio: Column, share: float = 0.25) -> Column:
    """A share of the Kelly fraction of a win chance and a win to loss ratio, not below 0."""
    return F.greatest(F.lit(0.0), win - (1 - win) / F.when(ratio > 0, ratio)) * share


def convexity_bias(sigma: Column, years: Column, tau: float = 0.25) -> Column:
    """-1/2 sigma^2 T tau in basis points."""
    return -0.5 * sigma * sigma * years * tau * 1e4


def sign_state(change: Column, small: Column, surprise: Column) -> Column:
    """FLAT, or direction, sign of the surprise and size of a release's change."""
    size = F.when(F.abs(change) <= small, "small").otherwise("large")
    return F.when(change == 0, "FLAT").otherwise(F.concat_ws("_", F.when(change > 0, "UP").otherwise("DOWN"), F.when(surprise > 0, "POS").otherwise("NEG"), size))


def lattice_odds(move: Column, points: list[float]) -> list[Column]:
    """Chance of each of evenly spaced points: linear between the two around ``move``, certain at the ends."""
    step = points[1] - points[0]
    inside = bounded(move, points[0], points[-1])
    return [F.greatest(F.lit(0.0), 1 - F.abs(inside - p) / step) for p in points]


def neutral_weights(front: Column, belly: Column, back: Column) -> tuple[Column, Column]:
    """Weight of both wings against one belly, and of the back leg against one front leg, so that sensitivities cancel; 0 where they cannot."""
    wing = F.when(front + back != 0, -belly / (front + back)).otherwise(0.0)
    return wing, F.when(back != 0, front / back).otherwise(0.0)


def z_pattern(scores: list[Column], elevated: float = 1.0, fresh: float = 1.5, alike: float = 0.75) -> Column:
    """One of eight patterns of the scores of several windows, the shortest first. With a score missing: STABLE if the others are quiet, else MIXED."""
    sizes, signs = [F.abs(z) for z in scores], [F.signum(z) for z in scores]
    every = lambda flags: functools.reduce(lambda a, b: a & b, flags)
    known = F.array_compact(F.array(*sizes))
    near = 1e-9
    down = every([a >= b - near for a, b in zip(sizes, sizes[1:])])
    up = every([a <= b + near for a, b in zip(sizes, sizes[1:])])
    together = every([a >= elevated for a in sizes] + [s == signs[0] for s in signs[1:]])
    drifted = [sizes[0] < elevated, *(a >= fresh for a in sizes[-2:])] + [signs[-1] == signs[-2]] * (len(scores) > 1)
    return (
        F.when(F.size(known) == 0, "MIXED")
        .when(F.array_max(known) < elevated, "STABLE")
        .when(F.size(known) < len(scores), "MIXED")
        .when(every([sizes[0] >= fresh, *(a < elevated for a in sizes[1:])]), "FRESH")
        .when(every(drifted), "DRIFTED")
        .when((sizes[0] >= elevated) & (sizes[-1] >= elevated) & (signs[0] * signs[-1] < 0), "REVERTING")
        .when(~together, "MIXED")
        .when(down & ~up, "ACCELERATING")
        .when(up & ~down, "DECELERATING")
        .when(F.array_max(known) - F.array_min(known) < alike, "PERSISTENT")
        .otherwise("MIXED")
    )
