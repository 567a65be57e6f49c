"""Changes of level: the posterior of the time since the last one, row by row, and the best segments of a whole series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.operators.folds import ordered_fold

#: Run lengths that are kept; the least likely beyond these are dropped, so a state does not grow with its series.
MOST_RUNS = 500


class RunLengths:
    """Posterior of the number of rows since the last change, the rows independent normals of unknown mean and variance in each dimension.

    The prior has mean 0 and counts as one row; a change comes with probability ``hazard`` at each row.
    """

    _logs = np.zeros(0)

    def __init__(self, d: int, hazard: float = 0.01, horizon: int = 5, most: int = MOST_RUNS):
        self.hazard, self.horizon, self.most = hazard, horizon, most
        self.runs, self.log_p = np.zeros(1, np.int64), np.zeros(1)
        self.mean, self.beta = np.zeros((1, d)), np.ones((1, d))

    @classmethod
    def _gammas(cls, runs: np.ndarray) -> np.ndarray:
        """ln gamma(alpha + 1/2) - ln gamma(alpha) for alpha = 1 + run / 2."""
        need = int(runs.max()) + 1
        if need > len(cls._logs):
            cls._logs = np.array([math.lgamma(1.5 + r / 2) - math.lgamma(1 + r / 2) for r in range(2 * need)])
        return cls._logs[runs]

    def observe(self, x: np.ndarray) -> float:
        """Take a row in; the probability that fewer than ``horizon`` rows have passed since the last change."""
        kappa, alpha = 1.0 + self.runs, 1.0 + self.runs / 2
        scale = self.beta * ((kappa + 1) / (alpha * kappa))[:, None]
        off2, df = (x - self.mean) ** 2, (2 * alpha)[:, None]
        log_t = self._gammas(self.runs)[:, None] - 0.5 * np.log(df * np.pi * scale) - (df + 1) / 2 * np.log(1 + off2 / (df * scale + 1e-12))
        joint = self.log_p + log_t.sum(1)
        top = joint.max()
        whole = top + math.log(np.exp(joint - top).sum())
        self.log_p = np.concatenate([[math.log(self.hazard)], joint - whole + math.log1p(-self.hazard)])
        grown = (kappa[:, None] * self.mean + x) / (kappa + 1)[:, None]
        self.beta = np.concatenate([np.ones((1, len(x))), self.beta + kappa[:, None] * off2 / (2 * (kappa + 1))[:, None]])
        self.mean = np.concatenate([np.zeros((1, len(x))), grown])
        self.runs = np.concatenate([[0], self.runs + 1])
        if len(self.runs) > self.most:
            keep = np.sort(np.concatenate([[0], 1 + np.argsort(-self.log_p[1:], kind="stable")[: self.most - 1]]))
            self.runs, self.log_p, self.mean, self.beta = self.runs[keep], self.log_p[keep], self.mean[keep], self.beta[keep]
            self.log_p = self.log_p - math.log(np.exp(self.log_p).sum())
        return float(np.exp(self.log_p[self.runs < self.horizon]).sum())

    def dump(self) -> tuple[list[int], list[float], list[float], list[float]]:
        return self.runs.tolist(), self.log_p.tolist(), self.mean.ravel().tolist(), self.beta.ravel().tolist()

    def load(self, runs, log_p, mean, beta) -> RunLengths:
        self.runs, self.log_p = np.array(runs, np.int64), np.array(log_p, float)
        self.mean, self.beta = (np.array(v, float).reshape(len(self.runs), -1) for v in (mean, beta))
        return self


def change_probabilities(rows: DataFrame, by: str, at: str, x: str, d: int, hazard: float = 0.01, horizon: int = 5, most: int = MOST_RUNS) -> DataFrame:
    """by, at and p_change, the probability that a change lies fewer than ``horizon`` rows back, of every row with an array x; in the order of at, then x."""
    types = rows.schema

    def step(state: RunLengths, part: pd.DataFrame) -> pd.DataFrame:
        return part[[by, at]].assign(p_change=[state.observe(np.asarray(v, float)) for v in part[x]])

    schema = f"`{by}` {types[by].dataType.simpleString()}, `{at}` {types[at].dataType.simpleString()}, p_change double"
    whole = rows.where(F.col(x).isNotNull() & F.col(at).isNotNull()).select(by, at, x)
    return ordered_fold(whole, [by], [at, x], lambda: RunLengths(d, hazard, horizon, most), step, schema)


def best_breaks(y: np.ndarray, most: int = 5, trim: float = 0.15, gain: float = 0.02) -> list[int]:
    """Last places of all segments but the last, where up to ``most`` breaks in the mean give the least information criterion.

    Segments have at least max(5, trim * n) rows; breaks must take away more than ``gain`` of the squares. A dynamic
    programme over the last place of a segment; the squares of all segments that end there come from running sums.
    """
    n = len(y)
    if n < 30:
        return []
    least = max(5, int(trim * n))
    y = y - y.mean()
    s, s2 = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])

    def squares(first: np.ndarray, last: int) -> np.ndarray:
        size = last + 1 - first
        return np.maximum(s2[last + 1] - s2[first] - (s[last + 1] - s[first]) ** 2 / size, 0.0)

    cost = np.full(n, np.inf)
    for j in range(least - 1, n):
        cost[j] = squares(np.zeros(1, np.int64), j)[0]
    whole = cost[n - 1]
    if whole <= 0:
        return []
    best, chosen, back = n * math.log(whole / n) + math.log(n), 0, []
    for m in range(1, most + 1):
        after, came = np.full(n, np.inf), np.zeros(n, np.int64)
        for j in range((m + 1) * least - 1, n):
            cut = np.arange(m * least - 1, j - least + 1)
            total = cost[cut] + squares(cut + 1, j)
            k = int(total.argmin())
            after[j], came[j] = total[k], cut[k]
        cost = after
        back.append(came)
        if np.isfinite(cost[n - 1]) and cost[n - 1] > 0:
            criterion = n * math.log(cost[n - 1] / n) + (m + 1) * math.log(n)
            if criterion < best and 1 - cost[n - 1] / whole > gain:
                best, chosen = criterion, m
    found, j = [], n - 1
    for m in range(chosen, 0, -1):
        j = int(back[m - 1][j])
        found.append(j)
    return found[::-1]


def level_breaks(rows: DataFrame, by: str, at: str, x: str, most: int = 5, trim: float = 0.15) -> DataFrame:
    """by and at of the last row of each segment but the last one of every series. A series is one group; its calendar bounds it."""
    types = rows.schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at)
        return part.iloc[best_breaks(part[x].to_numpy(float), most, trim)][[by, at]]

    schema = f"`{by}` {types[by].dataType.simpleString()}, `{at}` {types[at].dataType.simpleString()}"
    return rows.where(F.col(x).isNotNull()).select(by, at, x).groupBy(by).applyInPandas(run, schema)
