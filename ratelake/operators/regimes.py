"""Hidden regimes: a Gaussian mixture fitted by sums that Spark adds up, smoothed along the calendar, with states that keep their names.

Every pass of the fit is one aggregation over all rows, for all starts at once; the driver sees only K * (1 + d + d * d)
sums of a start. Starts come from a bounded sample in the order of a hash. Smoothing runs forward and backward over a
panel's rows, which its calendar bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of six states by their order, the two in the middle by entropy.
OUTER_NAMES = {0: "TRENDING_HIKE_LATE", 1: "STEEPENING_RISK_ON", 4: "FLATTENING_FLIGHT", 5: "TRENDING_CUT_LATE"}
CALM, WILD = "RANGE_BOUND", "VOL_BREAKOUT"
#: Added to the variances, and the rows from which starts are drawn.
FLOOR, SAMPLE_ROWS = 1e-4, 2000


@dataclass
class Mixture:
    """Weights (K), means (K, d) and covariances (K, d, d); ``history`` has the mean log-likelihood before each pass."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    history: list[float] = field(default_factory=list)
    rows: int = 0

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """(n, K) logarithms of the components' densities, without their weights."""
        out = np.empty((len(x), len(self.weights)))
        for k, (mean, covariance) in enumerate(zip(self.means, self.covariances)):
            root = np.linalg.cholesky(covariance)
            z = np.linalg.solve(root, (x - mean).T)
            out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def joint(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return self.log_densities(x) + np.log(self.weights)

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2

    @property
    def bic(self) -> float:
        return -2 * self.history[-1] * self.rows + self.parameters * float(np.log(self.rows))

    @property
    def aic(self) -> float:
        return -2 * self.history[-1] * self.rows + 2 * self.parameters


def log_sum(a: np.ndarray, axis: int = -1) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sufficient(x: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """One row: the log-likelihood, then each component's share of rows, of x and of its products."""
    whole = log_sum(joint)
    share = np.exp(joint - whole[:, None])
    products = np.einsum("nk,ni,nj->kij", share, x, x)
    return np.concatenate([[whole.sum()], share.sum(0), (share.T @ x).ravel(), products.ravel()])


def from_sums(s: np.ndarray, n: int, k: int, d: int, floor: float) -> Mixture:
    mass = s[1 : 1 + k] + 10 * np.finfo(float).eps
    means = s[1 + k : 1 + k + k * d].reshape(k, d) / mass[:, None]
    products = s[1 + k + k * d :].reshape(k, d, d) / mass[:, None, None]
    covariances = products - np.einsum("ki,kj->kij", means, means)
    return Mixture(mass / mass.sum(), means, (covariances + covariances.transpose(0, 2, 1)) / 2 + floor * np.eye(d), rows=n)


def _start(sample: np.ndarray, k: int, seed: int, floor: float) -> Mixture:
    """Centres drawn far apart, moved by 25 rounds of nearest means, as a mixture."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        far = np.min([((sample - c) ** 2).sum(1) for c in centres], axis=0)
        total = far.sum()
        centres.append(sample[rng.choice(len(sample), p=far / total if total > 0 else None)])
    centres = np.array(centres)
    for _ in range(25):
        label = ((sample[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([sample[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
    hard = np.where(label[:, None] == np.arange(k), 0.0, -np.inf)
    return from_sums(sufficient(sample, hard), len(sample), k, sample.shape[1], floor)


def fit_mixture(points: DataFrame, x: str, k: int = 6, starts: int = 3, most: int = 200, tolerance: float = 1e-3, floor: float = FLOOR, seed: int = 42) -> Mixture:
    """The best of several fits of K Gaussians with full covariances to the arrays ``x``; rows without one are ignored.

    Stops when the mean log-likelihood of every start gains less than ``tolerance`` in a pass.
    """
    points = points.where(F.col(x).isNotNull()).select(F.col(x).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sample = np.array([r[0] for r in points.orderBy(F.xxhash64("x"), "x").limit(SAMPLE_ROWS).collect()], float)
        if len(sample) < k:
            raise ValueError(f"{len(sample)} rows are too few for {k} components")
        n, d = points.count(), sample.shape[1]
        # A common origin keeps the sums of products precise.
        origin = sample.mean(0)
        open_, done = {s: _start(sample - origin, k, seed + s, floor) for s in range(starts)}, {}
        histories: dict[int, list[float]] = {s: [] for s in open_}
        for step in range(most):
            current = dict(open_)

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    y = np.array(batch.column(0).to_pylist(), float).reshape(-1, d) - origin
                    if len(y):
                        found = [sufficient(y, m.joint(y)) for m in current.values()]
                        yield pa.RecordBatch.from_arrays([pa.array(list(current), pa.int32()), pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], ["start", "s"])

            parts = points.mapInArrow(sums, "start int, s array<double>").select("start", F.posexplode("s").alias("at", "v"))
            total: dict[int, np.ndarray] = {s: np.zeros(1 + k + k * d + k * d * d) for s in current}
            for r in parts.groupBy("start", "at").agg(F.sum("v").alias("v")).collect():
                total[r["start"]][r["at"]] = r["v"]
            for s, found in total.items():
                histories[s].append(float(found[0]) / n)
                if len(histories[s]) > 1 and histories[s][-1] - histories[s][-2] < tolerance or step == most - 1:
                    done[s] = open_.pop(s)
                else:
                    open_[s] = from_sums(found, n, k, d, floor)
            if not open_:
                break
        best = max(done, key=lambda s: histories[s][-1])
        m = done[best]
        return Mixture(m.weights, m.means + origin, m.covariances, histories[best], n)
    finally:
        points.unpersist()


def transitions(labels: np.ndarray, k: int, smoothing: float = 2.0) -> np.ndarray:
    """Shares of moves between labels, each pair counted ``smoothing`` times beforehand."""
    a = np.full((k, k), smoothing)
    np.add.at(a, (labels[:-1], labels[1:]), 1.0)
    return a / a.sum(1, keepdims=True)


def smoothed_posteriors(log_b: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
    """(posteriors of the states at every row, log-likelihood) by forward and backward messages."""
    with np.errstate(divide="ignore"):
        log_a, log_first = np.log(moves), np.log(first)
    ahead, back = np.empty_like(log_b), np.zeros_like(log_b)
    ahead[0] = log_first + log_b[0]
    for t in range(1, len(log_b)):
        ahead[t] = log_b[t] + log_sum(ahead[t - 1][:, None] + log_a, axis=0)
    for t in range(len(log_b) - 2, -1, -1):
        back[t] = log_sum(log_a + (log_b[t + 1] + back[t + 1])[None, :], axis=1)
    both = ahead + back
    return np.exp(both - log_sum(both)[:, None]), float(log_sum(ahead[-1]))


def matched(means: np.ndarray, previous: np.ndarray | None) -> np.ndarray:
    """order[new] = old: which of ``means`` takes each of the previous places, at the least sum of distances; by first, then second coordinate, highest first, where there is no previous.

    A programme over sets of taken places: exact, 2**K steps.
    """
    k = len(means)
    if previous is None or previous.shape != means.shape:
        second = means[:, 1] if means.shape[1] > 1 else np.zeros(k)
        return np.lexsort((-second, -means[:, 0]))
    cost = np.linalg.norm(previous[:, None] - means[None], axis=2)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for place in range(k):
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for taken, (so_far, order) in best.items():
            for old in range(k):
                if not taken >> old & 1:
                    entry = (so_far + float(cost[place, old]), (*order, old))
                    key = taken | 1 << old
                    if key not in after or entry < after[key]:
                        after[key] = entry
        best = after
    return np.array(best[(1 << k) - 1][1])


def named(means: np.ndarray, entropies: np.ndarray) -> list[str]:
    """Names of the states by their means' first and second coordinates, highest first; of six, the two in the middle by entropy."""
    k = len(means)
    order = matched(means, None).tolist()
    if k != 6:
        return [f"S{order.index(i)}" for i in range(k)]
    calm, wild = sorted(order[2:4], key=lambda i: (entropies[i], i))
    names = {order[place]: name for place, name in OUTER_NAMES.items()} | {calm: CALM, wild: WILD}
    return [names[i] for i in range(k)]


def regime_days(points: DataFrame, by: list[str], at: str, x: str, mixture: Mixture, previous: np.ndarray | None = None) -> DataFrame:
    """by, at, state, top, second and posteriors of every row: the mixture's labels smoothed along each panel's calendar, states in the order of ``previous`` means."""
    k = len(mixture.weights)
    order = matched(mixture.means, previous)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at)
        y = np.array(part[x].tolist(), float)
        joint = mixture.joint(y)
        p, _ = smoothed_posteriors(mixture.log_densities(y), transitions(joint.argmax(1), k), mixture.weights)
        p = p[:, order]
        ranked = np.sort(p, axis=1)
        found = part[[*by, at]].copy()
        found["state"], found["top"], found["second"], found["posteriors"] = p.argmax(1).astype("int32"), ranked[:, -1], ranked[:, -2] if k > 1 else 0.0, p.tolist()
        return found

    schema = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in (*by, at))
    rows = points.where(F.col(x).isNotNull()).select(*by, at, x)
    return rows.groupBy(*by).applyInPandas(run, f"{schema}, state int, top double, second double, posteriors array<double>")


def degraded(most: float = 0.6, second: float = 0.25):
    """Whether no state is likely and another one is not unlikely."""
    return (F.col("top") < most) & (F.col("second") > second)


def state_runs(days: DataFrame, by: list[str], at: str) -> DataFrame:
    """Per panel and state: n_bars, frac_bars, mean_run_length, max_run_length and the entropy of its posteriors' column."""
    w = W.partitionBy(*by).orderBy(at)
    island = F.row_number().over(w) - F.row_number().over(W.partitionBy(*by, "state").orderBy(at))
    runs = days.withColumn("island", island).groupBy(*by, "state", "island").agg(F.count("*").alias("length"))
    r = runs.groupBy(*by, "state").agg(F.sum("length").alias("n_bars"), F.avg("length").alias("mean_run_length"), F.max("length").alias("max_run_length"))
    r = r.withColumn("frac_bars", F.col("n_bars") / F.sum("n_bars").over(W.partitionBy(*by)))
    e = days.select(*by, F.posexplode("posteriors").alias("state", "p")).groupBy(*by, "state").agg((-F.avg(F.col("p") * F.log(F.col("p") + 1e-12))).alias("entropy"))
    return e.join(r, [*by, "state"], "left").select(*by, "state", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), F.coalesce("frac_bars", F.lit(0.0)).alias("frac_bars"), "mean_run_length", "max_run_length", "entropy")
