"""Quality by ordinal regression: one score of hashed text features, cut by ordered thresholds into grades.

P(grade <= k) = logistic(threshold k - score). All grades share the weights; thresholds are kept in order by learning
their distances as exponentials. Features are the distinct words of a text (runs of ASCII letters and of characters beyond
ASCII, A-Z lower-cased) and the shares of its tokens by shape (runs of capitals, small letters and digits collapsed, other
characters as they are), both hashed. Weights are drawn to zero, so words seen too rarely to tell anything stay there.

A rating is 0 for a toxic text, 1 for one of low quality, 2 for one that is neither. A null or empty text has no features
and the score 0. Ratings of unknown documents and rows with a null rating teach nothing; a document rated several times
teaches each. Without any rating all chances are equal. Repeated rows are graded row by row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.llm.arrow_text import slices

FEATURES, GRADES = 1 << 18, 3
#: Rated texts that the weights are learned from, about; more are sampled by a hash of doc_id.
SAMPLE_ROWS = 8000

_rng = np.random.default_rng(613)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_PLACE, _ROW = _rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97
_SHAPE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs, which end at borders of texts, and the runs' borders by text."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[:-1][offsets[:-1] < len(inside)]
    begins[inner] = inside[inner]
    first = np.flatnonzero(begins)
    return first, np.searchsorted(first, offsets)


def _run_hashes(values: np.ndarray, inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    kept = np.flatnonzero(inside)
    at = np.searchsorted(kept, first)
    size = np.diff(np.append(at, len(kept)))
    powers = np.cumprod(np.full(int(size.max()), _PLACE, np.uint64))
    return _mixed(np.add.reduceat(values[kept] * powers[np.arange(len(kept)) - np.repeat(at, size)], at))


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the features of all texts."""
    rows, features, values = [], [], []

    def add(keys: np.ndarray, borders: np.ndarray, shares: bool) -> None:
        n = np.diff(borders)
        row = np.repeat(np.arange(len(n)), n)
        _, at, count = np.unique(keys + row.astype(np.uint64) * _ROW, return_index=True, return_counts=True)
        rows.append(row[at])
        features.append((keys[at] >> np.uint64(30)).astype(np.int64) & (FEATURES - 1))
        values.append(4.0 * count / n[row[at]] if shares else np.ones(len(at)))

    letters = _LETTER[data]
    first, borders = _runs(letters, offsets)
    if len(first):
        add(_run_hashes(_VALUE[data], letters, first), borders, False)
    solid = ~_WHITE[data]
    first, borders = _runs(solid, offsets)
    if len(first):
        shape = _SHAPE[data]
        new = solid.copy()
        new[1:] &= shape[1:] != shape[:-1]
        new[first] = True
        # The collapsed token: only the first byte of each run of one shape counts.
        at = np.flatnonzero(new)
        begins = np.searchsorted(at, first)
        size = np.diff(np.append(begins, len(at)))
        powers = np.cumprod(np.full(int(size.max()), _PLACE, np.uint64))
        keys = _mixed(np.add.reduceat(_SHAPE_VALUE[shape[at]] * powers[np.arange(len(at)) - np.repeat(begins, size)], begins) + np.uint64(7))
        add(keys, borders, True)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(features), np.concatenate(values)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade) of each score."""
        below = _logistic(self.thresholds[None, :] - score[:, None])
        return np.diff(np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1), axis=1)


def learn(texts: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, epochs: int = 200, shrink: float = 4e-4) -> OrdinalModel:
    """Fit weights and thresholds to grades 0..n_grades-1 by adaptive gradient steps with soft thresholding."""
    if not texts:
        return OrdinalModel(np.zeros(FEATURES, np.float32), np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1)))
    kinds, feature = np.unique(feature, return_inverse=True)
    w, squares = np.zeros(len(kinds)), np.full(len(kinds), 1e-8)
    reached = np.array([(np.bincount(grades, minlength=n_grades)[: k + 1].sum() + 0.5) / (texts + 1) for k in range(n_grades - 1)])
    thresholds = np.maximum.accumulate(np.log(reached / (1 - reached)) + 0.1 * np.arange(n_grades - 1))
    first, gaps = thresholds[0], np.log(np.maximum(np.diff(thresholds), 0.1))
    t_squares = np.full(n_grades - 1, 1e-8)
    for _ in range(epochs):
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, w[feature] * value, texts)
        upper = np.where(grades < n_grades - 1, _logistic(np.append(thresholds, 0)[grades] - score), 1.0)
        lower = np.where(grades > 0, _logistic(np.insert(thresholds, 0, 0)[grades] - score), 0.0)
        chance = np.maximum(upper - lower, 1e-12)
        to_score = (lower * (1 - lower) - upper * (1 - upper)) / chance  # of the log-likelihood
        g = np.bincount(feature, to_score[row] * value, len(kinds)) / texts
        squares += g * g
        step = 0.3 / np.sqrt(squares)
        w += step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        at = [((grades == k) * upper * (1 - upper) / chance - (grades == k + 1) * lower * (1 - lower) / chance).mean() for k in range(n_grades - 1)]
        t_g = np.array([sum(at), *(sum(at[k + 1 :]) * np.exp(gaps[k]) for k in range(n_grades - 2))])
        t_squares += t_g * t_g
        move = 0.1 * t_g / np.sqrt(t_squares)
        first, gaps = first + move[0], gaps + move[1:]
    weights = np.zeros(FEATURES, np.float32)
    weights[kinds] = w
    return OrdinalModel(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def fit(rated: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Learn from ``rated`` (doc_id, text, grade): all rows, or about ``sample_rows`` of them by a hash of doc_id; whole texts."""
    rated = rated.select("doc_id", "text", "grade").where("text is not null and grade is not null")
    share = min(1.0, sample_rows / max(1, rated.count()))
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("grade")), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            row, feature, value = text_features(data, offsets)
            order = np.argsort(row, kind="stable")
            bounds = pa.array(np.searchsorted(row[order], np.arange(len(offsets))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), part.column(2), pa.ListArray.from_arrays(bounds, pa.array(feature[order].astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value[order].astype(np.float32)))], ["doc_id", "n_bytes", "grade", "features", "values"])

    out = T.StructType([rated.schema["doc_id"], T.StructField("n_bytes", T.LongType()), rated.schema["grade"], T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])
    table = rated.where(unit < share).mapInArrow(run, out).toArrow().sort_by([("doc_id", "ascending"), ("n_bytes", "ascending"), ("grade", "ascending")]).combine_chunks()
    lists = table.column("features").combine_chunks()
    n = np.diff(lists.offsets.to_numpy()) if len(table) else np.zeros(0, np.int64)
    return learn(len(table), np.repeat(np.arange(len(table)), n), lists.flatten().to_numpy().astype(np.int64), table.column("values").combine_chunks().flatten().to_numpy().astype(float), table.column("grade").to_numpy().astype(np.int64))


_models: dict[str, OrdinalModel] = {}


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability (of the top grade) and grade (the likeliest) of every text."""
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("grade", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = sent.value
        for part, data, offsets in slices(batches):
            row, feature, value = text_features(data, offsets)
            score = np.bincount(row, _models[key].weights[feature] * value, len(offsets) - 1).astype(float)  # of no feature it makes integers
            p = _models[key].chances(score)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, -1]), pa.array(p.argmax(1).astype(np.int32))], out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and grade of every rated document."""
    rating = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).when((F.col("quality") >= 1) & (F.col("toxic") <= 0), 2)
    ratings = labels.select(F.col("doc_id").alias("_rated"), rating.alias("grade")).where("grade is not null")
    return docs.select("doc_id", "text").join(ratings, F.col("doc_id") == F.col("_rated")).select("doc_id", "text", "grade")


def quality_grades(docs: DataFrame, labels: DataFrame, least_chance: float = 0.5) -> DataFrame:
    """Grades of all documents with held_out (by crc32 of doc_id; those teach nothing) and kept (top grade at least this likely)."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(rated_documents(docs.where(~out), labels))
    return grade(docs, model).select("doc_id", out.alias("held_out"), "expected_grade", "tail_probability", "grade", (F.col("tail_probability") >= least_chance).alias("kept"))
