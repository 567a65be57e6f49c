"""Exact nearest vectors to a stated set of queries: parts of the vectors meet all queries as matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors that meet in a task, and queries whose distances to them are held at once (32 MB of numbers).
PART, AT_ONCE = 16384, 256


def _matrix(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros, and their lengths; -1 for a list that is null or holds a null."""
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    held = np.maximum(size, 0)
    x = np.zeros((len(size), int(held.max(initial=0))))
    x[np.arange(x.shape[1]) < held[:, None]] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    size[np.repeat(np.arange(len(size)), held)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return x, size


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """As Spark rounds: halves of the decimal form go up. Only what lies next to a half, or is large, takes that form."""
    scaled = x * 10.0**digits
    with np.errstate(invalid="ignore"):
        odd = np.isfinite(x) & ((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) | (scaled > 1e11))
    out = np.where(np.isfinite(x), np.floor(scaled + 0.5) / 10.0**digits, x)
    values, which = np.unique(x[odd], return_inverse=True)
    out[odd] = np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if v < 1e15 else v for v in values.tolist()])[which]
    return out


def _best(query_ids: np.ndarray, q: np.ndarray, q_size: np.ndarray, ids: np.ndarray, x: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query_id, vec_id, d2 and whether it is null, of the k best of each query.

    Products choose: all whose distance by them is within rounding of the k-th. Of those the distance is summed in the order of the elements.
    """
    own, other = (q * q).sum(1), (x * x).sum(1)
    about = own[:, None] + other - 2 * (q @ x.T)
    about[~np.isfinite(about)] = np.inf
    if (size != size[0]).any() or (q_size != size[0]).any() or size[0] < 0:
        about[(q_size[:, None] != size) | (q_size[:, None] < 0)] = np.inf
    about[query_ids[:, None] == ids] = np.inf
    if len(ids) > k:
        error = 16 * (x.shape[1] + 2) * np.finfo(float).eps * (own + other[np.isfinite(other)].max(initial=0))
        r, c = np.nonzero(~(about > (np.partition(about, k - 1, axis=1)[:, k - 1] + 1.1e-6 + error)[:, None]))
    else:
        r, c = (a.ravel() for a in np.indices(about.shape))
    r, c = r[keep := query_ids[r] != ids[c]], c[keep]
    d2 = np.zeros(len(r))
    for j in range(x.shape[1]):
        apart = q[r, j] - x[c, j]
        d2 += apart * apart
    null = (q_size[r] != size[c]) | (size[c] < 0)
    d2 = np.where(null, 0.0, _rounded(d2))
    order = np.lexsort((ids[c], d2, null, r))
    at = r[order]
    order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    return query_ids[r[order]], ids[c[order]], d2[order], null[order]


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors (Euclidean) to each of a stated set of queries, itself left out; ties by id, a whole number.

    Distances are squared and rounded to six digits before they are compared; one from or to a vector that is null, holds a null or has another length is null and comes last.
    Vectors are shuffled once, into parts of about PART rows; each part meets all queries and keeps their k best. The
    comparisons grow with vectors times queries, the shuffle with that over PART; a task holds one part and one batch of queries.
    """
    parts = max(1, -(-vectors.count() // PART))
    row = lambda part, asks: [part.cast("int").alias("part"), F.lit(asks).alias("asks"), F.col("vec_id").cast("long").alias("id"), "embedding"]
    dealt: Column = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    both = vectors.where("vec_id is not null").select(*row(dealt, False))
    both = both.union(queries.where("vec_id is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(*row(F.col("part"), True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, held = -1, [], None
        for batch in batches:
            part, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if part[a] != now:
                    now, pieces, held = part[a], [], None
                ids, (x, size) = batch.column(2).to_numpy()[a:b], _matrix(batch.column(3).slice(a, b - a))
                if not asks[a]:
                    pieces.append((ids, x, size))
                    continue
                if not pieces:
                    continue
                if held is None:
                    width = max(p[1].shape[1] for p in pieces)
                    held = np.concatenate([p[0] for p in pieces]), np.concatenate([_wide(p[1], width) for p in pieces]), np.concatenate([p[2] for p in pieces])
                    pieces = [held]
                width = max(held[1].shape[1], x.shape[1])
                held = held[0], _wide(held[1], width) if held[1].shape[1] < width else held[1], held[2]
                x = _wide(x, width)
                for s in range(0, b - a, AT_ONCE):
                    at = slice(s, s + AT_ONCE)
                    query_id, vec_id, d2, null = _best(ids[at], x[at], size[at], *held, k)
                    yield pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(vec_id), pa.array(d2, mask=null)], ["query_id", "vec_id", "d2"])

    x = both.repartition(parts, "part").sortWithinPartitions("part", "asks").mapInArrow(run, "query_id long, vec_id long, d2 double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.asc_nulls_last("d2"), "vec_id"))
    return x.withColumn("place", best).where(F.col("place") <= k)
