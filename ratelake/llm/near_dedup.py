"""Near-duplicates by MinHash bands and sequential Bayesian verification.

1. Every text becomes its set of hashed five-word shingles and a signature of minima under ``HASHES`` hash functions.
   Texts with equal sets are one class from here on, so copies, however many, cost one member.
2. Signatures are cut into bands; classes that share a band are candidates. In each of up to ``PIVOTS`` rounds every bucket
   has a pivot: the class that shares buckets with the most others, of those not yet in an earlier pivot's component. A
   class is paired with one pivot of its buckets alone, the one that shares the most, of those not in its component. In a last round, classes that still are not in the
   component of their bucket's first pivot meet the rest of the bucket, tile by tile: blocks of some ``BLOCK`` signatures
   against each other, the unit of Spark's work being a pair of blocks. Only pairs that pass step 3 leave a tile, and
   their texts are sent once a tile. So every pair of a bucket is compared or already in one component, a bucket of
   thousands of copies makes a few times as many pairs as members, and no join lists the pairs of a group.
3. A pair's signatures are compared in batches. After each batch the posterior of the similarity (uniform prior) is
   looked at; the pair goes as soon as the chance of reaching the threshold is below ``MISS``.
4. Survivors are verified on the full sets of both texts; verified pairs are links, and components are found by
   passing on the smallest label along links, with label shortcuts.

Null and empty texts have no shingles and no links. Equal rows are each judged as they are. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ratelake.llm.arrow_text import slices
from ratelake.llm.shared_store import discard, stored

SHINGLE, PERCENT = 5, 75
HASHES, BANDS, BATCH, MISS, PIVOTS = 128, 32, 32, 1e-6, 4
#: A set of ids up to this many is sent to every task (8 bytes each); a larger one is joined by shuffle.
SENT_IDS = 2_000_000
#: Rounds go on while one in so many of their pairs is a link.
FRUITFUL = 8
#: Members of a block in the last round: its signatures are compared with another block's in one numpy call.
BLOCK = 128

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE, _WORDS = _rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the n+1 borders of the texts among the words."""
    word = ~_WHITE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    begins[borders] = word[borders]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kept = np.flatnonzero(word)
    first = np.searchsorted(kept, at)
    which = np.zeros(len(kept), np.int64)
    which[first[1:]] = 1
    place = np.arange(len(kept)) - first[np.cumsum(which)]
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(place.max()), _PLACE, np.uint64))])
    return _mixed(np.add.reduceat(_BYTE[data[kept]] * powers[place], first)), np.searchsorted(at, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; a text of fewer words is one shingle."""
    words, borders = word_hashes(data, offsets)
    windows = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        windows = windows * _WORDS + words[k : len(words) - n + 1 + k]
    windows = _mixed(windows)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= n:
            x = np.sort(windows[a : b - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            short = np.full(int(b > a), b - a, np.uint64)
            for w in words[a:b]:
                short = short * _WORDS + w
            out.append(_mixed(short))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each set that is not empty; zeros for the others."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        everything = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(everything * _MULTIPLY[k] + _ADD[k], at) >> np.uint64(32)
    return out


@lru_cache(maxsize=None)
def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest of n equal minima with which the posterior chance of the threshold similarity is at least ``miss``.

    With a uniform prior the similarity given m matches has the density Beta(m+1, n-m+1), whose tail beyond s is the
    chance of at most m successes in n+1 trials of chance s.
    """
    s, below = percent / 100, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def _sign(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            minima = pa.array([row.tobytes() if len(s) else None for s, row in zip(sets, signatures(sets))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), minima], out.names)

    out = T.StructType([docs.schema["doc_id"], *(docs.schema[c] for c in columns), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("minima", T.BinaryType())])
    return docs.select("doc_id", "text", *columns).mapInArrow(run, out)


def _prune(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
            alive, found = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n in range(BATCH, HASHES + 1, BATCH):
                found[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(1)
                alive = alive[found[alive] >= least_matches(n)]
            yield batch.select([0, 1]).take(pa.array(alive))

    one = pairs.join(minima.select(F.col("id").alias("a"), F.col("minima").alias("left")), "a")
    both = one.join(minima.select(F.col("id").alias("b"), F.col("minima").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, pairs.select("a", "b").schema)


def _set_of(text: pa.StringScalar) -> np.ndarray:
    data = np.frombuffer(text.cast(pa.binary()).as_buffer(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]))[0]


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold. ``pairs`` is stored; ``texts`` has id and text, which is not null."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    texts = texts.join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, y = [], None, None
            for i in range(batch.num_rows):
                # Pairs come sorted by b, so that a text is cut into its set once for all its pairs.
                if batch.column(3)[i] != last:
                    last = batch.column(3)[i]
                    y = _set_of(last)
                x = _set_of(batch.column(2)[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, pairs.select("a", "b").schema)


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id of the links (a, b), the smallest id reachable. ``links`` is stored."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        new = stored(labels.join(heard, "id").select("id", "label", F.least("label", "other").alias("new")))
        hop = new.select(F.col("id").alias("at"), F.col("new").alias("further"))
        further = stored(new.join(hop, F.col("new") == F.col("at")).select("id", F.col("further").alias("label"), (F.col("further") < F.col("label")).alias("changed")))
        discard(labels, new)
        labels = further
        if not labels.where("changed").limit(1).count():
            discard(both)
            return labels.select("id", F.col("label").alias("component"))


def _pairs(x: DataFrame, one: str, other: str) -> DataFrame:
    return x.select(F.greatest(one, other).alias("a"), F.least(one, other).alias("b")).distinct()


def _met(known: DataFrame, pivots: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with their components, whether those are a pivot's so far, and the bucket's first pivot."""
    names = found.withColumnsRenamed({"id": "_id", "component": "_of"})
    new = known.join(names, known["id"] == names["_id"], "left").select("band", "id", "degree", F.coalesce("_of", "of").alias("of"), "met", "first")
    named = pivots.join(names, pivots["pivot"] == names["_id"], "left").select("band", "pivot", F.coalesce("_of", "pivot").alias("pivot_in"))
    return new.join(named, "band", "left").select("band", "id", "degree", "of", (F.col("met") | F.coalesce(F.col("of") == F.col("pivot_in"), F.lit(False))).alias("met"), F.coalesce("first", "pivot").alias("first"))


def _tiles(known: DataFrame, sizes: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of blocks (band, main, i, j, left, right) in which every two of a bucket meet, unless both are in the component of its first pivot.

    A bucket's members are dealt to blocks of about ``BLOCK`` by hash, those apart from the first pivot's component and
    those in it (``main``) in blocks of their own; blocks meet by their numbers, so a large bucket spreads over tasks.
    """
    open_ = known.where("of <> first_of").select("band").distinct()
    known = known.join(open_, "band", "left_semi").select("band", "id", "of", (F.col("of") == F.col("first_of")).alias("main"))
    bands = known.groupBy("id").agg(F.collect_set("band").alias("bands"))
    dealt = known.groupBy("band", "main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = known.join(dealt, ["band", "main"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(bands, "id").join(sizes, "id").join(members.select("id", "minima"), "id")
    blocks = stored(rows.groupBy("band", "main", "block").agg(F.collect_list(F.struct("id", "of", "least", "most", "bands", "minima")).alias("rows")))
    meets = dealt.select("band", "main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    apart = blocks.where("not main").select("band", F.col("block").alias("i"))
    pairs = apart.join(meets, "band").where("main or i <= j")
    left, right = blocks.where("not main").select("band", F.col("block").alias("i"), F.col("rows").alias("left")), blocks.select("band", "main", F.col("block").alias("j"), F.col("rows").alias("right"))
    return pairs.join(left, ["band", "i"]).join(right, ["band", "main", "j"]).select("band", "main", "i", "j", "left", "right")


def _compared(tiles: DataFrame, id_type: T.DataType) -> DataFrame:
    """band, main, i, j and the arrays a and b: the pairs of each tile whose signatures and sizes leave a link possible, if it has any.

    Of all buckets that two are in, only the one with the smallest number keeps them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                band, main, i, j, left, right = (c[k].as_py() for c in batch.columns)
                x, y = (np.frombuffer(b"".join(r["minima"] for r in side), np.uint32).reshape(-1, HASHES) for side in (left, right))
                component = np.unique([r["of"] for side in (left, right) for r in side], return_inverse=True)[1]
                fits = component[: len(left), None] != component[None, len(left) :]
                (x_least, x_most), (y_least, y_most) = (np.array([[r["least"], r["most"]] for r in side], np.int64).T for side in (left, right))
                fits &= (100 * x_most[:, None] >= PERCENT * y_least) & (100 * y_most >= PERCENT * x_least[:, None])
                at, to = np.nonzero(fits)
                found = np.zeros(len(at), np.int64)
                for n in range(BATCH, HASHES + 1, BATCH):
                    found += (x[at, n - BATCH : n] == y[to, n - BATCH : n]).sum(1)
                    keep = found >= least_matches(n)
                    at, to, found = at[keep], to[keep], found[keep]
                pairs = {(max(p, q), min(p, q)) for p, q, u, v in ((left[s]["id"], right[t]["id"], left[s]["bands"], right[t]["bands"]) for s, t in zip(at.tolist(), to.tolist())) if min(set(u) & set(v)) == band}
                if pairs:
                    a, b = zip(*sorted(pairs))
                    values = [[band], [main], [i], [j], [list(a)], [list(b)]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, types)], types.names)

    out = T.StructType([*(tiles.schema[c] for c in ("band", "main", "i", "j")), T.StructField("a", T.ArrayType(id_type)), T.StructField("b", T.ArrayType(id_type))])
    types = to_arrow_schema(out)
    return tiles.mapInArrow(run, out)


def _verified(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of _compared() whose full sets reach the threshold, as many as join the same components. A text is sent once for all its pairs in a tile."""
    key = ["band", "main", "i", "j"]
    wanted = found.select(*(F.col(c).alias(f"of_{c}") for c in key), F.explode(F.array_union("a", "b")).alias("id"))
    ids = wanted.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    sent = wanted.join(texts.join(ids, "id", "left_semi"), "id")

    def run(tile: pa.Table, rows: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for name, text in zip(rows.column("id").to_pylist(), rows.column("text")):
            if len(s := _set_of(text)):
                sets.setdefault(name, []).append(s)
        links, joined = [], {}

        def top(i):
            while joined.get(i, i) != i:
                i = joined[i]
            return i

        for a, b in zip(tile.column("a")[0].as_py(), tile.column("b")[0].as_py()):
            if (p := top(a)) == (q := top(b)):
                continue  # links of this tile join them already
            common = ((len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x in sets.get(a, ()) for y in sets.get(b, ()))
            if any(100 * n >= PERCENT * (both - n) for n, both in common):
                links.append((a, b))
                joined[max(p, q)] = min(p, q)
        return pa.table([pa.array([p[k] for p in links], t.type) for k, t in enumerate(types)], schema=types)

    out = T.StructType([T.StructField(c, found.schema[c].dataType.elementType) for c in ("a", "b")])
    types = to_arrow_schema(out)
    return found.groupBy(*key).cogroup(sent.groupBy(*(f"of_{c}" for c in key))).applyInArrow(run, out)


def near_duplicates(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``columns``, n_shingles and component_id (smallest doc_id that links reach) of every document.

    Links join documents whose sets of five-word shingles have at least three quarters of their union in common. A row without doc_id
    belongs to the class of its set, if another row has one; rows that share a doc_id are one node with several texts.
    """
    signed = stored(_sign(docs, columns))
    classes = stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id")))
    members = signed.select("doc_id", "set_key", "minima").join(classes, ["set_key"]).where("doc_id = id")
    members = stored(members.groupBy("id", "set_key").agg(F.min("minima").alias("minima")))
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null")
    rows = HASHES // BANDS * 4
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("minima", k * rows + 1, F.lit(rows))))
    banded = members.select("id", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    banded = stored(banded.join(shared, "band"))
    degrees = banded.groupBy("id").agg(F.sum("n").alias("degree"))
    known = stored(banded.join(degrees, "id").select("band", "id", "degree", F.col("id").alias("of"), F.lit(False).alias("met"), F.lit(None).cast(members.schema["id"].dataType).alias("first")))
    discard(banded)
    links, found, n_links = None, None, 0
    for _ in range(PIVOTS):
        pivots = known.where("not met").groupBy("band").agg(F.max_by(F.struct("id", "of", "degree"), F.struct("degree", "id")).alias("p")).select("band", F.col("p.id").alias("pivot"), F.col("p.of").alias("pivot_of"), F.col("p.degree").alias("pivot_degree"))
        pivots = stored(pivots)
        # Of the pivots of its buckets a class meets the most central one: no more pairs than classes.
        meets = known.join(pivots, "band").where("of <> pivot_of").groupBy("id").agg(F.max_by("pivot", F.struct("pivot_degree", "pivot")).alias("pivot"))
        pairs = stored(_pairs(meets, "id", "pivot"))
        if not (n_pairs := pairs.count()):
            discard(pivots, pairs)
            break
        likely = stored(_prune(pairs, members))
        new = _verify(likely, texts)
        both = stored(new if links is None else links.union(new))
        discard(pairs, likely, *([links] if links else []))
        links, found = both, components(both)
        told = stored(_met(known, pivots, found))
        discard(known, pivots)
        known, before, n_links = told, n_links, links.count()
        if n_links - before < n_pairs / FRUITFUL:
            break  # what is left are mostly single classes, which the last round compares with less effort
    if found is not None:
        # Only who is not in the component of the bucket's first pivot meets the rest of the bucket.
        name = found.select(F.col("id").alias("first"), F.col("component").alias("first_in"))
        known = stored(known.join(name, "first", "left").select("band", "id", "of", F.coalesce("first_in", "first").alias("first_of")))
        sizes = signed.where("n_shingles > 0").groupBy(F.col("doc_id").alias("id")).agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
        possible = stored(_compared(_tiles(known, sizes, members), members.schema["id"].dataType))
        if possible.limit(1).count():
            more = stored(_verified(possible, texts))
            if more.limit(1).count():
                found = components(stored(links.union(more)))
    else:
        found = members.select("id", F.col("id").alias("component")).limit(0)
    named = classes.join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    return signed.select("doc_id", *columns, "n_shingles", "set_key").join(named, "set_key", "left").select("doc_id", *columns, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))
