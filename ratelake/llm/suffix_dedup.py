"""Removal of repeated passages by bucket-pointer refinement.

A string of ``LENGTH`` bytes is repeated if it also starts earlier. Positions are held in buckets of equal beginnings; a
bucket's identifier points to its first position, and a bucket with one member is closed.

1. A pre-filter finds the positions that are worth a bucket. Grams of ``GRAM`` bytes are sampled: those with a small hash
   wherever they stand, and in strings that hold none, the gram with the least hash. Each string of LENGTH bytes has a
   sampled gram that its own bytes determine, its anchor. Grams that occur once close every string that holds them.
2. Neighbouring strings with one anchor that stay open form a unit. Units of equal bytes are one: all but the first are
   repeated as a whole, whatever their number, and the first stands for all. Where an anchor has several kinds of units,
   the positions of the firsts are refined.
3. The refinement holds the positions on a grid of ``GRID`` bytes around each first's anchor and begins with buckets of
   GRAM bytes. In a round with step q the positions of a bucket of p bytes are sorted apart by the identifiers of the
   buckets that the positions q bytes later are in, which gives the buckets of p + q bytes: of 64, then of 88 and 96. Each
   round reuses the identifiers that the one before has given, and closed positions are left out.
4. Each string of LENGTH bytes holds a block of 88 or 96 bytes that begins on the grid. The strings of the blocks that
   stay open are sorted apart by the bytes of theirs before and after the block. What stays in a bucket of LENGTH bytes
   behind its first position is repeated.

Units and first grams are told apart by two hashes of 64 bits with independent byte tables, all longer strings by
identifiers. Positions are ordered by doc_id, then by offset. Long texts are read in overlapping windows.

Null texts are empty. Rows without doc_id lose nothing and count as nowhere earlier. Rows that share a doc_id count as one
document with several texts, from each of which the bytes at their common repeated places go. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.llm.arrow_text import slices, windows
from ratelake.llm.shared_store import discard, stored

LENGTH, GRAM = 100, 32
#: Distance of the positions that are refined, and the lengths of the blocks that strings hold: a string that begins up to
#: 4 bytes before a block of 96 ends behind it, and so does one that begins 5 to 7 bytes before a block of 88.
GRID, BLOCKS = 8, ((96, 0, 4), (88, 5, 7))
#: One gram in so many is sampled wherever it stands.
EVERY = 32
#: A set of keys up to this many is sent to every task (8 bytes each); a larger one is joined by shuffle.
SENT_KEYS = 6_000_000

_rng = np.random.default_rng(977)
_BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_STEP = _rng.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_BASE = _rng.integers(1, 1 << 60, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BELOW = np.uint64((1 << 64) // EVERY)
_TOP = np.uint64(0xFFFFFFFF00000000)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64 to the powers below n."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, _BACK))


class Strings:
    """Hashes of the strings of a slice of texts: differences of prefix sums of random byte values times powers of _BASE, taken back to power 0 and mixed."""

    def __init__(self, data: np.ndarray, table: int = 0):
        n = len(data)
        self.up, self.down = _powers(1 << max(20, n.bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.take(_BYTES[table], data) * self.up[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self._mixed((self.sums[begin + size] - self.sums[begin]) * self.down[begin])

    def grams(self) -> np.ndarray:
        """Of the GRAM bytes from each position; only those that lie in one text mean anything."""
        out = np.zeros(len(self.sums) - 1, np.uint64)
        x = out[: max(0, len(out) - GRAM + 1)]
        np.subtract(self.sums[GRAM:], self.sums[: len(x)], out=x)
        x *= self.down[: len(x)]
        x[:] = self._mixed(x)
        return out

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= _STEP[0]
        x ^= x >> np.uint64(29)
        return x


class Sampled:
    """Sampled positions of a slice of texts, and the anchor of each string of LENGTH bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.strings = Strings(data)
        self.gram = self.strings.grams()
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
        self.holds = left >= LENGTH
        ranked = np.where(left >= GRAM, self.gram & _TOP | np.arange(n).astype(np.uint64), _NONE)
        self.sampled = (left >= GRAM) & (self.gram < _BELOW)
        width, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= width:
            ranked[: n - reach] = np.minimum(ranked[: n - reach], ranked[reach:])
            reach *= 2
        rest = width - reach
        if rest and n > rest:
            ranked[: n - rest] = np.minimum(ranked[: n - rest], ranked[rest:])
        self.anchor = (ranked & ~_TOP).astype(np.int64)
        self.anchor[~self.holds] = -1
        needed = self.sampled.copy()
        needed[self.anchor[self.holds]] = True
        self.positions = np.flatnonzero(needed)

    def units(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First positions of the units and their numbers of strings; kept: flags of the positions whose gram is repeated."""
        n = len(self.gram)
        closed = np.concatenate([[0], np.cumsum(self.sampled & ~kept)])
        to = np.minimum(np.arange(n) + LENGTH - GRAM + 1, n)
        open_ = self.holds & kept[self.anchor] & (closed[to] == closed[:-1])
        begins = open_.copy()
        begins[1:] &= ~(open_[:-1] & (self.anchor[1:] == self.anchor[:-1]))
        first = np.flatnonzero(begins)
        at = np.flatnonzero(open_)
        sizes = np.diff(np.append(np.searchsorted(at, first), len(at)))
        return first, sizes


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets, _ in windows(batches, LENGTH - 1):
            x = Sampled(data, offsets)
            grams, n = np.unique(x.gram[x.positions], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(grams), pa.array(n)], ["gram", "n"])

    return docs.select("text").mapInArrow(run, T.StructType([_long("gram"), _long("n")])).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def _sampled(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, base in windows(batches, LENGTH - 1):
            x = Sampled(data, offsets)
            row = np.searchsorted(offsets, x.positions, "right") - 1
            yield pa.RecordBatch.from_arrays([_signed(x.gram[x.positions]), part.column(0).take(pa.array(row)), pa.array(x.positions - offsets[row] + base)], ["gram", "doc_id", "at"])

    return docs.mapInArrow(run, T.StructType([_long("gram"), docs.schema["doc_id"], _long("at")]))


def _units(texts: DataFrame, grams: np.ndarray | None) -> DataFrame:
    """Units of ``texts`` (doc_id, text), whose repeated grams are ``grams``, sorted, or at the offsets in a column ``ats``."""
    sent = None if grams is None else texts.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, base in windows(batches, LENGTH - 1):
            x, kept = Sampled(data, offsets), np.zeros(len(data), bool)
            if sent is not None:
                kept[x.positions] = _among(x.gram[x.positions], sent.value)
            else:
                ats = part.column(2)
                places = np.repeat(offsets[:-1], ats.value_lengths().to_numpy()) + ats.flatten().to_numpy() - base
                kept[places[(places >= 0) & (places < len(data))]] = True
            first, sizes = x.units(kept)
            if not len(first):
                continue
            row = np.searchsorted(offsets, first, "right") - 1
            keys = [_signed(s.of(first, sizes + LENGTH - 1)) for s in (x.strings, Strings(data, 1))]
            yield pa.RecordBatch.from_arrays([*keys, _signed(x.gram[x.anchor[first]]), part.column(0).take(pa.array(row)), pa.array(first - offsets[row] + base), pa.array(sizes.astype(np.int32)), pa.array((x.anchor[first] - first).astype(np.int32))], names)

    names = ["key", "more", "gram", "doc_id", "at", "n", "lead"]
    out = T.StructType([_long("key"), _long("more"), _long("gram"), texts.schema["doc_id"], _long("at"), T.StructField("n", T.IntegerType()), T.StructField("lead", T.IntegerType())])
    return texts.mapInArrow(run, out)


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def _sent(keys: DataFrame, name: str) -> np.ndarray | None:
    """The keys as a sorted array, if they are few enough to send."""
    if keys.count() > SENT_KEYS:
        return None
    return np.sort(keys.select(name).toArrow().column(0).to_numpy().view(np.uint64))


def _packed(data: np.ndarray, at: np.ndarray, size: int, step: int) -> np.ndarray:
    """``size`` bytes from ``at`` on, or backwards, as one number with the first in its lowest byte; 0 beyond the ends."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = at + k * step
        inside = (there >= 0) & (there < len(data))
        out |= np.where(inside, data[np.where(inside, there, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


def _grid(texts: DataFrame) -> DataFrame:
    """Positions on the units' grids (k steps from the anchor) and the hashes of their GRAM bytes; where a string's block may begin, the bytes around it too.

    ``texts`` has doc_id, text, version and units (at, n, lead); ``version`` tells texts of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, base in windows(batches, LENGTH - 1):
            lists = part.column(3)
            units = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            begins, sizes, leads = units.field(0).to_numpy() + offsets[row] - base, units.field(1).to_numpy(), units.field(2).to_numpy()
            # Not those of another window, or of a text that shares its id with another.
            ok = (begins >= offsets[row]) & (begins + sizes + LENGTH - 1 <= offsets[row + 1])
            row, begins, sizes, leads = row[ok], begins[ok], sizes[ok], leads[ok]
            if not len(row):
                continue
            least = leads - sizes + 1  # how far before the anchor the last string begins, and the first: leads
            back, on = leads // GRID, (LENGTH - GRAM - least) // GRID
            n = back + on + 1
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) - np.repeat(back, n)
            at, inside = np.repeat(begins + leads, n) + GRID * k, np.repeat(row, n)
            unit = Strings._mixed(part.column(2).to_numpy()[row].view(np.uint64) + (begins - offsets[row] + base).astype(np.uint64) * _STEP[1])
            around = [_signed(np.where(k <= 0, x, 0)) for x in (_packed(data, at - 1, 7, -1), *(_packed(data, at + size, LENGTH - size - low, 1) for size, low, _ in BLOCKS))]
            keys = [_signed(Strings(data, t).of(at, GRAM)) for t in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, part.column(0).take(pa.array(inside)), pa.array(at - offsets[inside] + base), _signed(np.repeat(unit, n)), pa.array(k.astype(np.int32)), pa.array(np.repeat(least, n).astype(np.int32)), pa.array(np.repeat(leads, n).astype(np.int32)), *around], names)

    names = ["key", "more", "doc_id", "at", "unit", "k", "least", "most", "before", *(f"after_{size}" for size, _, _ in BLOCKS)]
    ints = [T.StructField(c, T.IntegerType()) for c in ("k", "least", "most")]
    return texts.mapInArrow(run, T.StructType([_long("key"), _long("more"), texts.schema["doc_id"], _long("at"), _long("unit"), *ints, *map(_long, names[8:])]))


def _refined(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of the buckets by ``keys`` that have several, with the identifier of each one's bucket in place of the keys."""
    same = W.partitionBy(*keys)
    x = positions.withColumns({"_id": F.min("place").over(same), "_n": F.count("*").over(same)})
    return x.where("_n > 1").drop(*keys, "_n").withColumnRenamed("_id", "bucket")


def _later(place: Places, step: int) -> Column:
    """The bucket of the position ``step`` bytes later on the unit's grid, or null."""
    return F.first("bucket").over(W.partitionBy(place.parts("place")[0], "unit").orderBy("k").rangeBetween(step // GRID, step // GRID))


def _strings(blocks: DataFrame, place: Places) -> DataFrame:
    """Each string of LENGTH bytes of the open blocks: its place, the bucket of its block and its bytes before and after."""
    doc_id, at = place.parts("place")
    out = []
    for size, low, high in BLOCKS:
        d = GRID * -F.col("k")
        phase = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("phase")
        x = blocks.where((F.col("size") == size) & (F.col("k") <= 0)).select("*", phase).where((d + F.col("phase")).between(F.col("least"), F.col("most")))
        bits = lambda c, n: F.col(c).bitwiseAND(F.expr(f"shiftleft(1L, 8 * ({n})) - 1"))
        start = x.select(doc_id.alias("doc_id"), (at - F.col("phase")).alias("at"), "bucket", (bits("before", "phase") + F.expr("shiftleft(bigint(phase), 56)")).alias("x"), bits(f"after_{size}", f"{LENGTH - size} - phase").alias("y"))
        out.append(start.select(place.of().alias("place"), "bucket", "x", "y"))
    return out[0].union(out[1])


class Places:
    """How a position is kept and compared: as one number where ids and lengths allow, else as a pair."""

    def __init__(self, docs: DataFrame):
        most = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
        bits = int(most[2] or 0).bit_length() + 1
        fits = isinstance(most[0], int) and most[0] >= 0 and most[1] < 1 << (63 - bits)
        self.bits, self.kind = bits if fits else None, docs.schema["doc_id"].dataType

    def of(self, doc_id: str = "doc_id", at: str = "at") -> Column:
        return F.struct(doc_id, at) if self.bits is None else F.shiftleft(F.col(doc_id).cast("long"), self.bits) + F.col(at)

    def parts(self, place: str) -> tuple[Column, Column]:
        if self.bits is None:
            return F.col(f"{place}.doc_id"), F.col(f"{place}.at")
        return F.shiftright(place, self.bits).cast(self.kind), F.col(place).bitwiseAND(F.lit((1 << self.bits) - 1))


def _listed(places: DataFrame) -> DataFrame:
    """(doc_id, places) of (doc_id, at, bytes)."""
    return places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "bytes")).alias("places"))


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, places): documents with repeated bytes and their (offset, bytes) pieces; pieces may overlap, and a document may have several rows."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and octet_length(text) >= %d" % LENGTH)
    place = Places(docs)
    grams = stored(_counted(docs))
    sent = _sent(grams, "gram")
    if sent is not None:
        texts = docs
    else:
        texts = docs.join(_sampled(docs).join(grams, "gram", "left_semi").groupBy("doc_id").agg(F.collect_list("at").alias("ats")), "doc_id")
    units = stored(_units(texts, sent).select("key", "more", "gram", "n", "lead", place.of().alias("place")))
    discard(grams)
    firsts = stored(units.groupBy("key", "more").agg(F.min("place").alias("first"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.min("gram").alias("gram"), F.count("*").alias("copies")))
    doc_id, at = place.parts("place")
    told = units.join(firsts.where("copies > 1").select("key", "more", "first"), ["key", "more"]).where("place > first")
    whole = stored(_listed(told.select(doc_id.alias("doc_id"), at.alias("at"), (F.col("n") + LENGTH - 1).cast("long").alias("bytes"))))
    discard(units)

    split = firsts.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    doc_id, at = place.parts("first")
    single = firsts.join(split, "gram", "left_semi").select(doc_id.alias("doc_id"), at.alias("at"), "n", "lead")
    single = stored(single.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "lead")).alias("units")))
    discard(firsts)
    texts = docs.join(single, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("version"), "units")
    grid = _grid(texts)
    grams = stored(_refined(grid.select(place.of().alias("place"), *(c for c in grid.columns if c not in ("doc_id", "at"))), ["key", "more"]))
    discard(single)
    pairs = stored(_refined(grams.withColumn("later", _later(place, GRAM)).where("later is not null"), ["bucket", "later"]))
    discard(grams)
    ends = F.explode(F.array(*(F.struct(F.lit(size).alias("size"), F.col(f"_{size}").alias("later")) for size, _, _ in BLOCKS)))
    blocks = pairs.withColumns({f"_{size}": _later(place, size - 2 * GRAM) for size, _, _ in BLOCKS}).where("k <= 0").withColumn("_end", ends)
    blocks = blocks.withColumns({"size": F.col("_end.size"), "later": F.col("_end.later")}).where("later is not null").drop("_end", *(f"_{size}" for size, _, _ in BLOCKS))
    # Blocks of both sizes may have one pair of buckets, so the size is part of the key and kept beside it.
    blocks = stored(_refined(blocks.withColumn("_size", F.col("size")), ["bucket", "later", "_size"]))
    discard(pairs)
    positions = stored(_refined(_strings(blocks, place), ["bucket", "x", "y"]))
    discard(blocks)
    doc_id, at = place.parts("place")
    parts = positions.where("place > bucket").select(doc_id.alias("doc_id"), at.alias("at"), F.lit(LENGTH).cast("long").alias("bytes"))
    return whole.union(_listed(parts))


def _kept(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, at: np.ndarray, size: np.ndarray, characters: bool = False) -> tuple[pa.Array, pa.Array]:
    """What is left of the texts, and the maximal runs of bytes that are not; a piece is ``size`` bytes from ``at`` of text ``row``.

    ``characters``: a character that a run cuts apart goes with it.
    """
    begin = np.minimum(offsets[row] + at, offsets[row + 1])
    end = np.minimum(begin + size, offsets[row + 1])
    if characters:
        for _ in range(3):  # back to a first byte, and on to the next one
            inner = (begin > offsets[row]) & (begin < offsets[row + 1])
            begin = begin - (inner & ((data[np.where(inner, begin, 0)] & 0xC0) == 0x80) if len(data) else 0)
            inner = end < offsets[row + 1]
            end = end + (inner & ((data[np.where(inner, end, 0)] & 0xC0) == 0x80) if len(data) else 0)
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    row, begin, end = (x[begin < end] for x in (row, begin, end))
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], (begin[1:] > reach[:-1]) | (row[1:] != row[:-1])])[: len(row)]
    first = np.flatnonzero(new)
    row, begin, end = row[first], begin[first], reach[np.append(first[1:], len(reach))[: len(first)] - 1]
    gone = np.zeros(len(data) + 1, np.int8)
    gone[begin] += 1
    gone[end] -= 1
    left = data[np.cumsum(gone[:-1], dtype=np.int8) == 0]
    sizes = np.diff(offsets) - np.bincount(row, end - begin, len(offsets) - 1).astype(np.int64)
    kept = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(left)])
    spans = pa.StructArray.from_arrays([pa.array(begin - offsets[row]), pa.array(end - offsets[row])], ["begin", "end"])
    return kept, pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)), spans)


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), characters: bool = False) -> DataFrame:
    """``columns`` of every document, its n_bytes, the kept bytes and the spans (offset, end) removed.

    ``characters``: spans are widened to the borders of characters, so that the kept bytes are UTF-8.
    """
    places = stored(repeated_places(docs).groupBy(F.col("doc_id").alias("_of")).agg(F.flatten(F.collect_list("places")).alias("places")))
    x = docs.select(*columns, F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(places, F.col("_id") == F.col("_of"), "left").select(*columns, "_text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "_text"):
            lists = part.column(len(columns) + 1)
            pieces = lists.flatten()
            row = np.repeat(np.arange(part.num_rows), pc.fill_null(lists.value_lengths(), 0).to_numpy())
            kept, spans = _kept(data, offsets, row, pieces.field(0).to_numpy(), pieces.field(1).to_numpy(), characters)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(np.diff(offsets)), kept, spans], [*columns, "n_bytes", "kept", "spans"])

    span = T.ArrayType(T.StructType([_long("begin"), _long("end")]))
    out = T.StructType([*(docs.schema[c] for c in columns), _long("n_bytes"), T.StructField("kept", T.BinaryType()), T.StructField("spans", span)])
    return x.mapInArrow(run, out)


def repeat_digest(docs: DataFrame) -> DataFrame:
    """Sizes and a digest of what remove_repeats leaves."""
    return remove_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
