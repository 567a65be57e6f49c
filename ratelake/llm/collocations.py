"""Phrases of two and three words, counted exactly behind merged count-min sketches, scored by their worst cut and subsumed.

A pass for each length fills count-min sketches: every task sends the cells that its phrases touch, with their counts, and
the sums over all tasks are kept as one bit a cell, whether it reaches the least count. A sketch only overestimates, so a
phrase whose cells lack a bit is rare for certain; a longer phrase is looked at only where both phrases of one word less
stand. The last pass counts what the sketches let through, phrase by phrase, so no result depends on them. Their size
follows the corpus up to ``MOST_CELLS`` a row (a bitmap of 32 MB, which bounds the broadcast); a corpus beyond that has
more phrases to count exactly, with the same result.

A null or empty text has no words, a null language counts as ``und``. Repeated rows count as often as they stand;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.llm.arrow_text import cut_words, sections
from ratelake.llm.shared_store import discard, stored

#: Least and most cells in a row of a sketch, as powers of two; blocks of a row, by which sketches are merged.
LEAST_CELLS, MOST_CELLS, BLOCKS = 16, 28, 256
#: Words of the corpus for each cell of the sketch of 1, 2 and 3 words.
WORDS_A_CELL = (64, 8, 16)
#: Two rows: odd multipliers of the phrase's hash.
ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Parts of a language that are ranked apart before the best of all parts are.
PARTS = 256

BLANK, CUT = 1, 2


def kinds_of_bytes() -> np.ndarray:
    """0 for bytes of words, BLANK between words, CUT between pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b" \t")] = BLANK
    kinds[list(b".,;:!?\n\x0b\x0c\r")] = CUT
    return kinds


class Grams(NamedTuple):
    """The different phrases of one length in a section: hash, count, a place (number of its first word) and language."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    langs: np.ndarray


class Sketch(NamedTuple):
    """A bit for each cell that reaches the least count, one array of bytes a row."""

    power: int
    rows: list[np.ndarray]

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for k, row in enumerate(self.rows):
            at = cells(hashes, k, self.power)
            out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) > 0
        return out


def cells(hashes: np.ndarray, row: int, power: int) -> np.ndarray:
    return (hashes * ROWS[row] >> np.uint64(64 - power)).astype(np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return x ^ (x >> np.uint64(32))


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


class Section:
    """Words of a section of texts, and its phrases by length; phrases are told apart by their words, never by hashes."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, lower: np.ndarray):
        self.word, self.words, at, text = cut_words(lower[data], offsets, kinds)
        coded = part.column(part.schema.get_field_index("lang")).cast(pa.large_string()).dictionary_encode()
        self.names, self.lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)[text]
        # Words i and i + 1 stand in one piece.
        piece = np.searchsorted(np.flatnonzero(kinds[data] == CUT), at)
        self.joined = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])

    def grams(self, length: int, sketches: list[Sketch]) -> Iterator[Grams]:
        """Phrases of 1 to ``length`` words, those that the sketches of their length call rare left out."""
        several = len(self.words)
        word_hash, lang_hash = _hashes(self.words), _hashes(self.names)
        places, keys = np.arange(len(self.word)), self.lang * several + self.word
        before = lang_hash
        for k in range(1, length + 1):
            keys, first, number, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            hashes = _spread(before[keys // several] ^ _spread(word_hash[keys % several])) if len(keys) else np.zeros(0, np.uint64)
            keep = sketches[k - 1].frequent(hashes) if k <= len(sketches) else np.ones(len(keys), bool)
            at = places[first]
            yield Grams(hashes[keep], counts[keep], at[keep], self.lang[at[keep]])
            # A phrase grows by a word where the phrase one word on stands as well.
            kept = keep[number]
            places, number = places[kept], number[kept]
            stands = np.zeros(len(self.word) + 1, bool)
            stands[places] = True
            grows = stands[places + 1] if k > 1 else stands[places + 1] & np.append(self.joined, False)[places]
            places, number = places[grows], number[grows]
            keys, before = number * several + self.word[places + k], hashes

    def phrases(self, found: Grams, length: int) -> list[bytes]:
        words = self.words.to_pylist()
        return [b" ".join([words[i] for i in row]) for row in self.word[found.places[:, None] + np.arange(length)].tolist()]


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[Section]:
    kinds = kinds_of_bytes()
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    for part, data, offsets, _ in sections(batches, kinds == CUT):
        yield Section(part, data, offsets, kinds, lower)


def merged_sketch(texts: DataFrame, power: int, sketches: list[Sketch], least: int) -> Sketch:
    """The sketch of phrases with one word more than the last of ``sketches``; ``texts`` has text and lang."""
    spark = texts.sparkSession
    length = len(sketches) + 1
    known = spark.sparkContext.broadcast(sketches)
    shift = power - (BLOCKS.bit_length() - 1)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for section in _sections(batches):
            *_, found = section.grams(length, known.value)
            for row in range(len(ROWS)):
                at, number = np.unique(cells(found.hashes, row, power), return_inverse=True)
                counts = np.minimum(np.bincount(number, found.counts, len(at)), 255).astype(np.uint8)
                blocks, begin = np.unique(at >> shift, return_index=True)
                inside = (at & ((1 << shift) - 1)).astype(np.uint32)
                ends = [*begin[1:].tolist(), len(at)]
                spans = list(zip(begin.tolist(), ends))
                columns = [
                    pa.array(np.full(len(blocks), row, np.int32)),
                    pa.array(blocks.astype(np.int32)),
                    pa.array([inside[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "block", "cells", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, at, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums = held.setdefault((row, block), np.zeros(1 << shift, np.uint8))
                at = np.frombuffer(at, np.uint32)
                sums[at] = np.minimum(sums[at].astype(np.uint16) + np.frombuffer(counts, np.uint8), 255)
        columns = [pa.array([k[i] for k in held], pa.int32()) for i in (0, 1)] + [pa.array([np.packbits(v >= least).tobytes() for v in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "block", "bits"])

    parts = texts.mapInArrow(touched, "row int, block int, cells binary, counts binary")
    bits = stored(parts.repartition("row", "block").mapInArrow(summed, "row int, block int, bits binary"))
    rows = [np.zeros(1 << power >> 3, np.uint8) for _ in ROWS]
    wide = 1 << shift >> 3
    for row, block, found in bits.toLocalIterator():
        rows[row][block * wide : (block + 1) * wide] = np.frombuffer(found, np.uint8)
    discard(bits)
    return Sketch(power, rows)


def phrase_counts(docs: DataFrame, length: int = 3, least: int = 10, most_cells: int = MOST_CELLS) -> DataFrame:
    """lang, phrase, k (its words) and f of every phrase of up to ``length`` words that occurs ``least`` times in its language; k = 0: all its words."""
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    sketches: list[Sketch] = []
    for k in range(length):
        wanted = (words // WORDS_A_CELL[min(k, len(WORDS_A_CELL) - 1)]).bit_length()
        sketches.append(merged_sketch(texts, min(max(wanted, LEAST_CELLS), most_cells), sketches, least))
    known = texts.sparkSession.sparkContext.broadcast(sketches)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "k", "f"]
        for section in _sections(batches):
            totals = np.bincount(section.lang, minlength=len(section.names))
            yield pa.RecordBatch.from_arrays([section.names.cast(pa.string()), pa.array([""] * len(totals)), pa.array(np.zeros(len(totals), np.int32)), pa.array(totals.astype(np.int64))], names)
            for k, found in enumerate(section.grams(length, known.value), 1):
                phrases = pa.array(section.phrases(found, k), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([section.names.take(pa.array(found.langs)).cast(pa.string()), phrases, pa.array(np.full(len(phrases), k, np.int32)), pa.array(found.counts.astype(np.int64))], names)

    found = texts.mapInArrow(counted, "lang string, phrase string, k int, f long")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best phrases of two and three words in each language.

    A phrase inside a longer candidate that makes up ``covered`` in 100 of its occurrences is dropped.
    """
    counts = stored(phrase_counts(docs, 3, least))
    known = counts.where("k > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    x = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    cut = lambda at: F.struct(F.lit(at).alias("at"), F.array_join(F.slice("w", 1, at), " ").alias("first"), F.array_join(F.expr(f"slice(w, {at + 1}, k - {at})"), " ").alias("rest"))
    cuts = x.select("lang", "phrase", "a", F.inline(F.when(F.col("k") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # a is at most l and r, so a score fits a long; the products have up to 38 digits.
    whole = F.expr("cast(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", whole).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "at", "l", "r")).alias("worst"))
    inner = counts.where("k = 3").select("lang", "f", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    covers = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    scored = scored.join(covers, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    scored = scored.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    ahead = scored.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(counts.where("k = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
