"""Fill-in-the-middle: texts cut in three and put in another order around sentinels, and the way back.

A table-driven automaton over bytes recognises UTF-8 continuation, the begin of each unit (a code point) and whole
sentinels in one scan. Its state depends on the last three bytes only, so chunks are scanned side by side, each
warmed up on the three bytes before it. Transitions emit what begins or ends there, counted per chunk; a second pass
finds the cuts by searching the running counts and scanning one chunk again.

A null text is empty, an empty text or one with a sentinel in it stays plain. A null id hashes as no digits.
Repeated rows are cut row by row, alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.llm.arrow_text import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# States: between units, in a sentinel after one and two bytes, 1 to 3 continuation bytes to come.
BETWEEN, OPENED, NAMED, MORE = 0, 1, 2, 2
UNIT, SENTINEL = 1, 2
#: A byte that no UTF-8 text has; it stands before each text and sets the state back.
BREAK = 0xFF
CHUNK, MEMORY = 512, 3


def byte_automaton() -> tuple[np.ndarray, np.ndarray]:
    """Tables (next state, emission) indexed by state * 256 + byte; emission adds UNIT where a unit begins and SENTINEL where one ends.

    A continuation byte out of place is a unit of its own.
    """
    goes, emits = np.zeros((6, 256), np.uint8), np.full((6, 256), UNIT, np.uint8)
    for lead, end, pending in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        goes[:, lead:end] = MORE + pending
    for pending in (1, 2, 3):
        goes[MORE + pending, 0x80:0xC0] = MORE + pending - 1 if pending > 1 else BETWEEN
        emits[MORE + pending, 0x80:0xC0] = 0
    goes[:, PREFIX[0]] = OPENED
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        goes[OPENED, sentinel[1]] = NAMED
    emits[NAMED, PREFIX[2]] |= SENTINEL
    emits[:, BREAK] = 0
    return goes.reshape(-1), emits.reshape(-1)


class Scan:
    """One scan over the bytes of several texts: what each byte emits, and how many units lie before each chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]):
        goes, emits = tables
        n = len(offsets) - 1
        self.begins, self.ends = offsets[:-1] + np.arange(1, n + 1), offsets[1:] + np.arange(1, n + 1)
        size = len(data) + n
        rows = -(-size // CHUNK) or 1
        padded = np.full(MEMORY + rows * CHUNK, BREAK, np.uint8)
        of_text = np.ones(size, bool)
        of_text[self.begins - 1] = False
        padded[MEMORY : MEMORY + size][of_text] = data
        # Row r of the view is chunk r with the bytes that lead up to it.
        view = np.lib.stride_tricks.as_strided(padded, (rows, MEMORY + CHUNK), (CHUNK, 1))
        columns = np.ascontiguousarray(view.T)
        state, out = np.zeros(rows, np.intp), np.empty((CHUNK, rows), np.uint8)
        for j, column in enumerate(columns):
            at = state * 256 + column
            if j >= MEMORY:
                out[j - MEMORY] = emits[at]
            state = goes[at].astype(np.intp)
        self.emitted = np.ascontiguousarray(out.T)
        self.units = np.zeros(rows + 1, np.int64)
        np.cumsum((self.emitted & UNIT).sum(1, dtype=np.int64), out=self.units[1:])

    def before(self, place: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        chunk, inside = np.minimum(place // CHUNK, len(self.emitted) - 1), place
        inside = place - chunk * CHUNK
        marks = (self.emitted[chunk] & UNIT) * (np.arange(CHUNK) < inside[:, None])
        return self.units[chunk] + marks.sum(1, dtype=np.int64)

    def place(self, unit: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each unit begins, counted over all texts; ``end`` for those past the last of their text."""
        chunk = np.minimum(np.searchsorted(self.units, unit, "right") - 1, len(self.emitted) - 1)
        reached = np.cumsum(self.emitted[chunk] & UNIT, axis=1, dtype=np.int64) > (unit - self.units[chunk])[:, None]
        return np.minimum(chunk * CHUNK + np.where(reached.any(1), reached.argmax(1), CHUNK), end)

    def has_sentinel(self) -> np.ndarray:
        at = np.flatnonzero(self.emitted.reshape(-1) & SENTINEL)
        return np.searchsorted(at, self.ends) > np.searchsorted(at, self.begins)


def draws(seed: str, id_column: str) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the seed's and id's SHA-256, as numbers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: str = "1:", moved: int = 90, suffix_first: int = 20) -> DataFrame:
    """id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and output of every text.

    The id's hash draws the two cuts, whether the text is moved (``moved`` in 100) and whether its suffix comes first (``suffix_first`` in 100).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = byte_automaton()
        for part, data, offsets in slices(batches, text):
            scan = Scan(data, offsets, tables)
            base = scan.before(scan.begins)
            n = scan.before(scan.ends) - base
            h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
            low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            cuts = [scan.place(base + k, scan.ends) - np.arange(1, len(n) + 1) for k in (low, high)]
            plain = (n == 0) | scan.has_sentinel() | (h3 % 100 >= moved)
            form = np.where(plain, 0, np.where(h4 % 100 < suffix_first, 2, 1))
            raw, out = data.tobytes(), []
            for kind, a, b, c, d in zip(form.tolist(), offsets[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), offsets[1:].tolist()):
                if kind == 0:
                    out.append(raw[a:d])
                elif kind == 1:
                    out.append(b"".join((PREFIX, raw[a:b], SUFFIX, raw[c:d], MIDDLE, raw[b:c])))
                else:
                    out.append(b"".join((SUFFIX, raw[c:d], PREFIX, raw[a:b], MIDDLE, raw[b:c])))
            columns = [
                part.column(0),
                pa.array(n),
                pa.DictionaryArray.from_arrays(pa.array(form), ["plain", "psm", "spm"]).cast(pa.string()),
                pa.array(low, mask=plain),
                pa.array(high - low, mask=plain),
                pa.array(out, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    h1, h2, h3, h4 = draws(seed, id_column)
    read = docs.select(F.col(id_column).alias("id"), F.col(text).alias(text), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    longs = [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
    out = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), *longs, T.StructField("output", T.BinaryType())])
    return read.mapInArrow(run, out).withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_column)


def restored_text(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() read: a moved text has no sentinels of its own, so its output splits at them in one way."""
    parts = F.split(output, "<[PSM]>", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = {k: F.concat(*(F.get(parts, F.lit(i)) for i in at)) for k, at in order.items()}
    return F.when(form == "psm", whole["psm"]).when(form == "spm", whole["spm"]).otherwise(output)


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """Counts and checksums of every text's output and of the text put together again from it."""
    x = fill_in_middle(docs)
    hashed = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored_text(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
