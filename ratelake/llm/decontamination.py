"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, run once over each text.

Words are runs of digits, letters a-z after lower-casing A-Z, and all characters beyond ASCII. A window is ``width``
consecutive words of an item; an item with fewer words, but not none, is one window. Windows are matched on words
joined by single spaces, and each match is mapped to words and characters of the original text.

Null texts have no words; a null item id marks words but names no item. Equal items count as one each, repeated
documents row by row. Other columns are ignored. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-cases A-Z and turns what separates words into spaces; a byte stays a byte.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def windows(items: list[tuple[object, str | None]], width: int) -> dict[str, set]:
    """Each window, as it stands between spaces, with the ids of the items that have it."""
    found: dict[str, set] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(f" {b' '.join(words[i : i + width]).decode('latin-1')} ", set()).add(item)
    return found


class Scanner:
    """The automaton over one block of items."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.automaton = ahocorasick.Automaton()
        for window, ids in windows(items, width).items():
            self.automaton.add_word(window, (len(window), sorted({str(x) for x in ids if x is not None})))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Number of words; maximal runs of hit words as (first word, last word, first character, character after); item ids."""
        raw = (text or "").encode()
        words = raw.translate(_FOLD).split()
        if not words or self.empty:
            return len(words), [], []
        line = f" {b' '.join(words).decode('latin-1')} "
        matches = list(self.automaton.iter(line))
        if not matches:
            return len(words), [], []
        # Word k stands between the k-th and the next space of the line.
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        ends = np.array([e for e, _ in matches])
        first, last = np.searchsorted(spaces, ends - [n - 1 for _, (n, _) in matches]), np.searchsorted(spaces, ends) - 1
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, first, 1)
        np.add.at(depth, last + 1, -1)
        hit = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth)[:-1] > 0).astype(np.int8), [0]])))
        is_word = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]])))
        begins, stops = edges[::2], edges[1::2]
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        runs = [(int(a), int(b) - 1, int(chars[begins[a]]), int(chars[stops[b - 1]])) for a, b in zip(hit[::2], hit[1::2])]
        return len(words), runs, sorted({x for _, (_, ids) in matches for x in ids})


_scanners: dict[str, Scanner] = {}


def _scan_block(docs: DataFrame, items: list[tuple[object, str | None]], width: int, keyed: bool = False) -> DataFrame:
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(sent.value, width)
        for batch in batches:
            found = [_scanners[key].scan(x) for x in batch.column(1).to_pylist()]
            spans = [[dict(zip(("first", "last", "begin", "end"), r)) for r in x[1]] for x in found]
            keys = pa.array([hashlib.sha256((x or "").encode()).digest() for x in batch.column(1).to_pylist()] if keyed else [None] * len(found), pa.binary())
            arrays = [batch.column(0), keys, pa.array([x[0] for x in found], pa.int64()), pa.array(spans, span_type), pa.array([x[2] for x in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_words", "spans", "items"])

    span_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "begin", "end")]))
    out = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    return docs.select("doc_id", "text").mapInArrow(run, out)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, spans (hit runs with word and character offsets) and items (ids as strings) of every text.

    The size of the benchmark is measured first. Up to ``block_bytes`` of text it is one automaton, sent to the tasks;
    beyond that its items are dealt to blocks of about that size (an automaton takes some 480 times its text in each worker), each one automaton and one scan of the documents, and a
    document's runs are united over the blocks. A single item must fit in a block's memory.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    at = F.pmod(F.xxhash64("text"), F.lit(blocks))
    part = lambda k: [tuple(r) for r in (benchmark if blocks == 1 else benchmark.where(at == k)).select("item_id", "text").toLocalIterator()]
    if blocks == 1:
        return _scan_block(docs, part(0), width).drop("text_key")
    scans = [_scan_block(docs, part(k), width, keyed=True).withColumn("block", F.lit(k)) for k in range(blocks)]
    union = scans[0]
    for x in scans[1:]:
        union = union.unionByName(x)
    merged = union.groupBy("doc_id", "text_key", "n_words").agg(F.flatten(F.collect_list("spans")).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.sum(F.when(F.col("block") == 0, 1)).alias("copies"))
    run = "struct(least({a}.first, {b}.first) as first, greatest({a}.last, {b}.last) as last, least({a}.begin, {b}.begin) as begin, greatest({a}.end, {b}.end) as end)"
    tail = "element_at(acc, -1)"
    spans = F.expr(f"aggregate(array_sort(all), cast(array() as {_SPANS.simpleString()}), (acc, x) -> if(size(acc) > 0 and x.first <= {tail}.last + 1, concat(slice(acc, 1, size(acc) - 1), array({run.format(a=tail, b='x')})), concat(acc, array(x))))")
    return merged.select("doc_id", "n_words", spans.alias("spans"), "items", F.explode(F.expr("sequence(1, copies)")).alias("copy")).drop("copy")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Counts and a digest of what find_contamination gives."""
    found = find_contamination(docs, benchmark, width)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
