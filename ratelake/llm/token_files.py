"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes apart from the data bytes.

Ids are replaced by their rank in the order of frequency, so that the common ones take one byte. Each rank takes one to
four bytes; two bits of a control byte tell its length, four ranks to a control byte, and all control bytes of a block
stand before its data bytes. A reader looks the four lengths up in a table by control byte and gathers the bytes in numpy.

Documents are ordered by ranges of doc_id, one shard a range; a shard's folder holds files of a bounded number of blocks,
each of whole documents. Blocks carry shard and number, so the order does not hang on names of files. Spark writes and
commits the files, so a lost executor leaves none of them half done.

A null or empty text has the end id alone; a null doc_id comes last; repeated ids are ordered by text. Ids of documents
are integers. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.llm.arrow_text import cut_words, sections
from ratelake.llm.shared_store import delete_on_exit, discard, shared_dir, stored

MAGIC = b"RKID"
#: Magic, shard, block, documents, ids, bytes of data.
HEADER = "<4sIIIQQ"
#: Ids in a block, unless one document has more; blocks in a file.
BLOCK_IDS, FILE_BLOCKS = 1 << 18, 16
#: A byte that Spark puts after every block.
BLOCK_END = 1
#: Words that a worker remembers the ids of, and their characters.
REMEMBERED, REMEMBERED_CHARS = 1 << 20, 1 << 25


def lengths_table() -> np.ndarray:
    """Lengths of the four values of each control byte."""
    return (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    more = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = more
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    ends = np.cumsum(more.astype(np.int64) + 1)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - more - 1
    for k in range(4):
        has = more >= k
        data[begins[has] + k] = values[has] >> np.uint32(8 * k) & np.uint32(255)
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The n values of pack()."""
    size = lengths[control].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    begins = ends - size
    out = data[begins].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        out[has] |= data[begins[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class WordTokenizer:
    """Ids of texts by the tokenizers library, each different word encoded once in a while.

    Words end at ASCII white space, and between an ASCII letter and a punctuation mark. This needs a tokenizer whose
    tokens never reach over these places, and whose normalizer looks at no neighbour beyond them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.library, self.letters):
            t.no_truncation()
            t.no_padding()
        # A word of ASCII letters in lower case is one piece that the normalizer leaves as it is.
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kinds, self.letter, self.mark = np.zeros(256, np.uint8), np.zeros(256, bool), np.zeros(256, bool)
        self.kinds[[0x20, *range(0x09, 0x0E)]] = 1
        self.letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
        self.mark[list(b".,;:!?")] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        simple = [w.isascii() and w.isalpha() for w in words]
        found = iter(self.letters.encode_batch_fast([w.lower() for w, x in zip(words, simple) if x], add_special_tokens=False))
        others = iter(self.library.encode_batch_fast([w for w, x in zip(words, simple) if not x], add_special_tokens=False))
        return [next(found if x else others).ids for x in simple]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)"""
        begin = self.mark[data]
        begin[1:] &= self.letter[data[:-1]]
        begin[:1] = False
        word, words, _, text = cut_words(data, offsets, self.kinds, begin)
        words = words.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        self.chars += sum(len(words[i]) for i in new.tolist())
        if len(self.known) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
            new = np.arange(len(words))
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            found = self._encode_words(fresh)
            size = np.fromiter(map(len, found), np.int64, len(found))
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(fresh, at[new].tolist()))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        begin, end = self.ends[at][word], self.ends[at + 1][word]
        size = end - begin
        ends = np.cumsum(size)
        out = self.ids[np.repeat(end - ends, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.bincount(text, size, len(offsets) - 1).astype(np.int64)


@lru_cache(maxsize=1)
def tokenizer_of_worker(path: str) -> WordTokenizer:
    """One for all tasks of a worker, so that its words stay known."""
    return WordTokenizer(path)


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """shard, block, doc_ids, sizes and ids (unsigned 32-bit, little-endian) in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_of_worker(tokenizer)
        shard, block = TaskContext.get().partitionId(), 0
        names, sizes, held, begun, total = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            row = [[shard], [block], [names], [sizes], [np.concatenate(held).tobytes()]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["shard", "block", "doc_ids", "sizes", "ids"])

        for part, data, offsets, ends in sections(batches, encoder.kinds > 0):
            ids, n = encoder.encode(data, offsets)
            if not ends:
                begun.append(ids)
                continue
            cuts = np.cumsum(n)[:-1]
            for name, x in zip(part.column(0).to_pylist(), np.split(ids, cuts)):
                x = np.concatenate([*begun, x, np.array([end_id], np.uint32)])
                begun = []
                if names and total + len(x) > block_ids:
                    yield close()
                    names, sizes, held, total, block = [], [], [], 0, block + 1
                total += len(x)
                names.append(name)
                sizes.append(len(x))
                held.append(x)
        if names:
            yield close()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return x.mapInArrow(run, "shard int, block int, doc_ids array<long>, sizes array<long>, ids binary")


def ids_by_frequency(blocks: DataFrame) -> DataFrame:
    """rank and id of every id that occurs, the most frequent first; as many rows as the vocabulary has ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n = np.bincount(np.frombuffer(ids.as_buffer(), np.uint32))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    n = blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return n.select((F.row_number().over(W.orderBy(F.desc("n"), "id")) - 1).cast("long").alias("rank"), "id")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Write ``path/ranks`` (rank, id) and ``path/blocks``, one folder a shard."""
    spark = docs.sparkSession
    blocks = stored(token_blocks(docs, tokenizer, end_id, block_ids))
    ids_by_frequency(blocks).coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(0, np.uint32)
    by_rank = _ids(spark, path)
    if len(by_rank):
        rank = np.zeros(int(by_rank.max()) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, names, sizes, ids = (c[i] for c in batch.columns)
                values = ranks.value[np.frombuffer(ids.as_buffer(), np.uint32)]
                control, data = pack(values)
                given = np.array([x is not None for x in names.as_py()], np.uint8)
                who = np.array([x or 0 for x in names.as_py()], np.int64)
                head = struct.pack(HEADER, MAGIC, shard.as_py(), block.as_py(), len(who), len(values), len(data))
                body = b"".join((head, who.tobytes(), given.tobytes(), np.array(sizes.as_py(), np.int64).tobytes(), control, data))
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int32()), pa.array([block.as_py()], pa.int32()), pa.array([body], pa.binary())], ["shard", "block", "body"])

    packed = blocks.mapInArrow(run, "shard int, block int, body binary").sortWithinPartitions("shard", "block")
    # The text writer puts the bytes of a value down as they are.
    packed.select("shard", F.col("body").cast("string").alias("value")).write.partitionBy("shard").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks")
    discard(blocks)


def _ids(spark: SparkSession, path: str) -> np.ndarray:
    """The id of each rank; no longer than the vocabulary."""
    return np.array([r["id"] for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()], np.int64)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, place (in its block), doc_id, n_tokens and ids (unsigned 32-bit, little-endian) of every document."""
    ids = spark.sparkContext.broadcast(_ids(spark, path).astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_table()
        for batch in batches:
            for content in batch.column(0):
                raw, at = np.frombuffer(content.as_buffer(), np.uint8), 0
                while at < len(raw):
                    magic, shard, block, docs, n, size = struct.unpack_from(HEADER, raw, at)
                    if magic != MAGIC:
                        raise ValueError(f"no block of token ids at byte {at}")
                    at += struct.calcsize(HEADER)
                    who, given = raw[at : at + 8 * docs].view("<i8"), raw[at + 8 * docs : at + 9 * docs]
                    sizes = raw[at + 9 * docs : at + 17 * docs].view("<i8")
                    at += 17 * docs
                    control = raw[at : at + -(-n // 4)]
                    at += len(control)
                    found = ids.value[unpack(control, raw[at : at + size], n, lengths)]
                    at += size + BLOCK_END
                    ends = np.cumsum(sizes)
                    whole = found.tobytes()
                    columns = [
                        pa.array(np.full(docs, shard, np.int32)),
                        pa.array(np.full(docs, block, np.int32)),
                        pa.array(np.arange(docs, dtype=np.int32)),
                        pa.array(who.copy(), mask=given == 0),
                        pa.array(sizes.copy()),
                        pa.array([whole[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "place", "doc_id", "n_tokens", "ids"])

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(f"{path}/blocks")
    return files.select("content").mapInArrow(run, "shard int, block int, place int, doc_id long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files written and read again."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/ratelake-ids-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    write_token_files(docs, path, tokenizer, end_id)
    x = stored(read_token_files(spark, path).select("shard", "block", "place", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    # A row for each shard: the ids of all shards before it.
    shards = x.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    shards = shards.select("shard", F.coalesce(F.sum("all").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("shard").orderBy("block", "place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("inside", inside).join(shards, "shard").select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
