"""A hashed maximum-entropy language model with a class-factored softmax, and the unigram base it is held against.

Tokens are words (runs of characters other than ASCII white space, A-Z lower-cased) and one end after each text.

1. Words are counted over all training texts; counts are added up in tasks first, then by key.
2. Every word has a bucket: each of the ``OWN`` most frequent words one of its own, any other word the one of its hashed
   ending. A bucket is a member of one of ``CLASSES`` classes of words of like frequency.
3. log P(word | history) = log P(class | history) + log P(member | class, history) + log P(word | bucket). The first two
   are softmaxes over summed weights of hashed features: the bucket before, the two before, and the second before with
   the nearer one skipped, besides a bias from the buckets' counts. The last is an add-one estimate from the counts, with one share in each bucket for all words not seen in it, so the model is normalised.
4. The weights are learned from all training texts, dealt by doc_id to ``ROUNDS`` rounds of as many shares as the root
   of the corpus's size asks for: in a round every share takes gradient steps over its texts from the common weights, and
   the shares' weights are averaged by their tokens, piece by piece of the tables. The tables have rows in proportion to
   the root of the number of training tokens, up to LARGEST times the least, which bounds a worker's memory.
5. Scoring runs over slices of texts. Counts of the frequent words, whose number is bounded, are sent to the tasks. All
   other words, none of which holds more than a small share of the tokens, meet their counts in a join: each row carries
   the number of its text, and what the join adds to a text is summed by that number.

Words are keyed by hashes of 64 bits. A null text is empty, so it has one token. Repeated rows are scored row by row. A row
without doc_id is not held out. Other columns are ignored; without training texts all counts are 0.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.llm.arrow_text import SLICE_BYTES, slices
from ratelake.llm.shared_store import discard, stored

#: Words with buckets of their own, hashed buckets after them, members of a class.
OWN, HASHED, MEMBERS = 512, 128, 16
BUCKETS = OWN + HASHED
CLASSES = BUCKETS // MEMBERS
#: Fewest weight rows of all features for classes and for members, and how many times as many there may be.
CLASS_ROWS, MEMBER_ROWS, LARGEST = 1 << 13, 1 << 15, 8
#: A share of a round has the root of this many bytes times those of all training texts.
SHARE_BYTES = 4 << 20
#: Floats of a piece of the weights.
PIECE = 4096
FEATURES, ROUNDS, BATCH, RATE = 3, 3, 8192, 0.15
#: Most words whose counts are sent to the tasks (16 bytes each).
SENT_WORDS = 400_000
END_WORD = 1

_rng = np.random.default_rng(41)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(1, 1 << 63, 1, dtype=np.uint64)[0] | np.uint64(1)
_BYTE[[32, *range(9, 14)]] = 0
_BACK = np.uint64(pow(int(_PLACE), -1, 1 << 64))
_KIND = _rng.integers(0, 1 << 63, CLASSES, dtype=np.uint64)
_grown: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the place's factor and of its inverse; those of a usual slice stay, longer ones are not kept."""
    if n > SLICE_BYTES + 65536:
        return np.cumprod(np.full(n, _PLACE, np.uint64)), np.cumprod(np.full(n, _BACK, np.uint64))
    if not _grown or len(_grown[0]) < n:
        size = min(SLICE_BYTES + 65536, max(n, 1 << 16) * 2)
        _grown[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (_PLACE, _BACK)]
    return _grown[0], _grown[1]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and hashed ending of every token of the texts, ends included, and the n+1 borders of the texts among them."""
    code = _BYTE[data]
    word = code != 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] = word[inner]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    stops[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    borders = np.searchsorted(first, offsets)
    keys, endings = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if len(first):
        # Sums of codes times powers of the place; a word's part of it, over the power at its start, does not depend on the place.
        up, down = _powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * up[: len(data)])])
        keys = _mixed((sums[last + 1] - sums[first]) * down[first]) | np.uint64(2)  # none is END_WORD
        size = last - first + 1
        start = last - np.minimum(size, 3) + 1
        endings = (_mixed((sums[last + 1] - sums[start]) * down[start] + np.minimum(size, 4).astype(np.uint64)) >> np.uint64(40)).astype(np.int32) % HASHED + OWN
    # One end after each text.
    return np.insert(keys, borders[1:], np.uint64(END_WORD)), np.insert(endings, borders[1:], OWN), borders + np.arange(len(borders))


def held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id as text leaves this remainder; false for a null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []

        def added() -> tuple[np.ndarray, ...]:
            keys, n, endings = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            keys, n, endings = keys[order], n[order], endings[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first), endings[first]

        def batch(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[2]), pa.array(x[1])], ["word", "ending", "n"])

        for _, data, offsets in slices(batches):
            keys, endings, _ = tokens(data, offsets)
            kinds, at, n = np.unique(keys, return_index=True, return_counts=True)
            parts.append((kinds, n, endings[at]))
            if sum(len(p[0]) for p in parts) > 2_000_000:
                parts[:] = [added()]
                if len(parts[0][0]) > 1_000_000:
                    yield batch(parts.pop())
        if parts:
            yield batch(added())

    out = T.StructType([T.StructField("word", T.LongType()), T.StructField("ending", T.IntegerType()), T.StructField("n", T.LongType())])
    return texts.select("text").mapInArrow(run, out).groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the words that are sent, buckets of the most frequent, and sums of all words by bucket."""

    words: np.ndarray  # sorted keys
    counts: np.ndarray
    own: np.ndarray  # bucket of a sent word, or -1
    bucket_count: np.ndarray
    bucket_words: np.ndarray
    n_tokens: int
    n_words: int
    least: int | None = None  # every word of at least this count is among ``words``

    def buckets(self, keys: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of each key; its count, and whether that is known here."""
        if not len(self.words):
            return endings.astype(np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        known = self.words[at] == keys
        own = np.where(known, self.own[at], -1)
        return np.where(own >= 0, own, endings), np.where(known, self.counts[at], 0), known


def build_vocabulary(counted: DataFrame, sent_words: int = SENT_WORDS) -> Vocabulary:
    """From stored counts. Sent are the ``OWN`` most frequent words and those of the counts that at most ``sent_words`` words reach."""
    levels = sorted((tuple(r) for r in counted.groupBy("n").count().collect()), reverse=True)  # at most sqrt(2 * tokens) rows
    n_tokens, n_words, above, least = sum(n * k for n, k in levels), sum(k for _, k in levels), 0, None
    for n, k in levels:
        above += k
        if above > sent_words:
            break
        least = n
    top = counted.orderBy(F.desc("n"), "word").limit(OWN).toPandas()
    rank = dict(zip(top["word"].tolist(), range(len(top))))
    table = counted.where(F.col("n") >= least).toPandas() if least is not None else top
    table = pd.concat([table, top]).drop_duplicates("word").sort_values("word", key=lambda x: x.to_numpy(np.int64).view(np.uint64))
    words, counts, endings = table["word"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["ending"].to_numpy(np.int64)
    own = np.array([rank.get(w, -1) for w in words.tolist()], np.int64)
    bucket_count, bucket_words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for ending, n, k in counted.groupBy("ending").agg(F.sum("n"), F.count("*")).collect():
        bucket_count[ending], bucket_words[ending] = n, k
    for i in np.flatnonzero(own >= 0):
        bucket_count[own[i]], bucket_words[own[i]] = counts[i], 1
        bucket_count[endings[i]] -= counts[i]
        bucket_words[endings[i]] -= 1
    return Vocabulary(words.view(np.uint64), counts, own, bucket_count, bucket_words, n_tokens, n_words, least)


@dataclass
class Weights:
    classes: np.ndarray  # rows x CLASSES
    members: np.ndarray  # rows x MEMBERS
    class_bias: np.ndarray
    member_bias: np.ndarray  # CLASSES x MEMBERS
    class_squares: np.ndarray
    member_squares: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.classes, self.members, self.class_squares, self.member_squares)])

    def with_flat(self, x: np.ndarray) -> Weights:
        sizes = np.cumsum([self.classes.size, self.members.size, len(self.classes)])
        a, b, c, d = np.split(x.astype(np.float32), sizes)
        return Weights(a.reshape(-1, CLASSES), b.reshape(-1, MEMBERS), self.class_bias, self.member_bias, c, d)


def initial_weights(vocabulary: Vocabulary) -> Weights:
    """No weights yet but the biases; the numbers of rows are powers of two next to the root of the number of tokens."""
    times = 1 << min(LARGEST.bit_length() - 1, max(0, int(2 * vocabulary.n_tokens**0.5).bit_length() - CLASS_ROWS.bit_length()))
    a, b = CLASS_ROWS * times, MEMBER_ROWS * times
    share = (vocabulary.bucket_count + 0.5).reshape(CLASSES, MEMBERS).astype(np.float32)
    return Weights(np.zeros((a, CLASSES), np.float32), np.zeros((b, MEMBERS), np.float32), np.log(share.sum(1) / share.sum()), np.log(share / share.sum(1, keepdims=True)), np.full(a, 1e-3, np.float32), np.full(b, 1e-3, np.float32))


def history_features(buckets: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Hashes of each token's features (tokens x FEATURES); before a text's first token stands the bucket BUCKETS."""
    n = len(buckets)
    place = np.arange(n) - np.repeat(borders[:-1], np.diff(borders))
    before = []
    for k in (1, 2):
        x = np.full(n, BUCKETS, np.uint64)
        x[k:] = buckets[: max(0, n - k)]
        x[place < k] = BUCKETS
        before.append(x)
    one, two = before
    kinds = (one, one * np.uint64(4096) + two + np.uint64(1 << 24), two + np.uint64(1 << 40))
    return np.stack([_mixed(x + np.uint64(1)) for x in kinds], 1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.exp(np.clip(logits, -60, 60, out=logits), out=logits)
    logits /= logits @ np.ones((logits.shape[1], 1), logits.dtype)
    return logits


def _chances(w: Weights, features: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and member chances of tokens, and the weight rows that made them."""
    kind = buckets // MEMBERS
    class_rows = (features >> np.uint64(20)).astype(np.uint32) & np.uint32(len(w.classes) - 1)
    member_rows = ((features + _KIND[kind][:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.uint32) & np.uint32(len(w.members) - 1)
    classes, members = np.broadcast_to(w.class_bias, (len(buckets), CLASSES)).copy(), w.member_bias[kind]
    for j in range(FEATURES):
        classes += w.classes.take(class_rows[:, j], 0)
        members += w.members.take(member_rows[:, j], 0)
    return _softmax(classes), _softmax(members), class_rows, member_rows


def log10_chances(w: Weights, buckets: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """log10 P(bucket | history) of each token."""
    out, features = np.empty(len(buckets)), history_features(buckets, borders)
    for a in range(0, len(buckets), BATCH):
        b = buckets[a : a + BATCH]
        classes, members, _, _ = _chances(w, features[a : a + BATCH], b)
        row = np.arange(len(b))
        out[a : a + BATCH] = np.log10(np.maximum(classes[row, b // MEMBERS], 1e-30)) + np.log10(np.maximum(members[row, b % MEMBERS], 1e-30))
    return out


def _descend(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, error: np.ndarray) -> None:
    """One gradient step of the rows of a weight table, each with its own rate by its squared gradients so far."""
    # Rows and places in one number each, as plain numbers sort much faster than places by their rows.
    flat = np.sort(rows.ravel().astype(np.uint64) << np.uint64(32) | np.arange(rows.size, dtype=np.uint64))
    order, ranked = (flat & np.uint64(0xFFFFFFFF)).astype(np.int64), (flat >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    at = ranked[first]
    gradient = np.add.reduceat(error.take(order // FEATURES, 0), first, 0)
    squares[at] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
    table[at] -= RATE * gradient / np.sqrt(squares[at])[:, None]


def gradient_steps(w: Weights, buckets: np.ndarray, borders: np.ndarray) -> None:
    features = history_features(buckets, borders)
    for a in range(0, len(buckets), BATCH):
        b = buckets[a : a + BATCH]
        classes, members, class_rows, member_rows = _chances(w, features[a : a + BATCH], b)
        row = np.arange(len(b))
        classes[row, b // MEMBERS] -= 1
        members[row, b % MEMBERS] -= 1
        _descend(w.classes, w.class_squares, class_rows, classes)
        _descend(w.members, w.member_squares, member_rows, members)


_kept: dict[str, tuple] = {}


def _here(key: str, sent) -> tuple:
    """What was sent, once in a worker process."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = sent.value
    return _kept[key]


def _round(shares: DataFrame, vocabulary: Vocabulary, w: Weights, n_shares: int) -> Weights:
    """Weights after every share (share, text) has learned from its texts, averaged by tokens."""
    key, sent = uuid.uuid4().hex, shares.sparkSession.sparkContext.broadcast((vocabulary, w))
    names = ["piece", "share", "n", "weights"]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, common = _here(key, sent)
        own, n, share = common.with_flat(common.flat()), 0, 0
        for part, data, offsets in slices(batches):
            keys, endings, borders = tokens(data, offsets)
            gradient_steps(own, vocabulary.buckets(keys, endings)[0], borders)
            n, share = n + len(keys), part.column(0)[0].as_py()
        if n:
            x = own.flat()
            parts = [x[k : k + PIECE].tobytes() for k in range(0, len(x), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([share] * len(parts), pa.int32()), pa.array([n] * len(parts)), pa.array(parts, pa.binary())], names)

    def average(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("share")
        n = piece.column("n").to_numpy()
        total = sum(np.frombuffer(x.as_buffer(), np.float32) * (k / n.sum()) for k, x in zip(n, piece.column("weights")))
        return pa.table({"piece": piece.column("piece")[:1], "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("share", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("weights", T.BinaryType())])
    # Steps depend on the order of rows, which a shuffle or a lost executor must not decide.
    learned = shares.repartitionById(n_shares, F.col("share")).sortWithinPartitions("place").select("share", "text").mapInArrow(learn, out)
    pieces = learned.groupBy("piece").applyInArrow(average, "piece int, weights binary")
    found = stored(pieces)
    table = found.toArrow().sort_by("piece")
    discard(found)
    sent.unpersist()
    return w.with_flat(np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in table.column("weights")])) if table.num_rows else w


@dataclass
class LanguageModel:
    counted: DataFrame  # stored (word, ending, n)
    vocabulary: Vocabulary
    weights: Weights


def train(texts: DataFrame, rounds: int = ROUNDS) -> LanguageModel:
    """Counts over all ``texts`` (doc_id, text), then weights learned from all of them in ``rounds`` shares."""
    counted = stored(word_counts(texts))
    vocabulary = build_vocabulary(counted)
    w = initial_weights(vocabulary)
    # Buckets need only the words with one of their own.
    top = vocabulary.own >= 0
    small = Vocabulary(vocabulary.words[top], vocabulary.counts[top], vocabulary.own[top], vocabulary.bucket_count, vocabulary.bucket_words, 0, 0)
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shares = max(1, math.ceil((n_bytes / SHARE_BYTES) ** 0.5))
    # By id and text, so that rows without an id are dealt out too.
    place = F.xxhash64("doc_id", "text")
    shares = texts.select(F.pmod(place, F.lit(rounds * n_shares)).alias("dealt"), place.alias("place"), "text").where("text is not null")
    for k in range(rounds):
        w = _round(shares.where(F.col("dealt") % rounds == k).select((F.col("dealt") / rounds).cast("int").alias("share"), "place", "text"), small, w, n_shares)
    return LanguageModel(counted, vocabulary, w)


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text."""
    v = model.vocabulary
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((v, model.weights))
    longs, doubles = ("row", "n_tokens", "n_known"), ("base", "model")
    rare = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("k", T.IntegerType())]))
    out = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.DoubleType()) for c in doubles), T.StructField("rare", rare)])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = _here(key, sent)
        log_all, at_row = np.log10(v.n_tokens + v.n_words + 1), TaskContext.get().partitionId() << 40
        bucket_logs = np.log10(v.bucket_count + v.bucket_words + 1)
        for part, data, offsets in slices(batches):
            keys, endings, borders = tokens(data, offsets)
            buckets, counts, known = v.buckets(keys, endings)
            n = len(borders) - 1
            row = np.repeat(np.arange(n), np.diff(borders))
            logged = np.where(known, np.log10(counts + 1), 0.0)
            base = np.bincount(row, logged, n) - np.diff(borders) * log_all
            total = np.bincount(row, log10_chances(w, buckets, borders) - bucket_logs[buckets] + logged, n)
            # The rare words of each text, each once with its number of occurrences.
            at = np.flatnonzero(~known)
            order = at[np.lexsort((keys[at], row[at]))]
            first = np.flatnonzero(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])])) if len(order) else np.zeros(0, np.int64)
            words = pa.StructArray.from_arrays([pa.array(keys[order[first]].view(np.int64)), pa.array(np.diff(np.append(first, len(order))).astype(np.int32))], ["word", "k"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order[first]], np.arange(n + 1)).astype(np.int32)), words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at_row + np.arange(n)), pa.array(np.diff(borders)), pa.array(np.bincount(row[known], minlength=n)), pa.array(base), pa.array(total), lists], names)
            at_row += n

    # Stored, so that a row keeps its number.
    scored = stored(docs.select("doc_id", "text").mapInArrow(run, out))
    below = model.counted if v.least is None else model.counted.where(F.col("n") < v.least)
    # A rare word's rows are few, since its count is below that of the words sent.
    seen = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k").join(below.select("word", "n"), "word")
    tails = seen.groupBy("row").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("logs"))
    x = scored.drop("rare").join(tails, "row", "left")
    logs, k = (F.coalesce(c, F.lit(0)) for c in ("logs", "k"))
    return x.select("doc_id", "n_tokens", (F.col("n_known") + k).cast("long").alias("n_known"), F.lit(v.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of all texts by a model of those that are not held out, with held_out beside them."""
    model = train(docs.where(~held_out(7, 2)))
    return score(docs, model).select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
