"""Language identification by a linear-chain conditional random field over the words of a text.

A word is a run of letters. Its features are the word, its first and last one to three letters, its two- and three-letter
grams (all hashed), and its row in a hashed lexicon: how often each language's training texts use it, counted over all
of them. Weights and transitions are learned on code-switched sequences put together from segments of the training
texts, so that changes of language inside a text are something the model has seen. Words are labelled by
forward-backward; a text's language is the one with the largest mean posterior, which is also its score.

All texts of a slice form one chain: the first word of a text has a matrix with equal rows, which forgets what came
before. Products of matrices over chunks are composed by parallel prefix scans, so a long text takes no long loop.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing has been learned. Ties go
to the language that sorts first. Repeated rows are predicted row by row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelake.llm.arrow_text import slices

UNDETERMINED = "und"
#: Hashed feature rows and lexicon rows; each has one number per language, so both tables are bounded by the languages.
FEATURES, LEXICON, CHUNK = 1 << 16, 1 << 17, 32
#: Training texts of a language are sampled down to about so many bytes for the weights. The lexicon counts all texts.
SAMPLE_BYTES = 150_000
#: A sampled text gives at most about so many bytes, in so many pieces from all over it, so that many texts fit in a sample.
TEXT_BYTES, PIECES = 6_000, 3

_C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point of the basic plane is a letter, and its lower case."""
    if not _tables:
        chars = [chr(c) for c in range(0x10000)]
        low = [c.lower() for c in chars]
        _tables.extend((np.array([c.isalpha() for c in chars]), np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)))
    return _tables[0], _tables[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _C[1]
    x = (x ^ x >> np.uint64(27)) * _C[2]
    return x ^ x >> np.uint64(33)


@dataclass
class Words:
    """The words of a slice: code points, first and number of letters of each word, borders of texts among words."""

    points: np.ndarray
    first: np.ndarray
    size: np.ndarray
    borders: np.ndarray

    def hashes(self) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, np.uint64)
        inside = np.arange(int(self.size.sum())) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        powers = np.cumprod(np.full(int(self.size.max()), _C[3], np.uint64))
        parts = _mixed(self.points[np.repeat(self.first, self.size) + inside].astype(np.uint64) * _C[0]) * powers[inside]
        return _mixed(np.add.reduceat(parts, np.cumsum(self.size) - self.size))


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    is_letter, lower = _letters()
    basic = points < 0x10000
    low = np.minimum(points, 0xFFFF).astype(np.uint16)
    letter = is_letter[low] & basic
    for p in np.unique(points[~basic]).tolist():
        letter[points == p] = chr(p).isalpha()
    points = np.where(basic, lower[low], points)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    texts = np.searchsorted(lead, offsets)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = texts[:-1][texts[:-1] < len(points)]
    begins[inner] = letter[inner]
    first = np.flatnonzero(begins)
    among = np.flatnonzero(letter)
    size = np.diff(np.append(np.searchsorted(among, first), len(among)))
    return Words(points, first, size, np.searchsorted(first, texts))


def word_features(words: Words, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``which``, feature) of the hashed features of the words at ``which``."""
    v = _mixed(words.points.astype(np.uint64) * _C[0] + np.uint64(1))
    first, size = words.first[which], words.size[which]
    rows, found = [np.arange(len(which))], [hashes]
    code = {1: v}
    for k in (2, 3):
        code[k] = code[k - 1] * _C[3]
        code[k][: len(v) - k + 1] += v[k - 1 :]
    for k in (1, 2, 3):
        long = np.flatnonzero(size >= k)
        rows += [long, long]
        found += [code[k][first[long]] + np.uint64(10 * k), code[k][first[long] + size[long] - k] + np.uint64(10 * k + 1)]
        if k > 1:
            n = size[long] - k + 1
            at = np.repeat(first[long], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            rows.append(np.repeat(long, n))
            found.append(code[k][at] + np.uint64(10 * k + 2))
    return np.concatenate(rows), (_mixed(np.concatenate(found)) >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.max(axis=tuple(range(1, x.ndim)), keepdims=True), 1e-300)


def _scan(products: np.ndarray, forward: bool) -> np.ndarray:
    """Running products from the left, or from the right."""
    out, reach = products.copy(), 1
    while reach < len(out):
        if forward:
            out[reach:] = _scaled(out[:-reach] @ out[reach:])
        else:
            out[:-reach] = _scaled(out[:-reach] @ out[reach:])
        reach *= 2
    return out


def forward_backward(unary: np.ndarray, is_first: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the words, and the scaled forward and backward vectors, of chains laid end to end."""
    n, k = unary.shape
    m = -(-n // CHUNK)
    e = np.ones((m * CHUNK, k))
    e[:n] = np.exp(unary - unary.max(1, keepdims=True))
    e = e.reshape(m, CHUNK, k)
    new = np.ones(m * CHUNK, bool)
    new[:n] = is_first
    new = new.reshape(m, CHUNK)
    t, s = np.exp(transitions), np.exp(start)
    product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for j in range(CHUNK):
        product = (product.reshape(-1, k) @ t).reshape(m, k, k)
        product[new[:, j]] = s
        product = _scaled(product * e[:, j, None, :])
    ahead, behind = _scan(product, True), _scan(product, False)
    alpha, beta = np.empty((m, CHUNK, k)), np.empty((m, CHUNK, k))
    a = np.concatenate([np.ones((1, k)), ahead[:-1, 0, :]])
    for j in range(CHUNK):
        a = a @ t
        a[new[:, j]] = s
        a = _scaled(a * e[:, j])
        alpha[:, j] = a
    b = np.concatenate([behind[1:].sum(2), np.ones((1, k))])
    for j in range(CHUNK - 1, -1, -1):
        b = _scaled(b)
        beta[:, j] = b
        x = e[:, j] * b
        b = x @ t.T
        b[new[:, j]] = 1
    both = alpha * beta
    return (both / both.sum(2, keepdims=True)).reshape(-1, k)[:n], alpha.reshape(-1, k)[:n], (e * beta).reshape(-1, k)[:n]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: np.ndarray  # lexicon rows x languages
    lexicon_weight: float
    transitions: np.ndarray
    start: np.ndarray

    def unary(self, words: Words, which: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        rows, found = word_features(words, which, hashes)
        out = np.stack([np.bincount(rows, self.weights[found, k], len(which)) for k in range(len(self.languages))], 1)
        return out + self.lexicon_weight * self.lexicon[_lexicon_row(hashes)]

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        words = find_words(data, offsets)
        if not len(words.first) or not self.languages:
            return words, np.zeros((len(words.first), len(self.languages)))
        kinds, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        is_first = np.zeros(len(words.first), bool)
        is_first[words.borders[:-1][words.borders[:-1] < len(is_first)]] = True
        return words, forward_backward(self.unary(words, at, kinds)[which], is_first, self.transitions, self.start)[0]


def _lexicon_row(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (LEXICON - 1)


def _lexicon_counts(labelled: DataFrame) -> DataFrame:
    """(lang, row, n) over all labelled texts, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for part, data, offsets in slices(batches):
            words = find_words(data, offsets)
            rows = _lexicon_row(words.hashes())
            langs, code = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
            n = np.bincount(np.repeat(code, np.diff(words.borders)) * LEXICON + rows, minlength=len(langs) * LEXICON).reshape(-1, LEXICON)
            for lang, more in zip(langs.tolist(), n):
                found[lang] = found[lang] + more if lang in found else more
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "row", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, row long, n long").groupBy("lang", "row").agg(F.sum("n").alias("n"))


def _lexicon_table(counted: DataFrame, languages: list[str]) -> np.ndarray:
    """The counts as lexicon rows x languages. They come as Arrow columns of numbers, 16 bytes a row; as Python rows they would take more than the model."""
    column = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    packed = counted.select(column.alias("column"), F.col("row").cast("int").alias("row"), "n").toArrow()
    table = np.zeros((LEXICON, len(languages)))
    for part in packed.to_batches():
        table[part.column(1).to_numpy(), part.column(0).to_numpy()] = part.column(2).to_numpy()
    return table


def _switched(words: Words, langs: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the words, their languages and starts of sequences, after segments of the texts are dealt anew."""
    n = len(words.first)
    of = np.repeat(langs, np.diff(words.borders))
    cut = rng.random(n) < 1 / 16
    cut[words.borders[:-1][words.borders[:-1] < n]] = True
    segment = np.cumsum(cut) - 1
    place = rng.permutation(int(segment[-1]) + 1)
    order = np.argsort(place[segment], kind="stable")
    is_first = cut[order] & (rng.random(n) < 1 / 4)
    is_first[0] = True
    return order, of[order], is_first


def _sample(labelled: DataFrame, sample_bytes: int) -> list[tuple[str, str, str]]:
    """(doc_id as string, text, lang) of texts in the order of a hash, until a language has ``sample_bytes``; the last may go beyond by its own pieces.

    Of a text longer than TEXT_BYTES, PIECES pieces of equal length stand for it, each from a place of its own part of the
    text. Rows are first thinned by a hash to about twice what is needed, but for the row with a language's least hash.
    """
    size = F.octet_length("text")
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit("crf")), F.lit(1 << 30)) / float(1 << 30)
    x = labelled.withColumn("unit", unit)
    totals = x.groupBy("lang").agg(F.sum(F.least(size, F.lit(TEXT_BYTES))).alias("bytes"), F.min("unit").alias("least"))
    cuts = {r["lang"]: max(r["least"], 2 * sample_bytes / max(1, r["bytes"])) for r in totals.collect()}
    cut = F.element_at(F.create_map(*(F.lit(v) for lang, c in cuts.items() for v in (lang, float(c)))), F.col("lang"))
    part = F.length("text") / PIECES
    piece = F.floor(part * TEXT_BYTES / size).cast("int")
    begin = lambda k: (F.floor(k * part + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1 << 20)) / float(1 << 20) * (part - piece)) + 1).cast("int")
    pieces = F.when(size <= TEXT_BYTES, F.array("text")).otherwise(F.array(*(F.substring(F.col("text"), begin(k), piece) for k in range(PIECES))))
    x = x.where(F.col("unit") <= cut).select("lang", "unit", F.col("doc_id").cast("string").alias("name"), pieces.alias("pieces"))
    own = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    before = F.sum(own).over(W.partitionBy("lang").orderBy("unit", "name", "pieces").rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_bytes)
    return sorted(((r["name"] or "", t, r["lang"]) for r in x.select("name", "pieces", "lang").collect() for t in r["pieces"]))


def fit(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, epochs: int = 8) -> Model:
    """Learn from ``labelled`` (doc_id, text, lang); rows with a null in text or lang, or an empty text, teach nothing.

    The lexicon is counted over all rows. Weights are learned on a sample of about ``sample_bytes`` of each language, in which every language has texts.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("text <> '' and lang is not null")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    k = len(languages)
    if not k:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((LEXICON, 0)), 0.0, np.zeros((0, 0)), np.zeros(0))
    lexicon = _lexicon_table(_lexicon_counts(labelled), languages)
    lexicon = np.log((lexicon + 0.1) / (lexicon.sum(0) + 0.1 * LEXICON) * 1e6)
    lexicon = np.clip(lexicon - lexicon.mean(1, keepdims=True), -6, 6).astype(np.float32)

    rows = _sample(labelled, sample_bytes)
    raw = [r[1].encode() for r in rows]
    words = find_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    model = Model(languages, np.zeros((FEATURES, k)), lexicon, 0.3, np.zeros((k, k)), np.zeros(k))
    if not len(words.first):
        return model
    rng = np.random.default_rng(5)
    kinds, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    feature_rows, found = word_features(words, at, kinds)
    order = np.argsort(feature_rows, kind="stable")
    feature_rows, found = feature_rows[order], found[order]
    bounds = np.searchsorted(feature_rows, np.arange(len(kinds) + 1))
    lex = lexicon[_lexicon_row(kinds)].astype(float)
    langs = np.array([languages.index(r[2]) for r in rows])
    squares = np.full((FEATURES, k), 1e-2)
    square_t, square_s, square_l = np.full((k, k), 1e-2), np.full(k, 1e-2), 1e-2
    for epoch in range(epochs):
        order, labels, is_first = _switched(words, langs, rng)
        for block in np.array_split(np.arange(len(order)), max(1, len(order) // 8192)):
            used, token = np.unique(which[order[block]], return_inverse=True)
            n = bounds[used + 1] - bounds[used]
            row = np.repeat(np.arange(len(used)), n)
            feature = found[np.repeat(bounds[used], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            unary = np.stack([np.bincount(row, model.weights[feature, j], len(used)) for j in range(k)], 1) + model.lexicon_weight * lex[used]
            new = is_first[block].copy()
            new[0] = True
            y = labels[block]
            gamma, alpha, e_beta = forward_backward(unary[token], new, model.transitions, model.start)
            error = np.eye(k)[y] - gamma
            per_kind = np.stack([np.bincount(token, error[:, j], len(used)) for j in range(k)], 1)
            for j in range(k):
                g = np.bincount(feature, per_kind[row, j], FEATURES) / len(block) - 1e-6 * model.weights[:, j]
                squares[:, j] += (g * len(block) / 100) ** 2
                model.weights[:, j] += 0.2 * (g * len(block) / 100) / np.sqrt(squares[:, j])
            inner = np.flatnonzero(~new)
            pair = alpha[inner - 1][:, :, None] * np.exp(model.transitions) * e_beta[inner][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            seen = np.bincount(y[inner - 1] * k + y[inner], minlength=k * k).reshape(k, k)
            g_t, g_s = (seen - pair.sum(0)) / 100, error[new].sum(0) / 10
            g_l = float((per_kind * lex[used]).sum()) / len(block)
            square_t, square_s, square_l = square_t + g_t**2, square_s + g_s**2, square_l + g_l**2
            model.transitions += 0.2 * g_t / np.sqrt(square_t)
            model.start += 0.1 * g_s / np.sqrt(square_s)
            model.lexicon_weight = max(0.0, model.lexicon_weight + 0.05 * g_l / square_l**0.5)
    model.weights = model.weights.astype(np.float32)
    return model


_models: dict[str, Model] = {}


def _apply(docs: DataFrame, model: Model, each, out: T.StructType) -> DataFrame:
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = sent.value
        for part, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *each(_models[key], data, offsets)], out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (mean posterior of that language's label over the words) of every text."""

    def each(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
        words, gamma = model.posteriors(data, offsets)
        sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma, 0)])
        n = np.diff(words.borders)
        mean = (sums[words.borders[1:]] - sums[words.borders[:-1]]) / np.maximum(n, 1)[:, None]
        if not gamma.shape[1]:
            return pa.array([UNDETERMINED] * len(n)), pa.array(np.zeros(len(n)))
        best = mean.round(12).argmax(1)
        names = np.where(n > 0, np.array(model.languages, object)[best], UNDETERMINED)
        return pa.array(names.tolist(), pa.string()), pa.array(np.clip(np.where(n > 0, mean.max(1), 0.0), 0.0, 1.0))

    return _apply(docs, model, each, T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans of every text: runs of words with one label, as (begin, end, lang, n_words, posterior), offsets in characters."""
    kind = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("posterior", T.DoubleType())])

    def each(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array]:
        words, gamma = model.posteriors(data, offsets)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        texts = np.searchsorted(lead, offsets)
        out = []
        for i, (a, b) in enumerate(zip(words.borders[:-1].tolist(), words.borders[1:].tolist())):
            spans = []
            if b > a and gamma.shape[1]:
                label = gamma[a:b].argmax(1)
                cuts = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), b - a]
                for s, t in zip(cuts[:-1], cuts[1:]):
                    spans.append({"begin": int(words.first[a + s] - texts[i]), "end": int(words.first[a + t - 1] + words.size[a + t - 1] - texts[i]), "lang": model.languages[label[s]], "n_words": t - s, "posterior": float(gamma[a + s : a + t, label[s]].mean())})
            out.append(spans)
        return (pa.array(out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("posterior", pa.float64())]))),)

    return _apply(docs, model, each, T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(kind))]))


def held_out(modulus: int, remainder: int):
    """Whether crc32 of doc_id as text leaves this remainder; false for a null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text; learned from the labelled texts that are not held out."""
    model = fit(docs.where(~held_out(4, 2)))
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
