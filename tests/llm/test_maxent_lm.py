"""The language model: its counts and base against a plain version, its chances against their sum, its gain on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.llm import maxent_lm as lm


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def expected(rows):
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 or i is None for w in words(t))
    n, v = sum(c.values()), len(c)
    return Counter((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)


def check(df, docs):
    found = df.collect()
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in found) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    return found


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = check(lm.lm_scores(docs), docs)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in out) > 0.15 * sum(r["n_tokens"] for r in out)


@pytest.mark.parametrize("sent", [1, 300])
def test_scores_do_not_depend_on_what_is_sent(spark, sf_dir, monkeypatch, sent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    whole = {r["doc_id"]: r["score"] for r in check(lm.lm_scores(docs), docs)}
    monkeypatch.setattr(lm.build_vocabulary, "__defaults__", (sent,))
    joined = {r["doc_id"]: r["score"] for r in check(lm.lm_scores(docs), docs)}
    assert joined.keys() == whole.keys() and all(math.isclose(joined[i], whole[i], rel_tol=1e-6) for i in whole)


def test_scores_do_not_depend_on_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.when(F.col("doc_id") % 9 != 0, F.col("doc_id")).alias("doc_id"))
    few, many = (sorted((r["doc_id"] or 0, r["n_tokens"], round(r["score"], 4)) for r in lm.lm_scores(docs.repartition(n)).collect()) for n in (3, 8))
    assert few == many


@pytest.mark.parametrize("texts", [[None, "", " ", "a", "a", "B b  é", "x" * 3000], []])
def test_awkward_rows(spark, texts):
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[3:5], *([(None, "a b", 1, "k")] if texts else [])], "doc_id long, text string, n int, word string")
    check(lm.lm_scores(docs), docs)


def test_chances_sum_to_one():
    rng = np.random.default_rng(1)
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), rng.integers(0, 50, lm.BUCKETS), rng.integers(0, 9, lm.BUCKETS), 1, 1)
    w = lm.initial_weights(v)
    w = w.with_flat(w.flat() + rng.normal(0, 0.3, len(w.flat())).astype(np.float32))
    history = np.array([5, 200, 17])
    total = sum(10 ** lm.log10_chances(w, np.append(history, b), np.array([0, 4]))[3] for b in range(lm.BUCKETS))
    assert abs(total - 1) < 1e-4
