"""Language ID and quality grades: held-out accuracy, defined results on awkward rows, and the chain against enumeration."""

import itertools
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ratelake.llm import language_id as li
from ratelake.llm import quality as q


def test_language_id_is_right_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r["doc_id"]: r for r in li.language_id(docs).collect()}
    assert len(found) == docs.count()
    out = [(r["lang"], found[r["doc_id"]]) for r in docs.collect() if found[r["doc_id"]]["held_out"]]
    assert sum(lang == r["lang_pred"] for lang, r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_code_switched_text_is_cut_into_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = li.fit(docs)
    text = "The of and that with thing was the. Le de la une les qui éoireeau. Der und ist einer schen auf nicht."
    spans = li.language_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).collect()
    assert [(s["lang"], text[s["begin"] : s["end"]].split()[0]) for s in spans[0]["spans"]] == [("en", "The"), ("fr", "Le"), ("de", "Der")]
    assert spans[1]["spans"] == []


def test_language_id_of_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, score string, held_out int"
    rows = [(i, t, lang, "x", 1) for i, (t, lang) in enumerate([("alpha beta", "aa"), ("gamma delta", "bb"), (None, "aa"), ("", "bb"), ("12 — !", "aa"), ("alpha " * 20000, None), ("日本語", "aa"), ("alpha beta", "aa"), ("a", None), ("𝐱", None)])]
    found = {r["doc_id"]: r for r in li.language_id(spark.createDataFrame([*rows, (None, "gamma", "bb", "x", 1)], schema)).collect()}
    assert len(found) == 11
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} == {2, 3, 4} and all(found[i]["score"] == 0 for i in (2, 3, 4))
    assert li.language_id(spark.createDataFrame([], schema)).collect() == []
    assert {r["lang_pred"] for r in li.language_id(spark.createDataFrame([(1, "a", None, "x", 1)], schema)).collect()} == {"und"}


def test_each_language_is_sampled_whatever_its_lengths(spark):
    rng = np.random.default_rng(8)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), 8)) for _ in range(n))

    rows = [(k, text("abcdefgh", 10), "aa") for k in range(2000)] + [(9000 + k, text("ijklmnop", 20_000), "bb") for k in range(2)] + [(9500, text("abcdefgh", 20_000), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # By its whole texts of 180 KB, bb has 0.02 rows in a sample of 3,000 bytes, and words the lexicon knows tell nothing here.
    model = li.fit(docs, sample_bytes=3000)
    found = li.identify(spark.createDataFrame([(k, text("ijklmnop", 20)) for k in range(20)] + [(20 + k, text("abcdefgh", 20)) for k in range(20)], "doc_id long, text string"), model)
    assert {r["doc_id"] for r in found.where("lang_pred = 'bb'").collect()} == set(range(20))
    sample = li._sample(docs, 3000)
    assert all(0 < sum(len(t) for _, t, lang in sample if lang == x) < 3000 + li.TEXT_BYTES for x in ("aa", "bb"))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    lengths, k = [1, 3, 5, 2], 3
    unary, t, s = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    is_first = np.zeros(len(unary), bool)
    is_first[np.cumsum([0, *lengths[:-1]])] = True
    gamma = li.forward_backward(unary, is_first, t, s)[0]
    at = 0
    for n in lengths:
        total = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            weight = np.exp(s[path[0]] + sum(unary[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                total[i, y] += weight
        assert np.allclose(gamma[at : at + n], total / total.sum(1, keepdims=True))
        at += n
    long = rng.normal(size=(1000, k))
    whole, _, _ = li.forward_backward(long, np.arange(1000) == 0, t, s)
    a = np.exp(s) * np.exp(long[0])
    for row in long[1:]:
        a = (a / a.sum()) @ np.exp(t) * np.exp(row)
    assert np.allclose(whole[-1], a / a.sum())


def test_grades_on_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in q.quality_grades(docs, labels).collect()}
    assert len(found) == docs.count()
    rated = [(r["grade"], found[r["doc_id"]]) for r in q.rated_documents(docs, labels).collect()]
    out = [(g, r) for g, r in rated if r["held_out"]]
    assert sum(r["kept"] for g, r in out if g == 2) >= 0.95 * sum(g == 2 for g, _ in out)
    means = [np.mean([r["expected_grade"] for g, r in rated if g == k]) for k in range(3)]
    assert means[0] < means[2] and means[1] < means[2]


def test_grades_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x" * 100_000, 5), (4, "good text", 5), (4, "good text", 5), (None, "?!", 5)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (3, 0, 1), (9, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = q.quality_grades(docs, labels).collect()
    assert len(found) == 6 and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in found)
    assert len(q.quality_grades(docs, labels.limit(0)).collect()) == 6
    assert q.quality_grades(docs.limit(0), labels).collect() == []


def test_ordinal_model_recovers_thresholds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    y = np.digitize(2 * x + rng.logistic(size=4000), [-1.0, 1.5])
    model = q.learn(4000, np.arange(4000), np.zeros(4000, np.int64), x, y, epochs=400)
    assert abs(model.weights[0] - 2) < 0.3 and np.allclose(model.thresholds, [-1, 1.5], atol=0.3)
    assert np.allclose(model.chances(np.array([-3.0, 0, 3])).sum(1), 1)


def test_a_full_lexicon_reaches_the_driver_as_numbers(spark):
    names = ["aa", "bb", "cc"]
    ids = spark.range(3 * li.LEXICON)
    counted = ids.select(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 3 + 1).cast("int")).alias("lang"), F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 77).alias("n"))
    tracemalloc.start()
    table = li._lexicon_table(counted, names)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (table == np.arange(3 * li.LEXICON).reshape(-1, 3) % 77).all()
    assert most < 30e6  # toPandas() of these rows takes some 200 MB
