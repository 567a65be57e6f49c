"""The pipeline against plain versions of its stages."""

import random
from collections import Counter

import corpus_pipeline
from test_text_operators import contamination, shingles

from ratelake.llm.near_dedup import near_duplicate_digest
from ratelake.llm.shared_store import stored


def plain_near(table):
    """Ids of one document of each group of near-duplicates."""
    near = {i: i for i, _ in table}

    def root(i):
        while near[i] != i:
            i = near[i]
        return i

    sets = {i: shingles(t) for i, t in table}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                near[y] = x
    return {i for i in near if root(i) == i}


def plain_suffix(table):
    """Texts without what also starts earlier; bytes of cut characters go."""
    seen, out = set(), {}
    for i, text in sorted(table):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        if not any(gone):
            out[i] = text
        elif (kept := bytes(b for b, g in zip(raw, gone) if not g)):
            out[i] = kept.decode("utf-8", "ignore")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    table = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    df = stored(steps["language_id"](spark, docs, sf_dir))
    assert df.columns == names and df.count() == docs.count()
    df = stored(steps["near_dedup"](spark, df, sf_dir))
    kept = plain_near(list(table.items()))
    table = {i: t for i, t in table.items() if i in kept}
    assert df.columns == names and {r["doc_id"]: r["text"] for r in df.collect()} == table
    df = stored(steps["suffix_dedup"](spark, df, sf_dir))
    table = plain_suffix(list(table.items()))
    assert df.columns == names and {r["doc_id"]: r["text"] for r in df.collect()} == table
    df = stored(steps["decontamination"](spark, df, sf_dir))
    bad = {r[0] for r in contamination(list(table.items()), items) if r[-1]}
    assert df.columns == names and {r["doc_id"] for r in df.collect()} == set(table) - bad and bad
    mixed = steps["mixing"](spark, df, sf_dir)
    assert {r["doc_id"] for r in mixed.collect()} == set(table) - bad
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))


def test_awkward_documents(spark, sf_dir):
    rng = random.Random(4)
    base = " ".join(f"word{rng.randint(0, 40)}" for _ in range(80))
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (3, base, "en", "a", 7), (3, base, "en", "a", 7), (4, base + " x", "en", None, 7), (None, "only words here", "en", "a", 1), (5, "é" * 400, "de", "a", 400), (6, "é" * 80 + "x" + "é" * 400, "de", "b", 481)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() <= docs.count()
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    assert {r["doc_id"] for r in docs.collect()} >= {3, None, 5}


def test_characters_cut_by_a_repeated_passage_go_as_a_whole(spark, sf_dir):
    passage = " ".join(f"w{k}" for k in range(60))
    # Both runs share the second byte before the passage and the first one after it; the remains of ũ and è would make a Ũ.
    rows = [(1, f"a é{passage}é end"), (2, f"� ũ{passage}è fin")]
    docs = spark.createDataFrame([(i, t, "fr", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.suffix_dedup_stage(spark, docs, sf_dir).collect()}
    assert found == {1: (rows[0][1], len(rows[0][1])), 2: ("�  fin", 6)}


def test_rows_that_share_an_id_are_judged_one_by_one(spark, sf_dir):
    rng = random.Random(9)
    base = " ".join(f"word{rng.randint(0, 400)}" for _ in range(80))
    rows = [(1, base, "en"), (2, base + " more", "en"), (2, None, "en"), (2, "", "en"), (3, base[:300], "en"), (3, "", "en"), (4, "clean words of its own", "en"), (4, None, "en"), (5, None, "en")]
    docs = spark.createDataFrame([(i, t, lang, "a", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_duplicate_digest(docs).collect()}
    assert found[1, 76] == 1 and found[2, 77] == 1 and found[2, 0] == 2 and {c for (i, _), c in found.items() if i == 3} == {3}
    steps = dict(corpus_pipeline.STAGES)
    kept = Counter((r["doc_id"], r["text"]) for r in steps["near_dedup"](spark, docs, sf_dir).collect())
    assert kept == Counter((i, t) for i, t, _ in rows if t != base + " more")
    kept = Counter((r["doc_id"], r["text"]) for r in steps["language_id"](spark, docs, sf_dir).collect())
    assert kept == Counter((i, t) for i, t, _ in rows if t)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, item, "en", "a", 1), (1, "clean", "en", "a", 1)], docs.schema)
    assert [r["text"] for r in steps["decontamination"](spark, docs, sf_dir).collect()] == ["clean"]


def test_whole_tables(spark):
    """Ten times the rows of the other tests, with texts of several scripts: every stage keeps most of what it gets."""
    root = "/root/testdata/sf0.01"
    rows = corpus_pipeline.run(spark, root).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id").collect()}
    assert len(rows) == len({r["doc_id"] for r in rows}) and {r["doc_id"] for r in rows} <= ids and len(rows) > len(ids) / 2
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 0.05 * sum(r["size"] for r in rows)
