"""The last round of near-duplicates: dense groups, repeated rows, tiles that grow with blocks and not with pairs."""

import random

import pytest
from pyspark.sql import functions as F

from ratelake.llm import near_dedup
from ratelake.llm.near_dedup import near_duplicate_digest


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(texts):
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                label[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def dense_group(n, seed=1, places=40, changed=6):
    """Texts of 200 words that differ in some of a few places: many are near one another, few reach the threshold."""
    rng = random.Random(seed)
    base = [f"word{i}" for i in range(200)]
    out = {}
    for i in range(n):
        w = list(base)
        for p in rng.sample(range(places), changed):
            w[p * 5] = rng.choice(["left", "right"]) + str(p)
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("times", [1, 2])
def test_dense_groups_equal_all_pairs(spark, times):
    texts = dense_group(250)
    want = plain_components(texts)
    assert 20 < len(set(want.values())) < 230
    rows = [(i, t) for i, t in texts.items()] * times + [(None, texts[3]), (900, None), (901, " ")]
    found = near_duplicate_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == want | {900: 900, 901: 901}
    assert all(r["n_shingles"] == len(shingles(texts.get(r["doc_id"], texts[3]))) for r in found if r["doc_id"] not in (900, 901))


def test_rounds_of_pivots_may_end_at_any_time(spark, monkeypatch):
    texts = dense_group(120, seed=4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_components(texts)
    for pivots, fruitful, sent in ((1, 8, 2_000_000), (4, 10**9, 2_000_000), (2, 1, 3)):
        monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
        monkeypatch.setattr(near_dedup, "FRUITFUL", fruitful)
        monkeypatch.setattr(near_dedup, "SENT_IDS", sent)
        assert {r["doc_id"]: r["component_id"] for r in near_duplicate_digest(docs).collect()} == want


def test_one_document_with_several_texts(spark):
    texts = dense_group(60, seed=7)
    # Two ids carry a second text each, which may link elsewhere.
    rows = [*texts.items(), (3, texts[50].replace("word7 ", "other ")), (9, "entirely different words stand in this second text of the document")]
    found = near_duplicate_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components(texts)
    assert len(found) == 62
    linked = {r["doc_id"]: r["component_id"] for r in found}
    joined = {want[3], want[50]}
    assert all(linked[i] == (min(joined) if want[i] in joined else want[i]) for i in texts)


def test_tiles_grow_with_blocks(spark):
    for n in (100, 1000, 2000):
        known = spark.range(n).select(F.lit(1).cast("long").alias("band"), "id", F.col("id").alias("of"), F.lit(0).cast("long").alias("first_of"))
        sizes = spark.range(n).select("id", F.lit(10).alias("least"), F.lit(10).alias("most"))
        members = spark.range(n).select("id", F.lit(b"\0" * 4 * near_dedup.HASHES).alias("minima"))
        tiles = near_dedup._tiles(known, sizes, members)
        blocks = -(-n // near_dedup.BLOCK)
        assert tiles.count() <= blocks * (blocks + 1) // 2 + blocks
