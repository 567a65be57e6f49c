"""Nearest vectors against brute force: copies that tie, parts, rows without a distance, halves in rounding."""

import numpy as np
from pyspark.sql import functions as F

from ratelake.operators import nearest as nn

SCHEMA = "vec_id long, embedding array<float>"


def test_parts_and_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "PART", 150)
    monkeypatch.setattr(nn, "AT_ONCE", 3)
    x = np.random.default_rng(3).normal(size=(700, 6)).astype(np.float32)
    x[200:400] = x[7]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = nn.nearest(vectors.where("vec_id % 50 = 0"), vectors, 10).collect()
    expected = set()
    for q in range(0, 700, 50):
        d2 = np.round(((x[q].astype(float) - x) ** 2).sum(1), 6)
        order = [i for i in np.lexsort((np.arange(700), d2)).tolist() if i != q][:10]
        expected |= {(q, i, place) for place, i in enumerate(order, 1)}
    assert {(r["query_id"], r["vec_id"], r["place"]) for r in got} == expected and len(got) == 140


def test_distances_come_from_products_of_blocks_not_from_a_join(spark, capsys):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(5)], SCHEMA)
    nn.nearest(vectors.where("vec_id % 50 = 0"), vectors, 2).explain()
    assert "MapInArrow" in (plan := capsys.readouterr().out) and "Cartesian" not in plan and "NestedLoop" not in plan


def test_vectors_without_a_distance_come_last(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [1.0]), (4, [3.0, 4.0]), (5, [float("inf"), 0.0]), (None, [0.0, 0.0]), (50, None)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in nn.nearest(vectors.where("vec_id % 50 = 0"), vectors, 4).orderBy("query_id", "place").collect()]
    assert got == [(0, 4, 25.0, 1), (0, 5, float("inf"), 2), (0, 1, None, 3), (0, 2, None, 4), (50, 0, None, 1), (50, 1, None, 2), (50, 2, None, 3), (50, 3, None, 4)]
    assert nn.nearest(vectors.limit(0), vectors.limit(0), 4).count() == 0


def test_rounding_is_sparks(spark):
    x = [*np.random.default_rng(1).random(500).tolist(), 0.0000005, 1.0000015, 2.6750005, 123456.7890125, 5e11 + 0.25, float("inf")]
    expected = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").coalesce(1).select(F.round("v", 6)).collect()]
    assert nn._rounded(np.array(x)).tolist() == expected
