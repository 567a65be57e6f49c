"""Exact quantiles by cells against numpy, on values of every kind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.operators.quantiles import _cells, quantiles

PROBS = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def groups():
    rng = np.random.default_rng(3)
    return {
        "one": [7.25],
        "two": [1.0, 2.0],
        "same": [0.1] * 999 + [0.2],
        "near": (1 + rng.integers(0, 5000, 4000) * 2.0**-52).tolist(),
        "wide": (rng.choice([-1, 1], 3000) * 10.0 ** rng.uniform(-300, 300, 3000)).tolist(),
        "tiny": [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, -2.2e-308, 1e-310] * 3,
        "edges": [s * 2.0**k * (1 + d) for s in (-1, 1) for k in range(-5, 60) for d in (0, 2**-52, -(2**-53))],
        "cents": np.round(rng.normal(0, 500, 5000), 2).tolist(),
        None: rng.normal(3, 1, 50).tolist(),
    }


def test_quantiles_equal_numpy(spark):
    rows = [(k, float(v), -float(v) if i % 2 else None) for k, vs in groups().items() for i, v in enumerate(vs)] + [("none", None, None), ("same", None, 1.0)]
    x = spark.createDataFrame(rows, "k string, v double, w double").repartition(7)
    got = {r["k"]: r for r in quantiles(x, ["k"], {"v": F.col("v"), "w": F.col("w")}, PROBS).collect()}
    assert set(got) == set(groups())
    for k in got:
        for c, i in (("v", 1), ("w", 2)):
            mine = [r[i] for r in rows if r[0] == k and r[i] is not None]
            for label, p in PROBS.items():
                value = got[k][f"{c}_{label}"]
                assert value is None if not mine else value == pytest.approx(float(np.quantile(mine, p)), rel=1e-12, abs=1e-320), (k, c, label)


def test_outer_values_integers_and_empty_tables(spark):
    x = spark.createDataFrame([("a", v) for v in (-math.inf, -math.inf, 1.0, 2.0, math.inf, math.inf, math.nan)], "k string, v double")
    r = quantiles(x, ["k"], {"v": F.col("v")}, {"lo": 0.0, "mid": 0.5, "hi": 5 / 6, "top": 1.0}).first()
    assert (r["v_lo"], r["v_mid"], r["v_hi"]) == (-math.inf, 2.0, math.inf) and math.isnan(r["v_top"])
    whole = quantiles(spark.range(100).withColumn("k", F.lit(1)), ["k"], {"id": F.col("id")}, {"p": 0.25}).first()
    assert whole["id_p"] == 24.75
    assert quantiles(x.limit(0), ["k"], {"v": F.col("v")}, PROBS).count() == 0


def test_cells_follow_the_order_of_values(spark):
    values = sorted({float(v) for vs in groups().values() for v in vs})
    x = _cells(spark.createDataFrame([(v,) for v in values], "_v double")).orderBy("_v")
    cells = [(r["_c1"], r["_c2"]) for r in x.collect()]
    assert cells == sorted(cells) and len(set(cells)) > 3000


def test_few_groups_broadcast_their_cells_and_do_not_shuffle_rows(spark, capsys):
    x = spark.range(3000).select((F.col("id") % 2).alias("k"), F.sqrt("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = quantiles(x, ["k"], {"v": F.col("v")}, PROBS, few=True)
        few.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(few.collect()) == sorted(quantiles(x, ["k"], {"v": F.col("v")}, PROBS).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
