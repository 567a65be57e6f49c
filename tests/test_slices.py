"""Calendar slices, as registered, over trades with gaps and of one kind alone, against a plain loop and their SQL."""

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from math import sqrt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

COLUMNS = ["year", "month", "weekday", "trades", "wins", "win_pct", "total", "profit_factor", "sharpe"]
DAY = dt.datetime(1996, 2, 26)  # a Monday, three days before the leap day


def lines():
    """Price, discount and time of shipping."""
    mixed = [(100.25 + 7 * i, i % 11 / 100, DAY + dt.timedelta(days=i % 40, hours=i % 24)) for i in range(1500)]
    wins, losses, even = ([(200.5, d, dt.datetime(1997, 6, 3))] * 3 for d in (0.01, 0.09, 0.05))
    losses, even = [(p, d, t + dt.timedelta(1)) for p, d, t in losses], [(p, d, t + dt.timedelta(2)) for p, d, t in even]
    edges = [(50.0, 0.02, dt.datetime(1995, 12, 31, 23, 59, 59, 999999)), (50.0, 0.07, dt.datetime(1996, 1, 1))]
    gaps = [(None, 0.02, DAY), (80.0, None, DAY), (80.0, 0.03, None), (90.0, 0.08, None), (None, 0.02, dt.datetime(1998, 1, 1))]
    return [*mixed, *wins, *losses, *even, *edges, *gaps]


def half_up(v, digits):
    return None if v is None else float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def plain(rows):
    groups = defaultdict(list)
    for price, discount, at in rows:
        gain = None if price is None or discount is None else half_up(price * (0.05 - discount), 4)
        groups[(at.year, at.month, f"{at:%A}") if at else (None, None, None)].append(gain)
    for key, all_gains in groups.items():
        gains = [Decimal(repr(g)) for g in all_gains if g is not None]
        n, wins, up, down = len(all_gains), sum(g > 0 for g in gains), sum(g for g in gains if g > 0), -sum(g for g in gains if g < 0)
        mean = sum(gains) / len(gains) if gains else None
        deviation = (sum((g - mean) ** 2 for g in gains) / len(gains)).sqrt() if gains else 0
        factor = up / down if down > 0 and wins else None
        yield key, (n, wins, half_up(100 * wins / n, 4), half_up(sum(gains) if gains else None, 4), half_up(factor, 6), half_up(float(mean / deviation) * sqrt(252) if deviation > 0 else None, 6))


def write(spark, root, parts):
    x = spark.createDataFrame(lines(), "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz")
    x = x.select(F.monotonically_increasing_id().alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), "*")
    x.repartition(parts).write.parquet(f"{root}/lineitem.parquet")


def slices(spark, root):
    return {tuple(r[:3]): tuple(r[3:]) for r in entry.queries()["calendar_slices"](spark, str(root)).select(*COLUMNS).collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_calendar_slices_equal_a_plain_loop(spark, tmp_path, parts):
    write(spark, tmp_path, parts)
    assert slices(spark, tmp_path) == dict(plain(lines()))


def test_calendar_slices_equal_their_sql(spark, tmp_path):
    write(spark, tmp_path, 3)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rows = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({entry.oracle_sql()['calendar_slices']})").fetchall()
    assert slices(spark, tmp_path) == {r[:3]: r[3:] for r in rows} and len({r[:3] for r in rows}) == len(rows)
