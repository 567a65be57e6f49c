"""Every query that has SQL against what DuckDB makes of that SQL."""

import math

import duckdb
import pytest

from ratelake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def same(spark, root, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    df = query(spark, root)
    columns = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == columns
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(tuple(map(plain, r)) for r in found) == sorted(tuple(map(plain, r)) for r in expected)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    same(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
