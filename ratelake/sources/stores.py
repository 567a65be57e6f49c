"""Tables on disk: dated panels with a manifest, a ledger that replaces its own day, exports, commented CSV files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_panel(df: DataFrame, root: str, asof: str, by: list[str], force: bool = False) -> str:
    """One folder a date, partitioned by ``by``, with a one-row JSON manifest beside it; what is already complete stays as it is unless forced.

    The manifest goes before the data are written anew and is written last, so a broken write is never taken for a whole one.
    """
    spark, path = df.sparkSession, f"{root}/asof={asof}"
    done, files = _files(spark, f"{path}/_manifest/_SUCCESS")
    if files.exists(done) and not force:
        return path
    files.delete(done.getParent(), True)
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/data")
    facts = {"asof": asof, "by": by, "columns": df.columns}
    rows = spark.read.parquet(f"{path}/data").agg(F.count("*").alias("rows"), F.lit(json.dumps(facts)).alias("facts"))
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return path


def read_panel(spark: SparkSession, root: str, asof: str) -> DataFrame:
    return spark.read.parquet(f"{root}/asof={asof}/data")


def read_manifest(spark: SparkSession, root: str, asof: str) -> dict:
    row = spark.read.json(f"{root}/asof={asof}/_manifest").first()
    return json.loads(row["facts"]) | {"rows": row["rows"]}


def keep_latest(spark: SparkSession, root: str, keep: int = 6) -> list[str]:
    """Dates that stay: the ``keep`` latest; the folders of older ones go."""
    where, files = _files(spark, root)
    dates = sorted(f.getPath().getName()[5:] for f in files.listStatus(where) if f.getPath().getName().startswith("asof="))
    for d in dates[: -keep or None]:
        files.delete(_files(spark, f"{root}/asof={d}")[0], True)
    return dates[-keep:]


def update_ledger(rows: DataFrame, path: str, day: str) -> DataFrame:
    """Append rows to a ledger partitioned by ``day``; days that the rows hold are replaced, so a rerun changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return rows.sparkSession.read.parquet(path)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """A table of the full schema without rows."""
    return spark.createDataFrame([], schema)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and lines that begin with ``#``."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def latest_bar(bars: DataFrame, at: str = "bar_date") -> DataFrame:
    return bars.agg(F.max(at).alias(at))


def live_symbols(bars: DataFrame, days: int = 7) -> DataFrame:
    """Symbols whose last bar is within so many days of the latest of all."""
    last = bars.groupBy("symbol").agg(F.max("bar_date").alias("last"))
    latest = bars.agg(F.max("bar_date").alias("m")).scalar()
    return last.withColumn("_latest", latest).where(F.datediff("_latest", "last") <= days).drop("_latest")
