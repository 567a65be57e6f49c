"""A pipeline over documents: language ID, near-dedup, suffix dedup, decontamination, mixing.

Each stage is written as Parquet and read again by the next. All but the last return the columns of documents.
Every stage judges whatever rows it gets: null texts have no language and go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm.decontamination import find_contamination
from ratelake.llm.language_id import UNDETERMINED, fit, held_out, identify
from ratelake.llm.mixing import mix_sources
from ratelake.llm.near_dedup import near_duplicates
from ratelake.llm.shared_store import stored
from ratelake.llm.suffix_dedup import remove_repeats

#: A text goes if no language reaches this mean posterior over its words.
LEAST_LANGUAGE = 0.3


def _text_key() -> Column:
    """With the id, what a row is known by: rows that share an id are judged one by one, and equal rows alike."""
    return F.unhex(F.md5("text"))


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, as a pair of id and text key, and text of every row."""
    return docs.select(F.struct("doc_id", _text_key().alias("text_key")).alias("doc_id"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents that are not among ``rows`` (columns doc_id and text_key); a null id stays."""
    gone = rows.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_gone")) & _text_key().eqNullSafe(F.col("_gone_key")), "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in some language that the labels teach; without any labels all stay."""
    model = fit(docs.where(~held_out(4, 2)))
    if not model.languages:
        return docs
    found = identify(_judged(docs), model)
    return _without(docs, found.where((F.col("lang_pred") == UNDETERMINED) | (F.col("score") < LEAST_LANGUAGE)).select("doc_id.*"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    found = near_duplicates(docs.select("doc_id", "text", _text_key().alias("text_key")), ("text_key",))
    return _without(docs, found.where("doc_id <> component_id"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of passages that stand earlier; those of which nothing is left go.

    Bytes of a character that is cut apart go as a whole.
    """
    columns = tuple(docs.columns)
    left = remove_repeats(docs, columns, characters=True)
    whole = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    left = left.where("size(spans) = 0 or octet_length(kept) > 0").withColumn("text", whole)
    return left.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark stands."""
    found = find_contamination(_judged(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("size(spans) > 0").select("doc_id.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage applied to all that the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else stored(out)
    return docs
