"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ratelake.llm.collocations import collocations
from ratelake.llm.decontamination import contamination_digest
from ratelake.llm.fill_middle import fill_in_middle_digest
from ratelake.llm.language_id import language_id
from ratelake.llm.maxent_lm import lm_scores
from ratelake.llm.mixing import mix_sources
from ratelake.llm.near_dedup import near_duplicate_digest
from ratelake.llm.ogg_media import ogg_digest
from ratelake.llm.oracle import ORACLE_SQL  # noqa: F401
from ratelake.llm.quality import quality_grades
from ratelake.llm.suffix_dedup import repeat_digest
from ratelake.llm.token_counts import token_counts
from ratelake.llm.token_files import token_file_digest
from ratelake.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_digest(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_digest(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digest(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_url_filter,
        op3_decontamination,
        op4_language_id,
        op5_lm_scoring,
        op6_mixing,
        op7_suffix_dedup,
        op8_near_dedup,
        op9_quality,
        op10_ogg_media,
        op11_fill_in_middle,
        op12_collocations,
        op13_token_files,
    )
}
