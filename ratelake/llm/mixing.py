"""Mixing sources to target weights with DataFrame operations alone.

Every document gets a hash-random key. Within its source, documents are ordered by that key in ranges: a range holds
the documents whose key has the same leading digits, so no source, however large, meets in one task. Sums per range and
their running totals give each range its offset, a window inside each range gives each document its own, and the
source's budget is cut there: whole epochs first, then the prefix of the order that fills the rest to the word.

Null texts have size 0; a null source is a source of its own, ordered last. Repeated rows are documents of their own
(equal rows may swap places, which leaves the result the same). Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hexadecimal digits of a key that make its range, so 4096 ranges in a source.
DIGITS = 3


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source: its target of words. ``sizes`` has source and source_size.

    Targets share the total by weight; those above ``max_repeats`` times their source's size stop there and the excess is
    shared again. In ascending order of limit to weight, a source stops if its limit is not above its share of what the
    sources before it leave, so one running sum finds all that stop.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * max_repeats)
    x = x.withColumn("ratio", F.col("limit") / F.col("weight"))
    everything, before = W.partitionBy(), by_ratio.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    x = x.withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("stops", F.col("limit") * F.col("rest_weight") <= F.col("weight") * F.col("rest"))
    # Those that stop come first in this order; the first that does not tells the share of all others.
    free = ~F.col("stops")
    rest, rest_weight = F.max(F.when(free, F.col("rest"))).over(everything), F.max(F.when(free, F.col("rest_weight"))).over(everything)
    return x.select("source", "source_size", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("weight") * rest / rest_weight).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, digits: int = DIGITS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes from it, repeats counted) of every document."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")))
    x = docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"), key.alias("key"))
    x = x.withColumn("range", F.substring("key", 1, digits))
    parts = x.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sizes = parts.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats).withColumnRenamed("source", "of")
    ahead = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("ahead", ahead).join(targets, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("range").alias("at"), "ahead", "source_size", "target")
    inside = W.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    x = x.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    left = words - epochs * F.col("source_size")
    cut = F.least(F.greatest(left - F.col("ahead") - F.col("inside"), F.lit(0)), F.col("size"))
    return x.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def take_mix(docs: DataFrame, mix: DataFrame, by: str = "doc_id") -> DataFrame:
    """Documents as the mix takes them: one row per started epoch, the last cut after its words.

    A text that is cut has its words joined by single spaces. ``by`` must be unique in ``docs``. Rows of documents that the mix leaves out are gone; the columns stay.
    """
    share = mix.select(F.col(by).alias("_by"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    x = docs.join(share, F.col(by).eqNullSafe(F.col("_by"))).where("_taken > 0")
    x = x.withColumn("_epoch", F.explode(F.expr("sequence(0L, (_taken - 1) div _size)")))
    words = F.expr("least(_size, _taken - _epoch * _size)")
    first_words = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), words.cast("int")), " ")
    cut = F.when(words == F.col("_size"), F.col("text")).otherwise(first_words)
    return x.withColumn("text", cut).select(*docs.columns)
