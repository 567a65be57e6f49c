"""URL filter: rules on host and path, and for all other urls a ratio of two character Markov models of the whole url.

Urls that a rule allows or blocks are the accepted and rejected examples. Each class gets a variable-order model of
characters: counts of contexts of two, one and no characters, smoothed by Witten-Bell weights, so that a longer context
counts as much as it was seen. A url's score is the difference of the two log-likelihoods over its length; scores of
both classes' examples calibrate it (two normal densities with one variance, so a logistic curve between their means).

Characters are folded to 42 symbols, so a model is one array of 42^3 numbers whatever the corpus: that bound is
what makes it fit to go to every task as a scalar. All steps are DataFrame functions.

A null url or one without ``://`` has empty host and path, and no rule; the model judges the latter by its characters like
any other. Where a class has no example or the scores don't
differ, what no rule decides is allowed. Repeated rows are judged row by row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Digits share one symbol, all characters beyond these one, and 0 stands before the first.
ALPHABET = "abcdefghijklmnopqrstuvwxyz/.-_?&=#%:~+,@"
SYMBOLS = 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host, A-Z lower-cased, up to ``/ ? #`` or the end; the path then up to ``? #`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent of it and the path's start, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def symbols(text: Column) -> Column:
    """The text as symbol numbers, two zeros ahead."""
    folded = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[0-9]", "0")
    one = lambda c: F.when(c == "0", F.lit(1)).otherwise(F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), c), F.lit(0)) + 1, F.lit(SYMBOLS - 1)))
    chars = F.filter(F.split(folded, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0), F.lit(0)), F.transform(chars, lambda c: F.coalesce(one(c), F.lit(SYMBOLS - 1))))


def train_ratio_model(examples: DataFrame) -> DataFrame:
    """One row: ``model``, log P(accepted) - log P(rejected) of each symbol after each pair of symbols, by number.

    ``examples`` has ``codes`` (from symbols()) and ``accepted``. Counts are summed where the urls lie; beyond that step
    every table here has at most 2 * SYMBOLS^3 rows.
    """
    at = F.explode(F.sequence(F.lit(2), F.size("codes") - 1))
    grams = examples.where(F.size("codes") > 2).select("accepted", "codes", at.alias("i"))
    pick = lambda k: F.expr(f"codes[i - {k}]")
    counts = grams.groupBy("accepted", pick(2).alias("a"), pick(1).alias("b"), pick(0).alias("c")).agg(F.count("*").alias("n"))
    # Every context that any example has, with every symbol: what a class has not seen gets its smoothed share.
    grid = counts.select("a", "b").distinct().withColumn("accepted", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(SYMBOLS - 1))))
    full = grid.join(counts, ["accepted", "a", "b", "c"], "left").fillna(0, ["n"])
    # Orders 0 and 1 sum over contexts; the sums stand beside each row.
    over = lambda *keys: W.partitionBy("accepted", *keys)
    n1, n0 = F.sum("n").over(over("b", "c")), F.sum("n").over(over("c"))
    t2, t1, t0 = (F.sum("n").over(over(*keys)) for keys in (("a", "b"), ("b",), ()))
    x = full.select("*", n1.alias("n1"), n0.alias("n0"), t2.alias("t2"), t1.alias("t1"), t0.alias("t0"))
    kinds = lambda n, *keys: F.size(F.collect_set(F.when(F.col(n) > 0, F.col("c"))).over(over(*keys)))
    x = x.select("*", kinds("n", "a", "b").alias("k2"), kinds("n1", "b").alias("k1"), kinds("n0").alias("k0"))
    p0 = (F.col("n0") + F.col("k0") / (SYMBOLS - 1)) / F.greatest(F.col("t0") + F.col("k0"), F.lit(1))
    p0 = F.when(F.col("t0") > 0, p0).otherwise(1.0 / (SYMBOLS - 1))
    p1 = F.when(F.col("t1") > 0, (F.col("n1") + F.col("k1") * p0) / (F.col("t1") + F.col("k1"))).otherwise(p0)
    p2 = F.when(F.col("t2") > 0, (F.col("n") + F.col("k2") * p1) / (F.col("t2") + F.col("k2"))).otherwise(p1)
    x = x.select("accepted", "a", "b", "c", F.log(p2).alias("lp"), F.log(p1).alias("lp1"))
    ratio = lambda p: F.sum(F.when(F.col("accepted"), F.col(p)).otherwise(-F.col(p)))
    r = x.groupBy("a", "b", "c").agg(ratio("lp").alias("r"), ratio("lp1").alias("r1"))
    row = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("c", v))), lambda s: s[v])
    rows = r.groupBy("a", "b").agg(row("r").alias("r"), row("r1").alias("r1"))
    # An unseen context falls back on its last symbol's row, an unseen symbol on no difference.
    place = F.expr(f"a * {SYMBOLS} + b")
    one = rows.groupBy("b").agg(F.first("r1").alias("r1")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(SYMBOLS - 1))))
    cells = one.join(rows.drop("r1"), ["a", "b"], "left").select(place.alias("place"), F.coalesce("r", "r1").alias("r"))
    zero = F.array_repeat(F.lit(0.0), SYMBOLS - 1)
    listed = cells.agg(F.array_sort(F.collect_list(F.struct("place", "r"))).alias("cells"))
    return listed.select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS * SYMBOLS - 1)), lambda i: F.concat(F.array(F.lit(0.0)), F.coalesce(F.element_at(F.map_from_entries("cells"), i), zero)))).alias("model"))


def url_scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """The input's columns with ``score``: the log-likelihood ratio per character (0 for an empty text)."""
    return urls.withColumn("_model", model.scalar()).withColumn("score", _score("codes", "_model")).drop("_model")


def _score(codes: str, model: str) -> Column:
    step = f"{model}[{codes}[i - 2] * {SYMBOLS * SYMBOLS} + {codes}[i - 1] * {SYMBOLS} + {codes}[i]]"
    return F.expr(f"if(size({codes}) > 2, aggregate(sequence(2, size({codes}) - 1), 0D, (acc, i) -> acc + {step}) / (size({codes}) - 2), 0D)")


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and p_block of every page's url."""
    host, path = host_and_path(F.col("url"))
    x = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), symbols(F.coalesce("url", F.lit(""))).alias("codes"))
    examples = x.where("ruled is not null").select((F.col("ruled") == "allow").alias("accepted"), "codes")
    model = train_ratio_model(examples)
    side = lambda f, yes: f(F.when(F.col("accepted") == yes, F.col("score")))
    fit = url_scores(examples, model).agg(side(F.avg, True).alias("good"), side(F.avg, False).alias("bad"), side(F.var_pop, True).alias("v1"), side(F.var_pop, False).alias("v0"))
    spread = F.greatest((F.col("v1") + F.col("v0")) / 2, F.lit(1e-9))
    fit = fit.select(F.struct(((F.col("good") - F.col("bad")) / spread).alias("slope"), ((F.col("good") + F.col("bad")) / 2).alias("middle")).alias("fit"))
    scored = url_scores(x, model).withColumn("fit", fit.scalar())
    p_block = F.when(F.col("fit.slope") > 0, 1 / (1 + F.exp(F.col("fit.slope") * (F.col("score") - F.col("fit.middle"))))).otherwise(0.0)
    scored = scored.withColumn("p_block", F.coalesce(p_block, F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("p_block") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "p_block")
