"""Trades: outcome of bracketed entries, drawdowns, runs and metric packs over grouping sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratelake.operators.folds import ordered_fold
from ratelake.operators.quantiles import alike, quantiles


def first_touch(entries: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Exit of each long entry (symbol, i, stop, target): the first of the next ``horizon`` bars that touches stop or target, else the last.

    Bars have symbol, i (their running number), low, high and close. A bar that touches both counts as a stop.
    """
    path = entries.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("j", F.col("i") + F.col("k"))
    x = path.join(bars.select("symbol", F.col("i").alias("j"), "low", "high", "close"), ["symbol", "j"])
    reason = F.when(F.col("low") <= F.col("stop"), "stop").when(F.col("high") >= F.col("target"), "target").when(F.col("k") == horizon, "time")
    price = F.when(reason == "stop", F.col("stop")).when(reason == "target", F.col("target")).otherwise(F.col("close"))
    x = x.withColumns({"reason": reason, "price": price}).where("reason is not null")
    return x.groupBy("symbol", "i").agg(F.min("k").alias("held"), F.min_by("reason", "k").alias("reason"), F.min_by("price", "k").alias("exit_price"))


def drawdowns(pnl: DataFrame, by: str, at: str) -> DataFrame:
    """Running equity of each group, its highest and lowest so far, and the distances from these."""
    run = W.partitionBy(by).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    x = pnl.withColumn("equity", F.sum("pnl").over(run))
    x = x.withColumns({"peak": F.max("equity").over(run), "trough": F.min("equity").over(run)})
    return x.withColumns({"drawdown": F.col("equity") - F.col("peak"), "updraw": F.col("equity") - F.col("trough")})


def longest_runs(x: DataFrame, by: str, at: str, flag: str) -> DataFrame:
    """Longest run of true and of false of each group."""
    row = F.row_number().over(W.partitionBy(by).orderBy(at)) - F.row_number().over(W.partitionBy(by, flag).orderBy(at))
    runs = x.select(by, flag, row.alias("island")).groupBy(by, flag, "island").count()
    side = lambda v: F.coalesce(F.max(F.when(F.col(flag) == v, F.col("count"))), F.lit(0))
    return runs.groupBy(by).agg(side(True).alias("longest_true"), side(False).alias("longest_false"))


def metric_pack(pnl: str = "pnl") -> list[Column]:
    """Aggregates of trades: counts, win share, profit factor, mean, deviation, Sharpe by 252 days."""
    p = F.col(pnl)
    gain, loss = F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))
    return [
        F.count("*").alias("trades"),
        F.count_if(p > 0).alias("wins"),
        (100.0 * F.count_if(p > 0) / F.count("*")).alias("win_pct"),
        F.sum(p).alias("total"),
        F.avg(p).alias("mean"),
        F.when(loss > 0, gain / loss).alias("profit_factor"),
        F.when(F.stddev_pop(p) > 0, F.avg(p) / F.stddev_pop(p) * F.sqrt(F.lit(252.0))).alias("sharpe"),
    ]


def simulate(fires: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Exit of each fire (symbol, i, side, risk): in at the next bar's open, stop and targets at one and two times ``risk`` from there.

    From the bar after the entry on, the stop counts before the second target and that before the first; after ``horizon``
    bars, or with the last bar, the trade ends at the close. A fire on the last bar has no entry and gives no row, one without risk neither. Bars
    have symbol, i, open, high, low and close. ``worst`` and ``best`` are the excursions while held, in units of risk.
    """
    sign = F.when(F.col("side") == "SHORT", -1).otherwise(1)
    entry = bars.select("symbol", (F.col("i") - 1).alias("i"), F.col("open").alias("entry"))
    e = fires.where("risk <> 0").join(entry, ["symbol", "i"]).withColumn("sign", sign)
    path = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("j", F.col("i") + 1 + F.col("k"))
    x = path.join(bars.select("symbol", F.col("i").alias("j"), "low", "high", "close"), ["symbol", "j"])
    against = F.when(F.col("sign") > 0, F.col("entry") - F.col("low")).otherwise(F.col("high") - F.col("entry")) / F.col("risk")
    along = F.when(F.col("sign") > 0, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low")) / F.col("risk")
    reason = F.when(against >= 1, "stop").when(along >= 2, "target_2").when(along >= 1, "target_1").when(F.col("k") == horizon, "time")
    at_close = F.col("sign") * (F.col("close") - F.col("entry")) / F.col("risk")
    gain = F.when(reason == "stop", -1.0).when(reason == "target_2", 2.0).when(reason == "target_1", 1.0).otherwise(at_close)
    x = x.withColumns({"reason": reason, "gain": gain, "against": against, "along": along})
    ended = F.min(F.when(F.col("reason").isNotNull(), F.col("k"))).over(W.partitionBy("symbol", "i", "side"))
    held = x.withColumn("ended", ended).where("k <= coalesce(ended, k)")
    return held.groupBy("symbol", "i", "side").agg(F.max("k").alias("held"), F.coalesce(F.max_by("reason", "k"), F.lit("open")).alias("reason"), F.max_by("gain", "k").alias("gain"), F.max("against").alias("worst"), F.max("along").alias("best"))


def exits(fires: DataFrame, bars: DataFrame, setup: list[str], horizon: int = 60, multiples: tuple[float, float] = (1.0, 2.0)) -> DataFrame:
    """How a trade from each fire would end: setup, symbol, i, side, entry, stop, t1, t2, exit_i, exit_price, reason, held, mae_r, mfe_r and gain_r.

    Fires have setup, symbol, i, side (LONG or SHORT), stop and the nullable targets t1 and t2; bars have symbol, i (their
    running number), open, high, low and close. A trade enters at the next bar's open; a fire on the last bar, or with its
    stop at the entry, makes none. From the bar after the entry on, a bar ends it by the stop, the second target, the
    first, or a fire of the same setup the other way (then at the next open, if there is one); after ``horizon`` bars, or
    with the last, it ends at the close. Without t1 the targets stand at ``multiples`` of the risk, if the stop is on the
    right side. Excursions are those of the bars after the entry, in units of risk, and 0 at least.
    """
    key = [*setup, "symbol", "i", "side"]
    ordered = W.partitionBy("symbol").orderBy("i")
    b = bars.select("symbol", "i", "open", "high", "low", "close", F.lead("open").over(ordered).alias("next_open"), F.max("i").over(W.partitionBy("symbol")).alias("last"))
    sign = F.when(F.col("side") == "SHORT", -1).otherwise(1)
    e = fires.join(b.select("symbol", (F.col("i") - 1).alias("i"), F.col("open").alias("entry"), "last"), ["symbol", "i"]).where("abs(entry - stop) > 0")
    e = e.withColumns({"sign": sign, "room": F.least(F.lit(horizon), F.col("last") - F.col("i") - 1), "risk": F.abs(F.col("entry") - F.col("stop"))})
    right = F.col("t1").isNull() & (F.col("sign") * (F.col("entry") - F.col("stop")) > 0)
    target = lambda c, m: F.when(right & F.col(c).isNull(), F.col("entry") + m * F.col("risk") * F.col("sign")).otherwise(F.col(c))
    e = e.withColumns({"t1": target("t1", multiples[0]), "t2": target("t2", multiples[1])})
    path = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("room").cast("int")))).withColumn("j", F.col("i") + 1 + F.col("k"))
    x = path.join(b.select("symbol", F.col("i").alias("j"), "high", "low", "close", "next_open"), ["symbol", "j"])
    other = fires.select(*setup, "symbol", F.col("i").alias("j"), F.when(F.col("side") == "SHORT", "LONG").otherwise("SHORT").alias("side"), F.lit(True).alias("turns")).distinct()
    x = x.join(other, [*setup, "symbol", "j", "side"], "left")
    best, worst = F.when(F.col("sign") > 0, F.col("high")).otherwise(-F.col("low")), F.when(F.col("sign") > 0, F.col("low")).otherwise(-F.col("high"))
    turns = F.col("turns") & F.col("next_open").isNotNull()
    hit = F.when(worst <= F.col("sign") * F.col("stop"), "stop").when(best >= F.col("sign") * F.col("t2"), "t2").when(best >= F.col("sign") * F.col("t1"), "t1").when(turns, "reversal")
    reason = F.coalesce(F.when(F.col("k") > 0, hit), F.when(F.col("k") == F.col("room"), "time"))
    price = F.when(reason == "stop", F.col("stop")).when(reason == "t2", F.col("t2")).when(reason == "t1", F.col("t1")).when(reason == "reversal", F.col("next_open")).otherwise(F.col("close"))
    moved = lambda v: F.when(F.col("k") > 0, (v - F.col("sign") * F.col("entry")) / F.col("risk")).otherwise(0.0)
    x = x.withColumns({"reason": reason, "exit_price": price, "along": moved(best), "against": moved(worst)})
    x = x.withColumn("ended", F.min(F.when(F.col("reason").isNotNull(), F.col("k"))).over(W.partitionBy(*key))).where("k <= ended")
    fixed = ["entry", "stop", "t1", "t2", "sign", "risk"]
    y = x.groupBy(*key).agg(*(F.first(c).alias(c) for c in fixed), F.max_by(F.struct("reason", "exit_price", "k"), "k").alias("end"), F.least(F.min("against"), F.lit(0.0)).alias("mae_r"), F.greatest(F.max("along"), F.lit(0.0)).alias("mfe_r"))
    held = F.col("end.k") + (F.col("end.reason") == "reversal").cast("int")
    gain = F.col("sign") * (F.col("end.exit_price") - F.col("entry")) / F.col("risk")
    return y.select(*key, "entry", "stop", "t1", "t2", (F.col("i") + 1 + held).alias("exit_i"), "end.exit_price", "end.reason", held.alias("held"), "mae_r", "mfe_r", gain.alias("gain_r"))


def sequenced(trades: DataFrame, setup: list[str], cooldown: int = 3) -> DataFrame:
    """Of the trades that exits() finds, those that are taken: a setup is in one trade of a symbol and side at a time, and pauses for ``cooldown`` bars after it."""

    def step(state: list[int], part: pd.DataFrame) -> pd.DataFrame:
        taken = []
        for i, exit_i in zip(part["i"].tolist(), part["exit_i"].tolist()):
            taken.append(state[0] is None or i - state[0] > cooldown)
            if taken[-1]:
                state[0] = exit_i
        return part[taken]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.schema)
    return ordered_fold(trades, [*setup, "symbol", "side"], ["i"], lambda: [None], step, schema)


def full_pack(pnl: str = "pnl", risk: str = "risk") -> list[Column]:
    """Aggregates of trades: counts, shares, sums, averages of each side, ratios, moments, in money and in units of risk."""
    p, x = F.col(pnl), F.col(pnl) / F.nullif(F.col(risk), F.lit(0))
    up, down = F.when(p > 0, p), F.when(p < 0, p)
    gain, loss, n = F.sum(up), -F.sum(down), F.count("*")
    mean, sd = F.avg(p), F.stddev_pop(p)
    below = F.sqrt(F.avg(F.pow(F.least(p, F.lit(0.0)), 2)))
    return [
        n.alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.count_if(p == 0).alias("even"),
        (100.0 * F.count_if(p > 0) / n).alias("win_pct"), F.sum(p).alias("total"), mean.alias("mean"), sd.alias("deviation"),
        gain.alias("gain"), loss.alias("loss"), F.avg(up).alias("mean_win"), (-F.avg(down)).alias("mean_loss"), F.max(p).alias("best"), F.min(p).alias("worst"),
        F.when(loss > 0, gain / loss).alias("profit_factor"), F.when(F.avg(down) < 0, -F.avg(up) / F.avg(down)).alias("payoff"), mean.alias("expectancy"),
        F.when(sd > 0, mean / sd * F.sqrt(F.lit(252.0))).alias("sharpe"), F.when(below > 0, mean / below * F.sqrt(F.lit(252.0))).alias("sortino"),
        F.avg(x).alias("mean_r"), F.sum(x).alias("total_r"), F.stddev_pop(x).alias("deviation_r"), F.count_if(x >= 1).alias("above_1r"), F.count_if(x >= 2).alias("above_2r"), F.count_if(x <= -1).alias("below_1r"),
    ]


def full_metric_pack(rows: DataFrame, keys: list[str], pnl: str = "pnl", risk: str = "risk", few: bool = False) -> DataFrame:
    """The full pack per ``keys`` with its quantiles, which no task takes from a whole group; null where a group has no result. ``few``: as for quantiles()."""
    probs = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    q = quantiles(rows, keys, {"money": F.col(pnl), "r": F.col(pnl) / F.nullif(F.col(risk), F.lit(0))}, probs, few)
    q = q.select(*keys, *(F.col(f"money_{p}").alias(p) for p in probs), F.col("r_median").alias("median_r"))
    return alike(rows.groupBy(*keys).agg(*full_pack(pnl, risk)), q, keys, "left")
