"""What releases did to instruments: closes at eleven anchors around each release, moves between them, their medians by state and window, and how these drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ZONE = "America/New_York"

# Each measure with the anchor it ends at and the anchor it starts from.
MEASURES = {
    "anticipation_full": ("pre", "before_open"),
    "anticipation_overnight": ("open", "before_close"),
    "anticipation_morning": ("pre", "open"),
    "release_impulse": ("post_1h", "pre"),
    "release_immediate_2h": ("post_2h", "pre"),
    "release_short_4h": ("post_4h", "pre"),
    "release_day_end": ("close", "pre"),
    "next_day_open_gap": ("after_open", "close"),
    "next_day_full": ("after_close", "close"),
    "full_t_to_tp1": ("after_close", "pre"),
    "full_window": ("after_close", "before_open"),
}
HOURS = {"pre": -1, "at": 0, "post_1h": 1, "post_2h": 2, "post_4h": 4}
WINDOWS = {"3m": 90, "6m": 180, "12m": 360}  # days back from the date of judgement


def half_days(bars: DataFrame, zone: str = ZONE, lookback: int = 20) -> DataFrame:
    """One row per symbol and local half day (``half`` 0 before noon, 1 from noon on): first and last close, bars, and the bars before the first.

    The window runs over a symbol's hourly bars, so its size is bounded by the calendar; it carries one more bar than ``lookback``.
    """
    w = W.partitionBy("symbol").orderBy("bar_time")
    gap = F.lag("close").over(w)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - gap), F.abs(F.col("low") - gap))
    x = bars.where("symbol is not null and bar_time is not null and close is not null").select("symbol", "bar_time", "high", "low", "close")
    x = x.withColumn("reach", reach).withColumn("prior", F.collect_list(F.struct("bar_time", "reach")).over(w.rowsBetween(-lookback - 1, -1)))
    local = F.from_utc_timestamp("bar_time", zone)
    first = F.min_by(F.struct("close", "prior"), "bar_time")
    g = x.groupBy("symbol", F.to_date(local).alias("day"), (F.hour(local) >= 12).cast("int").alias("half"))
    return g.agg(first.alias("f"), F.max_by("close", "bar_time").alias("last"), F.count("*").alias("bars")).select("symbol", "day", "half", F.col("f.close").alias("first"), "f.prior", "last", "bars")


def _prior_range(prior: Column, start: Column, least: int) -> Column:
    """Mean true range of the bars from ``start`` on; the earliest of them has no close before it. Null below ``least`` bars."""
    inside = F.filter(prior, lambda b: b["bar_time"] >= start)
    ranges = F.transform(F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))), lambda b: b["reach"])
    total = F.aggregate(ranges, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(inside) >= least, F.try_divide(total, F.size(ranges)))


def release_moves(releases: DataFrame, bars: DataFrame, keys: list[str], at: str, *, zone: str = ZONE, pad: int = 3, lookback: int = 20, least: int = 5, floor: float = 0.005, scale: float = 100.0, full_session: int = 12) -> DataFrame:
    """One row per release and symbol that has bars near it: range, flags, and each measure in basis points and in ranges.

    ``releases`` have ``keys`` (without a name of the result) and the UTC time ``at``; equal rows count once, rows without a time are left out. ``bars`` are
    hourly (symbol, bar_time in UTC, high, low, close). A release sees the bars of its local day, the day before and the day after,
    and ``pad`` half days more on both sides: where the day before (after) has no bars, the nearest day with some takes its place.
    ``atr`` is the mean of the last ``lookback`` true ranges before the first bar of the day before; moves are divided by it, or by
    ``floor`` where it is less. A missing anchor makes its measures null; ``partial_t`` and ``partial_tp1`` tell that the release's
    day and the next calendar day have fewer than ``full_session`` bars.

    Both sides meet on (day, half) and on the hour: equi-joins with 6 + 2 * pad and 5 rows a release, then one aggregation.
    """
    e = releases.select(*keys, F.col(at).cast("timestamp").alias("_at")).where("_at is not null").distinct()
    e = e.withColumn("_day", F.to_date(F.from_utc_timestamp("_at", zone)))
    halves = half_days(bars, zone, lookback)
    step = F.explode(F.sequence(F.lit(-2 - pad), F.lit(3 + pad))).alias("_step")
    spread = e.select(*keys, "_at", "_day", step).withColumn("day", F.date_add("_day", F.floor(F.col("_step") / 2).cast("int"))).withColumn("half", F.pmod("_step", F.lit(2)))
    near = spread.join(halves, ["day", "half"]).select(*keys, "_at", "_day", "symbol", "_step", F.floor(F.col("_step") / 2).alias("_off"), F.struct("first", "last", "bars", "prior").alias("_b"))
    hour = F.explode(F.array(*map(F.lit, HOURS.values()))).alias("_hour")
    hourly = e.select(*keys, "_at", "_day", hour).withColumn("bar_time", F.timestamp_micros(F.unix_micros(F.date_trunc("hour", "_at")) + F.col("_hour") * 3_600_000_000))
    hourly = hourly.join(bars.where("symbol is not null and close is not null").select("symbol", "bar_time", "close"), "bar_time").select(*keys, "_at", "_day", "symbol", "_hour", "close")

    off, step, b = F.col("_off"), F.col("_step"), F.col("_b")
    before, on, after = off < 0, off == 0, off > 0
    pick = lambda f, c, order, where: f(F.when(where, c), F.when(where, order))
    anchors = [
        pick(F.max_by, b, F.struct(off, -step), before).alias("_before"),
        pick(F.max_by, b["last"], step, before).alias("before_close"),
        pick(F.min_by, b["first"], step, on).alias("open"),
        pick(F.max_by, b["last"], step, on).alias("close"),
        pick(F.min_by, b["first"], step, after).alias("after_open"),
        pick(F.min_by, b["last"], F.struct(off, -step), after).alias("after_close"),
        F.coalesce(F.sum(F.when(on, b["bars"])), F.lit(0)).alias("_t"),
        F.coalesce(F.sum(F.when(off == 1, b["bars"])), F.lit(0)).alias("_tp1"),
        *(F.max(F.when(F.col("_hour") == h, F.col("_close"))).alias(n) for n, h in HOURS.items()),
    ]
    x = near.unionByName(hourly.withColumnRenamed("close", "_close"), allowMissingColumns=True).groupBy(*keys, "_at", "_day", "symbol").agg(*anchors)
    start = F.to_utc_timestamp(F.date_add("_day", -1).cast("timestamp") - F.expr(f"interval {12 * pad} hours"), zone)
    x = x.withColumn("atr", _prior_range(F.col("_before.prior"), start, least)).withColumn("before_open", F.col("_before.first"))
    unit = F.when(F.col("atr") > 0, F.greatest(F.col("atr"), F.lit(floor)) * scale)
    moves = {m: (F.col(end) - F.col(begin)) * scale for m, (end, begin) in MEASURES.items()}
    return x.select(
        *keys, F.col("_at").alias("released"), F.col("_day").alias("release_day"), "symbol", "atr",
        F.coalesce(F.col("atr").between(0, floor) & (F.col("atr") > 0) & (F.col("atr") < floor), F.lit(False)).alias("floored"),
        (F.col("_t") < full_session).alias("partial_t"), (F.col("_tp1") < full_session).alias("partial_tp1"),
        *(m.alias(f"{n}_bp") for n, m in moves.items()), *((m / unit).alias(f"{n}_norm") for n, m in moves.items()),
    )


def state_summary(moves: DataFrame, keys: list[str], asof, windows: dict[str, int] = WINDOWS, low: int = 3) -> DataFrame:
    """Per ``keys`` (null in none of them), measure and window of days back from ``asof`` (a date's text or a column of ``moves``; and ``full``): medians, quartiles and the last three days.

    ``moves`` are rows of release_moves. Only measures with a value in ranges count; a window without any has no row. A group holds the
    releases of one kind in one state, which the calendar bounds, so exact quantiles fit a task.
    """
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"{m}_bp").alias("bp"), F.col(f"{m}_norm").alias("norm")) for m in MEASURES))).alias("m")
    day = F.lit(asof).cast("date") if isinstance(asof, str) else asof
    x = moves.dropna(subset=keys).select(*keys, "release_day", day.alias("_asof"), long).where("m.norm is not null")
    kept = F.filter(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in {"full": None, **windows}.items())), lambda w: w["d"].isNull() | (F.col("release_day") >= F.date_sub("_asof", w["d"])))
    x = x.select(*keys, "release_day", "m.*", F.explode(F.transform(kept, lambda w: w["n"])).alias("window"))
    p = lambda q: F.percentile("norm", F.lit(q))
    latest = F.array_join(F.array_sort(F.slice(F.sort_array(F.collect_list(F.date_format("release_day", "yyyy-MM-dd")), False), 1, 3)), ";")
    g = x.groupBy(*keys, "measure", "window").agg(F.count("*").alias("n"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.75).alias("p75"), F.percentile("bp", F.lit(0.5)).alias("median_bp"), F.avg((F.abs("norm") > 1).cast("int")).alias("above_one"), latest.alias("latest"))
    return g.withColumn("low_sample", F.col("n") < low)


def drift_tags(summary: DataFrame, keys: list[str], recent: str, windows: dict[str, int] = WINDOWS, fading: float = 0.5, growing: float = 1.0, least: float = 0.1) -> DataFrame:
    """Per ``keys`` and measure of a state_summary: medians by window, their distance from the full one in full interquartile ranges, and a tag.

    REVERSING: the ``recent`` median has the other sign; GROWING: it is more than ``growing`` ranges off; FADING: less than ``fading``
    off a median beyond ``least``; else STABLE, as where a median or a range lacks. Distances are rounded to nine digits first, so a tie is
    neither GROWING nor FADING however sums are rounded.
    """
    of = lambda c, w: F.max(F.when(F.col("window") == w, F.col(c)))
    g = summary.groupBy(*keys, "measure").agg(*(of(c, w).alias(f"{c}_{w}") for w in (*windows, "full") for c in ("median", "n")), (of("p75", "full") - of("p25", "full")).alias("_range"))
    wide = F.when(F.col("_range") > 0, F.col("_range"))
    g = g.where("median_full is not null").withColumns({f"recency_{w}": F.round((F.col(f"median_{w}") - F.col("median_full")) / wide, 9) for w in windows})
    now, full, index = F.col(f"median_{recent}"), F.col("median_full"), F.col(f"recency_{recent}")
    tag = F.when(index.isNull(), "STABLE").when(F.signum(now) * F.signum(full) < 0, "REVERSING").when(F.abs(index) > growing, "GROWING").when((F.abs(index) < fading) & (F.abs(full) > least), "FADING").otherwise("STABLE")
    return g.withColumn("tag", tag).drop("_range")
