"""Panels, ledgers and exports, written and read again; streams with late and repeated rows."""

import datetime as dt

from pyspark.sql import functions as F

from ratelake.functions import calendar as C
from ratelake.operators import trades
from ratelake.sources import stores
from ratelake.streaming import bars as streams


def test_panel_is_built_once_and_old_dates_go(spark, tmp_path):
    root = f"file://{tmp_path}/panel"
    x = spark.range(10).select((F.col("id") % 3).alias("node"), F.col("id").alias("v"))
    for d in range(1, 9):
        stores.write_panel(x, root, f"2024-01-0{d}", ["node"])
    stores.write_panel(x.limit(1), root, "2024-01-08", ["node"])
    assert stores.read_panel(spark, root, "2024-01-08").count() == 10
    assert stores.read_manifest(spark, root, "2024-01-08") == {"asof": "2024-01-08", "by": ["node"], "columns": ["node", "v"], "rows": 10}
    stores.write_panel(x.limit(1), root, "2024-01-08", ["node"], force=True)
    assert stores.read_panel(spark, root, "2024-01-08").count() == 1
    assert stores.keep_latest(spark, root) == [f"2024-01-0{d}" for d in range(3, 9)]


def test_ledger_replaces_its_own_day(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = lambda *r: spark.createDataFrame(list(r), "day string, idea string, score double")
    stores.update_ledger(rows(("d1", "a", 1.0), ("d1", "b", 2.0)), path, "day")
    stores.update_ledger(rows(("d2", "a", 3.0)), path, "day")
    found = stores.update_ledger(rows(("d2", "c", 4.0)), path, "day")
    assert sorted((r["day"], r["idea"]) for r in found.collect()) == [("d1", "a"), ("d1", "b"), ("d2", "c")]


def test_csv_with_comments_and_empty_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("symbol,lots\n# a note\nSRAH26,3\nSRAM26,\n")
    x = stores.commented_csv(spark, f"file://{tmp_path}/p.csv", "symbol string, lots int")
    assert sorted(map(tuple, x.collect()), key=str) == [("SRAH26", 3), ("SRAM26", None)]
    stores.export_csv(x, f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2
    assert stores.empty(spark, "a int, b string").count() == 0


def test_live_symbols(spark):
    day = lambda d: dt.date(2024, 1, d)
    x = spark.createDataFrame([("a", day(1)), ("a", day(20)), ("b", day(12)), ("c", day(13))], "symbol string, bar_date date")
    assert sorted(r["symbol"] for r in stores.live_symbols(x).collect()) == ["a", "c"]
    assert stores.latest_bar(x).first()[0] == day(20)


def test_symbols_and_business_days_at_their_edges(spark):
    x = spark.createDataFrame([("SRAH26",), ("SRAZ99",), ("SRH26",), ("SRAX9",), (None,)], "s string")
    assert [r[0] for r in x.select(C.symbol_month(F.col("s"), "SRA")).collect()] == [dt.date(2026, 3, 1), dt.date(1999, 12, 1), None, None, None]
    friday, sunday, monday = dt.date(2024, 1, 5), dt.date(2024, 1, 7), dt.date(2024, 1, 8)
    y = spark.createDataFrame([(friday, monday), (monday, friday), (sunday, monday), (friday, friday)], "a date, b date")
    assert [tuple(r) for r in y.select(C.business_days(F.col("a"), F.col("b")), C.add_business_days(F.col("a"), 1)).collect()] == [(1, monday), (-1, dt.date(2024, 1, 9)), (0, monday), (0, monday)]


def test_simulated_trades_on_both_sides_and_at_the_end(spark):
    bars = spark.createDataFrame([("a", i, 10.0, lo, hi, c) for i, (lo, hi, c) in enumerate([(9.0, 11.0, 10.0), (9.0, 11.0, 10.0), (9.5, 10.5, 10.0), (8.0, 14.0, 9.0), (9.0, 11.0, 10.5)])], "symbol string, i int, open double, low double, high double, close double")
    fires = spark.createDataFrame([("a", 0, "LONG", 2.0), ("a", 0, "SHORT", 10.0), ("a", 2, "LONG", 5.0), ("a", 4, "LONG", 1.0)], "symbol string, i int, side string, risk double")
    found = {(r["i"], r["side"]): (r["held"], r["reason"], round(r["gain"], 4)) for r in trades.simulate(fires, bars, 3).collect()}
    # The bar that touches the stop and both targets is a stop; the last bar ends what is open; a fire on it has no entry.
    assert found == {(0, "LONG"): (2, "stop", -1.0), (0, "SHORT"): (3, "time", -0.05), (2, "LONG"): (1, "open", 0.1)}


def test_streams_close_windows_and_drop_late_and_repeated_rows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1), 1, "x", 1.0), (2, at(1, 30), 1, "x", 5.0)], [(3, at(6), 1, "x", 2.0), (1, at(1), 1, "x", 1.0)], [(4, at(1, 10), 1, "x", 99.0), (5, at(12), 1, "x", 3.0)], [(6, at(20), 1, "x", 4.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, None) for r in rows], streams.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    spark.read.parquet(f"{tmp_path}/in0").limit(0).write.parquet(f"{tmp_path}/in")

    def run(df, name):
        out = []
        for k in range(len(batches)):
            spark.read.parquet(f"{tmp_path}/in{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            q = df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/{name}_out").option("checkpointLocation", f"{tmp_path}/{name}_at").trigger(availableNow=True).start()
            q.awaitTermination(120)
            out = spark.read.parquet(f"{tmp_path}/{name}_out").collect()
        return out

    for name in ("bars", "once"):
        spark.read.parquet(f"{tmp_path}/in").write.parquet(f"{tmp_path}/{name}")
    bars = run(streams.bars(streams.event_stream(spark, f"{tmp_path}/bars", 10)), "bars")
    first = next(r for r in bars if r["bar_time"] == at(1))
    assert first["high"] == 5.0 and 99.0 not in {r["high"] for r in bars} and at(20) not in {r["bar_time"] for r in bars}
    once = run(streams.deduplicated(streams.event_stream(spark, f"{tmp_path}/once", 10)), "once")
    ids = [r["event_id"] for r in once]
    assert len(ids) == len(set(ids)) and {1, 2, 3, 5, 6} <= set(ids)
