"""Recursions over a stream: rows of a key wait until the watermark has passed them, then go through in the order of event time.

So a stream gives what the batch twin gives for the same rows, whatever batches they came in. A row later than the
watermark is dropped, as in any aggregation by event time. What waits is bounded by the watermark's delay, what is
carried by the recursion's own state; both live in the state store and come back from a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ratelake.operators.changepoints import MOST_RUNS, RunLengths
from ratelake.operators.throttle import MOST, SPAN_SECONDS, Recorded

#: The state store that keeps several states and timers of a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds rows (event time in microseconds and ``payload`` fields) and hands those behind the watermark to step() in order."""

    names: tuple[str, ...]
    payload: str
    carried: str

    def load(self, saved):
        """The recursion's state from what save() gave; None for a new key."""
        raise NotImplementedError

    def save(self, state) -> tuple:
        raise NotImplementedError

    def step(self, state, row: tuple):
        """The result that goes with one row (time, payload fields)."""
        raise NotImplementedError

    def frame(self, key, rows: list[tuple], results: list) -> pd.DataFrame:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"at long, {self.payload}")
        self.state = handle.getValueState("state", self.carried)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            came = [tuple(v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v for v in row) for row in frame[["at", *self.names]].itertuples(index=False)]
            self.held.appendList(came)
            times.update(-(-row[0] // 1000) for row in came)
        for time in times:
            self.handle.registerTimer(time)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = [tuple(row) for row in self.held.get()]
        due = sorted(row for row in held if row[0] <= until)
        if not due:
            return iter([])
        later = [row for row in held if row[0] > until]
        self.held.put(later) if later else self.held.clear()
        state = self.load(self.state.get() if self.state.exists() else None)
        results = [self.step(state, row) for row in due]
        self.state.update(self.save(state))
        return iter([self.frame(key, due, results)])

    def close(self) -> None:
        pass


class ChangePoints(InOrder):
    names, payload, carried = ("x",), "x array<double>", "runs array<long>, log_p array<double>, mean array<double>, beta array<double>"

    def __init__(self, d: int, hazard: float, horizon: int, most: int):
        self.settings = d, hazard, horizon, most

    def load(self, saved):
        state = RunLengths(*self.settings)
        return state.load(*saved) if saved is not None else state

    def save(self, state) -> tuple:
        return state.dump()

    def step(self, state, row):
        return state.observe(np.asarray(row[1], float))

    def frame(self, key, rows, results):
        return pd.DataFrame({"symbol": [key[0]] * len(rows), "ts": pd.to_datetime([r[0] for r in rows], unit="us", utc=True), "p_change": results})


class Throttle(InOrder):
    names, payload, carried = ("alert_id",), "alert_id long", "times array<long>"

    def __init__(self, most: int, seconds: float):
        self.settings = most, seconds

    def load(self, saved):
        return Recorded(*self.settings, list(saved[0]) if saved is not None else None)

    def save(self, state) -> tuple:
        return (list(state.times),)

    def step(self, state, row):
        return state.take(row[0])

    def frame(self, key, rows, results):
        return pd.DataFrame({"setup": [key[0]] * len(rows), "alert_id": [r[1] for r in rows], "ts": pd.to_datetime([r[0] for r in rows], unit="us", utc=True), "recorded": results})


def change_stream(rows: DataFrame, d: int, late: str = "1 hour", hazard: float = 0.01, horizon: int = 5, most: int = MOST_RUNS) -> DataFrame:
    """symbol, ts and p_change of a stream of symbol, ts and x (array), as change_probabilities() gives them."""
    x = rows.where("x is not null").select("symbol", "ts", F.unix_micros("ts").alias("at"), "x").withWatermark("ts", late)
    return x.groupBy("symbol").transformWithStateInPandas(ChangePoints(d, hazard, horizon, most), "symbol string, ts timestamp, p_change double", "append", "EventTime")


def throttled_stream(alerts: DataFrame, late: str = "10 minutes", most: int = MOST, seconds: float = SPAN_SECONDS) -> DataFrame:
    """setup, alert_id, ts and recorded of a stream of alerts, as throttled() gives them; an alert that comes twice within the watermark counts once."""
    x = alerts.select("setup", "alert_id", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["setup", "alert_id"])
    x = x.withColumn("at", F.unix_micros("ts"))
    return x.groupBy("setup").transformWithStateInPandas(Throttle(most, seconds), "setup string, alert_id long, ts timestamp, recorded boolean", "append", "EventTime")
