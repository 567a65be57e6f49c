"""Alerts of a setup, at most so many recorded in a span of time; those that are held back do not count."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame

from ratelake.operators.folds import ordered_fold

# Recorded alerts of a setup in an hour.
MOST, SPAN_SECONDS = 5, 3600


class Recorded:
    """Times, in microseconds, of the last recorded alerts: as many as may stand in a span."""

    def __init__(self, most: int = MOST, seconds: float = SPAN_SECONDS, times: list[int] | None = None):
        self.span, self.times = int(seconds * 1_000_000), deque(times or [], maxlen=most)

    def take(self, time: int) -> bool:
        """Whether an alert at ``time`` is recorded. A time just one span back still counts."""
        full = len(self.times) == self.times.maxlen and self.times[0] >= time - self.span
        if not full:
            self.times.append(time)
        return not full


def throttled(alerts: DataFrame, by: list[str], at: str, tie: list[str], most: int = MOST, seconds: float = SPAN_SECONDS) -> DataFrame:
    """by, at, tie and whether each alert is recorded, in the order of at, then tie. Rows without a time are left out."""
    types = alerts.schema
    columns = [*by, at, *tie]

    def step(state: Recorded, part: pd.DataFrame) -> pd.DataFrame:
        times = part[at].to_numpy("datetime64[us]").astype("int64").tolist()
        return part[columns].assign(recorded=[state.take(t) for t in times])

    schema = ", ".join(f"`{c}` {types[c].dataType.simpleString()}" for c in columns) + ", recorded boolean"
    return ordered_fold(alerts.where(f"`{at}` is not null").select(*columns), by, [at, *tie], lambda: Recorded(most, seconds), step, schema)
