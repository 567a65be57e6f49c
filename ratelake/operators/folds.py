"""Rows of a key, one after the other in order, through a step that carries a state: for recursions that no window function expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def ordered_fold(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """step(state, part) for the parts of each key in order; ``start`` makes a key's state, which step changes in place.

    A key's rows pass through one task, as the recursion demands, in batches: none is held whole, however many rows it has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for frame in frames:
            for found, part in frame.groupby(by, sort=False, dropna=False):
                if key is None or not _same(found, key):
                    state, key = start(), found
                yield step(state, part)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
