"""Whole series, many at a time, for numeric work inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Rows that a task works on at once; a series itself is bounded by the calendar.
BATCH_ROWS = 1 << 16


def series_starts(frame: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a new series begins, in a frame sorted by its keys. Missing keys equal each other."""
    new = np.zeros(len(frame), bool)
    if len(frame):
        new[0] = True
    for k in keys:
        here, before = frame[k], frame[k].shift()
        new |= ((here != before) & ~(here.isna() & before.isna())).to_numpy(bool)
    return np.flatnonzero(new)


def whole_series(frames: Iterable[pd.DataFrame], keys: Sequence[str], rows: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """Frames of a partition sorted by ``keys``, cut so that every series is whole; at least ``rows`` rows each but the last."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        size += len(frame)
        if size < rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = int(series_starts(whole, keys)[-1])
        if last:
            yield whole.iloc[:last]
        held, size = [whole.iloc[last:]], len(whole) - last
    if size:
        yield pd.concat(held, ignore_index=True)


def map_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply ``fn`` to batches of whole series; one shuffle by the keys, with as many partitions as the session asks for.

    The number is explicit, as a coalesced exchange would leave the work of small but costly batches to one task.
    """
    keys, parts = list(keys), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        for batch in whole_series(frames, keys):
            yield fn(batch)

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
