"""Shared helpers: stored intermediate tables, word splitting in SQL, and vectorised word hashes for Python tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import workspace

# Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1024  # rows with texts that a Python worker takes at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs that run inside hand Python at most ``rows`` rows at once; the session's own limit comes back afterwards.

    With Spark's 10,000 rows a worker holds tens of MB of text as Arrow, as pandas and once more in the executor.
    """
    held = spark.conf.get(ARROW_ROWS)
    if rows is None or 0 < int(held) <= rows:
        yield
        return
    spark.conf.set(ARROW_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, held)


class Scratch:
    """Intermediate tables in the shared folder; ``drop`` removes those that no later plan reads.

    ``rows`` bounds the batches that the writing jobs hand to Python.
    """

    def __init__(self, spark: SparkSession, label: str, rows: int | None = None):
        self.spark, self.label, self.rows, self.paths = spark, label, rows, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = workspace(self.spark, f"{self.label}_{name}")
        with arrow_rows(self.spark, self.rows):
            df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def bytes_in(df: DataFrame) -> int:
    """Size of a stored table's files, as the optimiser sees it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def words(text: Column) -> Column:
    """Array of the words of a text; NULL counts as an empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


# --- vectorised words of many texts -------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 18
_powers: list[np.ndarray] = []

_is_space = np.zeros(256, dtype=bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, _SEGMENT + 65536)
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)]
    return _powers[0], _powers[1]


def _segment_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word in a buffer, by prefix sums of a polynomial modulo 2**64."""
    space = _is_space[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _powers_to(len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_lower[buf].astype(np.uint64) * power[: len(buf)], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * inverse[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(texts: Sequence[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts, and each text's first word number (one more at the end).

    Works through the joined bytes in segments that end at white space, so memory does not follow the longest text.
    """
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "replace") for t in texts]
    first = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=first[1:])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        to = min(at + _SEGMENT, len(buf))
        while to < len(buf) and not _is_space[buf[to]]:
            stop = min(to + 65536, len(buf))
            found = np.flatnonzero(_is_space[buf[to:stop]])
            to = to + int(found[0]) if len(found) else stop
        h, s = _segment_words(buf[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, first)


def text_chunks(frames: Iterator, limit: int, column: str = "_text") -> Iterator:
    """Frames cut into runs of rows with about ``limit`` characters; a longer text is a run of its own."""
    for frame in frames:
        if not len(frame):
            continue
        part = np.cumsum(frame[column].str.len().to_numpy()) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(frame)]
        for at, to in zip(cuts[:-1], cuts[1:]):
            yield frame.iloc[at:to].reset_index(drop=True)


def sorted_groups(frames: Iterator, key: str) -> Iterator:
    """Whole groups of equal ``key`` from frames of a partition that is sorted by it."""
    import pandas as pd

    held = None
    for frame in frames:
        if held is not None and len(held):
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        at = 0
        for cut in cuts:
            yield frame.iloc[at:cut]
            at = cut
        held = frame.iloc[at:]
    if held is not None and len(held):
        yield held
