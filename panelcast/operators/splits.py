"""Time-ordered splits per series and the windows built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.features import sliding_windows
from panelcast.operators.scaling import minmax_columns, scaled
from panelcast.spec import SeriesSpec


@dataclass(frozen=True)
class SplitRule:
    """Share of rows held out, the least number of training rows, and the least series length."""

    test_size: float = 0.2
    min_train: int | None = None
    min_rows: int = 0

    def index(self, n: Column) -> Column:
        """First test position for a series of ``n`` rows."""
        plain = F.floor(n.cast("double") * F.lit(1.0 - self.test_size))
        if self.min_train is None:
            return plain
        return F.least(F.greatest(plain, F.lit(self.min_train).cast("bigint")), n - 1)


def plain_rule(test_size: float = 0.2) -> SplitRule:
    return SplitRule(test_size)


def panel_rule(test_size: float = 0.2) -> SplitRule:
    return SplitRule(test_size, min_train=50)


def sequence_rule(seq: int = 30, test_size: float = 0.2) -> SplitRule:
    return SplitRule(test_size, min_train=seq + 5, min_rows=seq + 10)


def hybrid_rule(test_size: float = 0.2) -> SplitRule:
    return SplitRule(test_size, min_train=10, min_rows=20)


def split_series(df: DataFrame, spec: SeriesSpec, rule: SplitRule) -> DataFrame:
    """Add position, length, split index and ``is_test``; series below the least length are left out."""
    placed = df.withColumns(
        {
            "pos": F.row_number().over(spec.ordered()).cast("bigint") - 1,
            "n_rows": F.count(F.lit(1)).over(spec.series()),
        }
    )
    return (
        placed.where(F.col("n_rows") >= rule.min_rows)
        .withColumn("split_idx", rule.index(F.col("n_rows")))
        .withColumn("is_test", F.col("pos") >= F.col("split_idx"))
    )


def series_status(df: DataFrame, spec: SeriesSpec, rule: SplitRule, seq: int | None = None) -> DataFrame:
    """One row per series: length, split index, whether it is used and why not."""
    counted = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_rows"))
    enough = F.col("n_rows") >= rule.min_rows
    split = F.when(enough, rule.index(F.col("n_rows")))
    columns = [
        *spec.keys,
        "n_rows",
        split.alias("split_idx"),
        F.when(enough, "ok").otherwise("skipped").alias("status"),
        F.when(~enough, F.format_string("too short: %d rows", "n_rows")).alias("reason"),
    ]
    if seq is not None:
        columns += [
            (split - seq).alias("n_train_windows"),
            (F.when(enough, F.col("n_rows")) - split).alias("n_test_windows"),
        ]
    return counted.select(*columns)


def split_windows(df: DataFrame, spec: SeriesSpec, seq: int, rule: SplitRule) -> DataFrame:
    """Scaled sliding windows; a window is test when its target row is at or past the split.

    The scaling range comes from training rows only. Split, scaling and windows all partition
    by the series keys, so they share one shuffle.
    """
    rows = minmax_columns(split_series(df, spec, rule), spec, train=~F.col("is_test"))
    rows = rows.withColumn("actual", F.col(spec.demand)).withColumn(spec.demand, scaled(F.col(spec.demand)))
    return sliding_windows(rows, spec, seq)


def split_counts(windows: DataFrame) -> DataFrame:
    return windows.agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")
    )


def training_size_ok(df: DataFrame, seq: int = 30) -> DataFrame:
    """Whether the rows reach twice the look-back plus twenty."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(2 * seq + 20).cast("bigint").alias("needed"),
        (F.col("n_rows") >= 2 * seq + 20).alias("ok"),
    )
