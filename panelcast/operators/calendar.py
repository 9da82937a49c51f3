"""Calendar features, date ranges, resampling and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.spec import SeriesSpec


def time_features(df: DataFrame, date: str) -> DataFrame:
    day = F.col(date)
    weekday = F.weekday(day)
    return df.withColumns(
        {
            "Year": F.year(day),
            "Month": F.month(day),
            "Week": F.weekofyear(day),
            "Day": F.dayofmonth(day),
            "DayOfWeek": weekday,
            "Quarter": F.quarter(day),
            "IsWeekend": (weekday >= 5).cast("int"),
        }
    )


# Period label of a date, and the step between labels.
def period_label(freq: str, day: Column) -> Column:
    """D: the day; W: the Sunday that ends the week; M: the last day of the month."""
    if freq == "D":
        return day.cast("date")
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "Sun")
    if freq in ("M", "ME"):
        return F.last_day(day)
    raise ValueError(f"unknown frequency {freq!r}: use D, W or M")


def _labels_between(freq: str, first: Column, last: Column) -> Column:
    step = {"D": "interval 1 day", "W": "interval 7 days"}.get(freq)
    if step:
        return F.sequence(first, last, F.expr(step))
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
    return F.transform(months, F.last_day)


def date_range(spark: SparkSession, start: str, end: str, freq: str = "D") -> DataFrame:
    """All period labels from start to end, both included where they fall on a label."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    labels = _labels_between(freq, period_label(freq, first), period_label(freq, last))
    inside = F.filter(labels, lambda d: (d >= first) & (d <= last))
    return spark.range(1).select(F.explode(inside).alias("date"))


def gap_fill(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Add a zero row for every absent period between the first and last of each series.

    Each row emits the empty periods up to its successor, so no calendar join is needed.
    """
    label = F.col(spec.date)
    following = F.col("_next")
    before_next = F.when(following.isNotNull(), F.date_sub(following, 1)).otherwise(label)
    periods = F.filter(
        _labels_between(freq, label, before_next), lambda d: (d >= label) & (d <= before_next)
    )
    ahead = df.withColumn("_next", F.lead(spec.date).over(spec.ordered()))
    return ahead.select(*spec.keys, spec.demand, F.posexplode(periods).alias("_i", spec.date)).select(
        *spec.keys,
        spec.date,
        F.when(F.col("_i") == 0, F.coalesce(F.col(spec.demand), F.lit(0.0)))
        .otherwise(F.lit(0.0))
        .alias(spec.demand),
    )


def resample(df: DataFrame, spec: SeriesSpec, freq: str = "D") -> DataFrame:
    """Summed demand per period, with empty periods present as zero."""
    totals = df.groupBy(*spec.keys, period_label(freq, F.col(spec.date)).alias(spec.date)).agg(
        F.sum(spec.demand).alias(spec.demand)
    )
    return gap_fill(totals, spec, freq)


def future_dates(df: DataFrame, spec: SeriesSpec, steps: int) -> DataFrame:
    """The next ``steps`` days after the last date of each series."""
    last = df.groupBy(*spec.keys).agg(F.max(spec.date).cast("date").alias("_last"))
    return last.select(
        *spec.keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    ).select(*spec.keys, "step", F.date_add("_last", F.col("step")).alias("date"))
