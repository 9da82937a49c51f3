"""Parsing, duplicate collapse and filling of missing demand."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelcast.functions.scalars import to_number
from panelcast.spec import SeriesSpec


def date_evidence(stamp: Column) -> dict[str, Column]:
    """Aggregates that tell the order of day and month in texts such as 05/01/2022: the largest first and second number."""
    shape = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\s*$"

    def largest(group: int) -> Column:
        return F.max(F.regexp_extract(stamp.cast("string"), shape, group).try_cast("int"))

    return {"first_number": largest(1), "second_number": largest(2)}


def with_date_order(spec: SeriesSpec, first_number: int | None, second_number: int | None) -> SeriesSpec:
    """The spec with its formats in the column's order: a first number above 12 can only be a day.

    Without such evidence, or with evidence for both orders, the spec's own order stays.
    """
    return spec.day_first() if (first_number or 0) > 12 >= (second_number or 0) else spec


def detect_date_order(df: DataFrame, spec: SeriesSpec) -> SeriesSpec:
    """``with_date_order`` from one aggregate over the whole column."""
    found = df.agg(*[c.alias(n) for n, c in date_evidence(F.col(spec.date)).items()]).first()
    return with_date_order(spec, found.first_number, found.second_number)


def collapse_texts(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row per (keys, date as written) with the rows and the summed demand, so that each spelling of a date is read once.

    Dates repeat from row to row; partial sums keep the raw rows from moving.
    """
    return df.groupBy(*spec.keys, spec.date).agg(
        F.sum(to_number(F.col(spec.demand))).alias(spec.demand), F.count(F.lit(1)).alias("n_rows"))


def unread_dates(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows, rows without a date, and rows whose date cannot be read and which parsing therefore drops."""
    missing = F.col(spec.date).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_missing"),
        F.count_if(~missing & spec.period(F.col(spec.date)).isNull()).alias("n_unread"))


def parse_columns(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Read dates and demand; rows whose date cannot be read are dropped."""
    return df.withColumns(
        {spec.date: spec.period(F.col(spec.date)), spec.demand: to_number(F.col(spec.demand))}
    ).where(F.col(spec.date).isNotNull())


def collapse_duplicates(
    df: DataFrame,
    spec: SeriesSpec,
    extra_aggs: Mapping[str, Column] | None = None,
    null_as_zero: bool = False,
) -> DataFrame:
    """One row per (keys, date) with the summed demand.

    The sum stays NULL when every value is missing, so that it can be filled later;
    ``null_as_zero`` counts such periods as zero instead. Map-side partial sums keep a hot
    series from moving its raw rows.
    """
    total = F.sum(spec.demand)
    if null_as_zero:
        total = F.coalesce(total, F.lit(0.0))
    extras = [column.alias(name) for name, column in (extra_aggs or {}).items()]
    return df.groupBy(*spec.keys, spec.date).agg(total.alias(spec.demand), *extras)


def fill_missing(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Carry the last value forward, then the first known value backward, within each series."""
    value = F.col(spec.demand)
    so_far = spec.ordered().rowsBetween(Window.unboundedPreceding, 0)
    whole = spec.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Rows still empty after the forward pass precede the first known value of the series.
    filled = F.coalesce(
        F.last(value, ignorenulls=True).over(so_far),
        F.first(value, ignorenulls=True).over(whole),
    )
    return df.withColumn(spec.demand, filled)


def fill_with_mean(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """What is still missing gets the mean over all rows."""
    mean = df.agg(F.avg(spec.demand)).scalar()
    return df.withColumn(spec.demand, F.coalesce(F.col(spec.demand), mean))


def drop_negative(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.where(F.col(spec.demand) >= 0)


def clean_data(
    df: DataFrame,
    spec: SeriesSpec,
    extra_aggs: Mapping[str, Column] | None = None,
    null_as_zero: bool = False,
) -> DataFrame:
    """Parse, collapse, fill, and keep non-negative demand, in that order."""
    parsed = parse_columns(df, spec)
    collapsed = collapse_duplicates(parsed, spec, extra_aggs, null_as_zero)
    return drop_negative(fill_with_mean(fill_missing(collapsed, spec), spec), spec)
