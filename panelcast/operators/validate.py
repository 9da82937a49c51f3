"""Data checks, profiles and scores; every check is one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelcast.functions.scalars import to_number, to_timestamp_or_null
from panelcast.operators.explore import one_row, tukey_fences
from panelcast.operators.quantiles import quantiles_from_counts
from panelcast.session import written
from panelcast.spec import SeriesSpec

LEAST_ROWS = 100


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate_columns(df: DataFrame, required: Sequence[str]) -> tuple[bool, str]:
    missing = missing_columns(df, required)
    return (False, f"Missing columns: {missing}") if missing else (True, "All required columns present")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, row count, missing values, distinct values, three sample values.

    Values are counted per (column, value) first, so a frequent value costs one row after the
    map side, and the samples are the smallest three by a group-limited window.
    """
    position = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    dtype = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    texts = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    counted = texts.unpivot([], df.columns, "column", "value").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_column = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
    )
    smallest = Window.partitionBy("column").orderBy("value")
    samples = (
        counted.where(F.col("value").isNotNull())
        .withColumn("_r", F.row_number().over(smallest))
        .where("_r <= 3")
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), " | ").alias("samples"))
    )
    return per_column.join(samples, "column", "left").select(
        F.element_at(position, F.col("column")).alias("position"),
        "column",
        F.element_at(dtype, F.col("column")).alias("type"),
        "n_rows", "n_missing", "n_distinct", "samples",
    )


def _finding(rule: str, severity: str, value: Column, message: Column, applies: Column) -> Column:
    return F.when(
        applies,
        F.struct(
            F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
            value.cast("double").alias("value"), message.alias("message"),
        ),
    )


def validate_data(df: DataFrame, spec: SeriesSpec, seq_length: int = 30) -> DataFrame:
    """Findings as (rule, severity, value, message); an error means the data cannot be used."""
    absent = missing_columns(df, spec.columns)
    if absent:
        found = [_finding("missing_column", "error", F.lit(None), F.lit(f"There is no column {c}."), F.lit(True)) for c in absent]
        return _findings(df.sparkSession.range(1), found)
    demand = to_number(F.col(spec.demand))
    unreadable = F.col(spec.date).isNotNull() & to_timestamp_or_null(F.col(spec.date)).isNull()
    # Per-series partial sums first, then the totals: one scan and no wide distinct.
    partial = df.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(demand).alias("numeric"),
        F.count_if(F.col(spec.demand).isNull()).alias("missing"),
        F.count_if(unreadable).alias("bad_dates"),
        F.count(spec.date).alias("dates"),
        F.min(demand).alias("low"),
        F.max(demand).alias("high"),
    )
    total = partial.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.sum("numeric").alias("numeric"),
        F.sum("missing").alias("missing"),
        F.sum("bad_dates").alias("bad_dates"),
        F.sum("dates").alias("dates"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.count_if(F.col("rows") > 0).alias("groups"),
        F.min("rows").alias("smallest"),
    )
    rows, numeric, missing = F.col("rows"), F.col("numeric"), F.col("missing")
    bad = rows - numeric
    share = missing / rows
    some = rows > 0
    needed = seq_length + 10
    usable = some & (numeric > 0) & (F.col("bad_dates") == 0)
    found = [
        _finding("empty", "error", rows, F.lit("Dataset is empty."), rows == 0),
        _finding("dates", "error", F.col("bad_dates"),
                 F.format_string("%d dates cannot be read.", "bad_dates"),
                 some & (F.col("bad_dates") > 0) & (F.col("bad_dates") == F.col("dates"))),
        _finding("dates", "warning", F.col("bad_dates"),
                 F.format_string("%d dates cannot be read and their rows will be dropped.", "bad_dates"),
                 some & (F.col("bad_dates") > 0) & (F.col("bad_dates") < F.col("dates"))),
        _finding("numeric", "error", bad, F.lit(f"No value of {spec.demand} is a number."), some & (numeric == 0)),
        _finding("numeric", "warning", bad, F.format_string("%d non-numeric demand values found.", bad), some & (numeric > 0) & (bad > 0)),
        _finding("row_count", "warning", rows, F.format_string(f"Only %d rows found, at least {LEAST_ROWS} are needed.", rows), some & (rows < LEAST_ROWS)),
        _finding("variance", "warning", F.lit(0), F.lit("Demand has zero variance."), usable & (numeric > 1) & (F.col("low") == F.col("high"))),
        _finding("missing", "warning", share, F.format_string("%.0f%% of demand values are missing.", share * 100), some & (share > 0.3)),
    ]
    if spec.panel:
        found += [
            _finding("group_size", "warning", F.col("smallest"),
                     F.format_string(f"Some series have fewer than {needed} rows, the smallest has %d.", "smallest"),
                     some & (F.col("smallest") < needed)),
            _finding("group_count", "info", F.col("groups"), F.format_string("%d series found.", "groups"), some),
        ]
    return _findings(total, found)


def _findings(df: DataFrame, found: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array_compact(F.array(*found))))


def _row_facts(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Counts behind the quality checks. Rows are first collapsed per date key and value."""
    demand = F.col(spec.demand)
    per_date = df.groupBy(*spec.keys, spec.date).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(demand.isNull()).alias("missing"),
        F.count_if(demand < 0).alias("negative"),
        F.min(demand).alias("low"),
        F.max(demand).alias("high"),
    )
    return per_date.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicates"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def quality_score(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Six checks and the share passed, in percent. Demand must already be numeric.

    The two column checks hold by construction here, as the columns are resolved by the plan. Three aggregates read the rows, so
    their columns are stored once, and parsing and joins before are not run again for each.
    """
    df = written(df.select(*spec.columns), "quality")
    counts = df.where(F.col(spec.demand).isNotNull()).groupBy(spec.demand).agg(F.count(F.lit(1)).alias("weight"))
    fences = quantiles_from_counts(counts, spec.demand, (0.25, 0.75), names=("q1", "q3"))
    v = F.col(spec.demand)
    outside = (v < F.col("_f.low")) | (v > F.col("_f.high"))
    fenced = counts.withColumn("_f", one_row(tukey_fences(fences)))
    outliers = fenced.agg(F.coalesce(F.sum(F.when(outside, F.col("weight"))), F.lit(0))).scalar()
    facts = _row_facts(df, spec).withColumn("outliers", outliers)
    missing_pct = F.col("missing") * 100.0 / F.col("rows")
    outlier_pct = F.col("outliers") * 100.0 / F.col("rows")
    checks = [missing_pct < 5, F.col("duplicates") == 0, F.col("negative") == 0, outlier_pct < 5, F.lit(True), F.lit(True)]
    passed = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    return facts.select(
        "rows", missing_pct.alias("missing_pct"), "duplicates", "negative", "outliers",
        passed.alias("passed"), F.bround(passed / 6.0 * 100, 0).cast("int").alias("score"),
    )


def data_checks(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Page checks with the level pass, warn or err."""
    facts = _row_facts(df, spec)
    missing_pct = F.col("missing") * 100.0 / F.col("rows")

    def check(name: str, value: Column, level: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), level.alias("level"))

    rows = [
        check("missing values", missing_pct, F.when(missing_pct == 0, "pass").when(missing_pct < 5, "warn").otherwise("err")),
        check("negative demand", F.col("negative"), F.when(F.col("negative") == 0, "pass").otherwise("warn")),
        check("demand variance", F.col("high") - F.col("low"), F.when(F.col("high") > F.col("low"), "pass").otherwise("err")),
        check("row count", F.col("rows"), F.when(F.col("rows") >= LEAST_ROWS, "pass").otherwise("warn")),
    ]
    return facts.select(F.inline(F.array(*rows)))


def series_admission(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Whether each series can be fitted: three values or more, all of them finite."""
    v = F.col(spec.demand)
    not_finite = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    counted = df.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(not_finite).alias("n_not_finite")
    )
    short, broken = F.col("n_rows") < 3, F.col("n_not_finite") > 0
    return counted.select(
        *spec.keys, "n_rows", "n_not_finite",
        F.when(short | broken, "rejected").otherwise("ok").alias("status"),
        F.when(short, F.format_string("at least 3 observations are needed, got %d", "n_rows"))
        .when(broken, F.format_string("%d non-finite value(s)", "n_not_finite"))
        .alias("reason"),
    )
