"""From files to a clean series: detect, load, validate, clean, describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.clean import clean_data, date_evidence, unread_dates, with_date_order
from panelcast.operators.validate import validate_data
from panelcast.sources.readers import IngestError, melt_wide, peek_columns, read_csv, read_many
from panelcast.sources.roles import detect_series_roles, is_wide
from panelcast.session import written
from panelcast.spec import SeriesSpec


def ingest(
    spark: SparkSession,
    sources: Sequence[str],
    date: str | None = None,
    demand: str | None = None,
    start_date: str = "1970-01-01",
    min_rows: int = 100,
) -> tuple[DataFrame, dict]:
    """Clean single series and its metadata; raises ``IngestError`` when it cannot be used."""
    if not sources:
        raise IngestError("no sources given")
    columns = peek_columns(spark, sources[0])
    skipped: list[tuple[str, str]] = []
    if is_wide(columns):
        date, demand = date or "date", demand or "demand"
        raw = melt_wide(read_csv(spark, list(sources)), start_date, demand=demand).withColumnRenamed("date", date)
    else:
        roles = detect_series_roles(columns)
        date, demand = date or roles.date, demand or roles.demand
        if date is None or demand is None:
            raise IngestError(f"cannot tell the date and demand column among {columns}")
        raw, skipped = read_many(spark, sources, date, demand)
    # The files are read once: what is stored serves validation, cleaning and description, and the order of day and month is
    # observed on the way.
    seen = Observation("dates")
    raw = written(raw.observe(seen, *[c.alias(n) for n, c in date_evidence(F.col(date)).items()]), "raw")
    spec = with_date_order(SeriesSpec(date, demand, ()), seen.get["first_number"], seen.get["second_number"])
    findings = validate_data(raw, spec).where("severity <> 'info'").collect()  # at most one row per rule
    errors = [f.message for f in findings if f.severity == "error"]
    if errors:
        raise IngestError("validation failed: " + "; ".join(errors))
    clean = written(clean_data(raw, spec), "clean")
    lost = unread_dates(raw, spec).first()
    facts = describe(clean, spec).first()
    if facts.n_rows < min_rows:
        raise IngestError(f"insufficient data: {facts.n_rows} rows, at least {min_rows} needed")
    meta = {
        "n_rows": facts.n_rows,
        "date_range": (facts.first_date, facts.last_date),
        "date_col": date,
        "sales_col": demand,
        "sources": [s.rstrip("/").rsplit("/", 1)[-1] for s in sources],
        "skipped": skipped,
        "unread_dates": lost.n_missing + lost.n_unread,
        "warnings": [f.message for f in findings if f.severity == "warning"],
    }
    return clean, meta


def describe(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.date_format(F.min(spec.date), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max(spec.date), "yyyy-MM-dd").alias("last_date"),
    )
