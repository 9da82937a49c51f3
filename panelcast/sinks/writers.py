"""CSV, report bundles and append-only run tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def write_csv(df: DataFrame, path: str) -> str:
    """CSV parts with a header, written by all tasks in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report_bundle(folder: str, frames: Mapping[str, DataFrame]) -> dict[str, str]:
    """One CSV directory per table."""
    return {name: write_csv(df, f"{folder.rstrip('/')}/{name}") for name, df in frames.items()}


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Add the rows of one run. Its partition is replaced, so a repeated write leaves no copies."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_unique(df: DataFrame, unique: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """The newest row of each unique key, such as (model, version)."""
    order = Window.partitionBy(*unique).orderBy(*[F.desc(c) for c in newest_by])
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
