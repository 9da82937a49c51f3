"""Incremental ingest: every batch of new files leaves its partial sums; totals are merged from them.

A batch writes its sums by (keys, period) to ``batch=<id>``; the id comes from the stream's own log, so a batch that is repeated
after a failure replaces its own sums and nothing is counted twice. ``compact`` merges the newest base and all later batches
into the next base. Totals read one base and the batches after it, never the raw rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalars import to_number
from panelcast.sinks import files
from panelcast.spec import SeriesSpec


def partial_sums(rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Sum and number of usable rows per (keys, period)."""
    usable = rows.select(
        *spec.keys, spec.period(F.col(spec.date)).alias(spec.date), to_number(F.col(spec.demand)).alias(spec.demand),
    ).where(F.col(spec.date).isNotNull() & (F.col(spec.demand) >= 0))
    return usable.groupBy(*spec.keys, spec.date).agg(F.sum(spec.demand).alias(spec.demand), F.count(F.lit(1)).alias("n_rows"))


class PartialSums:
    """Partial sums stored below ``path``: ``batch=<id>`` for each batch, ``base=<id>`` for all batches up to an id."""

    def __init__(self, spark: SparkSession, path: str, spec: SeriesSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    def _finished(self, kind: str) -> list[int]:
        """Ids whose sums are committed; a folder without the commit marker is a write under way or given up."""
        found = [int(n.split("=")[1]) for n in files.names(self.spark, self.path) if n.startswith(f"{kind}=")]
        return sorted(i for i in found if files.exists(self.spark, f"{self.path}/{kind}={i}/_SUCCESS"))

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Store the sums of one batch; False when a base already holds it. A repeated batch replaces itself."""
        bases = self._finished("base")
        if bases and batch <= bases[-1]:
            return False
        partial_sums(rows, self.spec).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def parts(self) -> list[str]:
        """Folders that totals are made of."""
        bases, batches = self._finished("base"), self._finished("batch")
        last = bases[-1] if bases else -1
        return [f"{self.path}/base={last}"] * bool(bases) + [f"{self.path}/batch={b}" for b in batches if b > last]

    def totals(self) -> DataFrame:
        """Summed demand and rows per period over everything added so far."""
        parts = self.parts()
        if not parts:
            raise ValueError(f"no batch has been added to {self.path}")
        return self.spark.read.parquet(*parts).groupBy(*self.spec.keys, self.spec.date).agg(
            F.sum(self.spec.demand).alias(self.spec.demand), F.sum("n_rows").alias("n_rows"))

    def compact(self) -> None:
        """Merge all committed batches into the next base, and drop what the base before it already held.

        The base before stays for readers that have begun with it; a run that fails leaves no marker and is overwritten.
        """
        bases, batches = self._finished("base"), self._finished("batch")
        old = bases[-1] if bases else -1
        new = [b for b in batches if b > old]
        if not new:
            return
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base={new[-1]}")
        for b in batches:
            if b <= old:
                files.remove(self.spark, f"{self.path}/batch={b}")
        for b in bases[:-1]:
            files.remove(self.spark, f"{self.path}/base={b}")


def ingest_available(
    spark: SparkSession, folder: str, schema: T.StructType, columns: list[Column], spec: SeriesSpec, target: str,
    checkpoint: str, file_format: str = "parquet", glob: str = "*", files_per_batch: int = 1000,
) -> PartialSums:
    """Read all files that arrived since the last call and add their partial sums to ``target``."""
    sums = PartialSums(spark, target, spec)
    source = (
        spark.readStream.format(file_format).schema(schema)
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    query = (
        source.select(*columns).writeStream.foreachBatch(lambda rows, batch: sums.add(rows, batch) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sums


def running_totals(spark: SparkSession, target: str, spec: SeriesSpec) -> DataFrame:
    """Summed demand per period over everything ingested so far."""
    return PartialSums(spark, target, spec).totals().drop("n_rows")
