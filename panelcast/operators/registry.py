"""Model registry as an append-only event table; the current state is a query over the events."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from panelcast.sinks import files

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()), T.StructField("at", T.TimestampType()),
        T.StructField("action", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("model_type", T.StringType()), T.StructField("version", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("file_path", T.StringType()), T.StructField("description", T.StringType()),
    ]
)


def _boundaries(events: DataFrame) -> DataFrame:
    """The last registration or removal of each model, by partial aggregates: one row per model."""
    when = F.struct("at", "event_id")
    fields = F.struct("at", "event_id", "action", "model_type", "version", "file_path", "description")
    ends = events.where(F.col("action").isin("register", "remove"))
    return ends.groupBy("name").agg(F.max_by(fields, when).alias("_start")).where("_start.action = 'register'")


def live_events(events: DataFrame) -> DataFrame:
    """Events since the last registration of each model that has not been removed.

    The start of each model is joined on, so that a model with very many events is split like
    any other skewed join key.
    """
    starts = _boundaries(events).select("name", F.col("_start.at").alias("_at"), F.col("_start.event_id").alias("_id"))
    since = F.struct("at", "event_id") >= F.struct(F.col("_at").alias("at"), F.col("_id").alias("event_id"))
    return events.join(starts, "name").where(since).drop("_at", "_id")


def models(events: DataFrame) -> DataFrame:
    """Registration data of every live model."""
    return _boundaries(events).select(
        "name", "_start.model_type", "_start.version", F.col("_start.at").alias("created_at"), "_start.file_path", "_start.description"
    )


def newest_first(events: DataFrame, model_type: str | None = None) -> DataFrame:
    found = models(events)
    if model_type:
        found = found.where(F.col("model_type") == model_type)
    return found.orderBy(F.desc("created_at"), "name")


def latest_by_type(events: DataFrame) -> DataFrame:
    """The most recently registered model of each type."""
    order = Window.partitionBy("model_type").orderBy(F.desc("created_at"), "name")
    return models(events).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def merged_entries(events: DataFrame, column: str) -> DataFrame:
    """One row per model and map key; the newest value wins."""
    entries = live_events(events).select("name", "at", "event_id", F.explode(column).alias("key", "value"))
    return entries.groupBy("name", "key").agg(F.max_by("value", F.struct("at", "event_id")).alias("value"))


def merged_maps(events: DataFrame, column: str) -> DataFrame:
    return merged_entries(events, column).groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(column)
    )


def tag_rows(events: DataFrame) -> DataFrame:
    """Every tag of every live model, repeats included."""
    return live_events(events).select("name", F.explode("tags").alias("tag"))


def with_tag(events: DataFrame, tag: str) -> DataFrame:
    return models(events).join(tag_rows(events).where(F.col("tag") == tag).select("name").distinct(), "name", "left_semi")


class Registry:
    """Registry stored at ``path``; every change appends one event.

    Registrations are numbered by name, and each number is claimed by creating a file that must not exist. Of two writers that
    register the same name at once, one gets the number; the other finds the name taken. A claim whose writer failed before its
    event was written is void after ``PATIENCE_SECONDS`` and gives its number up to the next.
    """

    PATIENCE_SECONDS = 60.0

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).parquet(self.path)
        except Exception as err:
            if "PATH_NOT_FOUND" in str(err):
                return self.spark.createDataFrame([], EVENTS)
            raise

    def _append(self, action: str, name: str, **fields) -> None:
        row = {"event_id": uuid.uuid4().hex, "at": datetime.now(timezone.utc), "action": action, "name": name, **fields}
        values = tuple(row.get(f) for f in EVENTS.fieldNames())
        self.spark.createDataFrame([values], EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def register(
        self, name: str, model_type: str, version: str = "1.0.0", metrics: Mapping[str, float] | None = None,
        config: Mapping[str, str] | None = None, tags: Sequence[str] = (), file_path: str | None = None,
        description: str = "", overwrite: bool = False,
    ) -> None:
        if not overwrite and self.exists(name):
            raise ValueError(f"model {name!r} is already registered; pass overwrite=True to replace it")
        event_id = self._claim(name, overwrite)
        self._append(
            "register", name, event_id=event_id, model_type=model_type, version=version, metrics=dict(metrics or {}),
            config=dict(config or {}), tags=list(tags), file_path=file_path, description=description,
        )

    def _claim(self, name: str, overwrite: bool) -> str:
        """Take the next registration number of a name; the event id ends with it."""
        folder = f"{self.path.rstrip('/')}_claims/{hashlib.sha256(name.encode()).hexdigest()}"
        while True:
            # Numbers that ended: their registration was removed or replaced, or never written.
            taken = [int(n) for n in files.names(self.spark, folder) if n.isdigit()]
            number = max(taken, default=0) + 1
            if taken and not overwrite and not self._ended(name, folder, max(taken)):
                raise ValueError(f"model {name!r} is being registered by another writer")
            if files.create_once(self.spark, f"{folder}/{number}", repr(time.time())):
                return f"{uuid.uuid4().hex}-{number}"
            if not overwrite:
                raise ValueError(f"model {name!r} was registered by another writer")

    def _ended(self, name: str, folder: str, number: int) -> bool:
        """Whether the registration with this number is over: removed since, or given up by its writer."""
        mine = self.events().where((F.col("name") == name) & (F.col("action") == "register")).where(
            F.element_at(F.split("event_id", "-"), -1) == str(number))
        if not mine.isEmpty():
            return not self.exists(name)
        claimed = float(files.first_bytes(self.spark, [f"{folder}/{number}"])[0] or b"0")
        return time.time() - claimed > self.PATIENCE_SECONDS

    def exists(self, name: str) -> bool:
        return not models(self.events()).where(F.col("name") == name).isEmpty()

    def get(self, name: str) -> DataFrame:
        """One row with registration data, merged metrics, merged config and tags; none when unknown."""
        events = self.events().where(F.col("name") == name)
        tags = tag_rows(events).groupBy("name").agg(F.collect_list("tag").alias("tags"))
        out = models(events)
        for part in (merged_maps(events, "metrics"), merged_maps(events, "config"), tags):
            out = out.join(part, "name", "left")
        return out

    def count(self) -> int:
        return models(self.events()).count()

    def list(self, model_type: str | None = None) -> DataFrame:
        return newest_first(self.events(), model_type)

    def latest(self, model_type: str | None = None) -> DataFrame:
        return self.list(model_type).limit(1)

    def update_metrics(self, name: str, metrics: Mapping[str, float]) -> bool:
        return self._change("update", name, metrics={k: float(v) for k, v in metrics.items()})

    def update_config(self, name: str, config: Mapping[str, str]) -> bool:
        return self._change("update", name, config={k: str(v) for k, v in config.items()})

    def add_tags(self, name: str, tags: Sequence[str]) -> bool:
        return self._change("update", name, tags=list(tags))

    def remove(self, name: str) -> bool:
        return self._change("remove", name)

    def _change(self, action: str, name: str, **fields) -> bool:
        if not self.exists(name):
            return False
        self._append(action, name, **fields)
        return True

    def clear(self) -> None:
        """Write one removal per live model."""
        gone = models(self.events()).select("name").withColumns(
            {
                "event_id": F.uuid(), "at": F.current_timestamp(), "action": F.lit("remove"),
                **{f.name: F.lit(None).cast(f.dataType) for f in EVENTS.fields[4:]},
            }
        )
        gone.select(*EVENTS.fieldNames()).write.mode("append").parquet(self.path)

    def save_model(self, name: str, model: MLWritable, file_path: str) -> bool:
        """Store a fitted Spark model and note where it lies."""
        if not self.exists(name):
            return False
        PipelineModel([model]).write().overwrite().save(file_path)
        return self._change("update", name, config={"file_path": file_path})

    def load_model(self, name: str):
        row = merged_entries(self.events(), "config").where((F.col("name") == name) & (F.col("key") == "file_path")).first()
        if row is None:
            raise ValueError(f"no stored model for {name!r}")
        return PipelineModel.load(row.value).stages[0]
