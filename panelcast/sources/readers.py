"""Reading sales tables from CSV, Parquet, catalogue tables and JDBC."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.scalars import to_number
from panelcast.sinks import files
from panelcast.sources.roles import day_columns
from panelcast.spec import SeriesSpec


class IngestError(Exception):
    """The sources cannot be turned into a usable series."""


def read_csv(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Every column as text, so that no inference pass reads the files; cleaning casts later.

    Several files are read by column name: those with the same header form one scan, and a column that a file lacks is NULL.
    Only the first bytes of each file are looked at for that.
    """
    one = spark.read.options(header=True, inferSchema=False, **options).csv(path)
    listed = [unquote(f) for f in one.inputFiles()]
    if len(listed) < 2:
        return one
    groups, _ = _by_header(spark, listed, options)
    if len(groups) < 2:
        return one
    base = {"basePath": path} if isinstance(path, str) and not set(path) & set("*?[{") else {}
    parts = [spark.read.options(header=True, inferSchema=False, **{**options, **base}).csv(names) for names in groups.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _by_header(spark: SparkSession, paths: Sequence[str], options: Mapping[str, str]) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """Files of each distinct first line, in the order of the paths, and the files without one with the reason."""
    groups: dict[str, list[str]] = {}
    skipped = []
    for path, header in zip(paths, _headers(spark, list(paths), options.get("encoding", "utf-8"))):
        if isinstance(header, Exception):
            skipped.append((path, f"cannot be read: {str(header).splitlines()[0][:200]}"))
        elif not header.strip():
            skipped.append((path, "no header line"))
        else:
            groups.setdefault(header, []).append(path)
    return groups, skipped


def _headers(spark: SparkSession, paths: list[str], encoding: str) -> list[str | Exception]:
    """First line of each file, from as many bytes as it takes."""
    size, out = 1 << 16, dict(zip(paths, files.first_bytes(spark, paths)))
    while True:
        short = [p for p, raw in out.items() if isinstance(raw, bytes) and len(raw) >= size and b"\n" not in raw and b"\r" not in raw]
        if not short:
            break
        size *= 8
        out.update(zip(short, files.first_bytes(spark, short, size)))
    lines = []
    for path in paths:
        raw = out[path]
        text = raw if isinstance(raw, Exception) else raw.decode(encoding, "replace").lstrip("\ufeff")
        lines.append(text if isinstance(text, Exception) else re.split("\r?\n|\r", text, maxsplit=1)[0])
    return lines


def read_usable(
    spark: SparkSession, paths: Sequence[str], date: str, demand: str, **options: str
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Union of (date, demand) over the CSV files below ``paths``, and the paths or files left out with the reason.

    One scan for each distinct header; files that lack a column, are empty or cannot be opened are left out, not read as NULLs.
    """
    df, skipped, _ = _usable(spark, paths, date, demand, options)
    return df, skipped


def _usable(spark: SparkSession, paths: Sequence[str], date: str, demand: str, options: Mapping[str, str]):
    """``read_usable`` and the path that each file was found below."""
    found, skipped, source = [], [], {}
    for path in paths:
        try:
            inside = files.below(spark, path, options.get("pathGlobFilter", "*"))
        except Exception as err:
            skipped.append((path, str(err).splitlines()[0][:200]))
            continue
        if not inside:
            skipped.append((path, "no such file or folder, or no file in it"))
        found += inside
        source.update((name, path) for name in inside)
    groups, broken = _by_header(spark, found, options)
    skipped += broken
    parts = []
    reader = {k: v for k, v in options.items() if k != "pathGlobFilter"}
    for header, names in groups.items():
        columns = next(csv.reader([header], delimiter=options.get("sep", ","), quotechar=options.get("quote", '"')))
        lacking = [c for c in (date, demand) if c not in columns]
        if lacking:
            skipped += [(name, f"no column {' or '.join(lacking)}") for name in names]
        else:
            parts.append(spark.read.options(header=True, inferSchema=False, **reader).csv(names).select(date, demand))
    if not parts:
        raise IngestError("none of the sources could be read")
    return union_all(parts), skipped, source


def peek_columns(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV."""
    try:
        return read_csv(spark, path).columns
    except AnalysisException as err:
        raise IngestError(f"cannot read columns of {path}") from err


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.csv`` files of one folder as one scan."""
    try:
        df = read_csv(spark, folder, pathGlobFilter="*.csv")
    except AnalysisException as err:
        raise IngestError(f"folder {folder} is missing or holds no CSV file") from err
    if not df.columns:
        raise IngestError(f"folder {folder} holds no CSV file")
    return df


def read_many(
    spark: SparkSession, paths: Sequence[str], date: str, demand: str
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Union of (date, demand) over several CSVs, and the sources left out with the reason; of a source that is used, its files."""
    df, skipped, source = _usable(spark, paths, date, demand, {})
    files_of, lost = Counter(source.values()), Counter(source[p] for p, _ in skipped if p in source)
    out = []
    for path, reason in skipped:
        whole = source.get(path, path)
        entry = (whole if lost[whole] == files_of[whole] else path, reason)
        if entry not in out:
            out.append(entry)
    order = {path: i for i, path in enumerate(paths)}
    return df, sorted(out, key=lambda e: order[source.get(e[0], e[0])])


def read_folder_usable(spark: SparkSession, folder: str, date: str, demand: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All usable ``*.csv`` files below a folder, and the others with the reason."""
    return read_usable(spark, [folder], date, demand, pathGlobFilter="*.csv")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_train_test(
    spark: SparkSession, train: str, test: str, template: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    return read_csv(spark, train), read_csv(spark, test), read_csv(spark, template) if template else None


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalogue table, the usual home of a warehouse history."""
    return spark.table(name)


def read_jdbc(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """A warehouse table; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(**options).load()


def table_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def melt_wide(df: DataFrame, start_date: str, keys: Sequence[str] = (), demand: str = "demand") -> DataFrame:
    """Day columns ``d_1 … d_N`` to one summed row per date (and key).

    The day columns become one array that is exploded next to the partial sums, so only one
    row per key and day reaches the shuffle, and the plan does not grow with N.
    """
    days = day_columns(df.columns)
    if not days:
        raise IngestError("no day columns d_<number> found")
    by_day = {int(d[2:]): d for d in days}
    slots = [F.struct(F.lit(i).alias("i"), F.col(by_day[i]).alias("text")) for i in sorted(by_day)]
    long = df.select(*keys, F.explode(F.array(*slots)).alias("_cell"))
    value = F.sum(F.col("_cell.text").try_cast("double"))  # a day without any value sums to 0
    sums = long.groupBy(*keys, F.col("_cell.i").alias("_i")).agg(F.coalesce(value, F.lit(0.0)).alias(demand))
    date = F.date_add(F.lit(start_date).cast("date"), F.col("_i") - 1)
    return sums.select(*keys, date.alias("date"), demand)


def aggregate_rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Coerce, drop unreadable and negative rows, and sum per period: one partial/final aggregate."""
    return (
        df.select(
            *spec.keys,
            spec.period(F.col(spec.date)).alias(spec.date),
            to_number(F.col(spec.demand)).alias(spec.demand),
        )
        .where(F.col(spec.date).isNotNull() & (F.col(spec.demand) >= 0))
        .groupBy(*spec.keys, spec.date)
        .agg(F.sum(spec.demand).alias(spec.demand))
    )


def source_manifest(df: DataFrame) -> DataFrame:
    """Name, size and signature of every file behind a file-based frame."""
    meta = df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("bytes"),
    )
    return meta.groupBy("path", "file_name", "bytes").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "file_name", "bytes", "n_rows",
        F.sha2(F.concat_ws("::", "path", F.col("bytes").cast("string")), 256).alias("signature"),
    )
