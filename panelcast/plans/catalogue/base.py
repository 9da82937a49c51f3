"""Shared inputs of the catalogue: the demand panel in Spark and the same panel as SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.scalars import iso_date
from panelcast.operators.clean import collapse_duplicates
from panelcast.spec import SeriesSpec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PANEL = SeriesSpec()
SINGLE = PANEL.single()
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their store and brand. AQE broadcasts ``part`` only when it is small."""
    line = table(spark, sf_dir, "lineitem").withColumn("store_id", F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sku_id"))
    return line.join(part, line.l_partkey == part.p_partkey)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw demand rows: several per (store, sku, date)."""
    return lines(spark, sf_dir).select(
        "store_id", "sku_id", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("units_sold")
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as text, with unreadable dates and amounts, gaps and negative amounts."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    amount = (
        F.when(n == 7, F.lit("n/a"))
        .when((n == 6) | ((n <= 3) & (flag == "N")), F.lit(None).cast("string"))
        .when((n == 4) & (flag == "R"), (-F.col("l_quantity")).cast("string"))
        .otherwise(F.col("l_quantity").cast("string"))
    )
    day = F.when((n == 5) & (flag == "A"), F.lit("unknown")).otherwise(iso_date(F.col("l_shipdate")))
    return lines(spark, sf_dir).select("store_id", "sku_id", day.alias("date"), amount.alias("units_sold"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (store, sku, date)."""
    return collapse_duplicates(panel(spark, sf_dir), PANEL)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single series: total demand per date."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("units_sold")
    )
    return collapse_duplicates(rows, SINGLE)


def shown(df: DataFrame) -> DataFrame:
    """Doubles to six places and dates as ISO text, so that both engines print the same."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, DIGITS)
        elif kind == "date":
            c = iso_date(c)
        columns.append(c.alias(name))
    return df.select(columns)


# Steps of the SQL side, each built on the ones before it.
_STEPS = {
    "panel": """
        SELECT 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS store_id, p_brand AS sku_id,
               CAST(l_shipdate AS DATE) AS date, l_quantity AS units_sold
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "dirty": """
        SELECT 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS store_id, p_brand AS sku_id,
               CASE WHEN l_linenumber = 5 AND l_returnflag = 'A' THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
               CASE WHEN l_linenumber = 7 THEN 'n/a'
                    WHEN l_linenumber = 6 OR (l_linenumber <= 3 AND l_returnflag = 'N') THEN NULL
                    WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN CAST(-l_quantity AS VARCHAR)
                    ELSE CAST(l_quantity AS VARCHAR) END AS units_sold
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "parsed": """
        SELECT store_id, sku_id, try_cast(date AS DATE) AS date, try_cast(units_sold AS DOUBLE) AS units_sold
        FROM dirty WHERE try_cast(date AS DATE) IS NOT NULL""",
    "collapsed": "SELECT store_id, sku_id, date, sum(units_sold) AS units_sold FROM parsed GROUP BY ALL",
    "filled": """
        SELECT store_id, sku_id, date,
               coalesce(last_value(units_sold IGNORE NULLS) OVER (PARTITION BY store_id, sku_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        first_value(units_sold IGNORE NULLS) OVER (PARTITION BY store_id, sku_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS units_sold
        FROM collapsed""",
    "clean": """
        SELECT * FROM (SELECT store_id, sku_id, date, coalesce(units_sold, (SELECT avg(units_sold) FROM filled)) AS units_sold FROM filled)
        WHERE units_sold >= 0""",
    "daily": "SELECT store_id, sku_id, date, sum(units_sold) AS units_sold FROM panel GROUP BY ALL",
    "totals": "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS units_sold FROM lineitem GROUP BY ALL",
    "placed": """
        SELECT *, row_number() OVER (PARTITION BY store_id, sku_id ORDER BY date) - 1 AS pos,
               count(*) OVER (PARTITION BY store_id, sku_id) AS n_rows FROM daily""",
}
# Steps that are read more than once further on; worked out once.
_KEPT = {"filled"}
_NEEDS = {
    "parsed": ["dirty"], "collapsed": ["parsed"], "filled": ["collapsed"], "clean": ["filled"],
    "daily": ["panel"], "placed": ["daily"],
}


def _closure(names: Sequence[str]) -> list[str]:
    seen: list[str] = []
    for name in names:
        for inner in [*_closure(_NEEDS.get(name, [])), name]:
            if inner not in seen:
                seen.append(inner)
    return seen


def sql(body: str, use: Sequence[str] = (), doubles: Sequence[str] = (), dates: Sequence[str] = (), recursive: bool = False, **extra: str) -> str:
    """Assemble the steps, further named steps and the body; round and format like ``shown``."""
    parts = [f"{name} AS {'MATERIALIZED ' if name in _KEPT else ''}({_STEPS[name]})" for name in _closure(use)]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    parts.append(f"answer AS ({body})")
    fixes = [f"round({c}, {DIGITS}) + 0 AS {c}" for c in doubles]
    fixes += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
    star = f"* REPLACE ({', '.join(fixes)})" if fixes else "*"
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} SELECT {star} FROM answer"
