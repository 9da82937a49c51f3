"""Sources, sinks, validation and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import clean as c
from panelcast.operators import validate as v
from panelcast.operators.evaluate import error_metrics, rolling_accuracy
from panelcast.operators.explore import newest
from panelcast.operators.profile import ProfileStore
from panelcast.operators.splits import panel_rule, split_series
from panelcast.plans.catalogue.base import PANEL, SINGLE, daily, dirty, panel, query, shown, sql, table, totals
from panelcast.plans.store import RunStore
from panelcast.session import workspace, written
from panelcast.sinks import writers
from panelcast.sources import readers
from panelcast.sources.ingest import ingest
from panelcast.sources.roles import is_wide
from panelcast.streaming.increments import PartialSums, ingest_available, running_totals

KEY = ["store_id", "sku_id"]

PARSED = sql("SELECT * FROM parsed", ["parsed"], doubles=["units_sold"], dates=["date"])


@query("P1P2_parse", PARSED)
def parse(spark: SparkSession, sf: str) -> DataFrame:
    return shown(c.parse_columns(dirty(spark, sf), PANEL))


@query("S1_csv", PARSED)
def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.write_csv(dirty(spark, sf), workspace(spark, "sales_csv"))
    return shown(c.parse_columns(readers.read_csv(spark, path), PANEL))


@query("S2_many_csv", sql(
    "SELECT date, sum(units_sold) AS units_sold FROM panel GROUP BY date", ["panel"], doubles=["units_sold"], dates=["date"]))
def many_csv(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV per store; the last source does not exist and is reported, not fatal."""
    base = workspace(spark, "stores")
    daily(spark, sf).write.partitionBy("store_id").option("header", True).csv(base)
    paths = [f"{base}/store_id=S{i}" for i in range(5)]
    merged, skipped = readers.read_many(spark, [*paths, workspace(spark, "absent")], "date", "units_sold")
    assert len(skipped) == 1
    return shown(c.collapse_duplicates(c.parse_columns(merged, SINGLE), SINGLE))


@query("S3_folder", sql("SELECT * FROM daily", ["daily"], doubles=["units_sold"], dates=["date"]))
def folder(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.write_csv(daily(spark, sf), workspace(spark, "folder"))
    return shown(c.parse_columns(readers.read_folder(spark, path), PANEL))


@query("S3_folder_mixed", sql(
    "SELECT date, sum(units_sold) AS units_sold FROM panel WHERE store_id <> 'S4' GROUP BY date", ["panel"], doubles=["units_sold"], dates=["date"]))
def folder_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one folder with their columns in other orders, under another name, or empty; unusable ones are left out with a reason."""
    base, rows = workspace(spark, "mixed"), daily(spark, sf).persist()
    shapes = {"S0": PANEL.columns, "S1": PANEL.columns[::-1], "S2": ["units_sold", "date"], "S3": ["date", "sku_id", "units_sold"]}
    for store, columns in shapes.items():
        writers.write_csv(rows.where(F.col("store_id") == store).select(*columns), f"{base}/{store}")
    writers.write_csv(rows.where("store_id = 'S4'").withColumnRenamed("date", "moment"), f"{base}/S4")
    rows.unpersist()
    found, skipped = readers.read_folder_usable(spark, base, "date", "units_sold")
    assert skipped and all(reason == "no column date" and "/S4/" in path for path, reason in skipped)
    return shown(c.collapse_duplicates(c.parse_columns(found, SINGLE), SINGLE))


@query("P1_date_formats", sql(
    "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n_rows, sum(l_quantity) AS units_sold FROM lineitem GROUP BY 1", doubles=["units_sold"], dates=["date"]))
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    """A day-first source in seven spellings; the column itself tells the order of day and month."""
    spellings = ["yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy", "d.M.yyyy", "MMM d yyyy", "d MMM yyyy", "d/M/yy"]
    text = F.date_format("l_shipdate", spellings[0])
    for i, form in enumerate(spellings[1:], start=2):
        text = F.when(F.col("l_linenumber") == i, F.date_format("l_shipdate", form)).otherwise(text)
    rows = table(spark, sf, "lineitem").select(text.alias("date"), F.col("l_quantity").alias("units_sold"))
    texts = written(c.collapse_texts(rows, SINGLE), "texts")
    spec = c.detect_date_order(texts, SINGLE)
    assert c.unread_dates(texts, spec).first().n_unread == 0
    parsed = c.parse_columns(texts, spec)
    return shown(parsed.groupBy("date").agg(F.sum("n_rows").alias("n_rows"), F.sum("units_sold").alias("units_sold")))


@query("S4_train_test", sql(
    """SELECT CASE WHEN pos >= greatest(least(greatest(CAST(floor(n_rows * CAST(0.8 AS DOUBLE)) AS BIGINT), 50), n_rows - 1), 0) THEN 'test' ELSE 'train' END AS part,
              count(*) AS n, sum(units_sold) AS units_sold FROM placed GROUP BY 1""", ["placed"], doubles=["units_sold"]))
def train_test(spark: SparkSession, sf: str) -> DataFrame:
    base = workspace(spark, "parts")
    rows = split_series(daily(spark, sf), PANEL, panel_rule()).select(*PANEL.columns, "is_test")
    rows.write.partitionBy("is_test").option("header", True).csv(base)
    a, b, _ = readers.read_train_test(spark, f"{base}/is_test=false", f"{base}/is_test=true")
    both = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))
    return shown(both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("units_sold").cast("double")).alias("units_sold")))


def _wide(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Day columns d_1 … d_N per brand, over the whole span of dates."""
    rows = daily(spark, sf)
    span = rows.agg(F.min("date").alias("a"), F.datediff(F.max("date"), F.min("date")).alias("n")).first()
    day = F.concat(F.lit("d_"), (F.datediff("date", F.lit(span.a)) + 1).cast("string"))
    names = [f"d_{i}" for i in range(1, span.n + 2)]
    by_day = rows.groupBy("sku_id", day.alias("d")).agg(F.sum("units_sold").alias("units"))
    return by_day.groupBy(F.col("sku_id").alias("item_id")).pivot("d", names).agg(F.first("units")), str(span.a)


@query("S9_unpivot", sql(
    """SELECT d.date AS date, coalesce(t.units_sold, 0) AS demand
       FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM totals) d
       LEFT JOIN totals t USING (date)""", ["totals"], doubles=["demand"], dates=["date"]))
def unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide, start = _wide(spark, sf)
    stored = readers.read_csv(spark, writers.write_csv(wide, workspace(spark, "wide_csv")))
    assert is_wide(stored.columns)
    return shown(readers.melt_wide(stored, start))


@query("S9_unpivot_keyed", sql(
    """SELECT k.item_id, d.date AS date, coalesce(t.units_sold, 0) AS demand
       FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM totals) d
       CROSS JOIN (SELECT DISTINCT sku_id AS item_id FROM daily) k
       LEFT JOIN (SELECT sku_id, date, sum(units_sold) AS units_sold FROM daily GROUP BY ALL) t ON t.date = d.date AND t.sku_id = k.item_id""",
    ["totals", "daily"], doubles=["demand"], dates=["date"]))
def unpivot_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """The wide layout with its key kept: one row per item and day."""
    wide, start = _wide(spark, sf)
    stored = readers.read_csv(spark, writers.write_csv(wide, workspace(spark, "wide_csv")))
    return shown(readers.melt_wide(stored, start, keys=["item_id"]))


@query("S10_manifest")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return readers.source_manifest(table(spark, sf, "lineitem"))


@query("S10_rows", "SELECT 'lineitem.parquet' AS file_name, count(*) AS n_rows FROM lineitem")
def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return readers.source_manifest(table(spark, sf, "lineitem")).select("file_name", "n_rows")


SUMMED = sql(
    "SELECT date, sum(units_sold) AS units_sold FROM parsed WHERE units_sold >= 0 GROUP BY date",
    ["parsed"], doubles=["units_sold"], dates=["date"])


@query("S11_aggregate", SUMMED)
def aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return shown(readers.aggregate_rows(dirty(spark, sf), SINGLE))


@query("S12_increments", sql("SELECT * FROM totals", ["totals"], doubles=["units_sold"], dates=["date"]))
def increments(spark: SparkSession, sf: str) -> DataFrame:
    """The order lines ingested as a stream of files, then summed."""
    target, checkpoint = workspace(spark, "increments"), workspace(spark, "increments_log")
    columns = [F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("units_sold")]
    schema = table(spark, sf, "lineitem").schema
    ingest_available(spark, sf, schema, columns, SINGLE, target, checkpoint, glob="lineitem.parquet")
    return shown(running_totals(spark, target, SINGLE))


@query("S12_compacted", sql(
    "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS units_sold, count(*) AS n_rows FROM lineitem GROUP BY 1",
    doubles=["units_sold"], dates=["date"]))
def compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Partial sums of three batches, compacted after the second; the last batch is replayed."""
    sums = PartialSums(spark, workspace(spark, "sums"), SINGLE)
    rows = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("date"), F.col("l_quantity").alias("units_sold"), "l_linenumber")
    for batch, part in enumerate(("l_linenumber <= 2", "l_linenumber between 3 and 4", "l_linenumber > 4", "l_linenumber > 4")):
        sums.add(rows.where(part), min(batch, 2))
        if batch == 1:
            sums.compact()
    assert len(sums.parts()) == 2
    return shown(sums.totals())


@query("S13_table_count", "SELECT count(*) AS n_rows FROM lineitem")
def table_count(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("demand_history")
    return readers.table_rows(readers.read_table(spark, "demand_history"))


@query("S14_ingest", sql(
    "SELECT date, sum(units_sold) AS units_sold FROM daily GROUP BY date", ["daily"], doubles=["units_sold"], dates=["date"]))
def ingest_all(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.write_csv(daily(spark, sf), workspace(spark, "history"))
    clean, meta = ingest(spark, [path])
    assert meta["sales_col"] == "units_sold" and not meta["skipped"]
    return shown(clean)


@query("U1_union", sql(
    "SELECT date, units_sold FROM daily UNION ALL SELECT date, units_sold FROM totals", ["daily", "totals"], doubles=["units_sold"], dates=["date"]))
def union(spark: SparkSession, sf: str) -> DataFrame:
    return shown(readers.union_all([daily(spark, sf).select("date", "units_sold"), totals(spark, sf)]))


@query("A1_dedup", sql("SELECT * FROM collapsed", ["collapsed"], doubles=["units_sold"], dates=["date"]))
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    return shown(c.collapse_duplicates(c.parse_columns(dirty(spark, sf), PANEL), PANEL))


@query("W1_fill", sql("SELECT * FROM filled", ["filled"], doubles=["units_sold"], dates=["date"]))
def fill(spark: SparkSession, sf: str) -> DataFrame:
    return shown(c.fill_missing(c.collapse_duplicates(c.parse_columns(dirty(spark, sf), PANEL), PANEL), PANEL))


@query("W2_mean_fill", sql(
    "SELECT store_id, sku_id, date, coalesce(units_sold, (SELECT avg(units_sold) FROM collapsed)) AS units_sold FROM collapsed",
    ["collapsed"], doubles=["units_sold"], dates=["date"]))
def mean_fill(spark: SparkSession, sf: str) -> DataFrame:
    return shown(c.fill_with_mean(c.collapse_duplicates(c.parse_columns(dirty(spark, sf), PANEL), PANEL), PANEL))


@query("P3_non_negative", sql("SELECT * FROM collapsed WHERE units_sold >= 0", ["collapsed"], doubles=["units_sold"], dates=["date"]))
def non_negative(spark: SparkSession, sf: str) -> DataFrame:
    return shown(c.drop_negative(c.collapse_duplicates(c.parse_columns(dirty(spark, sf), PANEL), PANEL), PANEL))


@query("C2_clean_panel", sql("SELECT * FROM clean", ["clean"], doubles=["units_sold"], dates=["date"]))
def clean_panel(spark: SparkSession, sf: str) -> DataFrame:
    return shown(c.clean_data(dirty(spark, sf), PANEL))


@query("C1_clean_single", sql(
    "SELECT * FROM one WHERE units_sold >= 0", ["parsed"], doubles=["units_sold"], dates=["date"],
    summed="SELECT date, sum(units_sold) AS units_sold FROM parsed GROUP BY date",
    one="""SELECT date, coalesce(last_value(units_sold IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                                 first_value(units_sold IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS units_sold FROM summed"""))
def clean_single(spark: SparkSession, sf: str) -> DataFrame:
    return shown(c.clean_data(dirty(spark, sf), SINGLE))


def _profile_sql() -> str:
    parts = [
        f"""SELECT {i} AS position, '{name}' AS "column", 'string' AS type, count(*) AS n_rows,
                   count(*) FILTER (WHERE {name} IS NULL) AS n_missing, count(DISTINCT {name}) AS n_distinct,
                   (SELECT string_agg(x, ' | ' ORDER BY x) FROM (SELECT DISTINCT {name} AS x FROM dirty WHERE {name} IS NOT NULL ORDER BY 1 LIMIT 3)) AS samples
            FROM dirty"""
        for i, name in enumerate(["store_id", "sku_id", "date", "units_sold"])
    ]
    return sql(" UNION ALL ".join(parts), ["dirty"])


@query("P5_profile", _profile_sql())
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return v.column_profile(dirty(spark, sf))


@query("P5_incremental", sql(
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c_}' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE {c_} IS NULL) AS n_missing,
                   count(try_cast({c_} AS DOUBLE)) AS n_numeric, min({c_}) AS smallest, max({c_}) AS largest, true AS within FROM dirty"""
        for i, c_ in enumerate(["store_id", "sku_id", "date", "units_sold"])), ["dirty"]))
def profile_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of five files merged; the sketches must lie within their stated error of the exact figures."""
    base, store = workspace(spark, "dirty"), ProfileStore(spark, workspace(spark, "profiles"))
    filed = dirty(spark, sf).withColumn("file", F.col("store_id"))
    filed.write.partitionBy("file").parquet(base)
    rows = spark.read.schema(filed.schema).parquet(base)  # a scan of one file leaves the others unread
    for i in (0, 1, 2, 3, 4, 4):  # the last file is added twice
        store.add(rows.where(F.col("file") == f"S{i}").drop("file"), f"S{i}")
    rows = rows.drop("file")
    exact = v.column_profile(rows).select(F.col("column").alias("_c"), F.col("n_distinct").alias("_n"))
    found = store.profile().join(exact, F.col("column") == F.col("_c"))
    number = F.col("units_sold").try_cast("double")
    ranks = rows.select(number.alias("x")).where("x is not null")
    half = found.where("column = 'units_sold'").select("median").scalar()
    share = ranks.agg((F.count_if(F.col("x") < half) / F.count("x")).alias("below"), (F.count_if(F.col("x") <= half) / F.count("x")).alias("to"))
    # The exact rank of the median lies between the shares below it and up to it, give or take the sketch's error.
    fits = share.select(((F.col("below") <= 0.51) & (F.col("to") >= 0.49)).alias("ok")).scalar()
    return found.select(
        "position", "column", "n_rows", "n_missing", "n_numeric", "smallest", "largest",
        ((F.abs(F.col("n_distinct") - F.col("_n")) <= 0.03 * F.col("_n")) & ((F.col("column") != "units_sold") | fits)).alias("within"))


@query("P6_validation", sql(
    """SELECT 'dates' AS rule, 'warning' AS severity, CAST(bad_dates AS DOUBLE) AS value FROM f WHERE bad_dates > 0 AND bad_dates < dates
       UNION ALL SELECT 'dates', 'error', CAST(bad_dates AS DOUBLE) FROM f WHERE bad_dates > 0 AND bad_dates = dates
       UNION ALL SELECT 'numeric', 'warning', CAST(n - numeric AS DOUBLE) FROM f WHERE n > numeric AND numeric > 0
       UNION ALL SELECT 'row_count', 'warning', CAST(n AS DOUBLE) FROM f WHERE n < 100
       UNION ALL SELECT 'missing', 'warning', missing / n FROM f WHERE missing / n > 0.3
       UNION ALL SELECT 'group_size', 'warning', CAST(min(g) AS DOUBLE) FROM sizes HAVING min(g) < 400
       UNION ALL SELECT 'group_count', 'info', CAST(count(*) AS DOUBLE) FROM sizes""", ["dirty"], doubles=["value"],
    f="""SELECT count(*) AS n, count(try_cast(units_sold AS DOUBLE)) AS numeric, count(*) FILTER (WHERE units_sold IS NULL) AS missing,
                count(*) FILTER (WHERE date IS NOT NULL AND try_cast(date AS DATE) IS NULL) AS bad_dates, count(date) AS dates FROM dirty""",
    sizes="SELECT count(*) AS g FROM dirty GROUP BY store_id, sku_id"))
def validation(spark: SparkSession, sf: str) -> DataFrame:
    return shown(v.validate_data(dirty(spark, sf), PANEL, seq_length=390).drop("message"))


FACTS = """SELECT count(*) AS rows, count(*) FILTER (WHERE units_sold IS NULL) AS missing, count(*) FILTER (WHERE units_sold < 0) AS negative,
                  count(*) - (SELECT count(*) FROM (SELECT DISTINCT store_id, sku_id, date FROM parsed)) AS duplicates,
                  min(units_sold) AS low, max(units_sold) AS high FROM parsed"""


@query("P7_quality", sql(
    """SELECT rows, missing_pct, duplicates, negative, outliers, passed, CAST(round_even(passed / 6 * 100, 0) AS INTEGER) AS score
       FROM (SELECT *, CAST((missing_pct < 5)::INT + (duplicates = 0)::INT + (negative = 0)::INT + (outliers * 100.0 / rows < 5)::INT + 2 AS INTEGER) AS passed
             FROM (SELECT rows, CAST(missing * 100.0 / rows AS DOUBLE) AS missing_pct, duplicates, negative, (SELECT n FROM o) AS outliers FROM facts))""",
    ["parsed"], doubles=["missing_pct"],
    facts=FACTS,
    q="SELECT quantile_cont(units_sold, 0.25) AS q1, quantile_cont(units_sold, 0.75) AS q3 FROM parsed",
    o="""SELECT count(*) AS n FROM parsed, q WHERE units_sold < q1 - 1.5 * (q3 - q1) OR units_sold > q3 + 1.5 * (q3 - q1)"""))
def quality(spark: SparkSession, sf: str) -> DataFrame:
    return shown(v.quality_score(c.parse_columns(dirty(spark, sf), PANEL), PANEL))


@query("P8_checks", sql(
    """SELECT 'missing values' AS "check", CAST(missing * 100.0 / rows AS DOUBLE) AS value,
              CASE WHEN missing = 0 THEN 'pass' WHEN missing * 100.0 / rows < 5 THEN 'warn' ELSE 'err' END AS level FROM facts
       UNION ALL SELECT 'negative demand', negative, CASE WHEN negative = 0 THEN 'pass' ELSE 'warn' END FROM facts
       UNION ALL SELECT 'demand variance', high - low, CASE WHEN high > low THEN 'pass' ELSE 'err' END FROM facts
       UNION ALL SELECT 'row count', rows, CASE WHEN rows >= 100 THEN 'pass' ELSE 'warn' END FROM facts""",
    ["parsed"], doubles=["value"], facts=FACTS))
def checks(spark: SparkSession, sf: str) -> DataFrame:
    return shown(v.data_checks(c.parse_columns(dirty(spark, sf), PANEL), PANEL))


@query("P9_admission", sql(
    """SELECT store_id, sku_id, count(*) AS n_rows, count(*) FILTER (WHERE units_sold IS NULL) AS n_not_finite,
              CASE WHEN count(*) < 3 OR count(*) FILTER (WHERE units_sold IS NULL) > 0 THEN 'rejected' ELSE 'ok' END AS status,
              CASE WHEN count(*) < 3 THEN 'at least 3 observations are needed, got ' || count(*)
                   WHEN count(*) FILTER (WHERE units_sold IS NULL) > 0 THEN count(*) FILTER (WHERE units_sold IS NULL) || ' non-finite value(s)' END AS reason
       FROM collapsed GROUP BY store_id, sku_id""", ["collapsed"]))
def admission(spark: SparkSession, sf: str) -> DataFrame:
    return v.series_admission(c.collapse_duplicates(c.parse_columns(dirty(spark, sf), PANEL), PANEL), PANEL)


@query("K1_csv_sink", sql("SELECT * FROM daily", ["daily"], doubles=["units_sold"], dates=["date"]))
def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = writers.write_csv(daily(spark, sf), workspace(spark, "out"))
    schema = "store_id string, sku_id string, date date, units_sold double"
    return shown(spark.read.schema(schema).option("header", True).csv(path))


@query("K2_bundle", sql(
    """SELECT 'processed' AS "table", count(*) AS n_rows, sum(units_sold) AS units FROM daily
       UNION ALL SELECT 'totals', count(*), sum(units_sold) FROM totals""", ["daily", "totals"], doubles=["units"]))
def bundle(spark: SparkSession, sf: str) -> DataFrame:
    paths = writers.write_report_bundle(
        workspace(spark, "bundle"), {"processed": daily(spark, sf), "totals": totals(spark, sf)}
    )
    parts = [
        readers.read_csv(spark, path).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("units_sold").cast("double")).alias("units"))
        .withColumn("table", F.lit(name))
        for name, path in paths.items()
    ]
    return shown(readers.union_all(parts))


@query("K4_runs", sql(
    "SELECT store_id, sku_id, sum(units_sold) * 2 AS total, 'second' AS run_id FROM daily GROUP BY ALL", ["daily"], doubles=["total"]))
def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the same unit are stored; the newest row per unit is read."""
    path = workspace(spark, "runs")
    sums = daily(spark, sf).groupBy(*KEY).agg(F.sum("units_sold").alias("total")).withColumn("created_at", F.lit(1))
    writers.append_run(sums, path, "first")
    writers.append_run(sums.withColumns({"total": F.col("total") * 2, "created_at": F.lit(2)}), path, "second")
    return shown(writers.latest_unique(writers.read_runs(spark, path), KEY, ["created_at"]).drop("created_at"))


@query("A22_rolling", sql(
    """SELECT 'Naive' AS model, date, CAST(n AS BIGINT) AS n, far / n AS mae, sqrt(square / n) AS rmse, share / n * 100 AS mape, off / n AS bias, off / nullif(far, 0) AS tracking
       FROM (SELECT date, sum(n) OVER w AS n, sum(off) OVER w AS off, sum(far) OVER w AS far, sum(square) OVER w AS square, sum(share) OVER w AS share
             FROM by_day WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))""", ["placed"],
    doubles=["mae", "rmse", "mape", "bias", "tracking"], dates=["date"],
    origins="SELECT store_id, sku_id, date, units_sold FROM placed WHERE pos % 28 = 0",
    pairs="""SELECT a.date, a.units_sold AS y, o.units_sold AS yhat FROM daily a ASOF JOIN origins o
             ON a.store_id = o.store_id AND a.sku_id = o.sku_id AND a.date - 1 >= o.date WHERE a.date - o.date <= 40""",
    by_day="""SELECT date, count(*) AS n, sum(yhat - y) AS off, sum(abs(yhat - y)) AS far, sum((yhat - y) ** 2) AS square, sum(abs(yhat - y) / y) AS share
              FROM pairs GROUP BY date"""))
def rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Every 28th row of a series forecasts the next 40 days in a log of two runs; accuracy over the last 30 days."""
    store, rows = RunStore(spark, workspace(spark, "store")), daily(spark, sf)
    placed = rows.withColumn("pos", F.row_number().over(PANEL.ordered()) - 1).where("pos % 28 = 0")
    log = placed.select(
        *KEY, F.lit("Naive").alias("model"), F.col("date").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("step"),
        F.col("units_sold").alias("yhat"), (F.col("pos") % 56).alias("half")).withColumn("date", F.date_add("origin", F.col("step")))
    for run_id, half in (("even", 0), ("odd", 28)):
        store.record_forecasts(log.where(F.col("half") == half), run_id, PANEL, F.col("origin"))
    return shown(rolling_accuracy(store.table("forecasts"), rows, PANEL, days=30))


@query("K4_metrics", sql(
    """SELECT 'Naive' AS model, version, avg(abs(units_sold - before)) AS mae, count(*) AS n_samples, min(date) AS test_start, max(date) AS test_end
       FROM (SELECT *, lag(units_sold) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS before FROM daily), (VALUES ('1'), ('2')) v(version)
       WHERE before IS NOT NULL GROUP BY version""", ["daily"], doubles=["mae"], dates=["test_start", "test_end"]))
def stored_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of two versions of a model in the run store; the second is written twice by its run and refused to another."""
    store = RunStore(spark, workspace(spark, "store"))
    rows = daily(spark, sf).withColumn("yhat", F.lag("units_sold").over(PANEL.ordered())).where("yhat is not null")
    judged = error_metrics(rows.select(F.lit("Naive").alias("model"), F.col("units_sold").alias("y"), "yhat"))
    span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    for run_id, version in (("first", "1"), ("second", "2"), ("second", "2")):
        store.record_metrics(judged, run_id, version, F.lit(span.a), F.lit(span.b), F.lit(1))
    try:
        store.record_metrics(judged, "third", "2", F.lit(span.a), F.lit(span.b), F.lit(1))
        raise AssertionError("a claimed version was given twice")
    except ValueError:
        pass
    return shown(store.table("metrics").select("model", "version", "mae", "n_samples", "test_start", "test_end"))


@query("K5_page", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice
                     FROM orders ORDER BY orders.o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def page(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice")
    return shown(newest(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 20, page=2))
