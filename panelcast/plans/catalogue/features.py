"""Calendar, lag, rolling and window features, splits and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import calendar, features, scaling, splits
from panelcast.plans.catalogue.base import PANEL, SINGLE, daily, query, shown, sql, totals

KEY = ["store_id", "sku_id"]
BY = "PARTITION BY store_id, sku_id ORDER BY date"
SEQ = 30


def as_text(values: Column) -> Column:
    """Array of numbers as text with six places, so that engines compare cell by cell."""
    return F.array_join(values.cast("array<decimal(18,6)>").cast("array<string>"), ",")


def text_of(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: CAST(CAST(x AS DECIMAL(18, 6)) AS VARCHAR)), ',')"


@query("F1_calendar", sql(
    """SELECT date, CAST(year(date) AS INTEGER) AS "Year", CAST(month(date) AS INTEGER) AS "Month", CAST(weekofyear(date) AS INTEGER) AS "Week",
              CAST(day(date) AS INTEGER) AS "Day", CAST(isodow(date) - 1 AS INTEGER) AS "DayOfWeek", CAST(quarter(date) AS INTEGER) AS "Quarter",
              CAST(isodow(date) >= 6 AS INTEGER) AS "IsWeekend" FROM totals""", ["totals"], dates=["date"]))
def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    return shown(calendar.time_features(totals(spark, sf).select("date"), "date"))


@query("F2_lag", sql(
    f"""SELECT * FROM (SELECT store_id, sku_id, date, units_sold,
          {", ".join(f'lag(units_sold, {k}) OVER ({BY}) AS "Sales_Lag_{k}"' for k in (1, 7, 14, 30))} FROM daily)
        WHERE "Sales_Lag_30" IS NOT NULL""", ["daily"], dates=["date"]))
def lag(spark: SparkSession, sf: str) -> DataFrame:
    return shown(features.lag_features(daily(spark, sf), PANEL))


@query("F3_rolling", sql(
    f"""SELECT store_id, sku_id, date, units_sold, {", ".join(
        f'avg(units_sold) OVER ({BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS "Rolling_Mean_{w}", '
        f'coalesce(stddev_samp(units_sold) OVER ({BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 0) AS "Rolling_Std_{w}"'
        for w in (7, 14, 30))} FROM daily""",
    ["daily"], doubles=[f'"Rolling_{a}_{w}"' for w in (7, 14, 30) for a in ("Mean", "Std")], dates=["date"]))
def rolling(spark: SparkSession, sf: str) -> DataFrame:
    return shown(features.rolling_features(daily(spark, sf), PANEL))


@query("F4_trend", sql(
    f"""SELECT store_id, sku_id, date, units_sold, avg(units_sold) OVER ({BY} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS "MA_Short",
               avg(units_sold) OVER ({BY} ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS "MA_Long" FROM daily""",
    ["daily"], doubles=['"MA_Short"', '"MA_Long"'], dates=["date"]))
def trend(spark: SparkSession, sf: str) -> DataFrame:
    return shown(features.moving_averages(daily(spark, sf), PANEL))


@query("F5_windows", sql(
    f"""SELECT store_id, sku_id, date, units_sold AS target, {text_of("w")} AS "window"
        FROM (SELECT *, list(units_sold) OVER ({BY} ROWS BETWEEN {SEQ} PRECEDING AND 1 PRECEDING) AS w FROM daily) WHERE len(w) = {SEQ}""",
    ["daily"], dates=["date"]))
def windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.sliding_windows(daily(spark, sf), PANEL, SEQ)
    return shown(rows.withColumn("window", as_text(F.col("window"))))


@query("F7_tail", sql(
    f"""SELECT store_id, sku_id, date AS last_date, CAST(least(n, 60) AS INTEGER) AS n_history,
               {text_of("CASE WHEN len(w) < 60 THEN list_concat(list_transform(range(60 - len(w)), lambda i: m), w) ELSE w END")} AS "window"
        FROM (SELECT *, list(units_sold) OVER ({BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS w, avg(units_sold) OVER ({BY} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m,
                     row_number() OVER (PARTITION BY store_id, sku_id ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY store_id, sku_id) AS n FROM daily)
        WHERE back = 1""", ["daily"], dates=["last_date"]))
def tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.tail_windows(daily(spark, sf), PANEL, 60)
    return shown(rows.withColumn("window", as_text(F.col("window"))))


@query("T4_tail", sql(
    f"SELECT store_id, sku_id, date, units_sold FROM (SELECT *, row_number() OVER (PARTITION BY store_id, sku_id ORDER BY date DESC) AS r FROM daily) WHERE r <= 90",
    ["daily"], dates=["date"]))
def newest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return shown(features.last_rows(daily(spark, sf), PANEL, 90))


@query("T1_sorted", sql("SELECT * FROM daily ORDER BY store_id, sku_id, date", ["daily"], dates=["date"]))
def ordered(spark: SparkSession, sf: str) -> DataFrame:
    return shown(daily(spark, sf).orderBy("store_id", "sku_id", "date"))


@query("A7_resample_week", sql(
    """SELECT CAST(c.d AS DATE) AS date, coalesce(w.units_sold, 0) AS units_sold FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 7 DAY)) AS d FROM weekly) c
       LEFT JOIN weekly w ON w.d = CAST(c.d AS DATE)""", ["totals"], dates=["date"],
    weekly="SELECT CAST(date + CAST((7 - isodow(date)) AS INTEGER) AS DATE) AS d, sum(units_sold) AS units_sold FROM totals GROUP BY 1"))
def resample_week(spark: SparkSession, sf: str) -> DataFrame:
    return shown(calendar.resample(totals(spark, sf), SINGLE, "W"))


@query("A7_resample_month", sql(
    """SELECT store_id, sku_id, last_day(m) AS date, coalesce(units_sold, 0) AS units_sold
       FROM (SELECT store_id, sku_id, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS m FROM (SELECT store_id, sku_id, min(m) AS a, max(m) AS b FROM monthly GROUP BY ALL))
       LEFT JOIN monthly USING (store_id, sku_id, m)""", ["daily"], dates=["date"],
    monthly="SELECT store_id, sku_id, CAST(date_trunc('month', date) AS DATE) AS m, sum(units_sold) AS units_sold FROM daily GROUP BY ALL"))
def resample_month(spark: SparkSession, sf: str) -> DataFrame:
    return shown(calendar.resample(daily(spark, sf), PANEL, "M"))


@query("J7_gap_fill", sql(
    """SELECT store_id, sku_id, date, coalesce(units_sold, 0) AS units_sold
       FROM (SELECT store_id, sku_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT store_id, sku_id, min(date) AS a, max(date) AS b FROM daily GROUP BY ALL))
       LEFT JOIN daily USING (store_id, sku_id, date)""", ["daily"], dates=["date"]))
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return shown(calendar.gap_fill(daily(spark, sf), PANEL))


@query("G1_future_dates", sql(
    """SELECT store_id, sku_id, CAST(s AS INTEGER) AS step, CAST(max(date) + CAST(s AS INTEGER) AS DATE) AS date
       FROM daily, (SELECT unnest(range(1, 31)) AS s) GROUP BY store_id, sku_id, s""", ["daily"], dates=["date"]))
def future(spark: SparkSession, sf: str) -> DataFrame:
    return shown(calendar.future_dates(daily(spark, sf), PANEL, 30))


def split_of(floor: int | None) -> str:
    plain = "CAST(floor(CAST(n_rows AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT)"
    return plain if floor is None else f"least(greatest({plain}, {floor}), n_rows - 1)"


def _split_sql(floor: int | None, least: int, source: str = "placed", keys: str = "store_id, sku_id, ") -> str:
    return f"""SELECT {keys}date, units_sold, CAST(pos AS BIGINT) AS pos, n_rows, {split_of(floor)} AS split_idx, pos >= {split_of(floor)} AS is_test
               FROM {source} WHERE n_rows >= {least}"""


@query("X1_split", sql(
    _split_sql(None, 0, "one", ""), ["totals"], dates=["date"],
    one="SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n_rows FROM totals"))
def split_single(spark: SparkSession, sf: str) -> DataFrame:
    return shown(splits.split_series(totals(spark, sf), SINGLE, splits.plain_rule()))


@query("X2_split", sql(_split_sql(50, 0), ["placed"], dates=["date"]))
def split_panel(spark: SparkSession, sf: str) -> DataFrame:
    return shown(splits.split_series(daily(spark, sf), PANEL, splits.panel_rule()))


def _status_sql(floor: int, least: int, windows: str = "") -> str:
    return f"""SELECT store_id, sku_id, n_rows, CASE WHEN n_rows >= {least} THEN {split_of(floor)} END AS split_idx,
                      CASE WHEN n_rows >= {least} THEN 'ok' ELSE 'skipped' END AS status,
                      CASE WHEN n_rows < {least} THEN 'too short: ' || n_rows || ' rows' END AS reason {windows}
               FROM (SELECT store_id, sku_id, count(*) AS n_rows FROM daily GROUP BY ALL)"""


SEQ_LONG = 360  # look-back that some series of the panel cannot serve


@query("X4_status", sql(_status_sql(
    SEQ_LONG + 5, SEQ_LONG + 10,
    f""", CASE WHEN n_rows >= {SEQ_LONG + 10} THEN {split_of(SEQ_LONG + 5)} - {SEQ_LONG} END AS n_train_windows,
        CASE WHEN n_rows >= {SEQ_LONG + 10} THEN n_rows - {split_of(SEQ_LONG + 5)} END AS n_test_windows"""), ["daily"]))
def sequence_status(spark: SparkSession, sf: str) -> DataFrame:
    return splits.series_status(daily(spark, sf), PANEL, splits.sequence_rule(SEQ_LONG), SEQ_LONG)


SCALED = f"""SELECT *, (units_sold - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS z
             FROM (SELECT *, min(CASE WHEN NOT is_test THEN units_sold END) OVER (PARTITION BY store_id, sku_id) AS lo,
                          max(CASE WHEN NOT is_test THEN units_sold END) OVER (PARTITION BY store_id, sku_id) AS hi
                   FROM ({_split_sql(SEQ + 5, SEQ + 10)}))"""


@query("X4_split", sql(
    f"""SELECT store_id, sku_id, date, z AS target, {text_of("w")} AS "window", is_test
        FROM (SELECT *, list(z) OVER ({BY} ROWS BETWEEN {SEQ} PRECEDING AND 1 PRECEDING) AS w FROM scaled) WHERE len(w) = {SEQ}""",
    ["placed"], doubles=["target"], dates=["date"], scaled=SCALED))
def split_sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_windows(daily(spark, sf), PANEL, SEQ, splits.sequence_rule(SEQ))
    return shown(rows.select(*KEY, "date", "target", as_text(F.col("window")).alias("window"), "is_test"))


@query("X3_split_counts", sql(
    f"""SELECT count(*) FILTER (WHERE pos >= {SEQ} AND pos < {split_of(None)}) AS n_train, count(*) FILTER (WHERE pos >= {SEQ} AND pos >= {split_of(None)}) AS n_test FROM one""",
    ["totals"], one="SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n_rows FROM totals"))
def split_sequence_single(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_counts(splits.split_windows(totals(spark, sf), SINGLE, SEQ, splits.plain_rule()))


@query("X5_split", sql(_split_sql(10, 20), ["placed"], dates=["date"]))
def split_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return shown(splits.split_series(daily(spark, sf), PANEL, splits.hybrid_rule()))


@query("P10_training_size", sql("SELECT count(*) AS n_rows, CAST(80 AS BIGINT) AS needed, count(*) >= 80 AS ok FROM totals", ["totals"]))
def training_size(spark: SparkSession, sf: str) -> DataFrame:
    return splits.training_size_ok(totals(spark, sf))


@query("Z1_minmax", sql(
    "SELECT store_id, sku_id, min(units_sold) FILTER (WHERE NOT is_test) AS min, max(units_sold) FILTER (WHERE NOT is_test) AS max FROM s GROUP BY ALL",
    ["placed"], s=_split_sql(35, 40)))
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_series(daily(spark, sf), PANEL, splits.sequence_rule(30))
    return shown(scaling.fit_minmax(rows, PANEL, ~F.col("is_test")))


@query("Z2_inverse", sql(
    "SELECT store_id, sku_id, date, z AS scaled, units_sold AS restored FROM scaled", ["placed"],
    doubles=["scaled", "restored"], dates=["date"], scaled=SCALED))
def inverse(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_series(daily(spark, sf), PANEL, splits.sequence_rule(SEQ))
    rows = scaling.minmax_columns(rows, PANEL, ~F.col("is_test")).withColumn("scaled", scaling.scaled(F.col("units_sold")))
    return shown(rows.select(*KEY, "date", "scaled", scaling.unscaled(F.col("scaled")).alias("restored")))


@query("Z3_standard", sql(
    f"""SELECT store_id, sku_id, date, units_sold AS target, {text_of("s")} AS window_std
        FROM (SELECT *, [{", ".join(f"(w[{i}] - avg(w[{i}]) OVER p) / CASE WHEN stddev_pop(w[{i}]) OVER p > 0 THEN stddev_pop(w[{i}]) OVER p ELSE 1 END" for i in range(1, 11))}] AS s
              FROM (SELECT * FROM (SELECT *, list(units_sold) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS w FROM daily) WHERE len(w) = 10)
              WINDOW p AS (PARTITION BY store_id, sku_id))""", ["daily"], dates=["date"]))
def standard(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaling.standardise_windows(features.sliding_windows(daily(spark, sf), PANEL, 10), PANEL, 10)
    return shown(rows.select(*KEY, "date", "target", as_text(F.col("window_std")).alias("window_std")))


@query("J2_scaler_lookup", sql(
    """SELECT store_id, sku_id, date, (units_sold - coalesce(lo, 0)) / CASE WHEN coalesce(hi, 100) > coalesce(lo, 0) THEN coalesce(hi, 100) - coalesce(lo, 0) ELSE 1 END AS scaled
       FROM daily LEFT JOIN s USING (store_id, sku_id)""", ["daily"], doubles=["scaled"], dates=["date"],
    s="SELECT store_id, sku_id, min(units_sold) AS lo, max(units_sold) AS hi FROM daily WHERE store_id <> 'S4' GROUP BY ALL"))
def scaler_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Series of one store have no fitted scaler and use the default range."""
    rows = daily(spark, sf)
    known = scaling.fit_minmax(rows.where("store_id <> 'S4'"), PANEL)
    joined = scaling.look_up_scalers(rows, known, PANEL, (0.0, 100.0))
    return shown(joined.select(*KEY, "date", scaling.scaled(F.col("units_sold")).alias("scaled")))
