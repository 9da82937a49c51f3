import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions.scalars import NUMBER, to_number
from panelcast.operators import calendar, clean, explore, features, scaling, splits, validate
from panelcast.operators.quantiles import exact_quantiles
from panelcast.spec import SeriesSpec

SPEC = SeriesSpec()


def values(df, *order):
    return [r.units_sold for r in df.orderBy(*(order or ("store_id", "sku_id", "date"))).collect()]


def test_to_number(spark):
    texts = ["1", " 2.5 ", "1e3", "abc", "3d", "4.f", "nan", None, "-7"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in rows.select("i", to_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [1.0, 2.5, 1000.0, None, None, None, None, None, -7.0]


def test_fill_forward_then_backward_then_mean(panel):
    df = panel({("A", "x"): [None, 2, None, 4], ("B", "y"): [None, None, None, None]})
    filled = clean.fill_missing(df, SPEC)
    assert values(filled.where("store_id = 'A'")) == [2, 2, 2, 4]
    assert values(clean.fill_with_mean(filled, SPEC).where("store_id = 'B'")) == [2.5] * 4


def test_duplicates_keep_missing_unless_asked(panel):
    df = panel({("A", "x"): [None, 3]}).unionByName(panel({("A", "x"): [None, 4]}))
    assert values(clean.collapse_duplicates(df, SPEC)) == [None, 7]
    assert values(clean.collapse_duplicates(df, SPEC, null_as_zero=True)) == [0, 7]
    extra = clean.collapse_duplicates(df, SPEC, {"n": F.count(F.lit(1))})
    assert [r.n for r in extra.collect()] == [2, 2]


def test_negative_is_carried_before_it_is_dropped(panel):
    assert values(clean.clean_data(panel({("A", "x"): [1, -2, None, 5]}), SPEC)) == [1, 5]


def test_rolling_hand_case(panel):
    out = features.rolling_features(panel({("A", "x"): [1, 2, 4, 7, 11, 30]}), SPEC, (3,)).orderBy("date").collect()
    assert [round(r.Rolling_Std_3, 7) for r in out] == [0, 0.7071068, 1.5275252, 2.5166115, 3.5118846, 12.2882057]


def test_summary_hand_case(panel):
    row = explore.summary_statistics(panel({("A", "x"): [1, 2, 4, 7, 11, 30]}), SPEC.single()).first()
    assert (round(row.skewness, 7), round(row.kurtosis, 7)) == (1.8845948, 3.7209010)
    assert (row.q1, row.median, row.q3) == (2.5, 5.5, 10.0)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [("hot", float(v)) for v in np.r_[rng.normal(size=4000), np.full(3000, 0.25)]]
    data += [("few", float(v)) for v in rng.integers(0, 9, 50)] + [("one", 4.0)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    for row in exact_quantiles(df, "v", probs, ["k"]).collect():
        want = np.quantile([v for k, v in data if k == row.k], probs)
        assert np.allclose([row[f"q{i}"] for i in range(len(probs))], want, rtol=0, atol=1e-12)
    whole = exact_quantiles(df, "v", probs).first()
    assert np.allclose(list(whole), np.quantile([v for _, v in data], probs), rtol=0, atol=1e-12)


def test_week_labels_and_gaps(panel):
    df = panel({("A", "x"): [1] * 14})
    weeks = calendar.resample(df.where("date <> '2024-01-03'"), SPEC, "W").orderBy("date").collect()
    assert [(r.date, r.units_sold) for r in weeks] == [(dt.date(2024, 1, 7), 6), (dt.date(2024, 1, 14), 7)]
    sparse = df.where("date in ('2024-01-01', '2024-01-05')")
    assert values(calendar.gap_fill(sparse, SPEC)) == [1, 0, 0, 0, 1]


def test_month_resample_matches_pandas(panel):
    data = list(range(100))
    got = calendar.resample(panel({("A", "x"): data}).where("month(date) <> 2"), SPEC, "M").orderBy("date").collect()
    series = pd.Series(data, index=pd.date_range("2024-01-01", periods=100), dtype=float)
    want = series[series.index.month != 2].resample("ME").sum()
    assert [(r.date, r.units_sold) for r in got] == [(d.date(), v) for d, v in want.items()]


def test_date_range(spark):
    got = [r.date for r in calendar.date_range(spark, "2024-01-30", "2024-03-31", "M").collect()]
    assert got == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)]
    assert calendar.date_range(spark, "2024-01-01", "2024-01-31").count() == 31


def test_scaler_sees_training_rows_only(panel):
    df = panel({("A", "x"): [*range(40), 1000]})
    rows = splits.split_series(df, SPEC, splits.sequence_rule(10))
    row = scaling.fit_minmax(rows, SPEC, ~F.col("is_test")).first()
    assert (row.min, row.max) == (0, 31)


def test_window_counts_and_skips(panel):
    df = panel({("A", "x"): range(60), ("B", "y"): range(39)})
    rule = splits.sequence_rule(30)
    windows = splits.split_windows(df, SPEC, 30, rule)
    assert windows.select("store_id").distinct().count() == 1
    assert windows.where("is_test").count() == 60 - 48 and windows.count() == 30
    status = {r.store_id: r for r in splits.series_status(df, SPEC, rule, 30).collect()}
    assert status["A"].split_idx == 48 and status["B"].reason == "too short: 39 rows"


def test_constant_series_scales_to_itself(panel):
    rows = splits.split_series(panel({("A", "x"): [5] * 30}), SPEC, splits.plain_rule())
    rows = scaling.minmax_columns(rows, SPEC, ~F.col("is_test"))
    back = rows.select(scaling.unscaled(scaling.scaled(F.col("units_sold"))).alias("v")).distinct().collect()
    assert [r.v for r in back] == [5.0]


def test_tail_is_padded_with_the_mean(panel):
    df = panel({("A", "x"): [1, 2, 6]})
    assert features.tail_windows(df, SPEC, 5).first().window == [3, 3, 1, 2, 6]
    assert features.tail_windows(df, SPEC, 5, pad=False).count() == 0


def test_validation_findings(spark, panel):
    def rules(df):
        return {(r.rule, r.severity) for r in validate.validate_data(df, SPEC).collect()}

    assert rules(panel({})) == {("empty", "error")}
    assert ("missing_column", "error") in rules(spark.createDataFrame([("A", 1.0)], "store_id string, units_sold double"))
    assert {("row_count", "warning"), ("variance", "warning"), ("group_size", "warning"), ("group_count", "info")} <= rules(panel({("A", "x"): [3] * 20}))
    text = spark.createDataFrame([("A", "x", "bad", "no")] * 3, "store_id string, sku_id string, date string, units_sold string")
    assert {("dates", "error"), ("numeric", "error")} <= rules(text)


def test_growth(panel):
    out = {r.store_id: r.growth_pct for r in explore.growth_rate(panel({("A", "x"): [10, 15], ("B", "x"): [0, 5], ("C", "x"): [4]}), SPEC).collect()}
    assert out == {"A": 50.0, "B": None, "C": 0.0}


def test_autocorrelation_matches_numpy(panel):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60).cumsum()
    row = explore.partial_autocorrelation(panel({("A", "x"): x}), SPEC, 10).first()
    c = x - x.mean()
    r = np.array([(c[k:] * c[: len(c) - k]).sum() for k in range(11)]) / (c * c).sum()
    assert np.allclose(row.acf, r)
    for k in (1, 2, 5):
        toeplitz = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert np.isclose(row.pacf[k], np.linalg.solve(toeplitz, r[1 : k + 1])[-1])


def test_unknown_frequency(panel):
    with pytest.raises(ValueError):
        calendar.resample(panel({("A", "x"): [1]}), SPEC, "Q")


def test_finer_grain(spark):
    hourly = SeriesSpec(grain="hour")
    stamps = ["2024-01-01 10:05:00", "2024-01-01 10:50:00", "2024-01-01 11:00:00", "bad"]
    df = spark.createDataFrame([("A", "x", t, "2") for t in stamps], "store_id string, sku_id string, date string, units_sold string")
    assert values(clean.clean_data(df, hourly)) == [4, 2]


def test_date_order_is_told_by_the_column(spark):
    """A day above 12 settles the order for the whole column; without one the month comes first."""
    def read(*texts):
        df = spark.createDataFrame([(t, "1") for t in texts], "date string, units_sold string")
        spec = clean.detect_date_order(df, SPEC.single())
        lost = clean.unread_dates(df, spec).first()
        days = [None if r.d is None else r.d.isoformat() for r in df.select(spec.period(F.col("date")).alias("d")).collect()]
        return days, lost.n_unread

    assert read("31/01/2022", "05/01/2022", "31.01.2022") == (["2022-01-31", "2022-01-05", "2022-01-31"], 0)
    assert read("1/31/22", "05/01/2022") == (["2022-01-31", "2022-05-01"], 0)
    assert read("05/01/2022") == (["2022-05-01"], 0)
    assert read("13/01/2022", "01/13/2022", "02/03/2022") == (["2022-01-13", "2022-01-13", "2022-02-03"], 0)  # both: the spec's order
    assert read("Jan 5 2022", "5 Jan 2022", "January 5, 2022", "5-Jan-2022", " 20220105 ", "5/1/68", "5/1/69") == (
        ["2022-01-05"] * 5 + ["2068-05-01", "1969-05-01"], 0)
    assert read("2022-02-30", "soon", None, "2022-01-05T10:00:00") == ([None, None, None, "2022-01-05"], 2)


def test_numbers_are_told_before_the_cast(spark):
    """The pattern takes all that the cast reads, and keeps other texts from it (each would raise an exception inside)."""
    texts = ["1", "+1.", "-.5", " 12 ", "\t3\n", "1e5", "1E-3", ".5e+2", "inf", "-Infinity", "+INF", "nan", "0x1p3", "-0X1.8P1", "1.5d",
             "n/a", "S1", "2024-01-01", "1,5", "", " ", ".", "e5", "1e", "--1", "1 2", "\u0663", "\u00a05", "infinit", "0x10", "1_0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cast = F.rtrim("t").try_cast("double")
    got = df.select("t", cast.isNotNull().alias("cast"), F.rtrim("t").rlike(NUMBER).alias("told")).collect()
    assert [r for r in got if r.cast and not r.told] == []
    assert {r.t for r in got if r.told and not r.cast} == set()


def test_each_spelling_of_a_date_is_read_once(spark):
    """Rows meet by their text before dates are read: one row per spelling, with all rows and amounts."""
    df = spark.createDataFrame(
        [("25/12/2022", "1"), ("25/12/2022", "n/a"), ("2022-12-25", "2"), (None, "4"), ("soon", "8"), ("soon", None)], "date string, units_sold string")
    spec = SPEC.single()
    got = {(r.date, r.units_sold, r.n_rows) for r in clean.collapse_texts(df, spec).collect()}
    assert got == {("25/12/2022", 1.0, 2), ("2022-12-25", 2.0, 1), (None, 4.0, 1), ("soon", 8.0, 2)}
    assert clean.detect_date_order(clean.collapse_texts(df, spec), spec) == clean.detect_date_order(df, spec)
