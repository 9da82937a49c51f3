"""Exploratory statistics: summaries, seasons, histograms, correlation, autocorrelation, rankings."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelcast.functions.moments import sample_kurtosis, sample_skewness, sample_std
from panelcast.functions.scalars import MONTHS, WEEKDAYS, label_of
from panelcast.operators.quantiles import exact_quantiles, series_quantiles
from panelcast.spec import SeriesSpec

QUARTILES = (0.25, 0.5, 0.75)


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct value, computed once by a scalar subquery."""
    return df.select(F.struct(*df.columns)).scalar()


def summary_statistics(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Count, mean, deviation, five-number summary, skewness and kurtosis.

    Per series when the spec has keys, else over all rows.
    """
    v = F.col(spec.demand)
    present = df.where(v.isNotNull())
    keys = list(spec.keys)
    moments = [
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std_dev"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        sample_skewness(v).alias("skewness"), sample_kurtosis(v).alias("kurtosis"),
    ]
    names = ("q1", "median", "q3")
    if keys:
        q = F.percentile(v, F.array(*[F.lit(p) for p in QUARTILES])).alias("_q")
        return present.groupBy(*keys).agg(*moments, q).select(
            "*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]
        ).drop("_q")
    quartiles = exact_quantiles(present, spec.demand, QUARTILES, names=names)
    return present.agg(*moments).withColumn("_q", one_row(quartiles)).select("*", "_q.*").drop("_q")


def demand_statistics(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean, deviation, range, variation and length over finite, non-negative demand."""
    v = F.col(spec.demand)
    usable = df.where((v >= 0) & (v < float("inf")))
    mean, std = F.avg(v), sample_std(v)
    return usable.groupBy(*spec.keys).agg(
        mean.alias("mean_demand"), std.alias("std_demand"),
        F.min(v).alias("min_demand"), F.max(v).alias("max_demand"),
        F.when(mean > 0, std / mean).otherwise(F.lit(0.0)).alias("cv"),
        F.count(v).alias("n_periods"),
    )


def group_sizes(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    sizes = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("smallest_group"))


def distinct_keys(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Number of different values of each key, counted over the distinct key combinations."""
    combos = df.select(*spec.keys).distinct()
    return combos.agg(*[F.count_distinct(k).alias(f"n_{k}") for k in spec.keys])


def kpi_row(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    v = F.col(spec.demand)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(spec.date).alias("first_date"), F.max(spec.date).alias("last_date"),
        F.avg(v).alias("mean_demand"), F.stddev_samp(v).alias("std_demand"), F.sum(v).alias("total_demand"),
    )


def date_span(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.agg(F.min(spec.date).alias("first_date"), F.max(spec.date).alias("last_date"))


def seasonal_mean(df: DataFrame, spec: SeriesSpec, period: str = "Month") -> DataFrame:
    """Average demand by Month, Day (of week) or Week, with a label."""
    d = F.col(spec.date)
    index, label = {
        "Month": (F.month(d), lambda i: label_of(MONTHS, i)),
        "Day": (F.weekday(d), lambda i: label_of(WEEKDAYS, i + 1)),
        "Week": (F.weekofyear(d), lambda i: i.cast("string")),
    }[period]
    means = df.groupBy(index.alias("period")).agg(F.avg(spec.demand).alias("average_demand"))
    return means.select("period", label(F.col("period")).alias("label"), "average_demand")


def monthly_box(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Five-number summary of demand per calendar month, over all rows."""
    v = F.col(spec.demand)
    rows = df.where(v.isNotNull()).select(F.month(spec.date).alias("month"), spec.demand)
    quartiles = exact_quantiles(rows, spec.demand, QUARTILES, ["month"], ("q1", "median", "q3"))
    ends = rows.groupBy("month").agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))
    return ends.join(quartiles, "month").withColumn("label", label_of(MONTHS, F.col("month")))


def histogram(df: DataFrame, spec: SeriesSpec, bins: int = 40) -> DataFrame:
    """Equal-width bins between the least and greatest value; the greatest falls in the last bin."""
    v = F.col(spec.demand)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"))
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    width = (hi - lo) / F.lit(float(bins))
    bucket = F.when(hi > lo, F.least(F.floor((v - lo) / width), F.lit(bins - 1).cast("bigint"))).otherwise(F.lit(0))
    binned = df.where(v.isNotNull()).withColumn("_e", one_row(ends)).groupBy(bucket.cast("int").alias("bin"), "_e")
    return binned.agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        "n", F.col("_e.mean").alias("mean_marker"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all from one aggregate."""
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two columns")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}~{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}~{b}`" if (a, b) in pairs else f"`{b}~{a}`").alias("corr"))
        for a, b in product(columns, columns)
    ]
    return one.select(F.inline(F.array(*cells)))


def autocorrelation(df: DataFrame, spec: SeriesSpec, lags: int = 40) -> DataFrame:
    """Autocorrelation per series as an array over lag 0 … min(lags, n/2 - 1).

    All lag columns share one window and the sums use its partitioning: one shuffle in all.
    """
    rows = df.where(F.col(spec.demand).isNotNull())
    rows = rows.withColumns(
        {"_x": F.col(spec.demand) - F.avg(spec.demand).over(spec.series())}
    ).withColumns({f"_l{k}": F.lag("_x", k).over(spec.ordered()) for k in range(1, lags + 1)})
    sums = rows.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_x") * F.col("_x")).alias("_c0"),
        *[F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    available = F.greatest(F.least(F.lit(lags), F.floor(F.col("n") / 2).cast("int") - 1), F.lit(0))
    ratios = F.array(*[F.col(f"_c{k}") / F.nullif(F.col("_c0"), F.lit(0.0)) for k in range(lags + 1)])
    return sums.select(*spec.keys, "n", F.slice(ratios, 1, available + 1).alias("acf"))


def partial_autocorrelation(df: DataFrame, spec: SeriesSpec, lags: int = 40) -> DataFrame:
    """Autocorrelation plus partial autocorrelation by the Durbin-Levinson recursion over the short array."""
    acf = autocorrelation(df, spec, lags)
    step = """
      (s, k) -> transform(array(named_struct('num', acf[k] - aggregate(zip_with(s.phi, reverse(slice(acf, 2, k - 1)), (a, b) -> a * b), 0D, (x, y) -> x + y),
                                             'den', 1D - aggregate(zip_with(s.phi, slice(acf, 2, k - 1), (a, b) -> a * b), 0D, (x, y) -> x + y))),
        t -> named_struct(
          'phi', concat(zip_with(s.phi, reverse(s.phi), (a, b) -> a - try_divide(t.num, t.den) * b), array(try_divide(t.num, t.den))),
          'out', concat(s.out, array(try_divide(t.num, t.den)))))[0]
    """
    start = "named_struct('phi', cast(array() as array<double>), 'out', array(1D))"
    orders = "if(size(acf) > 1, sequence(1, size(acf) - 1), cast(array() as array<int>))"
    return acf.withColumn("pacf", F.expr(f"aggregate({orders}, {start}, {step}, s -> s.out)"))


def lag_table(df: DataFrame, spec: SeriesSpec, column: str) -> DataFrame:
    """One row per series and lag from an autocorrelation array."""
    return df.select(*spec.keys, F.posexplode(column).alias("lag", "value"))


def flag_outliers(df: DataFrame, spec: SeriesSpec, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Add the boolean ``Outlier`` by quartile fences or z-score over all rows."""
    v = F.col(spec.demand)
    if method == "iqr":
        fences = exact_quantiles(df, spec.demand, (0.25, 0.75), names=("q1", "q3"))
        limits = one_row(tukey_fences(fences, threshold))
        flag = (v < F.col("_f.low")) | (v > F.col("_f.high"))
    elif method == "zscore":
        filled = F.coalesce(v, F.lit(0.0))
        limits = one_row(df.agg(F.avg(filled).alias("mean"), F.stddev_pop(filled).alias("dev")))
        flag = F.abs((filled - F.col("_f.mean")) / F.nullif(F.col("_f.dev"), F.lit(0.0))) > threshold
    else:
        return df.withColumn("Outlier", F.lit(False))
    return df.withColumn("_f", limits).withColumn("Outlier", F.coalesce(flag, F.lit(False))).drop("_f")


def tukey_fences(quartiles: DataFrame, threshold: float = 1.5) -> DataFrame:
    spread = threshold * (F.col("q3") - F.col("q1"))
    return quartiles.select((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def flag_outliers_by_series(df: DataFrame, spec: SeriesSpec, threshold: float = 1.5) -> DataFrame:
    """Quartile fences of each series of its own."""
    q = series_quantiles(df, spec.demand, (0.25, 0.75), spec.keys, ("q1", "q3"))
    spread = threshold * (F.col("q3") - F.col("q1"))
    v = F.col(spec.demand)
    return df.join(q, list(spec.keys)).withColumn(
        "Outlier", (v < F.col("q1") - spread) | (v > F.col("q3") + spread)
    ).drop("q1", "q3")


def growth_rate(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Change from the first to the last value in percent; 0 below two values, NULL from zero."""
    v = F.col(spec.demand)
    ends = df.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(v, spec.date).alias("first_value"), F.max_by(v, spec.date).alias("last_value")
    )
    change = (F.col("last_value") - F.col("first_value")) / F.nullif(F.col("first_value"), F.lit(0.0)) * 100
    return ends.select(*spec.keys, "first_value", "last_value", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(change).alias("growth_pct"))


def top_groups(df: DataFrame, key: str, demand: str, n: int = 5) -> DataFrame:
    """The n keys of greatest total demand, with their share of that set."""
    top = df.groupBy(key).agg(F.sum(demand).alias("total")).orderBy(F.desc("total"), key).limit(n)
    share = F.col("total") / F.sum("total").over(Window.partitionBy()) * 100  # n rows only
    return top.withColumn("pct", share)


def top_periods(df: DataFrame, spec: SeriesSpec, n: int = 5) -> DataFrame:
    """The n periods of greatest demand, with their share of the grand total."""
    total = df.agg(F.sum(spec.demand)).scalar()
    top = df.orderBy(F.desc(spec.demand), spec.date).limit(n)
    return top.withColumn("pct", F.col(spec.demand) / total * 100)


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("pct", F.col(value) / df.agg(F.sum(value)).scalar() * 100)


def newest(df: DataFrame, order: str | list[Column], n: int, page: int = 1) -> DataFrame:
    """One page of rows, newest first."""
    return df.orderBy(*([F.desc(order)] if isinstance(order, str) else order)).offset((page - 1) * n).limit(n)
