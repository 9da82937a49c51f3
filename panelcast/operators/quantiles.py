"""Exact linear-interpolated quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

EDGES = 256


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """One row per key with the exact quantiles, without gathering a group in one task.

    Built-in ``percentile`` holds every distinct value of a group in one buffer. Here the values
    are first counted (``value_counts``), cut into about ``EDGES`` slices of equally many distinct
    values by a bounded sketch, and ranked slice by slice.
    """
    return quantiles_from_counts(value_counts(df, value, keys), value, probs, keys, names)


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"))
    )


def quantiles_from_counts(
    counts: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    keys = list(keys)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    v = F.col(value)
    edge_probs = [i / EDGES for i in range(1, EDGES)]
    edges = F.approx_percentile(v, edge_probs, F.lit(20 * EDGES))
    if keys:
        sketch = counts.groupBy(*keys).agg(edges.alias("_edges"))
        with_edges = counts.join(sketch, keys)
    else:
        with_edges = counts.withColumn("_edges", counts.agg(edges).scalar())
    sliced = with_edges.select(
        *keys, value, "weight",
        # never NULL, so that no null check on it is pushed below the counting
        F.coalesce(F.size(F.filter("_edges", lambda e: e < v)), F.lit(0)).alias("_slice"),
    )
    # Ranks below each slice: at most EDGES rows per key.
    up_to = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("weight").alias("_w"))
        .withColumns(
            {"_below": F.sum("_w").over(up_to) - F.col("_w"), "_n": F.sum("_w").over(Window.partitionBy(*keys))}
        )
    )
    position = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    low = [F.floor(p) for p in position]
    high = [F.ceil(p) for p in position]
    start, end = F.col("_below"), F.col("_below") + F.col("_w")
    wanted = F.lit(False)
    for rank in (*low, *high):
        wanted = wanted | ((rank >= start) & (rank < end))
    needed = totals.where(wanted)
    within = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(needed, [*keys, "_slice"]).withColumn(
        "_end", F.col("_below") + F.sum("weight").over(within)
    )
    first = F.col("_end") - F.col("weight")

    def at(rank):
        return F.max(F.when((rank >= first) & (rank < F.col("_end")), v))

    parts = []
    for i, (lo, hi) in enumerate(zip(low, high)):
        parts += [at(lo).alias(f"_lo{i}"), at(hi).alias(f"_hi{i}")]
    picked = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *parts)
    result = []
    for i, name in enumerate(names):
        fraction = position[i] - F.floor(position[i])
        result.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * fraction).alias(name))
    return picked.select(*keys, *result)


def series_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Quantiles per series, whose length is bounded by the number of periods."""
    q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
    return df.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(names)]
    )
