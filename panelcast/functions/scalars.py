"""Column expressions: coercion, rounding, names, text and parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month and weekday labels.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Projection order used when the text cannot be read.
DEFAULT_ORDER = (1, 1, 1)


# What a cast to DOUBLE can read: decimals, the special values, and hexadecimal texts, which need an exponent.
NUMBER = (r"^[\x00-\x20]*(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?|[+-]?(?i:inf|infinity|nan)"
          r"|[+-]?0[xX][0-9a-fA-F.]+[pP][+-]?[0-9]+[dDfF]?)[\x00-\x20]*$")


def to_number(value: Column) -> Column:
    """Text or number to DOUBLE; anything unreadable, and NaN, becomes NULL."""
    text = F.rtrim(value.cast("string"))
    # The cast would also take type suffixes such as 3d or 1.5f; the pattern runs only for those endings.
    suffixed = F.right(text, F.lit(1)).isin("d", "D", "f", "F") & text.rlike(r"[0-9.][dDfF]$")
    # A text that is no number costs the cast an exception, many times the price of the pattern.
    return F.nanvl(F.when(text.rlike(NUMBER) & ~suffixed, text.try_cast("double")), F.lit(None).cast("double"))


def to_timestamp_or_null(value: Column) -> Column:
    return value.try_cast("timestamp")


def label_of(names: list[str], index: Column) -> Column:
    """The name at a 1-based position."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def iso_date(value: Column) -> Column:
    """yyyy-MM-dd; the plain cast is several times faster than a pattern formatter."""
    return value.cast("date").cast("string")


def round_to_nearest(value: Column, base: float = 5) -> Column:
    return F.bround(value / F.lit(float(base)), 0) * F.lit(float(base))


def format_metrics(metrics: Column, decimals: int = 2) -> Column:
    return F.transform_values(metrics, lambda _, v: F.bround(v, decimals))


def short_number(value: Column, decimals: int = 1) -> Column:
    """1234.0 -> '1.2K', 2500000.0 -> '2.5M', NULL -> 'N/A'."""
    def text(scaled: Column, suffix: str) -> Column:
        return F.format_string(f"%.{decimals}f{suffix}", F.bround(scaled.cast("double"), decimals))

    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(F.abs(value) >= 1_000_000, text(value / 1_000_000, "M"))
        .when(F.abs(value) >= 1_000, text(value / 1_000, "K"))
        .otherwise(text(value, ""))
    )


def parse_order(text: Column) -> Column:
    """'p,d,q' to ARRAY<INT>; malformed text gives the default order."""
    parts = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int"))
    valid = (F.size(parts) == 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(valid, parts).otherwise(F.array(*[F.lit(v) for v in DEFAULT_ORDER]))


def mean_of_two(a: Column, b: Column) -> Column:
    """Mean of both values, or the one that is present."""
    return F.coalesce((a + b) / 2.0, a, b)
