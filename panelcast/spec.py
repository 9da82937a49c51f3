"""Column roles and parameters shared by all operators."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def date_shape(form: str) -> str | None:
    """Pattern of the texts that a date format can read; None for formats with other parts than year, month and day."""
    parts = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}",
             "dd": r"\d{2}", "d": r"\d{1,2}"}
    out = []
    for piece in re.findall(r"(.)(\1*)", form):
        token = "".join(piece)
        if token in parts:
            out.append(parts[token])
        elif token[0].isalpha() or token[0] == "'":
            return None
        else:
            out.append(re.escape(token))
    return f"^{''.join(out)}$"


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns hold the date, the demand and the series keys.

    ``grain`` is the finest period kept. Cleaning collapses rows to one per (keys, period), so
    a series never has more rows than there are periods in the calendar, however many raw rows
    its key holds. Window operators rely on that bound.
    """

    date: str = "date"
    demand: str = "units_sold"
    keys: tuple[str, ...] = ("store_id", "sku_id")
    grain: str = "day"
    # Tried in order after ISO text, each only on text of its shape.
    date_formats: tuple[str, ...] = (
        "yyyyMMdd", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "M/d/yy", "d/M/yy", "d.M.yy",
        "MMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMMM yyyy",
    )

    @property
    def panel(self) -> bool:
        return bool(self.keys)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, self.date, self.demand]

    def series(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def ordered(self) -> WindowSpec:
        return self.series().orderBy(self.date)

    def period(self, stamp: Column) -> Column:
        """Read a date or timestamp, or text holding one, at the grain; unreadable text gives NULL.

        Day grain gives a DATE, a finer one a truncated TIMESTAMP.
        """
        kind = "date" if self.grain == "day" else "timestamp"
        text = F.trim(stamp.cast("string"))
        others = []
        for form in self.date_formats:
            read = F.try_to_timestamp(text, F.lit(form)).cast(kind)
            if "yy" in form and "yyyy" not in form:  # years 69 to 99 belong to the last century
                read = F.when(F.year(read) > 2068, read - F.expr("INTERVAL 100 YEAR")).otherwise(read)
            shape = date_shape(form)
            others.append(F.when(text.rlike(shape), read) if shape else read)
        read = F.coalesce(stamp.try_cast(kind), *others)
        return read if self.grain == "day" else F.date_trunc(self.grain, read)

    def day_first(self) -> SeriesSpec:
        """The same formats with every day-first one before its month-first twin."""
        def swapped(form: str) -> str:
            return form.translate(str.maketrans("Md", "dM")) if re.fullmatch(r"[Md]([/.-])[Md]\1y+", form) else form

        forms = list(self.date_formats)
        for i, form in enumerate(forms):
            twin = swapped(form)
            if form.startswith("M") and twin in forms[i:] and twin != form:
                j = forms.index(twin)
                forms[i], forms[j] = twin, form
        return replace(self, date_formats=tuple(forms))

    def single(self) -> SeriesSpec:
        return replace(self, keys=())


def keyed(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, SeriesSpec]:
    """Give a single series a constant key, so that joins by series work for it as well."""
    if spec.panel:
        return df, spec
    return df.withColumn("series", F.lit("all")), replace(spec, keys=("series",))


@dataclass(frozen=True)
class InventoryParams:
    """Replenishment inputs; costs stay None when no order quantity is wanted."""

    service_level: float = 0.95
    lead_time: int = 7
    annual_demand: float | None = None
    holding_cost: float | None = None
    ordering_cost: float | None = None

    def __post_init__(self) -> None:
        problems = [
            text
            for bad, text in (
                (not 0 < self.service_level < 1, "service_level must lie strictly between 0 and 1"),
                (not 1 <= self.lead_time <= 365, "lead_time must be 1 to 365 days"),
                (self.annual_demand is not None and self.annual_demand <= 0, "annual_demand must be positive"),
                (self.holding_cost is not None and self.holding_cost <= 0, "holding_cost must be positive"),
                (self.ordering_cost is not None and self.ordering_cost <= 0, "ordering_cost must be positive"),
            )
            if bad
        ]
        if problems:
            raise ValueError("; ".join(problems))
