"""Finding the column roles of a table from its header."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# Aliases in order of preference.
DATE_ALIASES = [
    "date", "timestamp", "order_date", "OrderDate", "week_start_date", "ds", "time", "period",
]
DEMAND_ALIASES = [
    "sales", "unit_sales", "units_sold", "UnitSales", "Units", "quantity", "qty",
    "Sales_Quantity", "demand", "Weekly_Sales", "cnt", "count", "sold", "revenue",
]

# Aliases of the four panel roles, matched in exact case first.
PANEL_DATE = ["week", "date", "Date", "timestamp", "ds", "period"]
PANEL_DEMAND = ["units_sold", "sales", "Sales", "demand", "quantity", "qty"]
PANEL_STORE = ["store_id", "store", "Store", "storeId"]
PANEL_SKU = ["sku_id", "sku", "SKU", "item_id", "product_id"]

# Identifier columns that mark the wide layout, and its least number of day columns.
WIDE_MARKERS = {"id", "item_id", "dept_id", "cat_id", "store_id", "state_id"}
WIDE_MORE_THAN = 100


@dataclass(frozen=True)
class Roles:
    date: str | None
    demand: str | None
    store: str | None = None
    sku: str | None = None


def detect_series_roles(columns: Sequence[str]) -> Roles:
    """Date and demand column, ignoring case; the earliest alias wins."""
    by_lower = {name.lower(): name for name in columns}

    def pick(aliases: list[str]) -> str | None:
        hits = [by_lower[a.lower()] for a in aliases if a.lower() in by_lower]
        return hits[0] if hits else None

    return Roles(pick(DATE_ALIASES), pick(DEMAND_ALIASES))


def detect_panel_roles(columns: Sequence[str]) -> Roles:
    """Four roles; an alias in exact case beats every case-insensitive match."""

    def pick(aliases: list[str]) -> str | None:
        exact = [a for a in aliases if a in columns]
        loose = [c for a in aliases for c in columns if c.lower() == a.lower()]
        return (exact + loose + [None])[0]

    return Roles(pick(PANEL_DATE), pick(PANEL_DEMAND), pick(PANEL_STORE), pick(PANEL_SKU))


def day_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith("d_") and c[2:].isdigit()]


def is_wide(columns: Sequence[str]) -> bool:
    marked = WIDE_MARKERS & {c.lower() for c in columns}
    return len(day_columns(columns)) > WIDE_MORE_THAN and bool(marked)
