"""Named queries over the sales tables, each with the SQL that must give the same rows."""

from panelcast.plans.catalogue import explore, features, forecasts, ingest, inventory, models  # noqa: F401
from panelcast.plans.catalogue.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
