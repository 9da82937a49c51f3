"""panelcast: sales-series cleaning, features, projections and replenishment as Spark jobs."""

from panelcast.spec import InventoryParams, SeriesSpec

__all__ = ["InventoryParams", "SeriesSpec"]
