"""Location-based giving analytics on Spark.

Donor and venue tables in, filters, rollups, hex-grid maps, governed views and
reports out. Everything is a lazily planned ``DataFrame``; only small,
aggregated results ever reach the driver.
"""

from hexgiving.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
