"""Named SQL views over the adapters, and parameterised SQL.

``register_views`` publishes the donor, venue and summary views as session
temp views, so SQL users query them by name (the reference's views). SQL is
run with bound parameters (``spark.sql(text, args=...)``), never with values
spliced into the text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from hexgiving.operators import rollups
from hexgiving.sources import tables as T

VIEWS = ("donors", "venues", "donor_overview", "donations_by_graduation_year",
         "donations_by_zip_code", "donations_by_major")


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Create or replace the temp views; returns their names."""
    donors = T.donor_table(spark, sf_dir)
    frames = {"donors": donors, "venues": T.venues(spark, sf_dir),
              "donor_overview": rollups.donor_overview(donors),
              "donations_by_graduation_year": rollups.by_grad_year(donors),
              "donations_by_zip_code": rollups.by_zip(donors),
              "donations_by_major": rollups.by_major(donors)}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


def sql(spark: SparkSession, text: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL with named parameter markers (``:name``) bound to ``args``."""
    return spark.sql(text, args=dict(args or {}))
