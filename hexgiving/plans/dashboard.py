"""One dashboard interaction as one set of lazy plans.

The filtered donor frame is built once and persisted (memory, spilling to
disk), then every table the page shows is derived from it: KPIs, best zip,
charts, the hex map with its boundaries and colours, the display and detail
tables. This replaces loading whole tables into a local frame and
re-filtering per widget; only the small aggregated results are collected by
whoever renders them. Persisted blocks lost with an executor are rebuilt
from lineage.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from hexgiving.operators import features, filters, hexmap, rollups
from hexgiving.sources import tables as T


@contextmanager
def dashboard(spark: SparkSession, sf_dir: str, **choices) -> Iterator[dict[str, DataFrame]]:
    """``dashboard_tables`` for the time of a page; the persisted rows are given back when it is left."""
    tables = dashboard_tables(spark, sf_dir, **choices)
    try:
        yield tables
    finally:
        tables["filtered"].unpersist()


def dashboard_tables(spark: SparkSession, sf_dir: str, zip_codes=None, grad_years=None,
                     donation_range=None, donor_segments=None, resolution: int = 8,
                     page_size: int | None = 50) -> dict[str, DataFrame]:
    """Every table of the page, lazily; ``filtered`` is persisted and its holder unpersists it (``dashboard`` does).

    The rows come from the stored donor table; amount bounds are exact
    decimals, so all filters reach its scan.
    """
    donors = T.donor_table(spark, sf_dir)
    venues = T.venues(spark, sf_dir)
    scale = donors.schema["annual_donation_amount"].dataType.scale
    pred = filters.donor_predicate(zip_codes, grad_years, donation_range, donor_segments, amount_scale=scale)
    filtered = donors.filter(pred).persist(StorageLevel.MEMORY_AND_DISK)
    rollup = hexmap.hex_rollup_stored(filtered, f"hex_level_{resolution}")
    return {
        "filtered": filtered,
        "kpi_row": rollups.kpi_row(donors, pred),
        "top_zip": rollups.top_zip(filtered),
        "geo_extent": rollups.geo_extent(filtered),
        "distinct_cells": rollups.distinct_cells(filtered),
        "chart_grad_year": rollups.chart_grad_year(filtered),
        "chart_top_zips": rollups.chart_top_zips(filtered),
        "segment_counts": rollups.segment_counts(filtered),
        "chart_top_majors": rollups.chart_top_majors(filtered),
        "hex_rollup": rollup,
        "hex_boundaries": hexmap.cell_boundaries(rollup.select("hex_cell"), resolution),
        "map_layers": features.map_layers(filtered, venues),
        "donor_table": features.donor_table(filtered, page_size),
        "donor_details": features.donor_details(filtered),
        "details_top_zips": rollups.details_top_zips(filtered),
    }
