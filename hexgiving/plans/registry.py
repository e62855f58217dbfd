"""Named queries: each takes ``(spark, sf_dir)`` and returns a lazy DataFrame.

Every query reads the input tables under ``sf_dir`` (through the adapters in
``hexgiving.sources.tables``), so its work grows with them. Parameters that
the dashboard takes from widgets are fixed here to one documented setting
per query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgiving.functions.measures import money_sum
from hexgiving.operators import features, filters, governance, hexmap, quality, rollups, sites
from hexgiving.operators import enrich as enr
from hexgiving.operators.numbering import global_rank, number_rows, sample_n
from hexgiving.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed query parameters (one widget setting per query).
ZIPS = ("29601", "29605", "29607", "29610", "29612", "29615")
YEARS = (2000, 2015)
AMOUNTS = (1000.0, 20000.0)
SEGMENTS = (T.SEGMENT_MAJOR, T.SEGMENT_MID)
FILTERS = dict(zip_codes=ZIPS, grad_years=YEARS, donation_range=AMOUNTS, donor_segments=SEGMENTS)
CLUSTER_FILTERS = {"zip": dict(zip_codes=ZIPS), "year": dict(grad_years=YEARS), "amount": dict(donation_range=AMOUNTS),
                   "all": dict(zip_codes=ZIPS, grad_years=YEARS, donation_range=AMOUNTS)}
EMPTY_FILTERS = dict(zip_codes=(), grad_years=None, donation_range=None, donor_segments=[])
NO_MATCH_FILTERS = dict(zip_codes=ZIPS, grad_years=(2100, 2200), donation_range=None, donor_segments=None)
VENUE_TYPES = ("Hotel", "Restaurant", "Museum")
PRICES = ("$$", "$$$")
MIN_CAPACITY = 300
TARGET_ZIPS = ("29607", "29610", "29612", "29615")
OTHER_ZIPS = ("29601", "29602", "29603", "29604", "29605", "29606", "29608", "29609",
              "29611", "29613", "29614", "29616", "29617")
SEED = "donors"


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def donors(spark, sf):
    """The donor table (materialised once per session, see ``T.donor_table``)."""
    return T.donor_table(spark, sf)


def filtered(spark, sf):
    return filters.apply_filters(donors(spark, sf), **FILTERS)


# --- filters ---------------------------------------------------------------

@query("filter_zip")
def _filter_zip(spark, sf):
    return filters.apply_filters(donors(spark, sf), zip_codes=ZIPS).select("donor_id", "zip_code")


@query("filter_segment")
def _filter_segment(spark, sf):
    return filters.apply_filters(donors(spark, sf), donor_segments=[T.SEGMENT_MAJOR]).select("donor_id", "donor_segment")


@query("filter_year_range")
def _filter_year_range(spark, sf):
    return filters.apply_filters(donors(spark, sf), grad_years=YEARS).select("donor_id", "graduation_year")


@query("filter_amount_range")
def _filter_amount_range(spark, sf):
    return (filters.apply_filters(donors(spark, sf), donation_range=AMOUNTS)
            .select("donor_id", F.col("annual_donation_amount").cast("double").alias("annual_donation_amount")))


@query("apply_filters")
def _apply_filters(spark, sf):
    return filtered(spark, sf).select("donor_id", "zip_code", "graduation_year", "donor_segment",
                                      F.col("annual_donation_amount").cast("double").alias("annual_donation_amount"))


@query("apply_filters_empty")
def _apply_filters_empty(spark, sf):
    return filters.apply_filters(donors(spark, sf), **EMPTY_FILTERS).select("donor_id", "zip_code")


@query("valid_points")
def _valid_points(spark, sf):
    return hexmap.valid_points(donors(spark, sf), hexmap.POINT_COLUMNS).select("donor_id", "latitude", "longitude")


@query("venue_filter")
def _venue_filter(spark, sf):
    return (filters.venue_filter(T.venues(spark, sf), VENUE_TYPES, PRICES, MIN_CAPACITY)
            .select("venue_id", "venue_type", "price_range", "capacity"))


@query("venue_filter_empty")
def _venue_filter_empty(spark, sf):
    return filters.venue_filter(T.venues(spark, sf), [], PRICES, 0).select("venue_id")


# --- SQL views and summary -------------------------------------------------

@query("donor_summary")
def _donor_summary(spark, sf):
    return rollups.donor_summary(donors(spark, sf))


@query("donor_overview")
def _donor_overview(spark, sf):
    return rollups.donor_overview(donors(spark, sf))


@query("by_grad_year")
def _by_grad_year(spark, sf):
    return rollups.by_grad_year(donors(spark, sf))


@query("by_zip")
def _by_zip(spark, sf):
    return rollups.by_zip(donors(spark, sf))


@query("by_major")
def _by_major(spark, sf):
    return rollups.by_major(donors(spark, sf))


@query("by_zip_ranked")
def _by_zip_ranked(spark, sf):
    return rollups.ranked(rollups.by_zip(donors(spark, sf)).select("zip_code", "total_annual_donations"),
                          "total_annual_donations", "zip_code")


@query("by_major_ranked")
def _by_major_ranked(spark, sf):
    return rollups.ranked(rollups.by_major(donors(spark, sf)).select("major", "total_annual_donations"),
                          "total_annual_donations", "major")


@query("grad_years_sorted")
def _grad_years_sorted(spark, sf):
    """The year domain of the filter widgets in order."""
    years = donors(spark, sf).select("graduation_year").dropna().distinct()
    return rollups.ranked(years, None, "graduation_year")


# --- dashboard tables on the filtered set ------------------------------------

@query("chart_grad_year")
def _chart_grad_year(spark, sf):
    return rollups.chart_grad_year(filtered(spark, sf))


@query("chart_top_zips")
def _chart_top_zips(spark, sf):
    return rollups.chart_top_zips(filtered(spark, sf))


@query("segment_counts")
def _segment_counts(spark, sf):
    return rollups.segment_counts(filtered(spark, sf))


@query("chart_top_majors")
def _chart_top_majors(spark, sf):
    return rollups.chart_top_majors(filtered(spark, sf))


@query("report_zip")
def _report_zip(spark, sf):
    return rollups.report_zip(filtered(spark, sf))


@query("report_segment")
def _report_segment(spark, sf):
    return rollups.report_segment(filtered(spark, sf))


@query("details_top_zips")
def _details_top_zips(spark, sf):
    return rollups.details_top_zips(filtered(spark, sf))


@query("kpi_row")
def _kpi_row(spark, sf):
    return rollups.kpi_row(donors(spark, sf), filters.donor_predicate(**FILTERS))


@query("kpi_row_empty")
def _kpi_row_empty(spark, sf):
    return rollups.kpi_row(donors(spark, sf), filters.donor_predicate(**NO_MATCH_FILTERS))


@query("top_zip")
def _top_zip(spark, sf):
    return rollups.top_zip(filtered(spark, sf))


@query("top_zip_empty")
def _top_zip_empty(spark, sf):
    return rollups.top_zip(filters.apply_filters(donors(spark, sf), **NO_MATCH_FILTERS))


@query("top_zip_rows")
def _top_zip_rows(spark, sf):
    return rollups.rows_of_top_zip(filtered(spark, sf)).select("donor_id", "zip_code")


@query("geo_extent")
def _geo_extent(spark, sf):
    return rollups.geo_extent(filtered(spark, sf))


@query("filter_domains")
def _filter_domains(spark, sf):
    return rollups.filter_domains(donors(spark, sf), T.venues(spark, sf))


@query("distinct_cells")
def _distinct_cells(spark, sf):
    return rollups.distinct_cells(filtered(spark, sf))


@query("report_scalars")
def _report_scalars(spark, sf):
    return rollups.report_scalars(filtered(spark, sf))


# --- hex grid ----------------------------------------------------------------

def _hex_assign(res):
    def run(spark, sf):
        return hexmap.assign_cells(donors(spark, sf), res).select("donor_id", "hex_cell")
    return run


def _hex_rollup(res):
    def run(spark, sf):
        return hexmap.hex_rollup(donors(spark, sf), res)
    return run


for _r in (7, 8, 9):
    QUERIES[f"hex_assign_{_r}"] = _hex_assign(_r)
    QUERIES[f"hex_rollup_{_r}"] = _hex_rollup(_r)


@query("hex_rollup_stored")
def _hex_rollup_stored(spark, sf):
    return hexmap.hex_rollup_stored(donors(spark, sf), "hex_level_8")


@query("hex_rollup_static")
def _hex_rollup_static(spark, sf):
    return hexmap.hex_rollup_static(donors(spark, sf), "hex_level_8")


@query("report_top_hex")
def _report_top_hex(spark, sf):
    return hexmap.report_top_hex(filtered(spark, sf), "hex_level_8")


@query("hex_top5")
def _hex_top5(spark, sf):
    return hexmap.hex_top(donors(spark, sf), "hex_level_8", 5)


@query("cell_boundaries")
def _cell_boundaries(spark, sf):
    cells = hexmap.hex_rollup(donors(spark, sf), 8).select("hex_cell")
    return hexmap.cell_boundaries(cells, 8)


@query("cell_polygons")
def _cell_polygons(spark, sf):
    cells = hexmap.hex_rollup(donors(spark, sf), 8).select("hex_cell")
    wkt = hexmap.cell_boundaries(cells, 8).where(F.col("corner") == 0).select("hex_cell", "wkt")
    parsed = hexmap.parse_polygon(wkt)
    return parsed.select("hex_cell", F.posexplode("ring").alias("point", "pt")).select(
        "hex_cell", "point", F.col("pt.lat").alias("lat"), F.col("pt.lon").alias("lon"))


@query("cell_boundary_stats")
def _cell_boundary_stats(spark, sf):
    return hexmap.cell_boundary_stats(hexmap.hex_rollup(donors(spark, sf), 8), 8)


@query("hex_colours")
def _hex_colours(spark, sf):
    return hexmap.hex_colours(hexmap.hex_rollup_stored(donors(spark, sf), "hex_level_8"))


# --- features and display tables --------------------------------------------------

def _money_double(df: DataFrame) -> DataFrame:
    """Money as double, dates as ISO text: engine-neutral output types."""
    cols = {}
    for name, dtype in df.dtypes:
        if dtype.startswith("decimal"):
            cols[name] = F.col(name).cast("double")
        elif dtype == "date":
            cols[name] = F.col(name).cast("string")
    return df.withColumns(cols) if cols else df


@query("donor_features")
def _donor_features(spark, sf):
    return features.donor_features(donors(spark, sf))


@query("venue_features")
def _venue_features(spark, sf):
    return features.venue_features(T.venues(spark, sf))


@query("map_layers")
def _map_layers(spark, sf):
    return features.map_layers(filters.apply_filters(donors(spark, sf), **FILTERS), T.venues(spark, sf))


@query("venue_cards")
def _venue_cards(spark, sf):
    return features.venue_cards(T.venues(spark, sf))


@query("donor_table")
def _donor_table(spark, sf):
    return features.donor_table(filters.apply_filters(donors(spark, sf), **FILTERS), 50)


@query("donor_table_all")
def _donor_table_all(spark, sf):
    return features.donor_table(filters.apply_filters(donors(spark, sf), **FILTERS), None)


@query("donor_details")
def _donor_details(spark, sf):
    return features.donor_details(filters.apply_filters(donors(spark, sf), **FILTERS))


@query("point_sizes")
def _point_sizes(spark, sf):
    return features.point_sizes(donors(spark, sf))


# --- governance -----------------------------------------------------------------
INTERN = governance.INTERN_ROLE
ADMIN = "ACCOUNTADMIN"
OTHER_ROLE = "PUBLIC"
PLATFORM_ADMIN = governance.PLATFORM_ADMIN_ROLE
ROLES = ("DATASCI", "SYSADMIN", "ACCOUNTADMIN", PLATFORM_ADMIN, "DATA_ANALYST", "SECURITY_ADMIN", INTERN,
         "ACADEMIC_ADVISOR_MGR_ROLE", OTHER_ROLE)


@query("mask_string")
def _mask_string(spark, sf):
    return donors(spark, sf).select("donor_id", governance.mask_string(F.col("full_name"), INTERN).alias("full_name"))


@query("mask_date")
def _mask_date(spark, sf):
    shown = lambda role: governance.mask_date(F.col("last_donation_date"), role).cast("string")
    return donors(spark, sf).select("donor_id", shown("DATASCI").alias("last_donation_date"),
                                    shown("DATA_ANALYST").alias("shown_to_analyst"))


@query("mask_number")
def _mask_number(spark, sf):
    d = donors(spark, sf)
    return d.select("donor_id",
                    governance.mask_number(F.col("annual_donation_amount"), INTERN, dtype="decimal(10,2)")
                    .cast("double").alias("annual_donation_amount"),
                    governance.mask_number(F.col("age"), INTERN, dtype="int").alias("age"))


def _masked(role):
    def run(spark, sf):
        g = governance.governed(donors(spark, sf), role)
        return _money_double(g.select("donor_id", "full_name", "age", "annual_donation_amount",
                                      "cumulative_donation_amount", "donor_segment", "major"))
    return run


def _row_access(role):
    def run(spark, sf):
        return governance.governed(donors(spark, sf), role).select("donor_id", "donor_segment")
    return run


QUERIES["masked_donors_intern"] = _masked(INTERN)
QUERIES["masked_donors_admin"] = _masked(ADMIN)
QUERIES["row_access_intern"] = _row_access(INTERN)
QUERIES["row_access_admin"] = _row_access(ADMIN)
QUERIES["row_access_other"] = _row_access(OTHER_ROLE)
QUERIES["masked_donors_platform_admin"] = _masked(PLATFORM_ADMIN)


@query("roles_clear")
def _roles_clear(spark, sf):
    """Per segment and role: what each mask shows of the first gift and the first name, and how many rows the role sees."""
    d = donors(spark, sf)
    out = None
    for role in ROLES:
        rows = governance.governed(d, role).groupBy("donor_segment").agg(
            F.count("*").alias("rows"), F.min("full_name").alias("first_name"),
            F.min(governance.mask_date(F.col("last_donation_date"), role)).cast("string").alias("first_date"),
            F.min("annual_donation_amount").cast("double").alias("least_gift")).withColumn("role", F.lit(role))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- where to hold an event ------------------------------------------------------

PAIR_RADIUS_KM, CATCHMENT_KM = 1.5, 4.0
RATING = 4.5


def _cells(spark, sf):
    return hexmap.hex_rollup_stored(donors(spark, sf), "hex_level_8")


@query("catchment_pairs")
def _catchment_pairs(spark, sf):
    """Every donor within 1.5 km of a venue, with the distance."""
    d = donors(spark, sf).select("donor_id", "latitude", "longitude", "hex_level_8")
    return sites.catchment_pairs(T.venues(spark, sf), d, PAIR_RADIUS_KM).select("venue_id", "donor_id", "distance_km")


@query("venue_catchments")
def _venue_catchments(spark, sf):
    return sites.venue_catchments(T.venues(spark, sf), donors(spark, sf), CATCHMENT_KM)


@query("hex_concentration")
def _hex_concentration(spark, sf):
    """Donors and giving around each cell, nearer cells counting more."""
    return sites.concentration(_cells(spark, sf), 8, rings=2)


@query("best_venues")
def _best_venues(spark, sf):
    """The three venues of each type with the most giving around them."""
    return sites.best_venues(T.venues(spark, sf), _cells(spark, sf), 8, k=3, rings=2)


@query("nearest_venues")
def _nearest_venues(spark, sf):
    """The three venues nearest to each cell that has donors."""
    return sites.nearest_venues(_cells(spark, sf).select("hex_cell"), T.venues(spark, sf), 8, k=3)


@query("nested_rollup")
def _nested_rollup(spark, sf):
    return hexmap.nested_rollup(donors(spark, sf))


@query("cell_parents")
def _cell_parents(spark, sf):
    cells = donors(spark, sf).select("hex_level_9").where("hex_level_9 IS NOT NULL").distinct()
    return hexmap.with_parents(cells)


@query("hex_rank_9")
def _hex_rank_9(spark, sf):
    """Place of every res 9 cell by its number of donors, ties included."""
    cells = hexmap.group_cells(donors(spark, sf), "hex_level_9", F.count(F.lit(1)).alias("donor_count"))
    return global_rank(cells, "donor_count", "hex_cell")


@query("hex_rank_8")
def _hex_rank_8(spark, sf):
    """The stored hex rollup in order of total: each cell's place."""
    return global_rank(_cells(spark, sf).select("hex_cell", "total_annual", "donor_count"), "total_annual", "hex_cell")


@query("venue_filter_rating")
def _venue_filter_rating(spark, sf):
    return (filters.venue_filter(T.venues(spark, sf), VENUE_TYPES, PRICES, MIN_CAPACITY, RATING)
            .select("venue_id", F.col("rating").cast("double").alias("rating")))


# --- enrichment -----------------------------------------------------------------

def _addresses(spark, sf):
    return T.addresses(spark, sf)


@query("address_pool")
def _address_pool(spark, sf):
    return enr.address_pool(_addresses(spark, sf), TARGET_ZIPS, OTHER_ZIPS, 7000, 3000)


@query("number_rows")
def _number_rows(spark, sf):
    """All addresses numbered in a repeatable random order."""
    return number_rows(_addresses(spark, sf), "address_id", SEED).select("address_id", "rn")


@query("sample_n")
def _sample_n(spark, sf):
    valid = _addresses(spark, sf).where(F.col("latitude").isNotNull())
    return sample_n(valid, 100, "address_id", "sample").select("address_id", "zip")


@query("donor_enrich")
def _donor_enrich(spark, sf):
    return enr.donor_enrich(_addresses(spark, sf), SEED)


@query("giving_bands")
def _giving_bands(spark, sf):
    d, year = donors(spark, sf), F.col("graduation_year")
    return d.select("donor_id", "graduation_year", enr.giving_band(year).alias("band_years"),
                    enr.grown_gift(F.col("annual_donation_amount"), year).cast("double").alias("grown_gift"))


@query("last_gift_date")
def _last_gift_date(spark, sf):
    last = F.col("last_donation_date")
    return donors(spark, sf).select(
        "donor_id", last.cast("string").alias("last_donation_date"),
        F.datediff(F.lit("2024-12-31").cast("date"), last).alias("days_since"),
        F.date_sub(last, 730).cast("string").alias("two_years_before"))


@query("pick_from_array")
def _pick_from_array(spark, sf):
    """Parts of the street text by zero-based index; null past the end."""
    parts = F.split("street", "#")
    return _addresses(spark, sf).select("address_id", enr.pick(parts, 0).alias("first_part"),
                                        enr.pick(parts, 1).alias("second_part"), enr.pick(parts, 2).alias("third_part"))


@query("scalar_subquery")
def _scalar_subquery(spark, sf):
    """Each gift's share of the largest one."""
    d = donors(spark, sf)
    largest = d.select(F.max("annual_donation_amount").cast("double")).scalar()
    return d.select("donor_id", (F.col("annual_donation_amount").cast("double") / largest).alias("share_of_largest"))


# --- quality ----------------------------------------------------------------------

@query("completeness")
def _completeness(spark, sf):
    return quality.completeness(donors(spark, sf), ["hex_level_7", "hex_level_8", "hex_level_9"])


@query("venue_completeness")
def _venue_completeness(spark, sf):
    v = T.with_cells(T.venues(spark, sf))
    return quality.completeness(v, ["hex_level_7", "hex_level_8", "hex_level_9"], "total_venues")


@query("status_line")
def _status_line(spark, sf):
    return quality.status_line(donors(spark, sf))


@query("key_uniqueness")
def _key_uniqueness(spark, sf):
    return quality.key_uniqueness(donors(spark, sf), "donor_id")


@query("venue_key_uniqueness")
def _venue_key_uniqueness(spark, sf):
    return quality.key_uniqueness(T.venues(spark, sf), "venue_id")


# --- sinks ------------------------------------------------------------------------
from hexgiving.session import shared_dir  # noqa: E402
from hexgiving.sinks import clustered, export  # noqa: E402

REPORT_TIME = "2024-12-31 00:00:00"


@query("ctas_roundtrip")
def _ctas_roundtrip(spark, sf):
    return export.write_table(rollups.donor_summary(donors(spark, sf)), shared_dir(spark, "summary"))


@query("append_roundtrip")
def _append_roundtrip(spark, sf):
    t = export.append_with_defaults(rollups.donor_summary(donors(spark, sf)), shared_dir(spark, "summary-append"))
    return t.withColumn("has_created_date", F.col("created_date").isNotNull()).drop("created_date")


@query("export_filtered")
def _export_filtered(spark, sf):
    return _money_double(export.csv_roundtrip(filtered(spark, sf), shared_dir(spark, "export-filtered")))


@query("export_complete")
def _export_complete(spark, sf):
    return _money_double(export.csv_roundtrip(donors(spark, sf), shared_dir(spark, "export-complete")))


@query("report_lines")
def _report_lines(spark, sf):
    """The report written as text in reading order, and its lines read back."""
    path = shared_dir(spark, "report")
    export.write_report(export.report_lines(filtered(spark, sf), REPORT_TIME), path)
    return export.read_report(spark, path)


# --- streaming ----------------------------------------------------------------------

@query("summary_stream")
def _summary_stream(spark, sf):
    """Donor rows land as files, read two per trigger; the streaming refresh
    keeps the summary current in its state; the result is the published table."""
    from hexgiving.streaming.refresh import read_summary, start_summary_refresh
    base = shared_dir(spark, "stream")
    src = f"{base}/donors"
    d = donors(spark, sf).select(*T.donors(spark, sf).columns)   # rows as they arrive, no cells
    d.write.parquet(src)
    q = start_summary_refresh(spark, src, d.schema, f"{base}/summary", f"{base}/_checkpoint",
                              available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    return read_summary(spark, f"{base}/summary")


# --- inline values, views and bound SQL ------------------------------------------------

@query("inline_values")
def _inline_values(spark, sf):
    """Supplier rows typed through the inline ``VALUES`` lookup."""
    s = T.read_table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("type_code"))
    return s.join(F.broadcast(T.venue_type_lookup(spark)), "type_code", "left").select("s_suppkey", "type_code", "venue_type")


@query("sql_zip_view")
def _sql_zip_view(spark, sf):
    """The zip view through SQL: view name and filter values are bound
    parameters (``IDENTIFIER(:view)``), never spliced into the text."""
    from hexgiving.sources.views import register_views, sql
    register_views(spark, sf)
    return sql(spark, "SELECT zip_code, donor_count, total_annual_donations, major_donors FROM IDENTIFIER(:view) "
                      "WHERE donor_count >= :min_count AND zip_code <> :skip",
               {"view": "donations_by_zip_code", "min_count": 1, "skip": "29600"})


@query("venue_cards_full")
def _venue_cards_full(spark, sf):
    """Venue cards with every field; some are null."""
    return features.venue_cards(T.venue_directory(spark, sf))


@query("summary_declared")
def _summary_declared(spark, sf):
    """The summary published with its declared types, its newest version read back; amounts as text, to the cent."""
    from hexgiving.sinks import published
    path = shared_dir(spark, "summary-declared")
    published.publish(rollups.declared_summary(donors(spark, sf), F.lit(REPORT_TIME).cast("timestamp")), path)
    t = published.latest(spark, path)
    money = [c for c, kind in t.dtypes if kind.startswith("decimal")]
    return t.withColumns({c: F.col(c).cast("string") for c in money}).withColumn("created_date", F.col("created_date").cast("string"))


@query("sql_governed")
def _sql_governed(spark, sf):
    """What SQL readers of the governed views see, per role and segment."""
    from hexgiving.sources.governed import declare_role, register_governed_views
    register_governed_views(spark, sf)
    out = None
    for role in ROLES:
        declare_role(spark, role)
        rows = spark.sql("SELECT donor_segment, count(*) AS donors, min(full_name) AS first_name, max(age) AS oldest, "
                         "CAST(sum(annual_donation_amount) AS DOUBLE) AS total_annual FROM governed_donors GROUP BY donor_segment")
        rows = rows.withColumn("role", F.lit(role))
        out = rows if out is None else out.unionByName(rows)
    declare_role(spark, "")
    return out


@query("sketch_counts")
def _sketch_counts(spark, sf):
    """Distinct donors' cells per zip, from sketches stored per summary row: is the estimate within four standard errors?"""
    from hexgiving.operators import sketches
    d = donors(spark, sf)
    path = shared_dir(spark, "sketches")
    sketches.distinct_sketches(d, ["zip_code", "hex_level_7"], {"cells": "hex_level_9", "givers": "donor_id"}).write.parquet(path)
    stored = spark.read.parquet(path)
    zips = sketches.estimates(sketches.united(stored, ["zip_code"], ["cells", "givers"]), ["cells", "givers"])
    exact = d.groupBy("zip_code").agg(F.countDistinct("hex_level_9").alias("distinct_cells"), F.countDistinct("donor_id").alias("distinct_donors"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.lit(4 * sketches.relative_error()) * F.col(b) + 1
    return exact.join(zips, "zip_code").select("zip_code", "distinct_cells", "distinct_donors",
                                               (near("cells", "distinct_cells") & near("givers", "distinct_donors")).alias("within_error"))


@query("delta_stream")
def _delta_stream(spark, sf):
    """Donor files land, half of the rows twice; the refresh writes deltas, which are folded and added up."""
    from hexgiving.streaming import incremental
    base = shared_dir(spark, "delta-stream")
    d = donors(spark, sf).select(*T.donors(spark, sf).columns)
    d.write.parquet(f"{base}/donors")
    d.where(F.pmod(F.xxhash64("donor_id"), F.lit(2)) == 0).write.mode("append").parquet(f"{base}/donors")
    q = incremental.start_delta_refresh(spark, f"{base}/donors", d.schema, f"{base}/summary", f"{base}/_checkpoint",
                                        available_now=True, max_files_per_trigger=4)
    q.awaitTermination()
    incremental.compact(spark, f"{base}/summary")
    return incremental.read_delta_summary(spark, f"{base}/summary")


@query("incremental_load")
def _incremental_load(spark, sf):
    """Orders arrive as files in two lots; each load appends the donors of the new files alone."""
    from hexgiving.streaming import incremental
    base = shared_dir(spark, "load")
    orders, customer = T.read_table(spark, sf, "orders"), T.read_table(spark, sf, "customer")
    for lot in (0, 1):
        orders.where(F.pmod(F.col("o_orderkey"), F.lit(2)) == lot).write.mode("append").parquet(f"{base}/orders")
        incremental.load_new_orders(spark, f"{base}/orders", orders.schema, customer, f"{base}/donors", f"{base}/_checkpoint").awaitTermination()
    return (spark.read.parquet(f"{base}/donors").groupBy("zip_code", "hex_level_8", "donor_segment")
            .agg(F.count(F.lit(1)).alias("donor_count"), F.countDistinct("donor_id").alias("distinct_donors"),
                 F.sum("annual_donation_amount").cast("double").alias("total_annual")))


@query("partitioned_filter_zip")
def _partitioned_filter_zip(spark, sf):
    """Donor table written once partitioned by zip, read back with a zip
    filter: only the matching partitions are scanned."""
    table = export.write_donor_table(T.donors(spark, sf), shared_dir(spark, "donor-table"))
    return (filters.apply_filters(table, zip_codes=ZIPS)
            .select("donor_id", "zip_code", "donor_segment",
                    F.col("annual_donation_amount").cast("double").alias("annual_donation_amount")))


@query("clustered_filters")
def _clustered_filters(spark, sf):
    """Donor table clustered by zip, year and amount at once; each filter
    alone, and all together, skips row groups of it."""
    rows = donors(spark, sf).select("donor_id", *clustered.DONOR_CLUSTERING)
    table = clustered.write_interleaved(rows, shared_dir(spark, "clustered-donors"))
    parts = [filters.apply_filters(table, **choice).agg(
        F.lit(name).alias("filter_name"), F.count("*").alias("donor_count"),
        money_sum(F.col("annual_donation_amount")).alias("total")) for name, choice in CLUSTER_FILTERS.items()]
    return reduce(DataFrame.unionByName, parts)
