"""Non-spatial rollups: summary table, overview, by year / zip / major,
chart and report tables, KPI row, extent, filter domains, distinct cells.

Every rollup is one ``groupBy().agg()`` (partial aggregation before the
shuffle, final after), and every ranked output is ``orderBy().limit(k)``
(``TakeOrderedAndProject``: each task keeps k rows). Ties are broken on the
group key so top-k results are deterministic.

Grouped results are returned unsorted: an ``ORDER BY`` inside a view
guarantees nothing to the query that reads it, and a global sort is a
range-partitioning shuffle. Readers sort with ``by_total`` (or any order)
where order is the feature; top-k results keep ``orderBy().limit()``.

Null groups follow their source: the SQL views keep a null key as a group
(``GROUP BY`` semantics) while the dashboard tables drop it (``groupby``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexgiving.functions.measures import coord_mean, mean_half_up, mean_of_sums, money_sum, rounded
from hexgiving.schemas import DONOR_SUMMARY, declared
from hexgiving.sources.tables import (MAJOR_DONOR_MIN, SEGMENT_ANNUAL, SEGMENT_MAJOR,
                                      SEGMENT_MID)

ANNUAL = "annual_donation_amount"
CUMULATIVE = "cumulative_donation_amount"


def _drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def by_total(df: DataFrame, total: str, key: str) -> DataFrame:
    """Reader-side presentation order: total descending, key ascending."""
    return df.orderBy(F.col(total).desc(), F.col(key).asc())


def ranked(df: DataFrame, total: str | None, key: str) -> DataFrame:
    """``df`` with its place in presentation order, as column ``position``: total
    descending, then key (null first). For small grouped results only: the
    groups of one key, or a filter's values, are numbered in one task."""
    order = ([F.col(total).desc()] if total else []) + [F.col(key).asc_nulls_first()]
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def top_k(df: DataFrame, k: int, by: str, key: str | Sequence[str], ascending: bool = False) -> DataFrame:
    """Top k rows by ``by`` (descending by default), ties broken on ``key`` ascending."""
    keys = [key] if isinstance(key, str) else list(key)
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return df.orderBy(order, *[F.col(c).asc() for c in keys]).limit(k)


# --- materialised summary and SQL views ----------------------------------

def donor_summary(donors: DataFrame, cell_cols: Sequence[str] = ("hex_level_7", "hex_level_8", "hex_level_9")) -> DataFrame:
    """Summary by zip and the three cell levels (null groups kept)."""
    return (donors.groupBy("zip_code", *cell_cols)
            .agg(F.count(F.lit(1)).alias("donor_count"),
                 money_sum(F.col(ANNUAL)).alias("total_annual_donations"),
                 money_sum(F.col(CUMULATIVE)).alias("total_cumulative_donations"),
                 mean_half_up(F.col(ANNUAL), 2).alias("avg_annual_donation"),
                 mean_half_up(F.col(CUMULATIVE), 2).alias("avg_cumulative_donation"),
                 F.count_if(F.col(ANNUAL) >= MAJOR_DONOR_MIN).alias("major_donors_count")))


def declared_summary(donors: DataFrame, created: Column | None = None,
                     cell_cols: Sequence[str] = ("hex_level_7", "hex_level_8", "hex_level_9")) -> DataFrame:
    """The stored summary with its declared types: exact DECIMAL totals and means, INT counts, the load time.

    Means are rounded half-up; sums of null amounts alone are null. A group too
    large for a declared type is an error, not a wrong number.
    """
    rows = donors.groupBy("zip_code", *cell_cols).agg(
        F.count(F.lit(1)).alias("donor_count"), F.sum(ANNUAL).alias("total_annual_donations"),
        F.sum(CUMULATIVE).alias("total_cumulative_donations"), F.count(ANNUAL).alias("_na"), F.count(CUMULATIVE).alias("_nc"),
        F.count_if(F.col(ANNUAL) >= MAJOR_DONOR_MIN).alias("major_donors_count"))
    mean = lambda total, n: mean_of_sums(F.col(total).cast("decimal(38,2)"), F.col(n), 2)
    rows = rows.withColumns({"avg_annual_donation": mean("total_annual_donations", "_na"),
                             "avg_cumulative_donation": mean("total_cumulative_donations", "_nc"),
                             "created_date": F.current_timestamp() if created is None else created})
    return declared(rows, DONOR_SUMMARY)


def donor_overview(donors: DataFrame) -> DataFrame:
    """One row: totals, averages and count per segment."""
    seg = F.col("donor_segment")
    return donors.agg(
        F.count(F.lit(1)).alias("total_donors"),
        money_sum(F.col(ANNUAL)).alias("total_annual_donations"),
        money_sum(F.col(CUMULATIVE)).alias("total_cumulative_donations"),
        mean_half_up(F.col(ANNUAL), 2).alias("avg_annual_donation"),
        mean_half_up(F.col(CUMULATIVE), 2).alias("avg_cumulative_donation"),
        F.count_if(seg == SEGMENT_MAJOR).alias("major_donors"),
        F.count_if(seg == SEGMENT_MID).alias("mid_level_donors"),
        F.count_if(seg == SEGMENT_ANNUAL).alias("annual_donors"))


def _view_measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("donor_count"),
            money_sum(F.col(ANNUAL)).alias("total_annual_donations"),
            money_sum(F.col(CUMULATIVE)).alias("total_cumulative_donations"),
            mean_half_up(F.col(ANNUAL), 2).alias("avg_annual_donation")]


def by_grad_year(donors: DataFrame) -> DataFrame:
    return (donors.groupBy("graduation_year")
            .agg(*_view_measures(), mean_half_up(F.col("age"), 1, 0).alias("avg_age")))


def by_zip(donors: DataFrame) -> DataFrame:
    return (donors.groupBy("zip_code")
            .agg(*_view_measures(),
                 F.count_if(F.col("donor_segment") == SEGMENT_MAJOR).alias("major_donors"),
                 rounded(coord_mean(F.col("latitude")), 6).alias("center_latitude"),
                 rounded(coord_mean(F.col("longitude")), 6).alias("center_longitude")))


def by_major(donors: DataFrame) -> DataFrame:
    return (donors.groupBy("major")
            .agg(*_view_measures(), mean_half_up(F.col("age"), 1, 0).alias("avg_age")))


# --- dashboard charts, report and detail tables (null keys dropped) -------

def total_or_zero(c: Column) -> Column:
    """Sum of a group; 0 where all its amounts are null."""
    return F.coalesce(money_sum(c), F.lit(0.0))


def chart_grad_year(donors: DataFrame) -> DataFrame:
    return (_drop_null_keys(donors, ["graduation_year"]).groupBy("graduation_year")
            .agg(total_or_zero(F.col(ANNUAL)).alias("total_annual"),
                 mean_half_up(F.col(ANNUAL), 2).alias("avg_annual"),
                 F.count(ANNUAL).alias("donor_count")))


def zip_totals(donors: DataFrame) -> DataFrame:
    return (_drop_null_keys(donors, ["zip_code"]).groupBy("zip_code")
            .agg(total_or_zero(F.col(ANNUAL)).alias("total_annual"),
                 F.count(ANNUAL).alias("donor_count")))


def chart_top_zips(donors: DataFrame, k: int = 10) -> DataFrame:
    return top_k(zip_totals(donors), k, "total_annual", "zip_code")


def segment_counts(donors: DataFrame) -> DataFrame:
    return (_drop_null_keys(donors, ["donor_segment"]).groupBy("donor_segment")
            .agg(F.count(F.lit(1)).alias("donor_count")))


def chart_top_majors(donors: DataFrame, k: int = 10) -> DataFrame:
    totals = (_drop_null_keys(donors, ["major"]).groupBy("major")
              .agg(total_or_zero(F.col(ANNUAL)).alias("total_annual")))
    return top_k(totals, k, "total_annual", "major")


def _count_sum_mean(key: str, df: DataFrame) -> DataFrame:
    return (_drop_null_keys(df, [key]).groupBy(key)
            .agg(F.count(ANNUAL).alias("donor_count"),
                 total_or_zero(F.col(ANNUAL)).alias("total_annual"),
                 mean_half_up(F.col(ANNUAL), 2).alias("avg_annual")))


def report_zip(donors: DataFrame) -> DataFrame:
    return _count_sum_mean("zip_code", donors)


def report_segment(donors: DataFrame) -> DataFrame:
    return _count_sum_mean("donor_segment", donors)


def details_top_zips(donors: DataFrame, k: int = 5) -> DataFrame:
    totals = (_drop_null_keys(donors, ["zip_code"]).groupBy("zip_code")
              .agg(F.count("donor_id").alias("donor_count"),
                   total_or_zero(F.col(ANNUAL)).alias("total_annual")))
    return top_k(totals, k, "total_annual", "zip_code")


# --- KPI row, best zip, extent, domains -----------------------------------

def kpi_row(donors: DataFrame, predicate: Column) -> DataFrame:
    """KPIs of the filtered set against the full set, in a single scan.

    The filter enters as conditional aggregates, so the full count and the
    filtered measures come out of one pass. The major share is null (not an
    error) when nothing is selected.
    """
    sel = F.coalesce(predicate, F.lit(False))
    n = F.count_if(sel)
    major = F.count_if(sel & (F.col("donor_segment") == SEGMENT_MAJOR))
    share = F.when(n > 0, F.call_function("div", major * 2000 + n, n * 2) / F.lit(10.0))
    annual_sel = F.when(sel, F.col(ANNUAL))
    return donors.agg(
        n.alias("total_donors"),
        (n - F.count(F.lit(1))).alias("delta_from_full"),
        F.coalesce(money_sum(annual_sel), F.lit(0.0)).alias("total_annual"),
        mean_half_up(annual_sel, 2).alias("avg_annual"),
        major.alias("major_donors"),
        share.alias("major_share_pct"))


def top_zip(filtered: DataFrame) -> DataFrame:
    """Best zip by total (ties: lowest zip) and its donor count.

    ``"No data"`` and 0 when the selection is empty. The single-row
    aggregate over the (at most one row) top-1 frame always yields one row.
    """
    totals = (_drop_null_keys(filtered, ["zip_code"]).groupBy("zip_code")
              .agg(total_or_zero(F.col(ANNUAL)).alias("total_annual"),
                   F.count(F.lit(1)).alias("donor_count")))
    best = top_k(totals, 1, "total_annual", "zip_code")
    return best.agg(F.coalesce(F.first("zip_code"), F.lit("No data")).alias("top_zip"),
                    F.coalesce(F.first("donor_count"), F.lit(0).cast("long")).alias("donor_count"))


def rows_of_top_zip(filtered: DataFrame) -> DataFrame:
    """Rows of the best zip: a semi-join against the one-row top-1 frame.

    The right side is a top-1 result, so its size is bounded by construction
    and it is broadcast.
    """
    totals = (_drop_null_keys(filtered, ["zip_code"]).groupBy("zip_code")
              .agg(total_or_zero(F.col(ANNUAL)).alias("total_annual")))
    best = top_k(totals, 1, "total_annual", "zip_code").select("zip_code")
    return filtered.join(F.broadcast(best), "zip_code", "left_semi")


def geo_extent(df: DataFrame) -> DataFrame:
    """Bounds and centre of the points (nulls skipped)."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.agg(F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
                  F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"),
                  rounded(coord_mean(lat), 6).alias("center_lat"),
                  rounded(coord_mean(lon), 6).alias("center_lon"))


def filter_domains(donors: DataFrame, venues: DataFrame) -> DataFrame:
    """Widget domains in long form: ``(domain, value)``.

    Distinct values are computed with ``distinct`` (partial dedup per task,
    then a shuffle of distinct values only); numeric bounds with one
    aggregate. Long form keeps every domain row-shaped, however many values
    a domain has.
    """
    def distinct_of(df: DataFrame, cols: dict[str, str]) -> DataFrame:
        # one pass over ``df`` for all its list domains
        pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("domain"), F.col(c).cast("string").alias("value"))
                                    for name, c in cols.items()])).alias("d")
        return df.select(pairs).select("d.domain", "d.value").where(F.col("value").isNotNull()).distinct()

    bounds = donors.agg(
        F.min("graduation_year").alias("min_year"), F.max("graduation_year").alias("max_year"),
        F.min(ANNUAL).alias("min_donation"), F.max(ANNUAL).alias("max_donation"))
    bound_rows = bounds.select(F.explode(F.array(
        F.struct(F.lit("min_year").alias("domain"), F.col("min_year").cast("string").alias("value")),
        F.struct(F.lit("max_year").alias("domain"), F.col("max_year").cast("string").alias("value")),
        F.struct(F.lit("min_donation").alias("domain"), F.col("min_donation").cast("string").alias("value")),
        F.struct(F.lit("max_donation").alias("domain"), F.col("max_donation").cast("string").alias("value")),
    )).alias("d")).select("d.domain", "d.value")
    cap = venues.agg(F.lit("max_capacity").alias("domain"),
                     F.max("capacity").cast("string").alias("value"))
    return (distinct_of(donors, {"zip_code": "zip_code", "donor_segment": "donor_segment"})
            .unionByName(distinct_of(venues, {"venue_type": "venue_type", "price_range": "price_range"}))
            .unionByName(bound_rows).unionByName(cap))


def distinct_cells(df: DataFrame, cell_cols: Sequence[str] = ("hex_level_7", "hex_level_8", "hex_level_9"),
                   approx_rsd: float | None = None) -> DataFrame:
    """Distinct cell count per level (nulls not counted).

    Exact by default (each task deduplicates before the shuffle). With
    ``approx_rsd`` a HyperLogLog++ sketch of that relative standard
    deviation is merged instead: constant memory per task and a shuffle of
    sketches only, however many cells there are.
    """
    def count(c):
        return F.approx_count_distinct(c, approx_rsd) if approx_rsd else F.countDistinct(c)
    return df.agg(*[count(c).alias(f"cells_{c.rsplit('_', 1)[-1]}") for c in cell_cols])


def report_scalars(filtered: DataFrame) -> DataFrame:
    """Report header numbers: count, sums, means, centre and bounds."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return filtered.agg(
        F.count(F.lit(1)).alias("total_donors"),
        F.coalesce(money_sum(F.col(ANNUAL)), F.lit(0.0)).alias("total_annual"),
        mean_half_up(F.col(ANNUAL), 2).alias("avg_annual"),
        F.coalesce(money_sum(F.col(CUMULATIVE)), F.lit(0.0)).alias("total_cumulative"),
        mean_half_up(F.col(CUMULATIVE), 2).alias("avg_cumulative"),
        rounded(coord_mean(lat), 6).alias("center_lat"),
        rounded(coord_mean(lon), 6).alias("center_lon"),
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))
