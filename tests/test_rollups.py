from pyspark.sql import functions as F

from hexgiving.functions.measures import mean_half_up
from hexgiving.operators import filters, rollups
from tests.conftest import DONOR_SCHEMA, donor_row


def test_half_up_mean_from_exact_cents(spark):
    df = spark.createDataFrame([(1, "0.01"), (1, "0.02"), (2, "0.01"), (2, "0.01"), (2, "0.02")],
                               "g int, v string").withColumn("v", F.col("v").cast("decimal(10,2)"))
    out = dict(df.groupBy("g").agg(mean_half_up(F.col("v"), 2).alias("m")).collect())
    assert out[1] == 0.02          # 0.015 rounds up
    assert out[2] == 0.01          # 0.01333...


def test_negative_mean_rounds_away_from_zero(spark):
    df = spark.createDataFrame([(-1,), (-2,)], "v int")
    assert df.agg(mean_half_up(F.col("v"), 0, 0)).collect()[0][0] == -2.0


def test_segments_and_overview(edge_donors):
    row = rollups.donor_overview(edge_donors).collect()[0]
    assert row.total_donors == 11
    assert (row.major_donors, row.mid_level_donors, row.annual_donors) == (1, 2, 8)


def test_sql_views_keep_null_group_dashboard_drops_it(edge_donors):
    majors = [r.major for r in rollups.by_major(edge_donors).collect()]
    assert None in majors
    assert None not in [r.major for r in rollups.chart_top_majors(edge_donors).collect()]
    zips = [r.zip_code for r in rollups.report_zip(edge_donors).collect()]
    assert None not in zips


def test_top_zip_tie_goes_to_lowest_zip(spark):
    rows = [donor_row(1, zip_code="29605", annual="100.00"), donor_row(2, zip_code="29604", annual="100.00")]
    df = spark.createDataFrame(rows, DONOR_SCHEMA)
    r = rollups.top_zip(df).collect()[0]
    assert (r.top_zip, r.donor_count) == ("29604", 1)


def test_top_zip_and_kpi_on_empty_selection(edge_donors):
    empty = edge_donors.where(F.lit(False))
    r = rollups.top_zip(empty).collect()
    assert [(x.top_zip, x.donor_count) for x in r] == [("No data", 0)]
    k = rollups.kpi_row(edge_donors, F.col("graduation_year") > 3000).collect()[0]
    assert k.total_donors == 0 and k.delta_from_full == -11
    assert k.major_share_pct is None and k.avg_annual is None and k.total_annual == 0.0


def test_kpi_single_pass_matches_filter(edge_donors):
    pred = filters.donor_predicate(donation_range=(1000.0, 20000.0))
    k = rollups.kpi_row(edge_donors, pred).collect()[0]
    assert k.total_donors == 3 and k.major_donors == 1
    assert k.major_share_pct == 33.3
    assert abs(k.total_annual - (1000.00 + 9999.99 + 10000.00)) < 1e-6


def test_rows_of_top_zip_is_semi_join(edge_donors):
    out = rollups.rows_of_top_zip(edge_donors)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    assert {r.zip_code for r in out.collect()} == {"29602"}


def test_filter_domains_long_form(edge_donors, spark):
    venues = spark.createDataFrame([("Hotel", "$$", 100), ("Museum", "$", None)],
                                   "venue_type string, price_range string, capacity int")
    d = rollups.filter_domains(edge_donors, venues)
    got = {(r.domain, r.value) for r in d.collect()}
    assert ("max_capacity", "100") in got and ("min_year", "1990") in got
    assert ("venue_type", "Museum") in got
    assert not any(v is None for _, v in got)


def test_distinct_cells_ignores_nulls(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", "b", None), (None, "b", "y")],
                               "hex_level_7 string, hex_level_8 string, hex_level_9 string")
    r = rollups.distinct_cells(df).collect()[0]
    assert (r.cells_7, r.cells_8, r.cells_9) == (1, 1, 2)


def test_distinct_cells_approx_close_to_exact(spark):
    df = spark.range(0, 20000).selectExpr("CAST(id % 5000 AS STRING) AS hex_level_7",
                                          "CAST(id % 700 AS STRING) AS hex_level_8",
                                          "CAST(id AS STRING) AS hex_level_9")
    exact = rollups.distinct_cells(df).collect()[0]
    approx = rollups.distinct_cells(df, approx_rsd=0.02).collect()[0]
    for k in ("cells_7", "cells_8", "cells_9"):
        assert abs(approx[k] - exact[k]) <= 0.08 * exact[k]


def test_sum_of_null_amounts_is_zero_in_charts(spark):
    df = spark.createDataFrame([("29601", None), ("29602", 5.0)], "zip_code string, a double").select(
        "zip_code", F.col("a").cast("decimal(10,2)").alias("annual_donation_amount"))
    got = {r.zip_code: (r.total_annual, r.donor_count) for r in rollups.zip_totals(df).collect()}
    assert got == {"29601": (0.0, 0), "29602": (5.0, 1)}


def test_ranked_orders_by_total_then_key(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 9.0), (None, 2.0)], "k string, t double")
    assert [r.k for r in rollups.ranked(df, "t", "k").orderBy("position").collect()] == ["c", None, "a", "b"]
