from pyspark.sql import functions as F

from hexgiving.operators import filters


def ids(df):
    return sorted(r[0] for r in df.select("donor_id").collect())


def test_empty_lists_mean_no_filter(edge_donors):
    out = filters.apply_filters(edge_donors, zip_codes=[], grad_years=None, donation_range=None, donor_segments=())
    assert out.count() == edge_donors.count()


def test_amount_range_is_closed(edge_donors):
    out = filters.apply_filters(edge_donors, donation_range=(1000.0, 10000.0))
    assert ids(out) == ["D002", "D003", "D004"]


def test_year_range_closed_and_zip_membership(edge_donors):
    out = filters.apply_filters(edge_donors, zip_codes=["29603"], grad_years=(1990, 2024))
    assert ids(out) == ["D010", "D011"]


def test_null_never_passes_a_range_or_list(edge_donors):
    out = filters.apply_filters(edge_donors, zip_codes=["29601", "29602", "29603"])
    assert "D005" not in ids(out)


def test_segments_filter(edge_donors):
    out = filters.apply_filters(edge_donors, donor_segments=["Major Donor"])
    assert ids(out) == ["D004"]


def test_venue_filter_empty_list_selects_nothing(spark):
    v = spark.createDataFrame([("V1", "Hotel", "$$", 100), ("V2", "Hotel", "$$", None)],
                              "venue_id string, venue_type string, price_range string, capacity int")
    assert filters.venue_filter(v, [], ["$$"], 0).count() == 0
    assert filters.venue_filter(v, ["Hotel"], [], 0).count() == 0
    # unknown capacity never passes the minimum
    assert [r[0] for r in filters.venue_filter(v, ["Hotel"], ["$$"], 0).collect()] == ["V1"]


def test_valid_points_drops_any_null(edge_donors):
    out = filters.valid_points(edge_donors)
    assert not {"D007", "D008", "D009"} & set(ids(out))


def test_require_columns(edge_donors):
    filters.require_columns(edge_donors, ["latitude", "donor_segment"])
    try:
        filters.require_columns(edge_donors, ["nope"])
        raise AssertionError("expected ValueError")
    except ValueError:
        pass
    assert filters.existing_columns(edge_donors, ["degree", "full_name"]) == ["full_name"]


def test_filter_reaches_scan(spark, tmp_path, edge_donors):
    path = str(tmp_path / "donors")
    edge_donors.write.parquet(path)
    df = filters.apply_filters(spark.read.parquet(path), zip_codes=["29601"], grad_years=(2000, 2010))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "zip_code" in plan.split("PushedFilters")[1]
    assert df.select(F.count("*")).collect()[0][0] > 0


def test_decimal_bounds_match_double_comparison(spark):
    from decimal import Decimal as D
    from hexgiving.operators.filters import decimal_bounds
    vals = [D(k) / 100 for k in range(99990, 100020)] + [D("0.10"), D("0.09"), D("0.11"), D("1000.01")]
    df = spark.createDataFrame([(v,) for v in vals], "annual_donation_amount decimal(10,2)")
    for lo, hi in [(1000.0, 1000.1), (999.995, 1000.005), (0.1, 1000.0), (999.999999, 1000.0000001)]:
        lo_d, hi_d = decimal_bounds(lo, hi, 2)
        by_double = {v for v in vals if lo <= float(v) <= hi}
        by_decimal = {v for v in vals if lo_d <= v <= hi_d}
        assert by_double == by_decimal, (lo, hi)
        got = {r[0] for r in filters.apply_filters(df, donation_range=(lo, hi)).collect()}
        assert got == by_double


def test_amount_range_reaches_scan(spark, tmp_path, edge_donors):
    path = str(tmp_path / "d")
    edge_donors.write.parquet(path)
    df = filters.apply_filters(spark.read.parquet(path), donation_range=(1000.0, 20000.0))
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "GreaterThanOrEqual(annual_donation_amount" in plan
