import datetime as dt

from pyspark.sql import functions as F

from hexgiving.operators import governance as gv
from hexgiving.operators import quality


def test_masks_by_role(edge_donors):
    intern = gv.governed(edge_donors, gv.INTERN_ROLE).collect()
    assert intern and all(r.donor_segment == "Annual Donor" for r in intern)
    assert all(r.full_name == "**masked**" and float(r.annual_donation_amount) == 0 and r.age == 0 for r in intern)
    admin = gv.governed(edge_donors, "ACCOUNTADMIN").collect()
    assert len(admin) == edge_donors.count() and admin[0].full_name.startswith("Name")
    assert gv.governed(edge_donors, "SOMEONE_ELSE").count() == 0


def test_mask_keeps_types_and_masks_nulls(edge_donors):
    m = gv.masked(edge_donors, "NOBODY")
    assert dict(m.dtypes)["annual_donation_amount"] == dict(edge_donors.dtypes)["annual_donation_amount"]
    d = edge_donors.select(gv.mask_date(F.col("last_donation_date"), "NOBODY").alias("d")).collect()
    assert {r.d for r in d} == {dt.date(9999, 12, 31)}
    s = edge_donors.select(gv.mask_string(F.lit(None).cast("string"), "NOBODY").alias("s")).collect()
    assert {r.s for r in s} == {"**masked**"}


def test_role_from_session_setting(spark, edge_donors):
    spark.conf.set(gv.ROLE_SETTING, gv.INTERN_ROLE)
    try:
        assert gv.governed(edge_donors).count() == 8
    finally:
        spark.conf.unset(gv.ROLE_SETTING)


def test_policies_fold_into_plan(spark, tmp_path, edge_donors):
    path = str(tmp_path / "d")
    edge_donors.write.parquet(path)
    df = spark.read.parquet(path)
    admin_plan = gv.governed(df, "ACCOUNTADMIN")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in admin_plan            # all-true row policy vanished
    intern_plan = gv.governed(df, gv.INTERN_ROLE)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in intern_plan and "donor_segment" in intern_plan.split("PushedFilters")[1]


def test_completeness_and_status(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "hex_level_7 string")
    r = quality.completeness(df, ["hex_level_7"]).collect()[0]
    assert (r.total_records, r.hex_level_7_count, r.hex_level_7_not_null) == (3, 2, 2)
    assert quality.status_line(df).collect()[0][0] == quality.STATUS_OK
    assert quality.status_line(df.where("hex_level_7 IS NULL")).collect()[0][0] == quality.STATUS_EMPTY


def test_key_uniqueness(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    r = quality.key_uniqueness(df, "k").collect()[0]
    assert (r.total_rows, r.distinct_keys, r.duplicated_keys, r.null_keys) == (4, 2, 1, 1)


def test_catalog_listing(spark, edge_donors):
    edge_donors.createOrReplaceTempView("alumni_donors_t")
    t = quality.catalog_tables(spark, ["alumni_donors_t"]).collect()
    assert [r.table_name for r in t] == ["alumni_donors_t"]
    cols = quality.catalog_columns(edge_donors, "%segment%").collect()
    assert [(r.column_name, r.data_type) for r in cols] == [("donor_segment", "string")]


def test_adapters_conform_to_declared_schemas(spark):
    from hexgiving import schemas
    from hexgiving.sources import tables as T
    sf = "/root/testdata/sf0.001"
    assert schemas.conforms(T.donors_with_cells(spark, sf), schemas.DONORS) == []
    assert schemas.conforms(T.addresses(spark, sf), schemas.ADDRESSES) == []
    assert schemas.conforms(T.venues(spark, sf), schemas.VENUES) == []
    assert schemas.empty(spark, schemas.DONOR_SUMMARY).count() == 0


def test_role_from_sql_session_variable(spark, edge_donors):
    spark.sql(f"DECLARE OR REPLACE VARIABLE {gv.ROLE_VARIABLE} STRING DEFAULT '{gv.INTERN_ROLE}'")
    try:
        assert gv.governed(edge_donors).count() == 8
        spark.sql(f"SET VAR {gv.ROLE_VARIABLE} = 'ACCOUNTADMIN'")
        assert gv.governed(edge_donors).count() == edge_donors.count()
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {gv.ROLE_VARIABLE}")
    assert gv.governed(edge_donors).count() == 0      # nothing declared or set: sees nothing
