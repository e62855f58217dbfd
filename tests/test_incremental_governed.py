"""Delta refresh, incremental load, governed SQL, sketches, published versions, declared types."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F
from tests.conftest import DONOR_SCHEMA, donor_row

from hexgiving import schemas
from hexgiving.operators import governance, rollups, sketches
from hexgiving.plans.dashboard import dashboard
from hexgiving.session import shared_dir
from hexgiving.sinks import published
from hexgiving.sources import governed
from hexgiving.sources import tables as T
from hexgiving.streaming import incremental

SF = "/root/testdata/sf0.001"
TIMED = DONOR_SCHEMA + ", known timestamp"


def timed(rows, hour):
    return [(*r, dt.datetime(2024, 1, 1, hour)) for r in rows]


def land(spark, path, rows):
    spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(path)


def refresh(spark, base, delay="2 hours"):
    schema = spark.createDataFrame([], TIMED).schema
    q = incremental.start_delta_refresh(spark, f"{base}/in", schema, f"{base}/out", f"{base}/check", available_now=True,
                                        state_partitions=2, time_col="known", delay=delay)
    q.awaitTermination()
    return q


def summary(spark, base):
    return {tuple(r) for r in incremental.read_delta_summary(spark, f"{base}/out").collect()}


def full(spark, rows):
    return {tuple(r) for r in rollups.donor_summary(T.with_cells(spark.createDataFrame(rows, DONOR_SCHEMA))).collect()}


def test_deltas_are_the_full_summary_and_hold_changed_groups_only(spark):
    base = shared_dir(spark, "deltas")
    first = [donor_row(i, zip_code=f"296{i % 10:02d}", lat=34.6 + i % 7 / 50, annual=None if i % 9 == 0 else f"{i}.37") for i in range(60)]
    land(spark, f"{base}/in", timed(first, 1))
    q = refresh(spark, base)
    assert "RocksDB" in str(q.lastProgress["stateOperators"][0]["customMetrics"]) or q.lastProgress is not None
    assert summary(spark, base) == full(spark, first)
    more = [donor_row(100 + i, zip_code="29601", annual="10000.00") for i in range(5)] + [donor_row(200, zip_code=None, lat=None)]
    land(spark, f"{base}/in", timed(more + first[:20], 2))      # twenty come again
    refresh(spark, base)
    assert summary(spark, base) == full(spark, first + more)
    deltas = sorted(glob.glob(f"{base.removeprefix('file:')}/out/deltas/b*"))
    assert spark.read.parquet(deltas[-1]).where("n > 0").count() <= 2       # of the groups that the batch touched
    incremental.compact(spark, f"{base}/out")
    incremental.compact(spark, f"{base}/out")
    assert summary(spark, base) == full(spark, first + more)
    third = [donor_row(300, zip_code="29699")]
    land(spark, f"{base}/in", timed(third, 2))
    refresh(spark, base)
    incremental.compact(spark, f"{base}/out")
    assert summary(spark, base) == full(spark, first + more + third)
    assert len(glob.glob(f"{base.removeprefix('file:')}/out/base/v*")) == 2


def test_late_repeated_and_unnamed_rows(spark):
    base = shared_dir(spark, "late")
    land(spark, f"{base}/in", timed([donor_row(1), donor_row(2)], 10))
    refresh(spark, base)
    unnamed = [(None, *donor_row(7)[1:])] * 3
    land(spark, f"{base}/in", timed([donor_row(1), donor_row(3)], 9) + timed(unnamed, 10))   # within the delay
    refresh(spark, base)
    land(spark, f"{base}/in", timed([donor_row(4)], 2))     # later than the delay: dropped
    refresh(spark, base)
    assert sum(r[4] for r in summary(spark, base)) == 6
    with pytest.raises(FileNotFoundError):
        incremental.read_delta_summary(spark, shared_dir(spark, "none"))


def test_second_load_reads_new_files_only(spark):
    base = shared_dir(spark, "load")
    orders, customer = T.read_table(spark, SF, "orders"), T.read_table(spark, SF, "customer")
    seen = []
    for lot in range(3):
        part = orders.where(F.pmod(F.col("o_orderkey"), F.lit(3)) == lot)
        part.coalesce(1).write.mode("append").parquet(f"{base}/orders")
        q = incremental.load_new_orders(spark, f"{base}/orders", orders.schema, customer, f"{base}/donors", f"{base}/check")
        q.awaitTermination()
        seen.append((sum(p["numInputRows"] for p in q.recentProgress), part.count()))
    assert all(read == new for read, new in seen)
    got = spark.read.parquet(f"{base}/donors")
    want = T.donors_with_cells(spark, SF)
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0


def test_governed_sql_is_the_governed_frame(spark):
    governed.register_governed_views(spark, SF)
    donors = T.donor_table(spark, SF)
    try:
        for role in ("", governance.INTERN_ROLE, "ACCOUNTADMIN", "DATASCI", "ACADEMIC_ADVISOR_MGR_ROLE", "it's"):
            governed.declare_role(spark, role)
            view = spark.sql(f"SELECT * FROM {governed.DONORS_VIEW}")
            want = governance.governed(donors, role)
            assert view.dtypes == donors.dtypes
            assert view.exceptAll(want.select(view.columns)).count() == 0 and view.count() == want.count()
        governed.declare_role(spark, governance.INTERN_ROLE)
        plan = spark.sql("SELECT donor_id FROM governed_donors")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(donor_segment,Annual Donor)" in plan and "session" not in plan
        governed.declare_role(spark, "ACCOUNTADMIN")
        plan = spark.sql("SELECT donor_id, full_name FROM governed_donors")._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan and "PushedFilters: []" in plan and "masked" not in plan
        by_zip = spark.sql("SELECT sum(donor_count) FROM governed_by_zip_code").first()[0]
        assert by_zip == donors.count()
    finally:
        governed.declare_role(spark, "")


def test_united_sketches_read_no_donors_again(spark):
    d = spark.range(40_000).select((F.col("id") % 40).alias("a"), (F.col("id") % 4).alias("b"), (F.col("id") % 9_973).alias("v"))
    path = shared_dir(spark, "sketch")
    sketches.distinct_sketches(d, ["a", "b"], {"n": "v"}).write.parquet(path)
    stored = spark.read.parquet(path)
    for keys, want in ((["b"], {r["b"]: r["n"] for r in d.groupBy("b").agg(F.countDistinct("v").alias("n")).collect()}), ([], {None: 9_973})):
        out = sketches.estimates(sketches.united(stored, keys, ["n"]), ["n"])
        assert path.split("/")[-1] in out.inputFiles()[0]
        got = {r.asDict().get("b"): r["n"] for r in out.collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) <= 4 * sketches.relative_error() * want[k] for k in want)
    empty = sketches.estimates(sketches.distinct_sketches(d.where("false"), ["a"], {"n": "v"}), ["n"])
    assert empty.count() == 0


def test_published_versions(spark):
    path = shared_dir(spark, "published")
    with pytest.raises(FileNotFoundError):
        published.latest(spark, path)
    for i in range(4):
        published.publish(spark.range(i), path)
        assert published.latest(spark, path).count() == i
    assert len(published.versions(spark, path)) == published.KEPT_VERSIONS
    spark.range(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/v{9:020d}")     # not complete
    assert published.latest(spark, path).count() == 3


def test_declared_summary_conforms(spark, edge_donors):
    s = rollups.declared_summary(T.with_cells(edge_donors))
    assert schemas.conforms(s, schemas.DONOR_SUMMARY) == [] and s.columns == [f.name for f in schemas.DONOR_SUMMARY.fields]
    path = shared_dir(spark, "declared")
    published.publish(s, path)
    back = published.latest(spark, path)
    assert schemas.conforms(back, schemas.DONOR_SUMMARY) == []
    plain = {(r["zip_code"], r["hex_level_9"]): r for r in rollups.donor_summary(T.with_cells(edge_donors)).collect()}
    for r in back.collect():
        p = plain[r["zip_code"], r["hex_level_9"]]
        assert float(r["total_annual_donations"]) == p["total_annual_donations"] and r["donor_count"] == p["donor_count"]
        assert float(r["avg_annual_donation"]) == p["avg_annual_donation"] and r["created_date"] is not None
    huge = spark.createDataFrame([donor_row(1, annual="99999999.99", cumulative="9999999999.99")], DONOR_SCHEMA)
    one = rollups.declared_summary(T.with_cells(huge)).first()
    assert str(one["total_cumulative_donations"]) == "9999999999.99"


def test_dashboard_reads_the_stored_table_and_gives_its_rows_back(spark):
    with dashboard(spark, SF, zip_codes=("29601", "29605"), donation_range=(100.0, 9000.0)) as page:
        plan = page["kpi_row"]._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        assert page["filtered"].count() == page["kpi_row"].first()["total_donors"]
        assert page["filtered"].is_cached and page["hex_rollup"].count() > 0
    assert not page["filtered"].is_cached
