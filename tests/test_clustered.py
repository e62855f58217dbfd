"""Tables clustered by several columns: no row lost, fewer rows read for a filter on any of them."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from hexgiving.operators import filters
from hexgiving.sinks import clustered

BY = clustered.DONOR_CLUSTERING


def rows_read(df):
    """Rows that leave the Parquet scan, after row groups were skipped."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().execute().count()
    leaf = execution.executedPlan().collectLeaves().apply(0)
    plan = leaf.inputPlan() if "Adaptive" in leaf.nodeName() else leaf
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def people(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("D"), "id").alias("donor_id"),
        (F.lit(29600) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))).cast("string").alias("zip_code"),
        (F.lit(1990) + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(35))).cast("int").alias("graduation_year"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2_000_000)) / 100).cast("decimal(10,2)").alias("annual_donation_amount"))


def test_each_single_filter_reads_fewer_rows(spark, tmp_path):
    df = people(spark, 60_000)
    table = clustered.write_interleaved(df, str(tmp_path / "t"), files=64)
    assert table.count() == 60_000 and table.exceptAll(df).count() == 0
    for choice in (dict(zip_codes=["29603"]), dict(grad_years=(2000, 2001)), dict(donation_range=(15_000.0, 15_500.0))):
        picked = filters.apply_filters(table, **choice)
        assert picked.count() == filters.apply_filters(df, **choice).count() > 0
        assert rows_read(picked) < 45_000, choice
    both = filters.apply_filters(table, zip_codes=["29603"], grad_years=(2000, 2001), donation_range=(0.0, 4_000.0))
    assert rows_read(both) < 10_000


def test_key_follows_the_order_of_each_column(spark):
    df = people(spark, 5_000)
    for c in BY:
        key = clustered.interleaved_key(df, clustered.range_bounds(df, [c]))
        seen = df.select(c, key.alias("k")).groupBy("k").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).orderBy("k").collect()
        assert len(seen) > 20
        assert all(a["hi"] < b["lo"] for a, b in zip(seen, seen[1:], strict=False))


def test_nulls_ties_empty_tables_and_clashing_names(spark, tmp_path):
    schema = ("cluster_key_0 int, zip_code string, graduation_year int, annual_donation_amount decimal(10,2), day date")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", 2000, Decimal("1.00"), dt.date(2024, 1, 1)),
            (3, "é" * 50, 2000, Decimal("1.00"), None), (3, "é" * 50, 2000, Decimal("1.00"), None)]
    for name, given in (("some", rows), ("none", []), ("equal", rows[-1:] * 40)):
        df = spark.createDataFrame(given, schema)
        table = clustered.write_interleaved(df, str(tmp_path / name), [*BY, "day"], files=3)
        assert table.columns == df.columns
        assert sorted(map(repr, table.collect())) == sorted(map(repr, df.collect()))


def test_a_key_with_most_rows_goes_to_many_files(spark, tmp_path):
    df = people(spark, 8_000).withColumns({"zip_code": F.lit("29601"), "graduation_year": F.lit(2000),
                                           "annual_donation_amount": F.lit(1).cast("decimal(10,2)")})
    table = clustered.write_interleaved(df, str(tmp_path / "hot"), files=8)
    sizes = [r["count"] for r in table.groupBy(F.input_file_name().alias("f")).count().collect()]
    assert sum(sizes) == 8_000 and len(sizes) == 8 and max(sizes) < 2_000
