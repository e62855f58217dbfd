from decimal import Decimal

from pyspark.sql import functions as F

from hexgiving import session
from hexgiving.functions.measures import mean_half_up
from hexgiving.sinks import export


def test_active_session_is_left_alone(spark):
    before = spark.sparkContext.master, spark.conf.get("spark.sql.shuffle.partitions")
    assert session.get_spark() is spark
    assert (spark.sparkContext.master, spark.conf.get("spark.sql.shuffle.partitions")) == before


def test_nothing_of_the_cluster_is_fixed():
    fixed = {k for k in session.DEFAULTS if k.startswith(("spark.master", "spark.driver", "spark.executor"))}
    assert not fixed and "spark.sql.shuffle.partitions" not in session.DEFAULTS


def test_mean_of_the_largest_amounts_does_not_overflow(spark):
    top = F.lit("9999999999.99").cast("decimal(12,2)")
    row = spark.range(10_000_000).select(top.alias("c")).agg(mean_half_up(F.col("c"), 2), mean_half_up(F.col("c"), 4)).first()
    assert tuple(row) == (9999999999.99, 9999999999.99)


def test_mean_rounds_half_up(spark):
    df = spark.createDataFrame([(1, Decimal("0.01")), (1, Decimal("0.02")), (2, Decimal("-0.01")), (2, Decimal("-0.02")), (3, None)],
                               "g int, c decimal(12,2)")
    r = dict(tuple(x) for x in df.groupBy("g").agg(mean_half_up(F.col("c"), 2)).collect())
    assert r == {1: 0.02, 2: -0.02, 3: None}
    assert df.agg(mean_half_up(F.col("g"), 1, 0)).first()[0] == 1.8


def test_csv_keeps_quotes_commas_and_line_ends(spark, tmp_path):
    rows = [(1, 'Doe, "Jim"\nJr'), (2, " blanks "), (3, None), (4, "plain"), (5, 'a"b'), (6, "x\r\ny")]
    df = spark.createDataFrame(rows, "i int, name string")
    back = export.csv_roundtrip(df, f"{tmp_path}/c").collect()
    assert sorted(tuple(r) for r in back)[0] == rows[0] and {tuple(r) for r in back if r[0] != 6} == set(rows[:5])


def test_report_fields_are_quoted(spark):
    df = spark.createDataFrame([('Doe, "Jim"',), ("plain",), (None,), ("a\nb",)], "t string")
    assert [r[0] for r in df.select(export.quoted(F.col("t"))).collect()] == ['"Doe, ""Jim"""', "plain", "", '"a\nb"']


def test_append_leaves_no_catalog_entry(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    out = export.append_with_defaults(df, f"{tmp_path}/append's")
    assert [r["i"] for r in out.where("created_date IS NOT NULL").collect()] == [1]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_changed_source_files_get_a_new_donor_table(spark, tmp_path):
    from hexgiving.sources import tables as T
    for name in ("orders", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/sf/{name}.parquet")
    first = T.source_version(spark, f"{tmp_path}/sf")
    assert first == T.source_version(spark, f"{tmp_path}/sf/")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(10).write.mode("append").parquet(f"{tmp_path}/sf/orders.parquet")
    assert T.source_version(spark, f"{tmp_path}/sf") != first
