from pyspark.sql import functions as F

from hexgiving.operators import enrich as enr
from hexgiving.operators.numbering import number_rows, sample_n


def test_number_rows_is_1_to_n_and_partition_independent(spark):
    df = spark.range(0, 5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    a = {r.key: r.rn for r in number_rows(df.repartition(3), "key", 7, num_partitions=4).collect()}
    b = {r.key: r.rn for r in number_rows(df.repartition(11), "key", 7, num_partitions=9).collect()}
    assert sorted(a.values()) == list(range(1, 5001))
    assert a == b


def test_number_rows_spreads_and_windows_only_the_counts(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("key"))
    out = number_rows(df, "key", 1, num_partitions=4)
    per_task = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(per_task) == 4 and max(per_task) < 500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "Aggregate [_pid" in window       # what the one-task window reads: one row per partition


def test_sample_n_repeatable_and_exact_size(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("key"))
    s1 = {r.key for r in sample_n(df.repartition(5), 50, "key", "s").collect()}
    s2 = {r.key for r in sample_n(df.repartition(2), 50, "key", "s").collect()}
    assert len(s1) == 50 and s1 == s2


def test_street_address_nulls(spark):
    df = spark.createDataFrame([("Main", "5"), (None, "5"), ("Main", None), (None, None)], "s string, n string")
    out = [r[0] for r in df.select(enr.street_address(F.col("s"), F.col("n"))).collect()]
    assert out == ["Main 5", " 5", "Main ", " "]


def test_pick_is_zero_based_and_null_past_the_end(spark):
    df = spark.createDataFrame([(["a", "b"], 0), (["a", "b"], 1), (["a", "b"], 2), (None, 0)], "v array<string>, i int")
    assert [r[0] for r in df.select(enr.pick(F.col("v"), F.col("i"))).collect()] == ["a", "b", None, None]


def test_sample_n_is_the_head_of_the_numbering(spark):
    df = spark.range(0, 3000).select(F.col("id").cast("string").alias("key"))
    numbered = {r.key for r in number_rows(df, "key", "q").where("rn <= 700").collect()}
    assert {r.key for r in sample_n(df, 700, "key", "q").collect()} == numbered
    assert sample_n(df, 5000, "key", "q").count() == 3000 and sample_n(df.where("key = ''"), 5, "key").count() == 0


def test_giving_bands(spark):
    df = spark.createDataFrame([(1999,), (2000,), (2009,), (2010,), (2019,), (2020,), (1990,), (None,)], "y int").select(
        "y", F.lit("100.00").cast("decimal(10,2)").alias("a"))
    r = df.select(enr.giving_band(F.col("y")), enr.grown_gift(F.col("a"), F.col("y")).cast("double")).collect()
    assert [tuple(x) for x in r] == [(25, 100.0), (15, 127.0), (15, 100.0), (5, 145.0), (5, 100.0), (0, 100.0), (25, 118.0), (None, 100.0)]


def test_donor_ids_independent_of_partitioning(spark):
    from hexgiving.sources import tables as T
    addr = T.addresses(spark, "/root/testdata/sf0.001")
    a, b = ({r.address_id: r.donor_id for r in enr.donor_enrich(addr.repartition(n)).collect()} for n in (1, 7))
    assert a == b and sorted(a.values())[0] == "DONOR_00001" and len(set(a.values())) == addr.count()


def test_address_pool_quotas_bind_exactly(spark):
    from hexgiving.sources import tables as T
    addr = T.addresses(spark, "/root/testdata/sf0.01")
    pool = enr.address_pool(addr, ["29607", "29610"], ["29601", "29602", "29603"], target_n=5, other_n=3)
    rows = pool.collect()
    assert sum(r.address_type == "TARGET" for r in rows) == 5
    assert sum(r.address_type == "OTHER" for r in rows) == 3
    assert all(r.state == "SC" and r.latitude is not None for r in rows)
    again = {r.address_id for r in enr.address_pool(addr.repartition(5), ["29607", "29610"],
                                                    ["29601", "29602", "29603"], 5, 3).collect()}
    assert again == {r.address_id for r in rows}
