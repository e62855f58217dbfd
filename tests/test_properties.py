"""Property tests: exact measures against Python's Decimal, filter identities."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hexgiving.functions.measures import coord_mean, mean_half_up, money_sum
from hexgiving.operators import filters

cents = st.integers(min_value=0, max_value=5_900_000)


@settings(max_examples=20, deadline=None)
@given(st.lists(cents, min_size=1, max_size=60), st.sampled_from([1, 2, 4]))
def test_mean_half_up_equals_decimal_arithmetic(spark, values, parts):
    df = spark.createDataFrame([(Decimal(v) / 100,) for v in values], "v decimal(10,2)").repartition(parts)
    got = df.agg(mean_half_up(F.col("v"), 2).alias("m"), money_sum(F.col("v")).alias("s")).collect()[0]
    exact = (Decimal(sum(values)) / 100 / len(values)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    assert got.m == float(exact)
    assert got.s == float(Decimal(sum(values)) / 100)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-90, 90), min_size=1, max_size=50))
def test_coord_mean_independent_of_partitioning(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    a = df.repartition(1).agg(coord_mean(F.col("x"))).collect()[0][0]
    b = df.repartition(7).agg(coord_mean(F.col("x"))).collect()[0][0]
    assert a == b
    assert abs(a - sum(values) / len(values)) < 1e-8


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["29601", "29602", "29603", None]), min_size=0, max_size=30))
def test_empty_filters_are_identity(spark, zips):
    df = spark.createDataFrame([(i, z) for i, z in enumerate(zips)], "id int, zip_code string")
    assert filters.apply_filters(df, zip_codes=[], donor_segments=()).count() == len(zips)
    picked = filters.apply_filters(df, zip_codes=["29601"]).count()
    assert picked == sum(1 for z in zips if z == "29601")
