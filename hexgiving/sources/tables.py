"""Readers for the input tables and the adapters that give them the donor,
venue and address shape.

The donor table is one row per order (orders joined to customer); venues are
one row per supplier; addresses one row per customer joined to nation. The
derivations are fixed arithmetic on the keys, so the same rows can be built
by any SQL engine (see ``hexgiving.plans.oracle``).

Scale notes
-----------
* Every reader selects only the columns it needs, so the parquet scan reads
  just those (``ReadSchema`` in the plan) and filters applied later are pushed
  into the scan by Catalyst.
* ``orders`` ⋈ ``customer`` is a plain equi-join: Spark broadcasts
  ``customer`` only while its measured size is under
  ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides
  on the customer key; AQE splits a customer that owns a third of all orders
  (skew join) instead of giving it one task.
* ``nation`` (25 rows) and the 4-row venue-type lookup are bounded by
  definition; only they carry explicit broadcast hints.
* ``donor_table`` computes the donor table once (per session, or per source
  at ``hexgiving.donor_table_path``) so queries scan stored columns instead
  of re-running the join.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgiving.functions import hexgrid
from hexgiving.functions.hexgrid import GRIDS

# Fixed values of the adapter (they must be equal on every engine).
ZIP_BASE = 29600          # zip code = ZIP_BASE + nation key
AS_OF_YEAR = 2024         # "now" of the age / years-out arithmetic
GRAD_AGE = 22             # age at graduation
FIRST_YEAR = 1990         # graduation years run FIRST_YEAR .. FIRST_YEAR + 34
YEAR_SPAN = 35
GIFT_RATE = Decimal("0.05")   # annual gift = 5 % of the order total
MAJOR_DONOR_MIN = 10000       # segment thresholds on the annual gift
MID_LEVEL_MIN = 1000
SEGMENT_MAJOR = "Major Donor"
SEGMENT_MID = "Mid-Level Donor"
SEGMENT_ANNUAL = "Annual Donor"
SEGMENTS = (SEGMENT_MAJOR, SEGMENT_MID, SEGMENT_ANNUAL)
VENUE_TYPES = ("Hotel", "Restaurant", "Golf Club", "Museum")

# Bounding box the synthetic coordinates are spread over.
LAT0, LON0, SPAN = 34.6, -82.6, 0.5


_PLANS: dict[tuple, DataFrame] = {}


def memo(fn):
    """Reuse the adapter's plan object per (session, folder).

    The plan is kept, which saves rebuilding the same projections for every
    query of a session; for ``donor_table`` that plan reads the written files.
    """
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (fn.__name__, id(spark), spark.sparkContext.applicationId, sf_dir)
        df = _PLANS.get(key)
        if df is None:
            df = _PLANS[key] = fn(spark, sf_dir)
        return df
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; parquet, so projections and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spread(key: Column, mult: int, modulus: int) -> Column:
    """Deterministic position in [0, 1) from an integer key."""
    return ((key * F.lit(mult)) % F.lit(modulus)).cast("double") / F.lit(float(modulus))


def segment_of(annual: Column) -> Column:
    """Donor segment from the annual gift (thresholds are inclusive)."""
    return (F.when(annual >= MAJOR_DONOR_MIN, F.lit(SEGMENT_MAJOR))
            .when(annual >= MID_LEVEL_MIN, F.lit(SEGMENT_MID))
            .otherwise(F.lit(SEGMENT_ANNUAL)))


@memo
def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor rows: one per order, giving derived from the order total."""
    return donor_rows(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"))


def donor_rows(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Donor rows of the given orders (a table or a stream of them) and customers."""
    orders = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("o_orderkey")
    year = (F.lit(FIRST_YEAR) + k % YEAR_SPAN).cast("int")
    annual = (F.col("o_totalprice").cast("decimal(12,2)")
              * F.lit(GIFT_RATE).cast("decimal(4,2)")).cast("decimal(10,2)")
    years_out = F.greatest(F.lit(1), F.lit(AS_OF_YEAR) - year).cast("decimal(4,0)")
    base = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(k.alias("k"), "c_name", "c_nationkey", "c_mktsegment",
                    F.col("o_orderdate").cast("date").alias("last_gift_date"),
                    year.alias("graduation_year"), annual.alias("annual")))
    return base.select(
        F.concat(F.lit("DONOR_"), F.format_string("%09d", F.col("k"))).alias("donor_id"),
        F.col("c_name").alias("full_name"),
        (F.lit(ZIP_BASE) + F.col("c_nationkey")).cast("string").alias("zip_code"),
        F.when(F.col("k") % 97 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(LAT0) + _spread(F.col("k"), 7919, 100003) * F.lit(SPAN))
         .alias("latitude"),
        F.when(F.col("k") % 101 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(LON0) + _spread(F.col("k"), 104729, 100019) * F.lit(SPAN))
         .alias("longitude"),
        "graduation_year",
        F.when(F.col("k") % 89 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("major"),
        (F.lit(AS_OF_YEAR) - F.col("graduation_year") + F.lit(GRAD_AGE)).alias("age"),
        F.col("annual").alias("annual_donation_amount"),
        (F.col("annual") * F.greatest(F.lit(1), F.lit(AS_OF_YEAR) - F.col("graduation_year"))
         .cast("decimal(4,0)")).cast("decimal(12,2)").alias("cumulative_donation_amount"),
        F.col("last_gift_date").alias("last_donation_date"),
        segment_of(F.col("annual")).alias("donor_segment"),
    )


def with_cells(df: DataFrame, resolutions=(7, 8, 9), lat: str = "latitude",
               lon: str = "longitude", prefix: str = "hex_level_") -> DataFrame:
    """Add the stored cell columns (computed once, read by every hex rollup)."""
    return hexgrid.with_cells(df, {f"{prefix}{r}": GRIDS[r] for r in resolutions}, lat, lon)


@memo
def donors_with_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donors plus ``hex_level_7/8/9``: the full donor table of the data model."""
    return with_cells(donors(spark, sf_dir))


MATERIALIZE_SETTING = "hexgiving.materialize_donors"


PATH_SETTING = "hexgiving.donor_table_path"


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a completed parquet write (``_SUCCESS`` marker) is at ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(marker.getFileSystem(conf).exists(marker))


ADAPTER_VERSION = 2     # raise when the donor rows' derivation changes


def source_version(spark: SparkSession, sf_dir: str) -> str:
    """Hash of the adapter version and of the source files' paths, sizes and times (file contents are not read)."""
    files = None
    for name in ("orders", "customer"):
        f = (spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{name}.parquet")
             .select("path", "length", "modificationTime"))
        files = f if files is None else files.unionByName(f)
    seen = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.sha1(f"{ADAPTER_VERSION}|{sf_dir.rstrip('/')}|{tuple(seen)}".encode()).hexdigest()[:12]


@memo
def donor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The donor table with its cell columns, computed once.

    Like the stored donor table of the data model: the join, derivations
    and cells are computed once, rebalanced on the zip, each file sorted by
    zip; every query reads that table in parallel: column pruning reads only what a query
    uses and filters are pushed into the parquet scan, skipping row groups
    by their statistics.

    Where it is written: under ``hexgiving.donor_table_path`` when set (one
    folder per ``source_version``, reused by every later session once its
    write has completed; changed source files or a changed derivation get a
    new one), else in the session's shared checkpoint folder. Within a
    session the first answer is kept per folder, so the load is one job that
    the first donor query starts.
    ``sinks.export.write_donor_table`` writes the zip-partitioned variant.
    Set ``hexgiving.materialize_donors=false`` to plan every query from the
    source tables instead.
    """
    if spark.conf.get(MATERIALIZE_SETTING, "true").lower() != "true":
        return donors_with_cells(spark, sf_dir)
    from hexgiving.sinks.export import write_clustered
    df = donors_with_cells(spark, sf_dir)
    base = spark.conf.get(PATH_SETTING, "") or ""
    if base:
        location = f"{base.rstrip('/')}/donors-{source_version(spark, sf_dir)}"
        if _written(spark, location):
            return spark.read.schema(df.schema).parquet(location)
    else:
        from hexgiving.session import shared_dir
        location = shared_dir(spark, "donor-table")
    return write_clustered(df, location, "zip_code")


def venue_type_lookup(spark: SparkSession) -> DataFrame:
    """Inline constant table (SQL ``VALUES`` with column aliases)."""
    return spark.sql(
        "SELECT * FROM VALUES (0, 'Hotel'), (1, 'Restaurant'), (2, 'Golf Club'), (3, 'Museum') "
        "AS t(type_code, venue_type)")


@memo
def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue rows: one per supplier.

    The venue type comes from the 4-row inline lookup; that side is
    bounded by construction, so it is broadcast.
    """
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    with_code = s.withColumn("type_code", (k % 4).cast("int"))
    typed = with_code.join(F.broadcast(venue_type_lookup(spark)), "type_code", "left")
    return typed.select(
        F.concat(F.lit("VENUE_"), F.format_string("%06d", k)).alias("venue_id"),
        F.col("s_name").alias("venue_name"),
        "venue_type",
        (F.lit(ZIP_BASE) + F.col("s_nationkey")).cast("string").alias("zip_code"),
        (F.lit(LAT0) + _spread(k, 7919, 10007) * F.lit(SPAN)).alias("latitude"),
        (F.lit(LON0) + _spread(k, 6287, 10009) * F.lit(SPAN)).alias("longitude"),
        F.when(k % 13 == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(80) + (k * 37) % 1421).cast("int")).alias("capacity"),
        F.repeat(F.lit("$"), (F.lit(2) + k % 3).cast("int")).alias("price_range"),
        F.when(k % 17 == 0, F.lit(None).cast("decimal(3,2)"))
         .otherwise(((F.lit(40) + k % 10).cast("decimal(3,0)") / F.lit(10)).cast("decimal(3,2)"))
         .alias("rating"),
    )


@memo
def venue_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues with all fields of a venue card: phone, street, city, state, description, website; some are null or empty.

    The city is the nation's name; a plain equi-join, broadcast by measured size.
    """
    n = read_table(spark, sf_dir, "nation").select((F.lit(ZIP_BASE) + F.col("n_nationkey")).cast("string").alias("zip_code"),
                                                   F.col("n_name").alias("city"))
    k = F.substring("venue_id", 7, 6).cast("int")
    full = venues(spark, sf_dir).join(n, "zip_code", "left")
    return full.withColumns({
        "state": F.when(k % 10 == 0, F.lit("NC")).otherwise(F.lit("SC")),
        "phone": F.when(k % 19 != 0, F.concat(F.lit("(864) 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))),
        "street_address": F.concat((k % 900 + 1).cast("string"), F.lit(" "), F.col("venue_type"), F.lit(" Street")),
        "description": F.when(k % 11 != 0, F.concat(F.col("venue_type"), F.lit(" in "), F.col("city"))),
        "website": F.when(k % 5 == 0, F.lit("")).when(k % 7 != 0, F.concat(F.lit("https://venues.example.com/"), k.cast("string")))})


@memo
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address rows: one per customer, city from the nation name."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("c_custkey")
    joined = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.concat(F.lit("ADDR_"), k.cast("string")).alias("address_id"),
        F.col("n_name").alias("city"),
        F.when(k % 10 == 0, F.lit("NC")).otherwise(F.lit("SC")).alias("state"),
        (F.lit(ZIP_BASE) + F.col("c_nationkey")).cast("string").alias("zip"),
        F.when(k % 23 == 0, F.lit(None).cast("double"))
         .otherwise(F.lit(LAT0) + _spread(k, 7919, 10007) * F.lit(SPAN)).alias("latitude"),
        (F.lit(LON0) + _spread(k, 6287, 10009) * F.lit(SPAN)).alias("longitude"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("street"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise((k % 900 + 1).cast("string")).alias("number"),
    )
