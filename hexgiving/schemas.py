"""Declared schemas of the data model (the typed, empty tables).

Lengths of the original character columns are not kept (Spark strings have
none); keys are not declared (parquet tables cannot enforce them), so key
uniqueness is a check (``operators.quality.key_uniqueness``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_KINDS = {"STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


def _table(columns: str) -> StructType:
    """``name TYPE`` pairs as a schema; no session is needed, unlike for DDL text."""
    def kind(name: str) -> T.DataType:
        digits = re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", name)
        return T.DecimalType(int(digits[1]), int(digits[2])) if digits else _KINDS[name]
    return StructType([T.StructField(c.split()[0], kind(c.split()[1])) for c in columns.split(", ")])


DONORS = _table(
    "donor_id STRING, first_name STRING, last_name STRING, full_name STRING, email STRING, "
    "address_id STRING, street_address STRING, city STRING, state STRING, zip_code STRING, "
    "latitude DOUBLE, longitude DOUBLE, graduation_year INT, degree_type STRING, major STRING, age INT, "
    "annual_donation_amount DECIMAL(10,2), cumulative_donation_amount DECIMAL(12,2), "
    "last_donation_date DATE, donor_segment STRING, hex_level_7 STRING, hex_level_8 STRING, "
    "hex_level_9 STRING, created_date TIMESTAMP")

VENUES = _table(
    "venue_id STRING, venue_name STRING, venue_type STRING, address_id STRING, street_address STRING, "
    "city STRING, state STRING, zip_code STRING, latitude DOUBLE, longitude DOUBLE, capacity INT, "
    "price_range STRING, rating DECIMAL(3,2), phone STRING, website STRING, description STRING, "
    "hex_level_7 STRING, hex_level_8 STRING, hex_level_9 STRING, created_date TIMESTAMP")

DONOR_SUMMARY = _table(
    "zip_code STRING, hex_level_7 STRING, hex_level_8 STRING, hex_level_9 STRING, donor_count INT, "
    "total_annual_donations DECIMAL(15,2), total_cumulative_donations DECIMAL(15,2), "
    "avg_annual_donation DECIMAL(10,2), avg_cumulative_donation DECIMAL(12,2), major_donors_count INT, "
    "created_date TIMESTAMP")

ADDRESSES = _table(
    "address_id STRING, city STRING, state STRING, zip STRING, latitude DOUBLE, longitude DOUBLE, "
    "street STRING, number STRING")


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty frame of a declared schema."""
    return spark.createDataFrame([], schema)


def declared(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the declared columns and types, in their order; columns it lacks are null, others are dropped.

    A value that does not fit its declared type is an error (ANSI casts).
    """
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def conforms(df: DataFrame, schema: StructType) -> list[str]:
    """Columns of ``df`` whose type differs from the declared one (columns
    the schema does not declare are reported too); empty when it conforms."""
    declared = {f.name: f.dataType for f in schema.fields}
    return [f.name for f in df.schema.fields if declared.get(f.name) != f.dataType]
