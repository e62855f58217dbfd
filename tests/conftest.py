import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from hexgiving.session import DEFAULTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[*]").appName("hexgiving-tests")
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    s = (builder.config("spark.sql.shuffle.partitions", "8")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hexgiving-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


DONOR_SCHEMA = ("donor_id string, full_name string, zip_code string, latitude double, longitude double, "
                "graduation_year int, major string, age int, annual_donation_amount decimal(10,2), "
                "cumulative_donation_amount decimal(12,2), last_donation_date date, donor_segment string")


def donor_row(i, zip_code="29601", lat=34.85, lon=-82.39, year=2000, major="Art", annual="500.00",
              cumulative="1000.00", segment=None, name=None):
    a = None if annual is None else Decimal(annual)
    if segment is None and a is not None:
        segment = "Major Donor" if a >= 10000 else "Mid-Level Donor" if a >= 1000 else "Annual Donor"
    return (f"D{i:03d}", name or f"Name {i}", zip_code, lat, lon, year, major,
            None if year is None else 2024 - year + 22, a,
            None if cumulative is None else Decimal(cumulative), dt.date(2024, 1, 1), segment)


@pytest.fixture
def edge_donors(spark):
    """Hand-made donors with the edge rows: threshold amounts, nulls, ties."""
    rows = [
        donor_row(1, annual="999.99"),
        donor_row(2, annual="1000.00"),
        donor_row(3, annual="9999.99", zip_code="29602"),
        donor_row(4, annual="10000.00", zip_code="29602"),
        donor_row(5, zip_code=None, annual="10.00"),
        donor_row(6, major=None, annual="20.00"),
        donor_row(7, lat=None, annual="30.00"),
        donor_row(8, lon=None, annual="40.00"),
        donor_row(9, lat=None, lon=None, annual="50.00"),
        donor_row(10, year=1990, annual="0.01", zip_code="29603"),
        donor_row(11, year=2024, annual="0.02", zip_code="29603"),
    ]
    return spark.createDataFrame(rows, DONOR_SCHEMA)
