"""Composable row filters (predicates stay ``Column`` expressions so Catalyst
pushes them into the parquet scan and prunes what it can).

Two empty-list rules exist side by side, as in the dashboard being rebuilt:
the donor filter treats an empty list as "no filter" while the venue filter
treats it as "no rows".
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def decimal_bounds(lo: float, hi: float, scale: int) -> tuple[Decimal, Decimal]:
    """Decimal thresholds at ``scale`` that select exactly the values whose
    double lies in [lo, hi].

    A decimal value k·10^-scale compares with a double bound through its
    correctly rounded double, which grows with k; so the rows kept are
    k ≥ k_lo and k ≤ k_hi, found here exactly. Comparing the column with
    decimal literals keeps it uncast, so the predicate reaches the parquet
    scan.
    """
    unit = Decimal(1).scaleb(-scale)

    def as_double(k: int) -> float:
        return float(Decimal(k) * unit)

    k_lo = math.ceil(lo * 10 ** scale)
    while as_double(k_lo - 1) >= lo:
        k_lo -= 1
    while as_double(k_lo) < lo:
        k_lo += 1
    k_hi = math.floor(hi * 10 ** scale)
    while as_double(k_hi + 1) <= hi:
        k_hi += 1
    while as_double(k_hi) > hi:
        k_hi -= 1
    return Decimal(k_lo) * unit, Decimal(k_hi) * unit


def donor_predicate(zip_codes: Sequence[str] | None = None,
                    grad_years: tuple[int, int] | None = None,
                    donation_range: tuple[float, float] | None = None,
                    donor_segments: Sequence[str] | None = None,
                    amount_scale: int | None = None) -> Column:
    """AND of the optional donor filters; empty or missing means no filter.

    Ranges are closed on both ends and a null value never passes them. With
    ``amount_scale`` (the decimal scale of the amount column) the amount
    bounds become exact decimal thresholds (``decimal_bounds``).
    """
    pred = F.lit(True)
    if zip_codes:
        pred = pred & F.col("zip_code").isin(list(zip_codes))
    if grad_years:
        pred = pred & F.col("graduation_year").between(int(grad_years[0]), int(grad_years[1]))
    if donation_range:
        lo, hi = donation_range
        if amount_scale is not None and math.isfinite(lo) and math.isfinite(hi):
            lo, hi = decimal_bounds(float(lo), float(hi), amount_scale)
        pred = pred & F.col("annual_donation_amount").between(F.lit(lo), F.lit(hi))
    if donor_segments:
        pred = pred & F.col("donor_segment").isin(list(donor_segments))
    return pred


def apply_filters(df: DataFrame, zip_codes=None, grad_years=None, donation_range=None,
                  donor_segments=None) -> DataFrame:
    """Donor filters: zips, closed year range, closed amount range, segments."""
    dtype = df.schema["annual_donation_amount"].dataType if "annual_donation_amount" in df.columns else None
    scale = dtype.scale if isinstance(dtype, DecimalType) else None
    return df.filter(donor_predicate(zip_codes, grad_years, donation_range, donor_segments, scale))


def valid_points(df: DataFrame, columns: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """Drop rows with a null in any of ``columns``."""
    return df.dropna(subset=list(columns))


def venue_filter(venues: DataFrame, venue_types: Sequence[str], price_ranges: Sequence[str],
                 min_capacity: int = 0, min_rating: float | None = None) -> DataFrame:
    """Venue filter: type in list, price in list, capacity ≥ minimum, rating ≥ minimum if one is given.

    An empty list selects no rows; a venue with unknown capacity never
    passes the capacity test, an unrated one no rating test.
    """
    out = venues.filter(F.col("venue_type").isin(list(venue_types))
                        & F.col("price_range").isin(list(price_ranges))
                        & (F.col("capacity") >= F.lit(int(min_capacity))))
    return out if min_rating is None else out.filter(F.col("rating") >= F.lit(Decimal(str(min_rating))))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail early when a required column is missing; returns ``df`` unchanged."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The subset of ``wanted`` that ``df`` has, in the order asked for."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
