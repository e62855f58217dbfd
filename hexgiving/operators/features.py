"""Map-ready feature rows, layers, venue cards and display tables.

Row-by-row dictionary building is replaced by ``select`` expressions: casts,
``coalesce`` for typed defaults, ``CASE`` for the segment colour lookup and
``format_number`` for currency text. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexgiving.operators.filters import existing_columns, valid_points
from hexgiving.sources.tables import SEGMENT_ANNUAL, SEGMENT_MAJOR, SEGMENT_MID

ANNUAL = "annual_donation_amount"
CUMULATIVE = "cumulative_donation_amount"

# Segment colours (RGBA) of the point map, the grey default,
# the venue colour, and the hex colours of the fallback chart.
SEGMENT_RGBA = {SEGMENT_MAJOR: (255, 0, 0, 180), SEGMENT_MID: (255, 140, 0, 180),
                SEGMENT_ANNUAL: (0, 166, 81, 180)}
DEFAULT_RGBA = (128, 128, 128, 180)
VENUE_RGBA = (128, 0, 128, 255)
SEGMENT_HEX = {SEGMENT_MAJOR: "#ff0000", SEGMENT_MID: "#ff8c00", SEGMENT_ANNUAL: "#00a651"}
VENUE_ICON = "\U0001F3DB\uFE0F "   # classical building emoji + space


def currency(c: Column) -> Column:
    """``$1,234``: thousands separators, no decimals, ties to even."""
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 0))


def segment_colour(seg: Column, channel: int, default: tuple | None = DEFAULT_RGBA) -> Column:
    """One RGBA channel of the segment colour (lookup as ``CASE``)."""
    expr = None
    for name, rgba in SEGMENT_RGBA.items():
        expr = (F.when(seg == name, F.lit(rgba[channel])) if expr is None
                else expr.when(seg == name, F.lit(rgba[channel])))
    return expr.otherwise(F.lit(default[channel]) if default else F.lit(None).cast("int"))


def segment_hex(seg: Column) -> Column:
    """Fallback-chart colour; null for an unknown segment."""
    expr = None
    for name, hx in SEGMENT_HEX.items():
        expr = F.when(seg == name, F.lit(hx)) if expr is None else expr.when(seg == name, F.lit(hx))
    return expr


def point_size(annual: Column, lo: float = 3.0, hi: float = 20.0) -> Column:
    """Marker size ``clip(annual / 500, lo, hi)``."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), annual.cast("double") / F.lit(500.0)))


def donor_features(donors: DataFrame) -> DataFrame:
    """Point-map donor features (rows with both coordinates only)."""
    seg = F.col("donor_segment")
    return valid_points(donors).select(
        F.col("donor_id"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("latitude").cast("double").alias("latitude"),
        F.coalesce(F.col("full_name"), F.lit("None")).alias("full_name"),
        F.coalesce(seg, F.lit("None")).alias("donor_segment"),
        F.col(ANNUAL).cast("double").alias("annual_donation_amount"),
        F.col(CUMULATIVE).cast("double").alias("cumulative_donation_amount"),
        F.coalesce(F.col("zip_code"), F.lit("None")).alias("zip_code"),
        F.coalesce(F.col("graduation_year"), F.lit(2000)).cast("int").alias("graduation_year"),
        *[segment_colour(seg, i).alias(ch) for i, ch in enumerate(("red", "green", "blue", "alpha"))],
        currency(F.col(ANNUAL)).alias("annual_formatted"),
        currency(F.col(CUMULATIVE)).alias("cumulative_formatted"))


def venue_features(venues: DataFrame) -> DataFrame:
    """Point-map venue features, shaped into the donor tooltip fields."""
    cap, rating = F.col("capacity"), F.col("rating")
    return valid_points(venues).select(
        F.col("venue_id"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("venue_name"), F.col("venue_type"),
        F.coalesce(cap, F.lit(0)).cast("int").alias("capacity"),
        F.col("price_range"),
        F.coalesce(rating.cast("double"), F.lit(0.0)).alias("rating"),
        *[F.lit(v).alias(ch) for v, ch in zip(VENUE_RGBA, ("red", "green", "blue", "alpha"))],
        F.concat(F.lit(VENUE_ICON), F.col("venue_name")).alias("full_name"),
        F.concat(F.lit("Event Venue - "), F.col("venue_type")).alias("donor_segment"),
        F.concat(F.lit("Capacity: "), F.coalesce(cap.cast("string"), F.lit("N/A"))).alias("annual_formatted"),
        F.concat(F.lit("Rating: "), F.coalesce(rating.cast("double").cast("string"), F.lit("N/A")),
                 F.lit("/5")).alias("cumulative_formatted"),
        F.col("price_range").alias("zip_code"),
        F.lit("Venue").alias("graduation_year"))


LAYER_COLUMNS = ("layer", "feature_id", "longitude", "latitude", "full_name", "donor_segment",
                 "annual_formatted", "cumulative_formatted", "zip_code", "graduation_year",
                 "red", "green", "blue", "alpha")


def map_layers(donors: DataFrame, venues: DataFrame | None = None) -> DataFrame:
    """Donor and venue features as two layers of one tooltip schema."""
    d = donor_features(donors).select(
        F.lit("donors").alias("layer"), F.col("donor_id").alias("feature_id"), "longitude", "latitude",
        "full_name", "donor_segment", "annual_formatted", "cumulative_formatted", "zip_code",
        F.col("graduation_year").cast("string").alias("graduation_year"), "red", "green", "blue", "alpha")
    if venues is None:
        return d
    v = venue_features(venues).select(
        F.lit("venues").alias("layer"), F.col("venue_id").alias("feature_id"), *LAYER_COLUMNS[2:])
    return d.unionByName(v)


def venue_cards(venues: DataFrame) -> DataFrame:
    """Venue card text: title, capacity, rating over 5, price, phone, address lines, description, website if set.

    A null field shows as ``None``; a column that the table lacks gives no
    line (without city and state the address line is the zip code alone).
    """
    cols = set(venues.columns)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), shown(c))
    out = [F.col("venue_id"), F.concat_ws(" - ", F.col("venue_name"), F.col("venue_type")).alias("title"),
           shown("capacity").alias("capacity_text"), F.concat(shown("rating"), F.lit("/5.0")).alias("rating_text"),
           line("Price Range", "price_range").alias("price_text")]
    for label, c in (("Phone", "phone"), ("Address", "street_address"), ("Description", "description")):
        if c in cols:
            out.append(line(label, c).alias(f"{c}_text"))
    if {"city", "state", "zip_code"} <= cols:
        out.append(F.concat(shown("city"), F.lit(", "), shown("state"), F.lit(" "), shown("zip_code")).alias("address_line"))
    elif "zip_code" in cols:
        out.append(shown("zip_code").alias("address_line"))
    if "website" in cols:
        site = F.col("website")
        out.append(F.when(site.isNotNull() & (site != ""), F.concat(F.lit("Website: "), site)).alias("website_text"))
    return venues.select(*out)


DISPLAY_COLUMNS = ("full_name", "zip_code", "graduation_year", "degree", ANNUAL, CUMULATIVE,
                   "donor_segment", "age", "city", "state")
DISPLAY_NAMES = {"full_name": "Name", "zip_code": "Zip", "graduation_year": "Grad Year",
                 "degree": "Degree", ANNUAL: "Annual Donation", CUMULATIVE: "Total Lifetime",
                 "donor_segment": "Segment", "age": "Age", "city": "City", "state": "State"}


def donor_table(filtered: DataFrame, page_size: int | None = 50, order_by: str = "donor_id") -> DataFrame:
    """Display table: columns that exist, currency text, display headers.

    ``page_size`` rows in stored (``order_by``) order; ``None`` shows all.
    """
    cols = existing_columns(filtered, DISPLAY_COLUMNS)
    page = filtered.orderBy(order_by)
    if page_size is not None:
        page = page.limit(int(page_size))
    exprs = []
    for c in cols:
        e = currency(F.col(c)) if c in (ANNUAL, CUMULATIVE) else F.col(c)
        exprs.append(e.alias(DISPLAY_NAMES[c]))
    return page.select(*exprs)


DETAIL_COLUMNS = ("full_name", "zip_code", "graduation_year", "major", "degree_type", ANNUAL, CUMULATIVE,
                  "donor_segment")


def donor_details(filtered: DataFrame) -> DataFrame:
    """Detail list: up to 8 columns, the amounts as doubles (they are stored with 2 places)."""
    cols = existing_columns(filtered, DETAIL_COLUMNS)
    out = []
    for c in cols:
        if c in (ANNUAL, CUMULATIVE):
            out.append(F.col(c).cast("double").alias(c))
        else:
            out.append(F.col(c))
    return filtered.select("donor_id", *out)


def point_sizes(df: DataFrame) -> DataFrame:
    """Marker sizes of the two point charts (clip 3..20 and 5..25)."""
    return df.select("donor_id",
                     point_size(F.col(ANNUAL), 3.0, 20.0).alias("size_chart"),
                     point_size(F.col(ANNUAL), 5.0, 25.0).alias("size_image"),
                     segment_hex(F.col("donor_segment")).alias("colour"))
