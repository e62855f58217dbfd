"""Hex-grid jobs: assign cells, roll up per cell, cell boundaries, colours.

The cell of a point is a pure ``Column`` expression (``functions.hexgrid``),
so assigning cells is a narrow projection. A rollup is one aggregation
shuffled on the cell id; a hot cell is absorbed by partial aggregation.
Boundaries are computed from the cell id on the rollup rows themselves, so
attaching the statistics to each polygon needs no join and no second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexgiving.functions.hexcells import with_parent
from hexgiving.functions.hexgrid import GRIDS, HexGrid, corner_rows, with_cell
from hexgiving.functions.measures import coord_mean, mean_half_up, money_sum, rounded
from hexgiving.operators.filters import valid_points
from hexgiving.session import checkpoint_root

ANNUAL = "annual_donation_amount"
CUMULATIVE = "cumulative_donation_amount"
POINT_COLUMNS = ("latitude", "longitude", ANNUAL, CUMULATIVE)


def grid_of(res_or_grid) -> HexGrid:
    return res_or_grid if isinstance(res_or_grid, HexGrid) else GRIDS[int(res_or_grid)]


def assign_cells(df: DataFrame, res, out: str = "hex_cell") -> DataFrame:
    """Add the cell id of each point at resolution ``res`` (null for null points)."""
    return with_cell(df, grid_of(res), out)


def hex_rollup(df: DataFrame, res) -> DataFrame:
    """Rollup with the cell computed from the points.

    Rows with a null coordinate or amount are dropped first, so the count is
    of complete rows. Centres are unrounded means. Unsorted (the result
    stays hash-partitioned by cell for boundary and colour steps); sort at
    the reader with ``rollups.by_total``.
    """
    cells = assign_cells(valid_points(df, POINT_COLUMNS), res)
    return (cells.groupBy("hex_cell")
            .agg(F.count(F.lit(1)).alias("donor_count"),
                 money_sum(F.col(ANNUAL)).alias("total_annual"),
                 mean_half_up(F.col(ANNUAL), 2).alias("avg_annual"),
                 money_sum(F.col(CUMULATIVE)).alias("total_cumulative"),
                 coord_mean(F.col("latitude")).alias("center_lat"),
                 coord_mean(F.col("longitude")).alias("center_lon")))


def group_cells(df: DataFrame, cell_col: str, *aggs) -> DataFrame:
    """Group by a cell column, null cell dropped, as ``hex_cell``.

    The null group is removed after aggregation with a HAVING-style test on
    an aggregate (``count(cell) > 0``). A plain ``where(cell IS NOT NULL)``
    before the grouping would be pushed by Catalyst through every projection
    that computes the cell and evaluated as one large inlined predicate per
    input row; the HAVING test cannot be pushed below the aggregation.
    """
    return (df.groupBy(F.col(cell_col).alias("hex_cell"))
            .agg(*aggs, F.count(cell_col).alias("_cells"))
            .where(F.col("_cells") > 0).drop("_cells"))


def hex_rollup_stored(df: DataFrame, cell_col: str = "hex_level_8") -> DataFrame:
    """Rollup from a stored cell column (any id scheme, H3 included).

    Null cells drop out; the count is of non-null amounts; every measure,
    the centre included, is rounded to 2 places.
    """
    return group_cells(df, cell_col,
                       money_sum(F.col(ANNUAL)).alias("total_annual"),
                       mean_half_up(F.col(ANNUAL), 2).alias("avg_annual"),
                       F.count(ANNUAL).alias("donor_count"),
                       money_sum(F.col(CUMULATIVE)).alias("total_cumulative"),
                       rounded(coord_mean(F.col("latitude")), 2).alias("center_lat"),
                       rounded(coord_mean(F.col("longitude")), 2).alias("center_lon"))


def hex_rollup_static(df: DataFrame, cell_col: str = "hex_level_8") -> DataFrame:
    """Rollup for the static map image: unrounded centre, sum, id count."""
    return group_cells(df, cell_col,
                       coord_mean(F.col("latitude")).alias("latitude"),
                       coord_mean(F.col("longitude")).alias("longitude"),
                       money_sum(F.col(ANNUAL)).alias("total_annual"),
                       F.count("donor_id").alias("donor_count"))


def with_parents(df: DataFrame, cell_col: str = "hex_level_9", levels: tuple[int, ...] = (8, 7), prefix: str = "parent_") -> DataFrame:
    """Add ``parent_<level>`` for each level, finest first: every cell has one parent a level, made of whole children."""
    child = cell_col
    for level in levels:
        df = with_parent(df, child, f"hn{level}", f"{prefix}{level}")
        child = f"{prefix}{level}"
    return df


def nested_rollup(df: DataFrame, cell_col: str = "hex_level_9", levels: tuple[int, ...] = (8, 7)) -> DataFrame:
    """Counts and totals of each cell, of its parents at each level, and of all cells: (level, hex_cell, parent_cell, ...).

    Donors are grouped once, by the finest cell; the hierarchy is a rollup of
    those sums, so its cost follows the cells. Children add up to their
    parent exactly. ``level`` 0 is the total; rows without a cell are in none.
    """
    finest = GRIDS[9].res if cell_col == "hex_level_9" else levels[0] + 1
    cells = group_cells(df, cell_col, F.count(F.lit(1)).alias("n"), F.sum(ANNUAL).alias("annual"), F.sum(CUMULATIVE).alias("cumulative"))
    path = [f"parent_{level}" for level in reversed(levels)] + ["hex_cell"]
    rolled = with_parents(cells, "hex_cell", levels).rollup(*path).agg(
        F.grouping_id().alias("gid"), F.sum("n").alias("donor_count"),
        F.coalesce(F.sum("annual").cast("double"), F.lit(0.0)).alias("total_annual"),
        F.coalesce(F.sum("cumulative").cast("double"), F.lit(0.0)).alias("total_cumulative"))
    level, parent = F.lit(0), F.lit(None).cast("string")
    for depth, number in enumerate((*reversed(levels), finest)):
        here = F.col("gid") == 2 ** (len(levels) - depth) - 1
        level = F.when(here, F.lit(number)).otherwise(level)
        parent = F.when(here & F.lit(depth > 0), F.col(path[depth - 1])).otherwise(parent)
    cell = F.coalesce(*reversed([F.col(c) for c in path]))
    return rolled.where("donor_count IS NOT NULL").select(
        level.alias("level"), cell.alias("hex_cell"), parent.alias("parent_cell"), "donor_count", "total_annual", "total_cumulative")


def report_top_hex(df: DataFrame, cell_col: str = "hex_level_8", k: int = 10) -> DataFrame:
    """Top k cells by total, every measure rounded to 4 places."""
    agg = group_cells(df, cell_col,
                      F.count(ANNUAL).alias("donor_count"),
                      money_sum(F.col(ANNUAL)).alias("total_annual"),
                      mean_half_up(F.col(ANNUAL), 4).alias("avg_annual"),
                      rounded(coord_mean(F.col("latitude")), 4).alias("center_lat"),
                      rounded(coord_mean(F.col("longitude")), 4).alias("center_lon"))
    return agg.orderBy(F.col("total_annual").desc(), "hex_cell").limit(k)


def hex_top(df: DataFrame, cell_col: str = "hex_level_8", k: int = 5) -> DataFrame:
    """Ad-hoc top k cells by donor count (ties: lowest cell id)."""
    agg = group_cells(df, cell_col,
                      F.count(F.lit(1)).alias("donor_count"),
                      money_sum(F.col(ANNUAL)).alias("total_annual"),
                      coord_mean(F.col("latitude")).alias("center_lat"),
                      coord_mean(F.col("longitude")).alias("center_lon"))
    return agg.orderBy(F.col("donor_count").desc(), "hex_cell").limit(k)


def cell_boundaries(cells: DataFrame, res, cell_col: str = "hex_cell", digits: int = 6) -> DataFrame:
    """One row per (cell, corner) plus the closed ring as WKT text.

    Every cell is handled (no 10- or 50-cell cap): corners are a pure
    function of the id. The WKT ring is a window over the cell's six corner
    rows (partitioned by cell, so a cell never spans tasks), listed as
    ``lon lat`` with the first corner repeated to close the ring.
    """
    rows = corner_rows(cells.select(F.col(cell_col).alias("hex_cell")), "hex_cell", grid_of(res), digits)
    fmt = f"%.{digits}f %.{digits}f"
    per_cell = Window.partitionBy("hex_cell").orderBy("corner").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    ring = rows.withColumn("_pts", F.collect_list(F.format_string(fmt, F.col("lon"), F.col("lat"))).over(per_cell))
    text = F.col("_pts")
    wkt = F.concat(F.lit("POLYGON(("), F.array_join(text, ", "), F.lit(", "), F.get(text, 0), F.lit("))"))
    return ring.select("hex_cell", "corner", "lat", "lon", wkt.alias("wkt"))


def parse_polygon(df: DataFrame, wkt_col: str = "wkt") -> DataFrame:
    """Parse ``POLYGON((lon lat, ...))`` text into a ring of (lat, lon).

    Bad pairs are skipped (``try_cast``), and only polygons with at least
    three points are kept.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(wkt_col), r"^POLYGON\(\(", ""), r"\)\)$", "")
    pairs = F.transform(F.split(body, ", "), lambda p: F.split(F.trim(p), " "))
    pts = F.transform(pairs, lambda a: F.struct(F.get(a, 1).try_cast("double").alias("lat"),
                                                F.get(a, 0).try_cast("double").alias("lon")))
    good = F.filter(pts, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return (df.where(F.col(wkt_col).contains("POLYGON"))
            .withColumn("ring", good).where(F.size("ring") >= 3))


def cell_boundary_stats(rollup: DataFrame, res, digits: int = 6) -> DataFrame:
    """Polygon corners with the statistics of their cell (inner: every
    rollup row has a cell, so none is lost; a null cell has no corners)."""
    rows = corner_rows(rollup, "hex_cell", grid_of(res), digits)
    return rows.select("hex_cell", "corner", "lat", "lon",
                       "donor_count", "total_annual", "avg_annual", "total_cumulative")


def hex_colours(rollup: DataFrame) -> DataFrame:
    """Colour ramp and opacity per cell, scaled by the largest total.

    The rollup (one row per cell, far smaller than its input) is
    checkpointed into the shared checkpoint folder first, so the maximum (a
    scalar subquery, referenced once) and the colours both read it instead
    of recomputing the aggregation from the source. No window over all cells
    in one partition is needed.
    """
    checkpoint_root(rollup.sparkSession)
    rollup = rollup.checkpoint(eager=True)
    with_max = rollup.withColumn("_max", rollup.select(F.max("total_annual")).scalar())
    mx, total = F.col("_max"), F.col("total_annual")
    n = F.when(mx > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / mx))).otherwise(F.lit(0.0))
    staged = with_max.withColumn("_n", n)
    n = F.col("_n")
    return staged.select(
        "hex_cell", "total_annual",
        F.floor(F.lit(255.0) * (F.lit(0.8) + F.lit(0.2) * n)).cast("int").alias("red"),
        F.floor(F.lit(255.0) * (F.lit(0.6) * (F.lit(1.0) - n))).cast("int").alias("green"),
        F.floor(F.lit(255.0) * (F.lit(0.2) * (F.lit(1.0) - n))).cast("int").alias("blue"),
        F.when(mx > 0, F.least(F.lit(0.8), F.greatest(F.lit(0.3), total / mx))).otherwise(F.lit(0.3)).alias("opacity"),
        F.format_number("total_annual", 0).alias("total_annual_formatted"),
        F.format_number("avg_annual", 0).alias("avg_annual_formatted"),
        F.format_number("total_cumulative", 0).alias("total_cumulative_formatted"))
