"""Planar hexagonal grid as plain ``Column`` arithmetic.

Spark has no hex-cell functions, so cells are computed with built-in
arithmetic that stays inside whole-stage codegen: project (lat, lon) onto a
local equirectangular plane, convert to pointy-top axial coordinates in units
of the cell edge, and round in cube coordinates.

These are *not* H3 ids. Limits: area is distorted away from the reference
latitude ``phi0``; longitudes do not wrap at ±180°; finer cells do not nest
in coarser ones. Every rollup also accepts an existing cell column, so data
that already carries H3 ids works unchanged.

Every constant is computed once in Python and enters the plan as a double
literal, so the arithmetic is a fixed sequence of IEEE operations and gives
the same bits on any engine that evaluates it in the same order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean earth radius (km), reference latitude and the cell
# edge length (km) per resolution.
EARTH_RADIUS_KM = 6371.0088
PHI0_DEG = 34.85
EDGE_KM = {7: 1.406475763, 8: 0.531414010, 9: 0.200786148}

SQRT3 = math.sqrt(3.0)
C_Q = SQRT3 / 3.0        # axial q from x
C_THIRD = 1.0 / 3.0      # axial q from y
C_R = 2.0 / 3.0          # axial r from y
HALF_SQRT3 = SQRT3 / 2.0
# Corner offsets in edge units, counter-clockwise from the lower right.
CORNERS = ((HALF_SQRT3, -0.5), (HALF_SQRT3, 0.5), (0.0, 1.0),
           (-HALF_SQRT3, 0.5), (-HALF_SQRT3, -0.5), (0.0, -1.0))


@dataclass(frozen=True)
class HexGrid:
    res: int
    edge_km: float
    phi0: float = PHI0_DEG

    @property
    def kx(self) -> float:
        """Edge units per degree of longitude at ``phi0``."""
        return EARTH_RADIUS_KM * math.cos(math.radians(self.phi0)) * math.pi / 180.0 / self.edge_km

    @property
    def ky(self) -> float:
        """Edge units per degree of latitude."""
        return EARTH_RADIUS_KM * math.pi / 180.0 / self.edge_km


GRIDS = {r: HexGrid(r, e) for r, e in EDGE_KM.items()}


def _lit(v: float) -> Column:
    return F.lit(float(v))


def with_cells(df: DataFrame, grids: dict[str, HexGrid], lat: str = "latitude",
               lon: str = "longitude") -> DataFrame:
    """Add the cell id ``hx<res>:<q>:<r>`` of each point, one column per
    ``{out_name: grid}`` entry.

    Three projections for any number of grids: axial coordinates, then the
    rounded coordinates with their errors, then the id. Keeping the stages
    as projected columns means Catalyst keeps one copy of each
    sub-expression instead of inlining the arithmetic wherever it is used.
    Null lat or lon gives a null id.
    """
    stage1, stage2, stage3, tmp = {}, {}, {}, []
    for out, grid in grids.items():
        t = f"_{out}_"
        xe = F.col(lon) * _lit(grid.kx)
        ye = F.col(lat) * _lit(grid.ky)
        q = xe * _lit(C_Q) - ye * _lit(C_THIRD)
        r = ye * _lit(C_R)
        stage1.update({t + "q": q, t + "r": r})
        qc, rc = F.col(t + "q"), F.col(t + "r")
        sc = -qc - rc
        rq, rr, rs = F.floor(qc + _lit(0.5)), F.floor(rc + _lit(0.5)), F.floor(sc + _lit(0.5))
        stage2.update({t + "rq": rq, t + "rr": rr, t + "rs": rs, t + "dq": F.abs(rq - qc),
                       t + "dr": F.abs(rr - rc), t + "ds": F.abs(rs - sc)})
        rq, rr, rs = F.col(t + "rq"), F.col(t + "rr"), F.col(t + "rs")
        dq, dr, ds = F.col(t + "dq"), F.col(t + "dr"), F.col(t + "ds")
        q_wins = (dq > dr) & (dq > ds)
        q_out = F.when(q_wins, -rr - rs).otherwise(rq).cast("long")
        r_out = F.when(q_wins, rr).when(dr > ds, -rq - rs).otherwise(rr).cast("long")
        stage3[out] = F.concat(F.lit(f"hx{grid.res}:"), q_out.cast("string"), F.lit(":"), r_out.cast("string"))
        tmp += [t + x for x in ("q", "r", "rq", "rr", "rs", "dq", "dr", "ds")]
    return df.withColumns(stage1).withColumns(stage2).withColumns(stage3).drop(*tmp)


def with_cell(df: DataFrame, grid: HexGrid, out: str, lat: str = "latitude",
              lon: str = "longitude") -> DataFrame:
    """Add one cell id column (see ``with_cells``)."""
    return with_cells(df, {out: grid}, lat, lon)


def cell_qr(cell: Column) -> tuple[Column, Column]:
    """Parse (q, r) back out of a cell id (``try_cast``: malformed → null)."""
    parts = F.split(cell, ":")
    return (F.get(parts, 1).try_cast("long"), F.get(parts, 2).try_cast("long"))


def round_half_up(x: Column, digits: int) -> Column:
    """``floor(x·10^d + 0.5) / 10^d``: half-up on the double, engine-neutral."""
    scale = float(10 ** digits)
    return F.floor(x * _lit(scale) + _lit(0.5)) / _lit(scale)


def with_centre(df: DataFrame, cell_col: str, grid: HexGrid, lat_out: str = "centre_lat",
                lon_out: str = "centre_lon") -> DataFrame:
    """Add the (unrounded) centre of each cell."""
    q, r = cell_qr(F.col(cell_col))
    df = df.withColumns({"_cq": q, "_cr": r})
    xe = _lit(SQRT3) * (F.col("_cq") + F.col("_cr") * _lit(0.5))
    ye = _lit(1.5) * F.col("_cr")
    return df.withColumns({lat_out: ye / _lit(grid.ky), lon_out: xe / _lit(grid.kx)}).drop("_cq", "_cr")


def corner_rows(df: DataFrame, cell_col: str, grid: HexGrid, digits: int = 6) -> DataFrame:
    """One row per (cell, corner) with ``corner``, ``lat``, ``lon`` rounded to
    ``digits`` places.

    The six corner offsets are a literal array exploded first, so each row
    computes one corner with a small expression (rather than one expression
    holding all six corners, which Catalyst would copy into every use).
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("corner"), _lit(dx).alias("dx"), _lit(dy).alias("dy"))
                        for i, (dx, dy) in enumerate(CORNERS)])
    q, r = cell_qr(F.col(cell_col))
    df = df.withColumns({"_cq": q, "_cr": r})
    df = df.withColumns({"_xe": _lit(SQRT3) * (F.col("_cq") + F.col("_cr") * _lit(0.5)),
                         "_ye": _lit(1.5) * F.col("_cr")})
    df = df.select("*", F.explode(offsets).alias("_o"))
    return df.withColumns({
        "corner": F.col("_o.corner"),
        "lat": round_half_up((F.col("_ye") + F.col("_o.dy")) / _lit(grid.ky), digits),
        "lon": round_half_up((F.col("_xe") + F.col("_o.dx")) / _lit(grid.kx), digits),
    }).drop("_cq", "_cr", "_xe", "_ye", "_o")
