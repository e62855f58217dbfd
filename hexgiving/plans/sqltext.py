"""SQL text of the adapters and measures, for the independent value check.

The check runs each query on a second engine (DuckDB) from SQL text. These
helpers write that text with the same constants and the same order of
arithmetic as the ``Column`` code, so results can be compared bit for bit.
They are used only by the checks, never by the Spark jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from hexgiving.functions import hexgrid as hg
from hexgiving.functions.measures import NANO


def d(x: float) -> str:
    """Double literal text (exponent form, so no engine reads a decimal)."""
    r = repr(float(x))
    return r if ("e" in r or "inf" in r or "nan" in r) else r + "e0"


def q(s: str) -> str:
    """Quoted string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


DONORS = """
SELECT 'DONOR_' || printf('%09d', k) AS donor_id,
       c_name AS full_name,
       CAST(29600 + c_nationkey AS VARCHAR) AS zip_code,
       CASE WHEN k % 97 = 0 THEN NULL ELSE 34.6e0 + CAST((k * 7919) % 100003 AS DOUBLE) / 100003e0 * 0.5e0 END AS latitude,
       CASE WHEN k % 101 = 0 THEN NULL ELSE -82.6e0 + CAST((k * 104729) % 100019 AS DOUBLE) / 100019e0 * 0.5e0 END AS longitude,
       graduation_year,
       CASE WHEN k % 89 = 0 THEN NULL ELSE c_mktsegment END AS major,
       2024 - graduation_year + 22 AS age,
       annual AS annual_donation_amount,
       CAST(annual * CAST(greatest(1, 2024 - graduation_year) AS DECIMAL(4,0)) AS DECIMAL(12,2)) AS cumulative_donation_amount,
       last_gift_date AS last_donation_date,
       CASE WHEN annual >= 10000 THEN 'Major Donor' WHEN annual >= 1000 THEN 'Mid-Level Donor' ELSE 'Annual Donor' END AS donor_segment
FROM (
  SELECT o.o_orderkey AS k, c.c_name, c.c_nationkey, c.c_mktsegment, CAST(o.o_orderdate AS DATE) AS last_gift_date,
         CAST(1990 + o.o_orderkey % 35 AS INT) AS graduation_year,
         CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) * CAST(0.05 AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS annual
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) b
"""

VENUES = """
SELECT 'VENUE_' || printf('%06d', s_suppkey) AS venue_id, s_name AS venue_name,
       t.venue_type,
       CAST(29600 + s_nationkey AS VARCHAR) AS zip_code,
       34.6e0 + CAST((s_suppkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.5e0 AS latitude,
       -82.6e0 + CAST((s_suppkey * 6287) % 10009 AS DOUBLE) / 10009e0 * 0.5e0 AS longitude,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(80 + (s_suppkey * 37) % 1421 AS INT) END AS capacity,
       repeat('$', CAST(2 + s_suppkey % 3 AS INT)) AS price_range,
       CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST(CAST(40 + s_suppkey % 10 AS DECIMAL(3,0)) / 10 AS DECIMAL(3,2)) END AS rating
FROM supplier
LEFT JOIN (VALUES (0, 'Hotel'), (1, 'Restaurant'), (2, 'Golf Club'), (3, 'Museum')) AS t(type_code, venue_type)
  ON CAST(s_suppkey % 4 AS INT) = t.type_code
"""

ADDRESSES = """
SELECT 'ADDR_' || CAST(c_custkey AS VARCHAR) AS address_id, n_name AS city,
       CASE WHEN c_custkey % 10 = 0 THEN 'NC' ELSE 'SC' END AS state, CAST(29600 + c_nationkey AS VARCHAR) AS zip,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 34.6e0 + CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.5e0 END AS latitude,
       -82.6e0 + CAST((c_custkey * 6287) % 10009 AS DOUBLE) / 10009e0 * 0.5e0 AS longitude,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS street,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 900 + 1 AS VARCHAR) END AS number
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


# --- hex grid --------------------------------------------------------------

def with_cells(src: str, resolutions=(7, 8, 9), lat: str = "latitude", lon: str = "longitude",
               prefix: str = "hex_level_") -> str:
    """``SELECT`` adding cell columns to the rows of ``src`` (a query text)."""
    step1 = []
    for r in resolutions:
        g = hg.GRIDS[r]
        step1.append(f"(({lon} * {d(g.kx)}) * {d(hg.C_Q)}) - (({lat} * {d(g.ky)}) * {d(hg.C_THIRD)}) AS _q{r}")
        step1.append(f"(({lat} * {d(g.ky)}) * {d(hg.C_R)}) AS _r{r}")
    s1 = f"SELECT *, {', '.join(step1)} FROM ({src}) _src"
    step2 = []
    for r in resolutions:
        step2.append(f"((-_q{r}) - _r{r}) AS _s{r}")
    s2 = f"SELECT *, {', '.join(step2)} FROM ({s1}) _s1"
    step3 = []
    for r in resolutions:
        step3 += [f"floor(_q{r} + 0.5e0) AS _rq{r}", f"floor(_r{r} + 0.5e0) AS _rr{r}",
                  f"floor(_s{r} + 0.5e0) AS _rs{r}"]
    s3 = f"SELECT *, {', '.join(step3)} FROM ({s2}) _s2"
    step4, tmp = [], []
    for r in resolutions:
        dq, dr, ds = f"abs(_rq{r} - _q{r})", f"abs(_rr{r} - _r{r})", f"abs(_rs{r} - _s{r})"
        win = f"({dq} > {dr} AND {dq} > {ds})"
        qo = f"CASE WHEN {win} THEN (-_rr{r}) - _rs{r} ELSE _rq{r} END"
        ro = f"CASE WHEN {win} THEN _rr{r} WHEN {dr} > {ds} THEN (-_rq{r}) - _rs{r} ELSE _rr{r} END"
        step4.append(f"'hx{r}:' || CAST(CAST({qo} AS BIGINT) AS VARCHAR) || ':' || CAST(CAST({ro} AS BIGINT) AS VARCHAR) AS {prefix}{r}")
        tmp += [f"_q{r}", f"_r{r}", f"_s{r}", f"_rq{r}", f"_rr{r}", f"_rs{r}"]
    return f"SELECT * EXCLUDE ({', '.join(tmp)}), {', '.join(step4)} FROM ({s3}) _s3"


def cell_expr(r: int, lat: str = "latitude", lon: str = "longitude") -> str:
    """Inline cell id expression (long; for one-off use)."""
    g = hg.GRIDS[r]
    qx = f"((({lon} * {d(g.kx)}) * {d(hg.C_Q)}) - (({lat} * {d(g.ky)}) * {d(hg.C_THIRD)}))"
    rx = f"((({lat} * {d(g.ky)}) * {d(hg.C_R)}))"
    sx = f"((-{qx}) - {rx})"
    rq, rr, rs = (f"floor({v} + 0.5e0)" for v in (qx, rx, sx))
    dq, dr, ds = f"abs({rq} - {qx})", f"abs({rr} - {rx})", f"abs({rs} - {sx})"
    win = f"({dq} > {dr} AND {dq} > {ds})"
    qo = f"CASE WHEN {win} THEN (-{rr}) - {rs} ELSE {rq} END"
    ro = f"CASE WHEN {win} THEN {rr} WHEN {dr} > {ds} THEN (-{rq}) - {rs} ELSE {rr} END"
    return f"('hx{r}:' || CAST(CAST({qo} AS BIGINT) AS VARCHAR) || ':' || CAST(CAST({ro} AS BIGINT) AS VARCHAR))"


def corner_rows(cells_src: str, r: int, cell: str = "hex_cell", digits: int = 6) -> str:
    """``SELECT`` of (cell, corner, lat, lon) for every cell of ``cells_src``."""
    g = hg.GRIDS[r]
    scale = d(10 ** digits)
    vals = ", ".join(f"({i}, {d(dx)}, {d(dy)})" for i, (dx, dy) in enumerate(hg.CORNERS))
    qq = f"CAST(split_part({cell}, ':', 2) AS BIGINT)"
    rr = f"CAST(split_part({cell}, ':', 3) AS BIGINT)"
    xe = f"({d(hg.SQRT3)} * ({qq} + {rr} * 0.5e0))"
    ye = f"(1.5e0 * {rr})"
    lat = f"floor((({ye} + c.dy) / {d(g.ky)}) * {scale} + 0.5e0) / {scale}"
    lon = f"floor((({xe} + c.dx) / {d(g.kx)}) * {scale} + 0.5e0) / {scale}"
    return (f"SELECT s.*, c.corner, {lat} AS lat, {lon} AS lon FROM ({cells_src}) s "
            f"CROSS JOIN (VALUES {vals}) AS c(corner, dx, dy)")


# --- measures --------------------------------------------------------------

def money_sum(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE)"


def mean_half_up(c: str, digits: int, scale_digits: int = 2) -> str:
    s = f"sum(CAST({c} * {10 ** scale_digits} AS BIGINT))" if scale_digits else f"sum(CAST({c} AS BIGINT))"
    n = f"count({c})"
    num = f"({s} * {10 ** (digits - scale_digits)})" if digits >= scale_digits else s
    den = n if digits >= scale_digits else f"({n} * {10 ** (scale_digits - digits)})"
    mag = f"((2 * abs({num}) + {den}) // (2 * {den}))"
    return (f"(CASE WHEN {n} > 0 THEN (CASE WHEN {num} >= 0 THEN {mag} ELSE -{mag} END) "
            f"/ {d(10 ** digits)} END)")


def coord_mean(c: str) -> str:
    units = f"CAST(floor({c} * {d(NANO)} + 0.5e0) AS DECIMAL(20,0))"
    return f"(CASE WHEN count({c}) > 0 THEN CAST(sum({units}) AS DOUBLE) / count({c}) / {d(NANO)} END)"


def rounded(x: str, digits: int) -> str:
    s = d(10 ** digits)
    return f"(floor(({x}) * {s} + 0.5e0) / {s})"


def draw(key: str, seed: str) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || {q('|' + str(seed))}), 1, 8)) AS BIGINT) / 4294967296e0)"


def uniform_int(lo: int, hi: int, u: str) -> str:
    return f"floor({d(lo)} + {u} * {d(hi - lo + 1)})"


def order_key(key: str, seed) -> str:
    return f"md5(CAST({key} AS VARCHAR) || {q('|' + str(seed))})"


def currency(c: str) -> str:
    return f"('$' || format('{{:,.0f}}', CAST({c} AS DOUBLE)))"
