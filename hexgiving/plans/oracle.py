"""Oracle SQL (DuckDB dialect) for the value check of each named query.

Runs on the same input tables, with the adapter and measure text of
``plans.sqltext``. Roles, bands and policies are literals here; the zips and
filter settings of a query are its parameters and come from the registry.
"""

from __future__ import annotations

from hexgiving.plans import registry as R
from hexgiving.plans import sqltext as S

ORACLE: dict[str, str] = {}

A, C = "annual_donation_amount", "cumulative_donation_amount"
DONORS_CELLS = S.with_cells(S.DONORS)


def w(body: str, cells: bool = False, extra: str = "") -> str:
    src = DONORS_CELLS if cells else S.DONORS
    more = f", {extra}" if extra else ""
    return f"WITH donors AS ({src}){more} {body}"


def pred(zip_codes=None, grad_years=None, donation_range=None, donor_segments=None) -> str:
    parts = ["TRUE"]
    if zip_codes:
        parts.append(f"zip_code IN {S.in_list(zip_codes)}")
    if grad_years:
        parts.append(f"graduation_year BETWEEN {int(grad_years[0])} AND {int(grad_years[1])}")
    if donation_range:
        parts.append(f"{A} BETWEEN {S.d(donation_range[0])} AND {S.d(donation_range[1])}")
    if donor_segments:
        parts.append(f"donor_segment IN {S.in_list(donor_segments)}")
    return " AND ".join(parts)


FILT = pred(**R.FILTERS)
FILTERED = f"filtered AS (SELECT * FROM donors WHERE {FILT})"

# --- filters ------------------------------------------------------------------
ORACLE["filter_zip"] = w(f"SELECT donor_id, zip_code FROM donors WHERE {pred(zip_codes=R.ZIPS)}")
ORACLE["filter_segment"] = w(f"SELECT donor_id, donor_segment FROM donors WHERE {pred(donor_segments=[R.T.SEGMENT_MAJOR])}")
ORACLE["filter_year_range"] = w(f"SELECT donor_id, graduation_year FROM donors WHERE {pred(grad_years=R.YEARS)}")
ORACLE["filter_amount_range"] = w(
    f"SELECT donor_id, CAST({A} AS DOUBLE) AS {A} FROM donors WHERE {pred(donation_range=R.AMOUNTS)}")
ORACLE["apply_filters"] = w(
    f"SELECT donor_id, zip_code, graduation_year, donor_segment, CAST({A} AS DOUBLE) AS {A} FROM donors WHERE {FILT}")
ORACLE["apply_filters_empty"] = w("SELECT donor_id, zip_code FROM donors")
ORACLE["valid_points"] = w(
    f"SELECT donor_id, latitude, longitude FROM donors WHERE latitude IS NOT NULL AND longitude IS NOT NULL "
    f"AND {A} IS NOT NULL AND {C} IS NOT NULL")
ORACLE["venue_filter"] = (
    f"WITH venues AS ({S.VENUES}) SELECT venue_id, venue_type, price_range, capacity FROM venues "
    f"WHERE venue_type IN {S.in_list(R.VENUE_TYPES)} AND price_range IN {S.in_list(R.PRICES)} "
    f"AND capacity >= {R.MIN_CAPACITY}")
ORACLE["venue_filter_empty"] = f"WITH venues AS ({S.VENUES}) SELECT venue_id FROM venues WHERE FALSE"

# --- SQL views and summary -------------------------------------------------------
VIEW_MEASURES = (f"count(*) AS donor_count, {S.money_sum(A)} AS total_annual_donations, "
                 f"{S.money_sum(C)} AS total_cumulative_donations, {S.mean_half_up(A, 2)} AS avg_annual_donation")
ORACLE["donor_summary"] = w(
    f"SELECT zip_code, hex_level_7, hex_level_8, hex_level_9, count(*) AS donor_count, "
    f"{S.money_sum(A)} AS total_annual_donations, {S.money_sum(C)} AS total_cumulative_donations, "
    f"{S.mean_half_up(A, 2)} AS avg_annual_donation, {S.mean_half_up(C, 2)} AS avg_cumulative_donation, "
    f"CAST(count_if({A} >= 10000) AS BIGINT) AS major_donors_count "
    f"FROM donors GROUP BY zip_code, hex_level_7, hex_level_8, hex_level_9", cells=True)
ORACLE["donor_overview"] = w(
    f"SELECT count(*) AS total_donors, {S.money_sum(A)} AS total_annual_donations, "
    f"{S.money_sum(C)} AS total_cumulative_donations, {S.mean_half_up(A, 2)} AS avg_annual_donation, "
    f"{S.mean_half_up(C, 2)} AS avg_cumulative_donation, "
    f"CAST(count_if(donor_segment = 'Major Donor') AS BIGINT) AS major_donors, "
    f"CAST(count_if(donor_segment = 'Mid-Level Donor') AS BIGINT) AS mid_level_donors, "
    f"CAST(count_if(donor_segment = 'Annual Donor') AS BIGINT) AS annual_donors FROM donors")
ORACLE["by_grad_year"] = w(
    f"SELECT graduation_year, {VIEW_MEASURES}, {S.mean_half_up('age', 1, 0)} AS avg_age "
    f"FROM donors GROUP BY graduation_year")
ORACLE["by_zip"] = w(
    f"SELECT zip_code, {VIEW_MEASURES}, CAST(count_if(donor_segment = 'Major Donor') AS BIGINT) AS major_donors, "
    f"{S.rounded(S.coord_mean('latitude'), 6)} AS center_latitude, "
    f"{S.rounded(S.coord_mean('longitude'), 6)} AS center_longitude FROM donors GROUP BY zip_code")
ORACLE["by_major"] = w(
    f"SELECT major, {VIEW_MEASURES}, {S.mean_half_up('age', 1, 0)} AS avg_age FROM donors GROUP BY major")

# --- dashboard tables -------------------------------------------------------------
ORACLE["chart_grad_year"] = w(
    f"SELECT graduation_year, {S.money_sum(A)} AS total_annual, {S.mean_half_up(A, 2)} AS avg_annual, "
    f"count({A}) AS donor_count FROM filtered WHERE graduation_year IS NOT NULL GROUP BY graduation_year",
    extra=FILTERED)
ORACLE["chart_top_zips"] = w(
    f"SELECT zip_code, {S.money_sum(A)} AS total_annual, count({A}) AS donor_count FROM filtered "
    f"WHERE zip_code IS NOT NULL GROUP BY zip_code ORDER BY total_annual DESC, zip_code LIMIT 10", extra=FILTERED)
ORACLE["segment_counts"] = w(
    "SELECT donor_segment, count(*) AS donor_count FROM filtered WHERE donor_segment IS NOT NULL GROUP BY donor_segment",
    extra=FILTERED)
ORACLE["chart_top_majors"] = w(
    f"SELECT major, {S.money_sum(A)} AS total_annual FROM filtered WHERE major IS NOT NULL GROUP BY major "
    f"ORDER BY total_annual DESC, major LIMIT 10", extra=FILTERED)
for _key, _name in (("zip_code", "by_zip_ranked"), ("major", "by_major_ranked")):
    ORACLE[_name] = w(
        f"SELECT {_key}, total_annual_donations, CAST(row_number() OVER (ORDER BY total_annual_donations DESC, {_key} NULLS FIRST) "
        f"AS INTEGER) AS position FROM (SELECT {_key}, {S.money_sum(A)} AS total_annual_donations FROM donors GROUP BY {_key}) g")
ORACLE["grad_years_sorted"] = w(
    "SELECT graduation_year, CAST(row_number() OVER (ORDER BY graduation_year) AS INTEGER) AS position "
    "FROM (SELECT DISTINCT graduation_year FROM donors WHERE graduation_year IS NOT NULL) g")
CSM = f"count({A}) AS donor_count, {S.money_sum(A)} AS total_annual, {S.mean_half_up(A, 2)} AS avg_annual"
ORACLE["report_zip"] = w(f"SELECT zip_code, {CSM} FROM filtered WHERE zip_code IS NOT NULL GROUP BY zip_code",
                         extra=FILTERED)
ORACLE["report_segment"] = w(
    f"SELECT donor_segment, {CSM} FROM filtered WHERE donor_segment IS NOT NULL GROUP BY donor_segment",
    extra=FILTERED)
ORACLE["details_top_zips"] = w(
    f"SELECT zip_code, count(donor_id) AS donor_count, {S.money_sum(A)} AS total_annual FROM filtered "
    f"WHERE zip_code IS NOT NULL GROUP BY zip_code ORDER BY total_annual DESC, zip_code LIMIT 5", extra=FILTERED)


def kpi_sql(p: str) -> str:
    sel = f"coalesce(({p}), FALSE)"
    n = f"CAST(count_if({sel}) AS BIGINT)"
    major = f"CAST(count_if({sel} AND donor_segment = 'Major Donor') AS BIGINT)"
    annual_sel = f"(CASE WHEN {sel} THEN {A} END)"
    return w(
        f"SELECT {n} AS total_donors, {n} - count(*) AS delta_from_full, "
        f"coalesce({S.money_sum(annual_sel)}, 0e0) AS total_annual, {S.mean_half_up(annual_sel, 2)} AS avg_annual, "
        f"{major} AS major_donors, "
        f"(CASE WHEN {n} > 0 THEN ({major} * 2000 + {n}) // ({n} * 2) / 10e0 END) AS major_share_pct FROM donors")


ORACLE["kpi_row"] = kpi_sql(FILT)
ORACLE["kpi_row_empty"] = kpi_sql(pred(**R.NO_MATCH_FILTERS))


def top_zip_sql(p: str) -> str:
    return w(
        f"SELECT coalesce(max(zip_code), 'No data') AS top_zip, coalesce(max(donor_count), 0) AS donor_count FROM ("
        f"SELECT zip_code, {S.money_sum(A)} AS total_annual, count(*) AS donor_count FROM donors "
        f"WHERE ({p}) AND zip_code IS NOT NULL GROUP BY zip_code ORDER BY total_annual DESC, zip_code LIMIT 1) t")


ORACLE["top_zip"] = top_zip_sql(FILT)
ORACLE["top_zip_empty"] = top_zip_sql(pred(**R.NO_MATCH_FILTERS))
ORACLE["top_zip_rows"] = w(
    f"SELECT donor_id, zip_code FROM filtered WHERE zip_code = (SELECT zip_code FROM filtered "
    f"WHERE zip_code IS NOT NULL GROUP BY zip_code ORDER BY sum({A}) DESC, zip_code LIMIT 1)", extra=FILTERED)
ORACLE["geo_extent"] = w(
    f"SELECT min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, "
    f"max(longitude) AS max_lon, {S.rounded(S.coord_mean('latitude'), 6)} AS center_lat, "
    f"{S.rounded(S.coord_mean('longitude'), 6)} AS center_lon FROM filtered", extra=FILTERED)
ORACLE["filter_domains"] = w(
    "SELECT DISTINCT 'zip_code' AS domain, zip_code AS value FROM donors WHERE zip_code IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'donor_segment', donor_segment FROM donors WHERE donor_segment IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'venue_type', venue_type FROM venues WHERE venue_type IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'price_range', price_range FROM venues WHERE price_range IS NOT NULL "
    "UNION ALL SELECT 'min_year', CAST(min(graduation_year) AS VARCHAR) FROM donors "
    "UNION ALL SELECT 'max_year', CAST(max(graduation_year) AS VARCHAR) FROM donors "
    f"UNION ALL SELECT 'min_donation', CAST(min({A}) AS VARCHAR) FROM donors "
    f"UNION ALL SELECT 'max_donation', CAST(max({A}) AS VARCHAR) FROM donors "
    "UNION ALL SELECT 'max_capacity', CAST(max(capacity) AS VARCHAR) FROM venues",
    extra=f"venues AS ({S.VENUES})")
ORACLE["distinct_cells"] = w(
    "SELECT count(DISTINCT hex_level_7) AS cells_7, count(DISTINCT hex_level_8) AS cells_8, "
    "count(DISTINCT hex_level_9) AS cells_9 FROM filtered", cells=True, extra=FILTERED)
ORACLE["report_scalars"] = w(
    f"SELECT count(*) AS total_donors, coalesce({S.money_sum(A)}, 0e0) AS total_annual, "
    f"{S.mean_half_up(A, 2)} AS avg_annual, coalesce({S.money_sum(C)}, 0e0) AS total_cumulative, "
    f"{S.mean_half_up(C, 2)} AS avg_cumulative, {S.rounded(S.coord_mean('latitude'), 6)} AS center_lat, "
    f"{S.rounded(S.coord_mean('longitude'), 6)} AS center_lon, min(latitude) AS min_lat, max(latitude) AS max_lat, "
    f"min(longitude) AS min_lon, max(longitude) AS max_lon FROM filtered", extra=FILTERED)

# --- hex grid ---------------------------------------------------------------------
POINTS = (f"points AS (SELECT * FROM donors WHERE latitude IS NOT NULL AND longitude IS NOT NULL "
          f"AND {A} IS NOT NULL AND {C} IS NOT NULL)")


def hex_rollup_sql(r: int) -> str:
    return (f"SELECT hex_cell_{r} AS hex_cell, count(*) AS donor_count, {S.money_sum(A)} AS total_annual, "
            f"{S.mean_half_up(A, 2)} AS avg_annual, {S.money_sum(C)} AS total_cumulative, "
            f"{S.coord_mean('latitude')} AS center_lat, {S.coord_mean('longitude')} AS center_lon "
            f"FROM ({S.with_cells('SELECT * FROM points', (r,), prefix='hex_cell_')}) x "
            f"GROUP BY hex_cell_{r}")


for _r in (7, 8, 9):
    ORACLE[f"hex_assign_{_r}"] = w(f"SELECT donor_id, {S.cell_expr(_r)} AS hex_cell FROM donors")

STORED_MEASURES = (
    f"{S.money_sum(A)} AS total_annual, {S.mean_half_up(A, 2)} AS avg_annual, count({A}) AS donor_count, "
    f"{S.money_sum(C)} AS total_cumulative, {S.rounded(S.coord_mean('latitude'), 2)} AS center_lat, "
    f"{S.rounded(S.coord_mean('longitude'), 2)} AS center_lon")
ORACLE["hex_rollup_stored"] = w(
    f"SELECT hex_level_8 AS hex_cell, {STORED_MEASURES} FROM donors WHERE hex_level_8 IS NOT NULL GROUP BY hex_level_8",
    cells=True)
ORACLE["hex_rollup_static"] = w(
    f"SELECT hex_level_8 AS hex_cell, {S.coord_mean('latitude')} AS latitude, {S.coord_mean('longitude')} AS longitude, "
    f"{S.money_sum(A)} AS total_annual, count(donor_id) AS donor_count FROM donors WHERE hex_level_8 IS NOT NULL "
    f"GROUP BY hex_level_8", cells=True)
ORACLE["report_top_hex"] = w(
    f"SELECT hex_level_8 AS hex_cell, count({A}) AS donor_count, {S.money_sum(A)} AS total_annual, "
    f"{S.mean_half_up(A, 4)} AS avg_annual, {S.rounded(S.coord_mean('latitude'), 4)} AS center_lat, "
    f"{S.rounded(S.coord_mean('longitude'), 4)} AS center_lon FROM filtered WHERE hex_level_8 IS NOT NULL "
    f"GROUP BY hex_level_8 ORDER BY total_annual DESC, hex_cell LIMIT 10", cells=True, extra=FILTERED)
ORACLE["hex_top5"] = w(
    f"SELECT hex_level_8 AS hex_cell, count(*) AS donor_count, {S.money_sum(A)} AS total_annual, "
    f"{S.coord_mean('latitude')} AS center_lat, {S.coord_mean('longitude')} AS center_lon FROM donors "
    f"WHERE hex_level_8 IS NOT NULL GROUP BY hex_level_8 ORDER BY donor_count DESC, hex_cell LIMIT 5", cells=True)


def _wkt(src_cells: str) -> str:
    """Per-cell WKT ring from the corner rows (6 corners, first repeated)."""
    pts = "string_agg(printf('%.6f %.6f', lon, lat), ', ' ORDER BY corner)"
    first = "max(CASE WHEN corner = 0 THEN printf('%.6f %.6f', lon, lat) END)"
    return (f"SELECT hex_cell, 'POLYGON((' || {pts} || ', ' || {first} || '))' AS wkt "
            f"FROM ({S.corner_rows(src_cells, 8)}) k GROUP BY hex_cell")


for _r in (7, 8, 9):
    ORACLE[f"hex_rollup_{_r}"] = w(hex_rollup_sql(_r), extra=POINTS)

CELLS8 = f"SELECT DISTINCT hex_cell_8 AS hex_cell FROM ({S.with_cells('SELECT * FROM points', (8,), prefix='hex_cell_')}) x"
ORACLE["cell_boundaries"] = w(
    f"SELECT k.hex_cell, k.corner, k.lat, k.lon, p.wkt FROM ({S.corner_rows(CELLS8, 8)}) k "
    f"JOIN ({_wkt(CELLS8)}) p ON k.hex_cell = p.hex_cell", extra=POINTS)
ORACLE["cell_polygons"] = w(
    f"SELECT hex_cell, corner AS point, lat, lon FROM ({S.corner_rows(CELLS8, 8)}) k "
    f"UNION ALL SELECT hex_cell, 6 AS point, lat, lon FROM ({S.corner_rows(CELLS8, 8)}) k WHERE corner = 0",
    extra=POINTS)
ORACLE["cell_boundary_stats"] = w(
    f"SELECT hex_cell, corner, lat, lon, donor_count, total_annual, avg_annual, total_cumulative "
    f"FROM ({S.corner_rows(hex_rollup_sql(8), 8)}) k", extra=POINTS)

HEXC = f"hexc AS (SELECT hex_level_8 AS hex_cell, {STORED_MEASURES} FROM donors WHERE hex_level_8 IS NOT NULL GROUP BY hex_level_8)"
_N = ("(CASE WHEN m.mx > 0 THEN least(1e0, greatest(0e0, total_annual / m.mx)) ELSE 0e0 END)")
ORACLE["hex_colours"] = w(
    f"SELECT hex_cell, total_annual, "
    f"CAST(floor(255e0 * (0.8e0 + 0.2e0 * {_N})) AS INTEGER) AS red, "
    f"CAST(floor(255e0 * (0.6e0 * (1e0 - {_N}))) AS INTEGER) AS green, "
    f"CAST(floor(255e0 * (0.2e0 * (1e0 - {_N}))) AS INTEGER) AS blue, "
    f"(CASE WHEN m.mx > 0 THEN least(0.8e0, greatest(0.3e0, total_annual / m.mx)) ELSE 0.3e0 END) AS opacity, "
    f"format('{{:,.0f}}', total_annual) AS total_annual_formatted, format('{{:,.0f}}', avg_annual) AS avg_annual_formatted, "
    f"format('{{:,.0f}}', total_cumulative) AS total_cumulative_formatted "
    f"FROM hexc, (SELECT max(total_annual) AS mx FROM hexc) m", cells=True, extra=HEXC)

# --- features and display tables -------------------------------------------------
from hexgiving.operators import features as FE  # noqa: E402
from hexgiving.operators import quality as QL  # noqa: E402


def _seg_colour(ch: int) -> str:
    arms = " ".join(f"WHEN {S.q(k)} THEN {v[ch]}" for k, v in FE.SEGMENT_RGBA.items())
    return f"(CASE donor_segment {arms} ELSE {FE.DEFAULT_RGBA[ch]} END)"


DONOR_FEATURES = (
    f"SELECT donor_id, longitude, latitude, coalesce(full_name, 'None') AS full_name, "
    f"coalesce(donor_segment, 'None') AS donor_segment, CAST({A} AS DOUBLE) AS {A}, CAST({C} AS DOUBLE) AS {C}, "
    f"coalesce(zip_code, 'None') AS zip_code, CAST(coalesce(graduation_year, 2000) AS INTEGER) AS graduation_year, "
    f"{_seg_colour(0)} AS red, {_seg_colour(1)} AS green, {_seg_colour(2)} AS blue, {_seg_colour(3)} AS alpha, "
    f"{S.currency(A)} AS annual_formatted, {S.currency(C)} AS cumulative_formatted "
    f"FROM {{src}} WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
VENUE_FEATURES = (
    f"SELECT venue_id, longitude, latitude, venue_name, venue_type, CAST(coalesce(capacity, 0) AS INTEGER) AS capacity, "
    f"price_range, coalesce(CAST(rating AS DOUBLE), 0e0) AS rating, {FE.VENUE_RGBA[0]} AS red, {FE.VENUE_RGBA[1]} AS green, "
    f"{FE.VENUE_RGBA[2]} AS blue, {FE.VENUE_RGBA[3]} AS alpha, {S.q(FE.VENUE_ICON)} || venue_name AS full_name, "
    f"'Event Venue - ' || venue_type AS donor_segment, "
    f"'Capacity: ' || coalesce(CAST(capacity AS VARCHAR), 'N/A') AS annual_formatted, "
    f"'Rating: ' || coalesce(CAST(CAST(rating AS DOUBLE) AS VARCHAR), 'N/A') || '/5' AS cumulative_formatted, "
    f"price_range AS zip_code, 'Venue' AS graduation_year "
    f"FROM venues WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
VEN = f"venues AS ({S.VENUES})"
ORACLE["donor_features"] = w(DONOR_FEATURES.replace("{src}", "donors"))
ORACLE["venue_features"] = f"WITH {VEN} {VENUE_FEATURES}"
ORACLE["map_layers"] = w(
    f"SELECT 'donors' AS layer, donor_id AS feature_id, longitude, latitude, full_name, donor_segment, annual_formatted, "
    f"cumulative_formatted, zip_code, CAST(graduation_year AS VARCHAR) AS graduation_year, red, green, blue, alpha "
    f"FROM ({DONOR_FEATURES.replace("{src}", "filtered")}) d UNION ALL "
    f"SELECT 'venues', venue_id, longitude, latitude, full_name, donor_segment, annual_formatted, cumulative_formatted, "
    f"zip_code, graduation_year, red, green, blue, alpha FROM ({VENUE_FEATURES}) v", extra=f"{FILTERED}, {VEN}")
ORACLE["venue_cards"] = (
    f"WITH {VEN} SELECT venue_id, concat_ws(' - ', venue_name, venue_type) AS title, "
    f"coalesce(CAST(capacity AS VARCHAR), 'None') AS capacity_text, "
    f"coalesce(CAST(rating AS VARCHAR), 'None') || '/5.0' AS rating_text, "
    f"'Price Range: ' || coalesce(price_range, 'None') AS price_text, coalesce(zip_code, 'None') AS address_line FROM venues")
TABLE_COLS = (f'full_name AS "Name", zip_code AS "Zip", graduation_year AS "Grad Year", '
              f'{S.currency(A)} AS "Annual Donation", {S.currency(C)} AS "Total Lifetime", '
              f'donor_segment AS "Segment", age AS "Age"')
ORACLE["donor_table"] = w(f"SELECT {TABLE_COLS} FROM (SELECT * FROM filtered ORDER BY donor_id LIMIT 50) t",
                          extra=FILTERED)
ORACLE["donor_table_all"] = w(f"SELECT {TABLE_COLS} FROM filtered", extra=FILTERED)
ORACLE["donor_details"] = w(
    f"SELECT donor_id, full_name, zip_code, graduation_year, major, CAST({A} AS DOUBLE) AS {A}, "
    f"CAST({C} AS DOUBLE) AS {C}, donor_segment FROM filtered", extra=FILTERED)
_HEX = " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in FE.SEGMENT_HEX.items())
ORACLE["point_sizes"] = w(
    f"SELECT donor_id, least(20e0, greatest(3e0, CAST({A} AS DOUBLE) / 500e0)) AS size_chart, "
    f"least(25e0, greatest(5e0, CAST({A} AS DOUBLE) / 500e0)) AS size_image, "
    f"(CASE donor_segment {_HEX} END) AS colour FROM donors")

# --- governance ---------------------------------------------------------------------


# Literals of the policies, not taken from the code under test.
INTERN = "HE_ADVANCEMENT_INTERN_ROLE"
PLATFORM_ADMIN = "PLATFORM_INTELLIGENCE_ADMIN_ROLE"
CLEAR = ("DATASCI", "SYSADMIN", "ACCOUNTADMIN", PLATFORM_ADMIN)
CLEAR_DATES = ("ACCOUNTADMIN", "DATA_ANALYST", "SECURITY_ADMIN", PLATFORM_ADMIN)
ALL_ROWS = ("ACADEMIC_ADVISOR_MGR_ROLE", "ACCOUNTADMIN", PLATFORM_ADMIN)
MASKED = "**masked**"


def _clear(role: str, roles) -> str:
    return f"({S.q(role)} IN {S.in_list(roles)})"


ORACLE["mask_string"] = w(
    f"SELECT donor_id, CASE WHEN {_clear(INTERN, CLEAR)} THEN full_name "
    f"ELSE {S.q(MASKED)} END AS full_name FROM donors")
ORACLE["mask_date"] = w(
    f"SELECT donor_id, CAST(CASE WHEN {_clear('DATASCI', CLEAR_DATES)} THEN last_donation_date "
    f"ELSE DATE '9999-12-31' END AS VARCHAR) AS last_donation_date, CAST(last_donation_date AS VARCHAR) AS shown_to_analyst "
    f"FROM donors")
ORACLE["mask_number"] = w(
    f"SELECT donor_id, CAST(CASE WHEN {_clear(INTERN, CLEAR)} THEN {A} "
    f"ELSE CAST(0 AS DECIMAL(10,2)) END AS DOUBLE) AS {A}, "
    f"CASE WHEN {_clear(INTERN, CLEAR)} THEN age ELSE 0 END AS age FROM donors")


def _row_pred(role: str) -> str:
    if role == INTERN:
        return "donor_segment = 'Annual Donor'"
    return "TRUE" if role in ALL_ROWS else "FALSE"


def _masked_sql(role: str) -> str:
    s_ok, n_ok = _clear(role, CLEAR), _clear(role, CLEAR)
    return w(
        f"SELECT donor_id, CASE WHEN {s_ok} THEN full_name ELSE {S.q(MASKED)} END AS full_name, "
        f"CASE WHEN {n_ok} THEN age ELSE 0 END AS age, "
        f"CAST(CASE WHEN {n_ok} THEN {A} ELSE 0 END AS DOUBLE) AS {A}, "
        f"CAST(CASE WHEN {n_ok} THEN {C} ELSE 0 END AS DOUBLE) AS {C}, donor_segment, major "
        f"FROM donors WHERE {_row_pred(role)}")


ORACLE["masked_donors_intern"] = _masked_sql(INTERN)
ORACLE["masked_donors_admin"] = _masked_sql("ACCOUNTADMIN")
for _role, _key in ((INTERN, "intern"), ("ACCOUNTADMIN", "admin"), ("PUBLIC", "other")):
    ORACLE[f"row_access_{_key}"] = w(f"SELECT donor_id, donor_segment FROM donors WHERE {_row_pred(_role)}")
ORACLE["masked_donors_platform_admin"] = _masked_sql(PLATFORM_ADMIN)


def _role_rows(role: str) -> str:
    name = "min(full_name)" if role in CLEAR else S.q(MASKED)
    gift = f"CAST(min({A}) AS DOUBLE)" if role in CLEAR else "0e0"
    date = "CAST(min(last_donation_date) AS VARCHAR)" if role in CLEAR_DATES else "'9999-12-31'"
    return (f"SELECT donor_segment, count(*) AS rows, {name} AS first_name, {date} AS first_date, {gift} AS least_gift, "
            f"{S.q(role)} AS role FROM donors WHERE {_row_pred(role)} GROUP BY donor_segment")


ORACLE["roles_clear"] = w(" UNION ALL ".join(_role_rows(r) for r in (
    "DATASCI", "SYSADMIN", "ACCOUNTADMIN", PLATFORM_ADMIN, "DATA_ANALYST", "SECURITY_ADMIN", INTERN,
    "ACADEMIC_ADVISOR_MGR_ROLE", "PUBLIC")))

# --- enrichment ---------------------------------------------------------------------
ADDR = f"addresses AS ({S.ADDRESSES})"


def _pool_part(zips, n, tag) -> str:
    return (f"(SELECT address_id, city, state, zip, latitude, longitude, "
            f"coalesce(street, '') || ' ' || coalesce(number, '') AS street_address, {S.q(tag)} AS address_type "
            f"FROM addresses WHERE state = 'SC' AND zip IN {S.in_list(zips)} AND latitude IS NOT NULL "
            f"AND longitude IS NOT NULL ORDER BY {S.order_key('address_id', 'pool-' + tag)}, address_id LIMIT {n})")


POOL = (f"{ADDR}, pool AS (SELECT * FROM {_pool_part(R.TARGET_ZIPS, 7000, 'TARGET')} t "
        f"UNION ALL SELECT * FROM {_pool_part(R.OTHER_ZIPS, 3000, 'OTHER')} o)")

ORACLE["address_pool"] = f"WITH {POOL} SELECT * FROM pool"
_NUMBER = f"row_number() OVER (ORDER BY {S.order_key('address_id', 'donors')}, address_id)"
ORACLE["number_rows"] = f"WITH {ADDR} SELECT address_id, {_NUMBER} AS rn FROM addresses"
ORACLE["sample_n"] = (f"WITH {ADDR} SELECT address_id, zip FROM addresses WHERE latitude IS NOT NULL "
                      f"ORDER BY {S.order_key('address_id', 'sample')}, address_id LIMIT 100")
ORACLE["donor_enrich"] = (f"WITH {ADDR} SELECT 'DONOR_' || printf('%05d', {_NUMBER}) AS donor_id, address_id, "
                          f"coalesce(street, '') || ' ' || coalesce(number, '') AS street_address, city, state, "
                          f"zip AS zip_code, latitude, longitude FROM addresses")
ORACLE["giving_bands"] = w(
    f"SELECT donor_id, graduation_year, CAST(CASE WHEN 2024 - graduation_year >= 25 THEN 25 WHEN 2024 - graduation_year >= 15 "
    f"THEN 15 WHEN 2024 - graduation_year >= 5 THEN 5 ELSE 0 END AS INTEGER) AS band_years, CAST(CASE "
    + " ".join(f"WHEN 2024 - graduation_year >= {y} THEN round({A} * (1 + (2024 - graduation_year - {y}) * CAST({r} AS DECIMAL(3,2))), 2)"
               for y, r in ((25, "0.02"), (15, "0.03"), (5, "0.05")))
    + f" ELSE {A} END AS DOUBLE) AS grown_gift FROM donors")
ORACLE["last_gift_date"] = w(
    "SELECT donor_id, CAST(last_donation_date AS VARCHAR) AS last_donation_date, "
    "CAST(DATE '2024-12-31' - last_donation_date AS INTEGER) AS days_since, "
    "CAST(last_donation_date - 730 AS VARCHAR) AS two_years_before FROM donors")
ORACLE["pick_from_array"] = (
    f"WITH {ADDR}, parts AS (SELECT address_id, string_split(street, '#') AS p FROM addresses) "
    f"SELECT address_id, p[1] AS first_part, p[2] AS second_part, p[3] AS third_part FROM parts")
ORACLE["scalar_subquery"] = w(
    f"SELECT donor_id, CAST({A} AS DOUBLE) / (SELECT CAST(max({A}) AS DOUBLE) FROM donors) AS share_of_largest FROM donors")

# --- quality ----------------------------------------------------------------------
_CELL_COLS = ("hex_level_7", "hex_level_8", "hex_level_9")


def _completeness(total: str, src: str) -> str:
    parts = [f"count(*) AS {total}"] + [f"count({c}) AS {c}_count" for c in _CELL_COLS]
    parts += [f"count(CASE WHEN {c} IS NOT NULL THEN 1 END) AS {c}_not_null" for c in _CELL_COLS]
    return f"SELECT {', '.join(parts)} FROM {src}"


ORACLE["completeness"] = w(_completeness("total_records", "donors"), cells=True)
ORACLE["venue_completeness"] = f"WITH venues AS ({S.with_cells(S.VENUES)}) {_completeness('total_venues', 'venues')}"
ORACLE["status_line"] = w(
    f"SELECT CASE WHEN CAST(count_if(hex_level_7 IS NOT NULL) AS BIGINT) > 0 THEN {S.q(QL.STATUS_OK)} ELSE {S.q(QL.STATUS_EMPTY)} END "
    f"AS final_status FROM donors", cells=True)


def _uniq(src: str, key: str) -> str:
    return (f"SELECT CAST(sum(_n) AS BIGINT) AS total_rows, count({key}) AS distinct_keys, "
            f"CAST(count_if({key} IS NOT NULL AND _n > 1) AS BIGINT) AS duplicated_keys, "
            f"CAST(coalesce(sum(CASE WHEN {key} IS NULL THEN _n END), 0) AS BIGINT) AS null_keys "
            f"FROM (SELECT {key}, count(*) AS _n FROM {src} GROUP BY {key}) g")


ORACLE["key_uniqueness"] = w(_uniq("donors", "donor_id"))
ORACLE["venue_key_uniqueness"] = f"WITH {VEN} {_uniq('venues', 'venue_id')}"


def _money_double_cols(cols) -> str:
    out = []
    for c in cols:
        if c in (A, C):
            out.append(f"CAST({c} AS DOUBLE) AS {c}")
        elif c == "last_donation_date":
            out.append(f"CAST({c} AS VARCHAR) AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


# --- sinks ------------------------------------------------------------------------
ORACLE["ctas_roundtrip"] = ORACLE["donor_summary"]
ORACLE["append_roundtrip"] = ORACLE["donor_summary"].replace(
    "AS major_donors_count FROM", "AS major_donors_count, TRUE AS has_created_date FROM")
DONOR_COLS = ["donor_id", "full_name", "zip_code", "latitude", "longitude", "graduation_year", "major", "age", A, C,
              "last_donation_date", "donor_segment", "hex_level_7", "hex_level_8", "hex_level_9"]
ORACLE["export_filtered"] = w(f"SELECT {_money_double_cols(DONOR_COLS)} FROM filtered", cells=True, extra=FILTERED)
ORACLE["export_complete"] = w(f"SELECT {_money_double_cols(DONOR_COLS)} FROM donors", cells=True)


def _report_sql() -> str:
    head = (f"head AS (SELECT count(*) AS n, {S.money_sum(A)} AS ta, {S.mean_half_up(A, 2)} AS ma, "
            f"{S.money_sum(C)} AS tc, {S.mean_half_up(C, 2)} AS mc, "
            f"{S.rounded(S.coord_mean('latitude'), 6)} AS clat, {S.rounded(S.coord_mean('longitude'), 6)} AS clon, "
            f"min(latitude) AS lat0, max(latitude) AS lat1, min(longitude) AS lon0, max(longitude) AS lon1 FROM filtered)")
    f6 = lambda c: f"printf('%.6f', {c})"
    money = lambda c: f"'$' || format('{{:,.2f}}', {c})"
    L = []
    const = [(0, "00", "'ALUMNI EVENT TARGETING REPORT'"), (0, "01", S.q("=" * 50)),
             (0, "02", S.q(f"Generated: {R.REPORT_TIME}")), (1, "00", "'SUMMARY STATISTICS'"), (1, "01", S.q("-" * 20))]
    L += [f"SELECT {s} AS section, {S.q(k)} AS line_key, {t} AS text" for s, k, t in const]
    fromhead = [(0, "03", "'Total Records Analyzed: ' || format('{:,}', n)"),
                (0, "04", f"'Map Center: ' || {f6('clat')} || ', ' || {f6('clon')}"),
                (0, "05", f"'Geographic Bounds: ' || {f6('lat0')} || ' to ' || {f6('lat1')} || ' (Lat)'"),
                (0, "06", f"{S.q(' ' * 19)} || {f6('lon0')} || ' to ' || {f6('lon1')} || ' (Lon)'"),
                (1, "02", "'Total Donors in Analysis: ' || format('{:,}', n)"),
                (1, "03", f"'Total Annual Donations: ' || {money('ta')}"),
                (1, "04", f"'Average Annual Donation: ' || {money('ma')}"),
                (1, "05", f"'Total Cumulative Donations: ' || {money('tc')}"),
                (1, "06", f"'Average Cumulative Donation: ' || {money('mc')}")]
    L += [f"SELECT {s}, {S.q(k)}, {t} FROM head" for s, k, t in fromhead]

    def table(section, title, key, grouped, digits=2, extra=()):
        return [f"SELECT {section}, '0', {S.q(title)}", f"SELECT {section}, '1', {S.q('-' * len(title))}",
                f"SELECT {section}, '2', {S.q(','.join([key, 'donor_count', 'total_annual', 'avg_annual', *extra]))}",
                (f"SELECT {section}, '3', {key} || ',' || CAST(donor_count AS VARCHAR) || ',' || printf('%.2f', total_annual) || ',' || "
                 f"printf('%.{digits}f', avg_annual)" + "".join(f" || ',' || printf('%.4f', {c})" for c in extra) + f" FROM ({grouped}) g")]

    L += table(2, "GEOGRAPHIC DISTRIBUTION", "zip_code",
               f"SELECT zip_code, {CSM} FROM filtered WHERE zip_code IS NOT NULL GROUP BY zip_code")
    L += table(3, "DONOR SEGMENTS", "donor_segment",
               f"SELECT donor_segment, {CSM} FROM filtered WHERE donor_segment IS NOT NULL GROUP BY donor_segment")
    L += table(4, "TOP 10 HEX CELLS BY TOTAL ANNUAL DONATIONS", "hex_cell",
               f"SELECT hex_level_8 AS hex_cell, count({A}) AS donor_count, {S.money_sum(A)} AS total_annual, "
               f"{S.mean_half_up(A, 4)} AS avg_annual, {S.rounded(S.coord_mean('latitude'), 4)} AS center_lat, "
               f"{S.rounded(S.coord_mean('longitude'), 4)} AS center_lon FROM filtered WHERE hex_level_8 IS NOT NULL GROUP BY hex_level_8 "
               f"ORDER BY total_annual DESC, hex_cell LIMIT 10", 4, ("center_lat", "center_lon"))
    L += [f"SELECT 5, '0', 'INDIVIDUAL DONOR RECORDS'", f"SELECT 5, '1', {S.q('-' * 25)}",
          f"SELECT 5, '2', {S.q(','.join(DONOR_COLS))}"]
    cells = []
    for c in DONOR_COLS:
        cells.append(f"coalesce(CAST({c} AS VARCHAR), '')")
    L.append(f"SELECT 5, '3:' || donor_id, concat_ws(',', {', '.join(cells)}) FROM filtered")
    return w("SELECT text FROM (" + " UNION ALL ".join(f"({x})" for x in L) + ") lines", cells=True, extra=f"{FILTERED}, {head}")


ORACLE["report_lines"] = _report_sql()
ORACLE["summary_stream"] = ORACLE["donor_summary"]
ORACLE["inline_values"] = (
    "SELECT s_suppkey, CAST(s_suppkey % 4 AS INTEGER) AS type_code, t.venue_type FROM supplier "
    "LEFT JOIN (VALUES (0, 'Hotel'), (1, 'Restaurant'), (2, 'Golf Club'), (3, 'Museum')) AS t(type_code, venue_type) "
    "ON CAST(s_suppkey % 4 AS INTEGER) = t.type_code")
ORACLE["sql_zip_view"] = w(
    f"SELECT zip_code, donor_count, total_annual_donations, major_donors FROM ("
    f"SELECT zip_code, count(*) AS donor_count, {S.money_sum(A)} AS total_annual_donations, "
    f"CAST(count_if(donor_segment = 'Major Donor') AS BIGINT) AS major_donors FROM donors GROUP BY zip_code) z "
    f"WHERE donor_count >= 1 AND zip_code <> '29600'")
ORACLE["partitioned_filter_zip"] = w(
    f"SELECT donor_id, zip_code, donor_segment, CAST({A} AS DOUBLE) AS {A} FROM donors WHERE {pred(zip_codes=R.ZIPS)}")
ORACLE["clustered_filters"] = w(" UNION ALL ".join(
    f"SELECT '{name}' AS filter_name, count(*) AS donor_count, {S.money_sum(A)} AS total FROM donors WHERE {pred(**choice)}"
    for name, choice in R.CLUSTER_FILTERS.items()))

# --- where to hold an event ---------------------------------------------------------
GRID8 = S.hg.GRIDS[8]


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"(2 * {S.d(S.hg.EARTH_RADIUS_KM)} * asin(sqrt(least({h}, 1))))"


def qr(cell: str) -> tuple[str, str]:
    return f"CAST(split_part({cell}, ':', 2) AS BIGINT)", f"CAST(split_part({cell}, ':', 3) AS BIGINT)"


VENUES_CELL = f"venues AS ({S.with_cells(S.VENUES, (8,))})"
VENUE_DONOR_KM = km("v.latitude", "v.longitude", "d.latitude", "d.longitude")
ORACLE["catchment_pairs"] = w(
    f"SELECT venue_id, donor_id, floor(km * 1000 + 0.5) / 1000 AS distance_km FROM (SELECT venue_id, donor_id, {VENUE_DONOR_KM} AS km "
    f"FROM venues v, donors d) WHERE km <= {R.PAIR_RADIUS_KM}", extra=f"venues AS ({S.VENUES})")
ORACLE["venue_catchments"] = w(
    f"SELECT v.venue_id, v.venue_type, count(donor_id) AS donor_count, CAST(coalesce(sum({A}), 0) AS DOUBLE) AS total_annual, "
    f"CAST(count_if(coalesce(donor_segment = 'Major Donor', FALSE)) AS BIGINT) AS major_donors, "
    f"floor(min({VENUE_DONOR_KM}) * 1000 + 0.5) / 1000 AS nearest_km "
    f"FROM venues v LEFT JOIN donors d ON {VENUE_DONOR_KM} <= {R.CATCHMENT_KM} GROUP BY v.venue_id, v.venue_type",
    extra=f"venues AS ({S.VENUES})")

CELLS8 = (f"cells AS (SELECT hex_level_8 AS hex_cell, {qr('hex_level_8')[0]} AS q, {qr('hex_level_8')[1]} AS r, count({A}) AS donor_count, "
          f"sum({A}) AS total FROM donors WHERE hex_level_8 IS NOT NULL GROUP BY hex_level_8)")
AROUND = ("around AS (SELECT 'hx8:' || CAST(q + dq AS VARCHAR) || ':' || CAST(r + dr AS VARCHAR) AS hex_cell, donor_count, total, "
          "greatest(abs(dq), abs(dr), abs(dq + dr)) AS ring FROM cells, range(-2, 3) a(dq), range(-2, 3) b(dr) WHERE abs(dq + dr) <= 2), "
          "score AS (SELECT hex_cell, CAST(sum(total * (3 - ring)) AS DOUBLE) AS weighted_total, "
          "CAST(sum(donor_count * (3 - ring)) AS BIGINT) AS weighted_donors, "
          "CAST(coalesce(sum(total) FILTER (ring = 0), 0) AS DOUBLE) AS total_annual, "
          "CAST(coalesce(sum(donor_count) FILTER (ring = 0), 0) AS BIGINT) AS donor_count FROM around GROUP BY hex_cell)")
ORACLE["hex_concentration"] = w("SELECT * FROM score", cells=True, extra=f"{CELLS8}, {AROUND}")
ORACLE["best_venues"] = w(
    "SELECT * FROM (SELECT v.venue_type, v.venue_id, v.venue_name, v.hex_level_8 AS hex_cell, coalesce(weighted_total, 0) AS weighted_total, "
    "coalesce(weighted_donors, 0) AS weighted_donors, coalesce(total_annual, 0) AS cell_total, "
    "CAST(row_number() OVER (PARTITION BY venue_type ORDER BY coalesce(weighted_total, 0) DESC, venue_id) AS INT) AS place "
    "FROM venues v LEFT JOIN score s ON s.hex_cell = v.hex_level_8) WHERE place <= 3",
    cells=True, extra=f"{CELLS8}, {AROUND}, {VENUES_CELL}")
ORACLE["nearest_venues"] = w(
    f"SELECT hex_cell, rank, venue_id, floor(km * 1000 + 0.5) / 1000 AS distance_km FROM (SELECT *, "
    f"CAST(row_number() OVER (PARTITION BY hex_cell ORDER BY km, venue_id) AS INT) AS rank FROM ("
    f"SELECT hex_cell, venue_id, {km('c.lat', 'c.lon', 'v.latitude', 'v.longitude')} AS km FROM ("
    f"SELECT hex_cell, 1.5e0 * r / {S.d(GRID8.ky)} AS lat, {S.d(S.hg.SQRT3)} * (q + r * 0.5e0) / {S.d(GRID8.kx)} AS lon FROM cells) c, venues v)) "
    f"WHERE rank <= 3", cells=True, extra=f"{CELLS8}, venues AS ({S.VENUES})")


def parent(cell: str, prefix: str) -> str:
    q, r = qr(cell)
    return (f"'{prefix}:' || CAST(CAST(round((3 * {q} + {r}) / 7e0) AS BIGINT) AS VARCHAR) || ':' || "
            f"CAST(CAST(round((2 * {r} - {q}) / 7e0) AS BIGINT) AS VARCHAR)")


PARENTS = (f"p8 AS (SELECT *, {parent('hex_level_9', 'hn8')} AS parent_8 FROM donors WHERE hex_level_9 IS NOT NULL), "
           f"p7 AS (SELECT *, {parent('parent_8', 'hn7')} AS parent_7 FROM p8)")
SUMS = f"count(*) AS donor_count, CAST(sum({A}) AS DOUBLE) AS total_annual, CAST(sum({C}) AS DOUBLE) AS total_cumulative FROM p7"
ORACLE["nested_rollup"] = w(
    f"SELECT 9 AS level, hex_level_9 AS hex_cell, any_value(parent_8) AS parent_cell, {SUMS} GROUP BY hex_level_9 UNION ALL "
    f"SELECT 8, parent_8, any_value(parent_7), {SUMS} GROUP BY parent_8 UNION ALL "
    f"SELECT 7, parent_7, NULL, {SUMS} GROUP BY parent_7 UNION ALL SELECT 0, NULL, NULL, {SUMS} HAVING count(*) > 0",
    cells=True, extra=PARENTS)
ORACLE["cell_parents"] = w("SELECT DISTINCT hex_level_9, parent_8, parent_7 FROM p7", cells=True, extra=PARENTS)


def ranks(value: str) -> str:
    return (f"row_number() OVER (ORDER BY {value} DESC NULLS LAST, hex_cell) AS position, rank() OVER (ORDER BY {value} DESC NULLS LAST) AS rank, "
            f"dense_rank() OVER (ORDER BY {value} DESC NULLS LAST) AS dense_rank")


ORACLE["hex_rank_9"] = w(
    f"SELECT *, {ranks('donor_count')} FROM (SELECT hex_level_9 AS hex_cell, count(*) AS donor_count FROM donors "
    f"WHERE hex_level_9 IS NOT NULL GROUP BY hex_level_9)", cells=True)
ORACLE["hex_rank_8"] = w(
    f"SELECT hex_cell, total_annual, donor_count, {ranks('total_annual')} FROM (SELECT hex_cell, CAST(total AS DOUBLE) AS total_annual, donor_count "
    f"FROM cells)", cells=True, extra=CELLS8)
ORACLE["venue_filter_rating"] = (
    f"WITH venues AS ({S.VENUES}) SELECT venue_id, CAST(rating AS DOUBLE) AS rating FROM venues "
    f"WHERE venue_type IN {S.in_list(R.VENUE_TYPES)} AND price_range IN {S.in_list(R.PRICES)} "
    f"AND capacity >= {R.MIN_CAPACITY} AND rating >= {R.RATING}")

# --- full cards, declared types, governed SQL, sketches, incremental jobs -----------------
SHOWN = "coalesce(CAST({} AS VARCHAR), 'None')"
ORACLE["venue_cards_full"] = (
    f"WITH v AS (SELECT *, CAST(substr(venue_id, 7, 6) AS INT) AS k FROM ({S.VENUES})), "
    "f AS (SELECT v.*, n_name AS city, CASE WHEN k % 10 = 0 THEN 'NC' ELSE 'SC' END AS state, "
    "CASE WHEN k % 19 <> 0 THEN '(864) 555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone, "
    "CAST(k % 900 + 1 AS VARCHAR) || ' ' || venue_type || ' Street' AS street_address, "
    "CASE WHEN k % 11 <> 0 THEN venue_type || ' in ' || n_name END AS description, "
    "CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 <> 0 THEN 'https://venues.example.com/' || CAST(k AS VARCHAR) END AS website "
    "FROM v LEFT JOIN nation ON v.zip_code = CAST(29600 + n_nationkey AS VARCHAR)) "
    f"SELECT venue_id, concat_ws(' - ', venue_name, venue_type) AS title, {SHOWN.format('capacity')} AS capacity_text, "
    f"{SHOWN.format('rating')} || '/5.0' AS rating_text, 'Price Range: ' || {SHOWN.format('price_range')} AS price_text, "
    f"'Phone: ' || {SHOWN.format('phone')} AS phone_text, 'Address: ' || {SHOWN.format('street_address')} AS street_address_text, "
    f"'Description: ' || {SHOWN.format('description')} AS description_text, "
    f"{SHOWN.format('city')} || ', ' || {SHOWN.format('state')} || ' ' || {SHOWN.format('zip_code')} AS address_line, "
    "CASE WHEN website <> '' THEN 'Website: ' || website END AS website_text FROM f")
ORACLE["summary_declared"] = w(
    f"SELECT zip_code, hex_level_7, hex_level_8, hex_level_9, CAST(count(*) AS INT) AS donor_count, "
    f"CAST(CAST(sum({A}) AS DECIMAL(15,2)) AS VARCHAR) AS total_annual_donations, "
    f"CAST(CAST(sum({C}) AS DECIMAL(15,2)) AS VARCHAR) AS total_cumulative_donations, "
    f"CAST(CAST({S.mean_half_up(A, 2)} AS DECIMAL(10,2)) AS VARCHAR) AS avg_annual_donation, "
    f"CAST(CAST({S.mean_half_up(C, 2)} AS DECIMAL(12,2)) AS VARCHAR) AS avg_cumulative_donation, "
    f"CAST(count_if({A} >= 10000) AS INT) AS major_donors_count, '{R.REPORT_TIME}' AS created_date "
    f"FROM donors GROUP BY zip_code, hex_level_7, hex_level_8, hex_level_9", cells=True)


def governed_sql(role: str) -> str:
    """What one role sees, from the policies' role lists."""
    from hexgiving.operators import governance as G
    rows = (f"donor_segment = 'Annual Donor'" if role == G.INTERN_ROLE else "TRUE" if role in G.ALL_ROWS_ROLES else "FALSE")
    name = "min(full_name)" if role in G.STRING_CLEAR_ROLES else "'**masked**'"
    number = role in G.NUMBER_CLEAR_ROLES
    return (f"SELECT donor_segment, count(*) AS donors, {name} AS first_name, CAST({'max(age)' if number else '0'} AS INT) AS oldest, "
            f"CAST({f'sum({A})' if number else '0'} AS DOUBLE) AS total_annual, '{role}' AS role FROM donors WHERE {rows} GROUP BY donor_segment")


ORACLE["sql_governed"] = w(" UNION ALL ".join(governed_sql(r) for r in R.ROLES))
ORACLE["sketch_counts"] = w("SELECT zip_code, count(DISTINCT hex_level_9) AS distinct_cells, count(DISTINCT donor_id) AS distinct_donors, "
                            "TRUE AS within_error FROM donors GROUP BY zip_code", cells=True)
ORACLE["delta_stream"] = ORACLE["donor_summary"]
ORACLE["incremental_load"] = w(
    f"SELECT zip_code, hex_level_8, donor_segment, count(*) AS donor_count, count(DISTINCT donor_id) AS distinct_donors, "
    f"CAST(sum({A}) AS DOUBLE) AS total_annual FROM donors GROUP BY zip_code, hex_level_8, donor_segment", cells=True)
