import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hexgiving.functions import hexgrid as hg
from hexgiving.operators import hexmap

points = st.lists(st.tuples(st.floats(34.0, 35.5), st.floats(-83.0, -81.5)), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(points, st.sampled_from([7, 8, 9]))
def test_cell_of_a_cells_centre_is_that_cell(spark, pts, res):
    grid = hg.GRIDS[res]
    df = spark.createDataFrame(pts, "latitude double, longitude double")
    cells = hg.with_cell(df, grid, "c")
    centres = hg.with_centre(cells, "c", grid, "latitude", "longitude").withColumnRenamed("c", "orig")
    back = hg.with_cell(centres, grid, "again")
    bad = back.where(F.col("orig") != F.col("again")).count()
    assert bad == 0


def test_null_point_gives_null_cell(spark):
    df = spark.createDataFrame([(None, -82.0), (34.8, None), (34.8, -82.4)], "latitude double, longitude double")
    out = [r.c for r in hg.with_cell(df, hg.GRIDS[8], "c").collect()]
    assert out[0] is None and out[1] is None and out[2].startswith("hx8:")


def test_point_lies_within_its_hexagon(spark):
    # distance (in edge units) from a point to its cell centre is at most one edge
    grid = hg.GRIDS[8]
    pts = [(34.6 + i * 0.0037, -82.6 + i * 0.0041) for i in range(200)]
    df = hg.with_cell(spark.createDataFrame(pts, "latitude double, longitude double"), grid, "c")
    df = hg.with_centre(df, "c", grid)
    for r in df.collect():
        dx = (r.longitude - r.centre_lon) * grid.kx
        dy = (r.latitude - r.centre_lat) * grid.ky
        assert math.hypot(dx, dy) <= 1.0 + 1e-9


def test_six_corners_at_one_edge_from_centre(spark):
    grid = hg.GRIDS[9]
    df = hg.with_cell(spark.createDataFrame([(34.85, -82.39)], "latitude double, longitude double"), grid, "c")
    centre = hg.with_centre(df, "c", grid).collect()[0]
    corners = hg.corner_rows(df, "c", grid, digits=12).collect()
    assert sorted(r.corner for r in corners) == list(range(6))
    for r in corners:
        d = math.hypot((r.lon - centre.centre_lon) * grid.kx, (r.lat - centre.centre_lat) * grid.ky)
        assert abs(d - 1.0) < 1e-6


def test_boundaries_wkt_closes_ring_and_parses_back(spark):
    cells = hg.with_cell(spark.createDataFrame([(34.85, -82.39), (34.9, -82.2)], "latitude double, longitude double"),
                         hg.GRIDS[8], "hex_cell").select("hex_cell")
    b = hexmap.cell_boundaries(cells, 8)
    wkts = {r.hex_cell: r.wkt for r in b.collect()}
    for w in wkts.values():
        body = w[len("POLYGON(("):-2].split(", ")
        assert len(body) == 7 and body[0] == body[-1]
    parsed = hexmap.parse_polygon(b.where("corner = 0"))
    rings = {r.hex_cell: r.ring for r in parsed.collect()}
    assert all(len(r) == 7 for r in rings.values())


def test_parse_polygon_skips_bad_pairs_and_short_rings(spark):
    df = spark.createDataFrame([("a", "POLYGON((1 2, x y, 3 4, 5 6))"), ("b", "POLYGON((1 2, 3 4))"),
                                ("c", "not a polygon")], "id string, wkt string")
    out = {r.id: r.ring for r in hexmap.parse_polygon(df).collect()}
    assert list(out) == ["a"]
    assert [(p.lat, p.lon) for p in out["a"]] == [(2.0, 1.0), (4.0, 3.0), (6.0, 5.0)]


def test_rollup_counts_add_up_to_valid_points(edge_donors):
    r = hexmap.hex_rollup(edge_donors, 8)
    total = r.agg(F.sum("donor_count")).collect()[0][0]
    assert total == hexmap.valid_points(edge_donors, hexmap.POINT_COLUMNS).count()


def test_colours_scale_by_max(spark):
    rollup = spark.createDataFrame([("a", 100.0, 1.0, 1.0), ("b", 50.0, 1.0, 1.0), ("c", 0.0, 0.0, 0.0)],
                                   "hex_cell string, total_annual double, avg_annual double, total_cumulative double")
    out = {r.hex_cell: r for r in hexmap.hex_colours(rollup).collect()}
    assert (out["a"].red, out["a"].green, out["a"].blue) == (255, 0, 0)
    assert (out["c"].red, out["c"].green, out["c"].blue) == (204, 153, 51)
    assert out["b"].opacity == 0.5 and out["c"].opacity == 0.3 and out["a"].opacity == 0.8
