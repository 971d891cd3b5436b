import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sward.functions import geo
from sward.operators import folds as S
from sward.operators import regions as G
from sward.sources import readers as R


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_grid_coordinates(spark):
    assert one(spark, geo.easting_km(F.lit(-1.0))) == pytest.approx(40075.017 - 6378.137 * math.pi / 180, abs=1e-9)
    assert one(spark, geo.northing_km(F.lit(90.0))) == pytest.approx(10001.965729, abs=1e-6)
    assert one(spark, geo.northing_km(F.lit(-10))) == pytest.approx(
        geo.MERIDIAN_KM - one(spark, geo.northing_km(F.lit(10.0))), abs=1e-9
    )
    assert one(spark, F.format_string("e%04dn%04d", F.lit(12345), F.lit(7))) == "e12345n0007"


def test_bins_reject_bad_input(spark):
    with pytest.raises(ValueError):
        geo.bin_index(F.lit(1.0), 0)
    with pytest.raises(Exception, match="negative"):
        one(spark, geo.bin_index(F.lit(-1.0), 10))


def plots(spark, *points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "plot_id long, lon double, lat double")


def lonlat(x, y):
    r = geo.MERCATOR_RADIUS
    return math.degrees(x / r), math.degrees(2 * math.atan(math.exp(y / r)) - math.pi / 2)


def shapes(spark, *polygons):
    data = [(i, n, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, (n, rings) in enumerate(polygons)]
    return spark.createDataFrame(data, "geom_id int, name string, rings array<array<struct<x:double,y:double>>>")


def test_folds_are_near_equal_and_whole(spark):
    df = plots(spark, *[(0.2 * i, 45.0) for i in range(23)], *[(0.2 * i + 0.0001, 45.0) for i in range(23)])
    out = S.assign_folds(df, 10, seed=1).persist()
    sizes = sorted(r["blocks"] for r in S.block_summary(out).collect())
    assert sizes == [2] * 7 + [3] * 3
    assert out.groupBy("block_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    again = S.assign_folds(df.repartition(7), 10, seed=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))


def test_more_folds_than_blocks(spark):
    out = S.assign_folds(plots(spark, (1.0, 45.0), (2.0, 45.0), (3.0, 45.0)), 10, seed=1)
    assert sorted(r["fold"] for r in out.collect()) == [0, 1, 2]


def test_nearest_region_prefers_the_nearest_box(spark, rows):
    # An L-shaped region whose box covers the point, and a square nearer to it but outside.
    ell = [[(0, 0), (1e6, 0), (1e6, 1e5), (1e5, 1e5), (1e5, 1e6), (0, 1e6)]]
    square = [[(1.01e6, 9e5), (1.2e6, 9e5), (1.2e6, 1.1e6), (1.01e6, 1.1e6)]]
    df = plots(spark, lonlat(9.9e5, 9.5e5), lonlat(1.1e6, 1e6), lonlat(-5e6, -3e6), lonlat(8e6, 9e6))
    out = G.locate(df, countries=shapes(spark, ("L", ell), ("S", square)))
    assert rows(out, "plot_id", "country") == [(0, "L"), (1, "S"), (2, "L"), (3, "S")]


def test_exact_mode_finds_the_nearest_polygon(spark, rows):
    # The box of the L covers the first point, but the square is nearer.
    ell = [[(0, 0), (1e6, 0), (1e6, 1e5), (1e5, 1e5), (1e5, 1e6), (0, 1e6)]]
    square = [[(1.01e6, 9e5), (1.2e6, 9e5), (1.2e6, 1.1e6), (1.01e6, 1.1e6), (1.01e6, 9e5)]]
    df = plots(spark, lonlat(9.9e5, 9.5e5), lonlat(1.1e6, 1e6), lonlat(-5e6, -3e6), lonlat(8e6, 9e6), (0.0, 0.0))
    regions = shapes(spark, ("L", ell), ("S", square))
    out = G.locate(df, countries=regions, mode="exact")
    assert rows(out, "plot_id", "country") == [(0, "S"), (1, "S"), (2, "L"), (3, "S"), (4, "L")]
    assert rows(G.locate(df, countries=regions), "plot_id", "country")[0] == (0, "L")
    assert G.nearest_polygon(G.sites(df), regions.where("false")).count() == 0


def test_exact_mode_against_brute_force(spark):
    rng = np.random.default_rng(9)
    triangles = rng.uniform(-6e6, 6e6, (40, 1, 2)) + rng.uniform(-1.5e6, 1.5e6, (40, 3, 2))
    triangles[1] = triangles[0]  # equal distances go to the lowest id
    regions = shapes(spark, *[(str(i), [[tuple(p) for p in t]]) for i, t in enumerate(triangles)])
    at = np.concatenate([rng.uniform(-1.2e7, 1.2e7, (150, 2)), rng.uniform(-6e6, 6e6, (250, 2))])
    df = plots(spark, *[lonlat(x, y) for x, y in at])
    got = {r["plot_id"]: int(r["country"]) for r in G.locate(df, countries=regions, mode="exact").collect()}
    differs = {r["plot_id"]: int(r["country"]) for r in G.locate(df, countries=regions).collect()}
    for i, p in enumerate(at):
        far = []
        for t in triangles:
            a, b = t, np.roll(t, -1, axis=0)
            k = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
            side = (b - a)[:, 0] * (p - a)[:, 1] - (b - a)[:, 1] * (p - a)[:, 0]
            within = (side > 0).all() or (side < 0).all()
            far.append(0.0 if within else np.hypot(*(p - a - k[:, None] * (b - a)).T).min())
        assert got[i] == int(np.argmin(np.round(far, 4)))
    assert got != differs


def test_cells_of_long_edges(spark):
    """A diagonal passes cells along its length; few edges are left to be measured per cell."""
    edges = spark.createDataFrame([(0, 0.0, 0.0, 5e6, 5e6)], "geom_id int, x1 double, y1 double, x2 double, y2 double")
    finest = G._edge_levels(edges, 1e5).where("level = 0")
    assert 51 <= finest.count() <= 210
    many = spark.range(200).selectExpr("cast(id AS int) AS geom_id", "id * 1e6 AS x1", "0D AS y1", "id * 1e6 AS x2", "5e5 AS y2")
    cell = spark.createDataFrame([(0, 0), (57, 3)], "cx long, cy long")
    assert G._edges_near(cell, many, 1e5).select("cx", "geom_id").distinct().count() <= 4


def test_nearest_region_with_random_boxes(spark):
    rng = np.random.default_rng(5)
    corner = rng.uniform(-8e6, 8e6, (30, 2))
    size = rng.uniform(1e5, 9e5, (30, 2))
    boxes = [(str(i), [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]]) for i, ((x, y), (w, h)) in enumerate(zip(corner, size))]
    at = rng.uniform(-1.4e7, 1.4e7, (300, 2))
    df = plots(spark, *[lonlat(x, y) for x, y in at])
    got = {r["plot_id"]: int(r["country"]) for r in G.locate(df, countries=shapes(spark, *boxes)).collect()}
    for i, (x, y) in enumerate(at):
        d = np.maximum(np.maximum(corner[:, 0] - x, x - corner[:, 0] - size[:, 0]), 0) ** 2
        d = d + np.maximum(np.maximum(corner[:, 1] - y, y - corner[:, 1] - size[:, 1]), 0) ** 2
        # Rectangles fill their boxes: all that contain the point tie and the lowest id wins.
        assert got[i] == int(np.argmin(d))


def test_containment_is_strict_and_knows_holes(spark, rows):
    ring = [(-1e5, -1e5), (1e5, -1e5), (1e5, 1e5), (-1e5, 1e5), (-1e5, -1e5)]
    hole = [(-2e4, -2e4), (2e4, -2e4), (2e4, 2e4), (-2e4, 2e4)]
    df = plots(spark, lonlat(5e4, 5e4), (0.0, 0.0), lonlat(3e5, 0), lonlat(0, 5e4))
    out = G.locate(df, dunes=shapes(spark, ("P1", [ring, hole])))
    assert [d for _, d in rows(out, "plot_id", "dune")] == ["Y_DUNES", "N_DUNES", "N_DUNES", "Y_DUNES"]
    edge = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double")
    side = shapes(spark, ("P1", [[(0, -1e5), (1e5, -1e5), (1e5, 1e5), (0, 1e5)]]))
    assert G.dune_label(edge, side).first()["dune"] == "N_DUNES"


def test_coast_reach_is_inclusive(spark, rows):
    lines = spark.createDataFrame(
        [("B", 5000.0, -1e5, 5000.0, 1e5), ("A", -5000.0, -1e5, -5000.0, 1e5)],
        "grp string, x1 double, y1 double, x2 double, y2 double",
    )
    point = spark.createDataFrame([(0.0, 0.0)], "lon double, lat double")
    assert G.nearest_within(point, lines).first()["coast"] == "A"
    assert G.nearest_within(point, lines, reach=4999.99).first()["coast"] == "N_COAST"


def test_coast_against_brute_force(spark):
    rng = np.random.default_rng(7)
    ends = rng.uniform(-2e5, 2e5, (40, 4))
    lines = spark.createDataFrame([(f"G{i % 5}", *map(float, e)) for i, e in enumerate(ends)], "grp string, x1 double, y1 double, x2 double, y2 double")
    at = rng.uniform(-2.2e5, 2.2e5, (400, 2))
    df = plots(spark, *[lonlat(x, y) for x, y in at])
    got = {r["plot_id"]: r["coast"] for r in G.locate(df, coasts=lines).collect()}
    for i, p in enumerate(at):
        a, b = ends[:, :2], ends[:, 2:]
        t = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
        d = np.hypot(*(p - a - t[:, None] * (b - a)).T)
        want = f"G{int(np.argmin(d)) % 5}" if d.min() <= 5000 else "N_COAST"
        assert got[i] == want


def test_sea_names_map_to_groups(spark, rows):
    lines = spark.createDataFrame([("North Sea",), ("Kattegat",), ("Lake",)], "name string")
    assert rows(G.dissolve(lines), "name", "grp") == [("Kattegat", "BAL_COAST"), ("North Sea", "ATL_COAST")]
    assert sum(map(len, G.COAST_GROUPS.values())) == 33


def test_raster_clamps(spark, rows):
    cells = spark.createDataFrame([(r, c, 10 * r + c) for r in range(2) for c in range(3)], "row int, col int, value int")
    grid = G.GeoTransform(0.0, 2e5, 1e5, -1e5, 2, 3)
    df = plots(spark, lonlat(1.5e5, 0.5e5), lonlat(-9e5, 9e5), lonlat(9e5, -9e5))
    out = G.locate(df, raster=(cells, grid))
    assert rows(out, "plot_id", "altitude") == [(0, 11), (1, 0), (2, 12)]


def test_tiles_equal_cells(spark, rows):
    """Tiles of any size, cells that are missing, and a lookup without a row per cell."""
    rng = np.random.default_rng(6)
    values = {(r, c): int(v) for (r, c), v in zip(((r, c) for r in range(23) for c in range(31)), rng.integers(0, 99, 713)) if v % 9}
    cells = spark.createDataFrame([(r, c, v) for (r, c), v in values.items()], "row int, col int, value int")
    grid = G.GeoTransform(0.0, 23e4, 1e4, -1e4, 23, 31)
    at = [(float(x), float(y)) for x, y in rng.uniform(-2e4, 34e4, (200, 2))]
    points = G.sites(plots(spark, *[lonlat(x, y) for x, y in at]))
    placed = G.projected(points)
    expected = {}
    for p in placed.collect():
        row = min(max(math.floor((p["y"] - 23e4) / -1e4), 0), 22)
        expected[p["lon"], p["lat"]] = values.get((row, min(max(math.floor(p["x"] / 1e4), 0), 30)))
    for tile in (1, 8, 64):
        tiles = R.tile_raster(cells, tile)
        got = {(r["lon"], r["lat"]): r["altitude"] for r in G.raster_value(points, tiles, grid).collect()}
        assert got == expected and tiles.count() == math.ceil(23 / tile) * math.ceil(31 / tile) - (tile == 1) * (713 - len(values))


def test_plots_without_coordinates_stay(spark):
    df = plots(spark, (None, 1.0), (1.0, 45.0))
    lines = spark.createDataFrame([("A", 0.0, 0.0, 1.0, 1.0)], "grp string, x1 double, y1 double, x2 double, y2 double")
    assert G.locate(df, coasts=lines).count() == 2


def test_cover_spares_ray_tests(spark):
    """The same answers at every depth, and fewer sites in cells that an edge passes."""
    rng = np.random.default_rng(3)
    turns = np.linspace(0, 2 * math.pi, 60, endpoint=False)
    ring = [(2e6 * math.cos(t) * (1 + 0.2 * math.sin(5 * t)), 2e6 * math.sin(t)) for t in turns]
    hole = [(5e5, 0), (9e5, 2e5), (6e5, 7e5)]
    regions = shapes(spark, ("P1", [ring, hole]), ("P2", [[(1e6, 1e6), (3e6, 1.2e6), (2e6, 3e6)]]))
    points = G.sites(plots(spark, *[lonlat(x, y) for x, y in rng.uniform(-3.5e6, 3.5e6, (600, 2))])).persist()
    outlines = G.outlines(regions)
    answers, shares = [], []
    for depth in (0, 2, 4):
        answers.append(sorted(map(tuple, G.within_any(points, regions, depth=depth).collect())))
        over = G._cells_over(points, G.cell_cover(outlines, G.REGION_CELL, depth), G.REGION_CELL, depth)
        assert over.where("geom_id IS NOT NULL").groupBy(*G.SITE, "geom_id").count().where("count > 1").count() == 0
        shares.append(over.where("NOT full").select(*G.SITE).distinct().count() / 600)
    assert answers[0] == answers[1] == answers[2] and shares[0] > shares[1] > shares[2] and shares[2] < 0.06
    rays = G.projected(points).crossJoin(outlines.select("edges"))  # two polygons
    brute = rays.groupBy(*G.SITE).agg(F.max(geo.inside_edges(F.col("x"), F.col("y"), F.col("edges"))).alias("within"))
    assert answers[0] == sorted(map(tuple, brute.collect()))
