"""Queries: location features.  The SQL side is brute force over all regions."""

from pyspark.sql import functions as F

from checks.cleaning import CLEAN
from checks.registry import query
from checks.views import oracle, view
from sward.functions import geo
from sward.operators import regions as G
from sward.session import cut_lineage
from sward.sources import readers as R

POINTS = """
SELECT plot_id, lon, lat, 6378137 * radians(lon) AS x, 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM v_header"""
CORNERS = """
SELECT geom_id, name, code, k, 6378137 * radians(lon) AS x, 6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y FROM v_corners"""
EDGES = """
SELECT a.geom_id, a.name, a.code, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
FROM corners a JOIN corners b ON a.geom_id = b.geom_id AND b.k = (a.k + 1) % 4"""
MEASURED = """
SELECT plot_id, geom_id, name, code, min(sqrt(pow(x - px, 2) + pow(y - py, 2))) AS edge_dist, sum(cast(crossing AS int)) % 2 = 1 AS inside FROM (
  SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM (
    SELECT p.plot_id, p.x, p.y, e.*,
      greatest(least(((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)), 1.0e0), 0.0e0) AS t,
      ((y1 > p.y) <> (y2 > p.y)) AND p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1 AS crossing
    FROM points p, edges e) a) b GROUP BY ALL"""
BOXED = """
SELECT p.plot_id, b.geom_id, round(sqrt(pow(greatest(x0 - x, x - x1, 0.0e0), 2) + pow(greatest(y0 - y, y - y1, 0.0e0), 2)), 6) AS box_dist
FROM points p, (SELECT geom_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM corners GROUP BY geom_id) b"""
NEAREST = """
SELECT plot_id, name FROM (
  SELECT plot_id, name, row_number() OVER (PARTITION BY plot_id ORDER BY CASE WHEN inside THEN 0 ELSE edge_dist END, geom_id) AS rn
  FROM (SELECT *, min(box_dist) OVER (PARTITION BY plot_id) AS best FROM boxed) b JOIN measured USING (plot_id, geom_id)
  WHERE box_dist = best) t WHERE rn = 1"""
COAST = """
SELECT plot_id, coalesce(grp, 'N_COAST') AS coast FROM points LEFT JOIN (
  SELECT plot_id, arg_min(grp, {'d': edge_dist, 'g': grp}) AS grp FROM (
    SELECT plot_id, edge_dist, CASE WHEN geom_id >= 20 THEN NULL ELSE concat('SEA_', geom_id % 5) END AS grp FROM measured) m
  WHERE grp IS NOT NULL AND edge_dist <= 5000 GROUP BY plot_id) c USING (plot_id)"""
GEO = dict(points=POINTS, corners=CORNERS, edges=EDGES, measured=MEASURED)
VIEWS = ("v_header", "v_corners")

# Groups of the query's lines; the last five regions belong to none.
LINE_GROUPS = {f"SEA_{g}": [f"NATION_{n}" for n in range(g, 20, 5)] for g in range(5)}


def polygons(spark, name_col="name"):
    point = F.struct("k", "lon", "lat")
    ring = F.array_sort(F.collect_list(point)).alias("ring")
    flat = view(spark, "v_corners").groupBy("geom_id", F.col(name_col).alias("name")).agg(ring)
    pairs = F.transform("ring", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    # Written once, as a stored polygon table would be.
    return cut_lineage(R.load_polygons(flat.withColumn("rings", F.array(pairs)), "name"))


def plots(spark):
    return view(spark, "v_header").select("plot_id", "lon", "lat")


@query("load_polygons", oracle("""
SELECT geom_id, name, count(*) AS corners, round(min(x), 2) AS x0, round(max(y), 2) AS y1 FROM corners GROUP BY geom_id, name""",
    "v_corners", corners=CORNERS))
def _(spark):
    json = polygons_json(spark)
    edges = G.ring_edges(R.load_polygons(json, "name"))
    return edges.groupBy("geom_id", "name").agg(
        F.count(F.lit(1)).alias("corners"), F.round(F.min("x1"), 2).alias("x0"),
        F.round(F.max("y1"), 2).alias("y1"),
    )


def polygons_json(spark):
    ring = F.array_sort(F.collect_list(F.struct("k", "lon", "lat")))
    return view(spark, "v_corners").groupBy("geom_id", "name").agg(
        F.to_json(F.array(ring)).alias("rings")
    )


@query("nearest_region", oracle("SELECT plot_id, name FROM nearest", *VIEWS, **GEO, boxed=BOXED, nearest=NEAREST))
def _(spark):
    return G.locate(plots(spark), countries=polygons(spark)).select("plot_id", F.col("country").alias("name"))


@query("nearest_region_exact", oracle("""
SELECT plot_id, name FROM (
  SELECT plot_id, name, row_number() OVER (
    PARTITION BY plot_id ORDER BY CASE WHEN inside THEN 0 ELSE round(edge_dist, 6) END, geom_id) AS rn
  FROM measured) t WHERE rn = 1""", *VIEWS, **GEO))
def _(spark):
    out = G.locate(plots(spark), countries=polygons(spark), mode="exact")
    return out.select("plot_id", F.col("country").alias("name"))


@query("within_regions", oracle("""
SELECT plot_id, CASE WHEN bool_or(inside) THEN 'Y_DUNES' ELSE 'N_DUNES' END AS dune FROM measured
WHERE code IN ('P1','P2','P3','P4','P5','P6','P7','P8','P9','P10','P11','P12','P13','P14','P15','P16') GROUP BY plot_id""", *VIEWS, **GEO))
def _(spark):
    dunes = G.dune_polygons(polygons(spark, "code"))
    return G.locate(plots(spark), dunes=dunes).select("plot_id", "dune")


@query("nearest_line_within", oracle("SELECT plot_id, coast FROM coast", *VIEWS, **GEO, coast=COAST))
def _(spark):
    lines = G.dissolve(G.ring_edges(polygons(spark)), LINE_GROUPS)
    return G.locate(plots(spark), coasts=lines).select("plot_id", "coast")


@query("dissolve_lines", oracle("""
SELECT concat('SEA_', geom_id % 5) AS grp, count(*) AS edges FROM edges WHERE geom_id < 20 GROUP BY 1""", "v_corners", corners=CORNERS, edges=EDGES))
def _(spark):
    lines = G.dissolve(G.ring_edges(polygons(spark)), LINE_GROUPS)
    return lines.groupBy("grp").agg(F.count(F.lit(1)).alias("edges"))


# A raster of 50 columns over a part of the plots' extent, rows from north to south.
RASTER_VALUE = """
SELECT plot_id, CASE WHEN value = 32767 THEN 0 ELSE value END AS altitude FROM (
  SELECT plot_id, cast(greatest(0, least(floor((y - 1.0e7) / (-4.0e6 / n)), n - 1)) AS int) AS row,
    cast(greatest(0, least(floor((x + 1.0e6) / 8.0e4), 49)) AS int) AS col
  FROM points, (SELECT max(row) + 1 AS n FROM v_raster) r) p JOIN v_raster USING (row, col)"""


def raster(spark):
    cells = R.load_raster_cells(view(spark, "v_raster"))
    rows = cells.agg(F.max("row") + 1).scalar()
    # Written once, as a stored raster would be.
    return cut_lineage(R.tile_raster(cells)), G.GeoTransform(-1.0e6, 1.0e7, 8.0e4, -4.0e6 / rows, rows, 50)


@query("raster_value", oracle(RASTER_VALUE, "v_header", "v_raster", points=POINTS))
def _(spark):
    return G.locate(plots(spark), raster=raster(spark)).select("plot_id", "altitude")


@query("locate_plots", oracle("""
SELECT plot_id, altitude, n.name AS country, dune, coast FROM raster_values JOIN nearest n USING (plot_id) JOIN coast USING (plot_id)
JOIN (SELECT plot_id, CASE WHEN bool_or(inside AND regexp_full_match(code, 'P([1-9]|1[0-6])')) THEN 'Y_DUNES' ELSE 'N_DUNES' END AS dune
  FROM measured GROUP BY plot_id) d USING (plot_id)""",
    *VIEWS, "v_raster", **GEO, boxed=BOXED, nearest=NEAREST, coast=COAST, raster_values=RASTER_VALUE))
def _(spark):
    shapes = polygons(spark)
    out = G.locate(
        plots(spark), raster=raster(spark), countries=shapes,
        dunes=G.dune_polygons(polygons(spark, "code")),
        coasts=G.dissolve(G.ring_edges(shapes), LINE_GROUPS),
    )
    return out.select("plot_id", "altitude", "country", "dune", "coast")


@query("bbox_filter", oracle("""
SELECT plot_id FROM clean WHERE lon BETWEEN 3.376716 AND 4.376716 AND lat BETWEEN 43.360769 AND 43.860769""", "v_header", clean=CLEAN))
def _(spark):
    from sward.operators.cleaning import clean_header
    from sward.operators.reports import bbox_filter

    return bbox_filter(clean_header(view(spark, "v_header")), (3.876716, 43.610769)).select("plot_id")


@query("extent", oracle("""
SELECT round(min(x) - 0.05 * (max(x) - min(x)), 2) AS x0, round(max(x) + 0.05 * (max(x) - min(x)), 2) AS x1,
  round(min(y) - 0.05 * (max(y) - min(y)), 2) AS y0, round(max(y) + 0.05 * (max(y) - min(y)), 2) AS y1 FROM points""",
    "v_header", points=POINTS))
def _(spark):
    from sward.operators.reports import extent

    df = extent(plots(spark), 0.05)
    return df.select([F.round(c, 2).alias(c) for c in df.columns])


@query("box_and_segment_distance", oracle("""
SELECT plot_id, min(edge_dist) < 20000 AS near, count(*) FILTER (inside) AS inside FROM measured GROUP BY plot_id""", *VIEWS, **GEO))
def _(spark):
    lines = G.dissolve(G.ring_edges(polygons(spark)), {"line": [f"NATION_{n}" for n in range(25)]})
    points = G.sites(plots(spark))
    near = G.nearest_within(points, lines, 20000.0, "far", "line")
    shapes = G.outlines(polygons(spark))
    boxed = G._boxes_over(points, shapes.select(*G.BOX), G.REGION_CELL)
    bands = G._edge_bands(shapes, G.BAND)
    tested = G.projected(boxed).withColumn("band", F.floor(F.col("y") / G.BAND)).join(bands, ["geom_id", "band"], "left")
    inside = geo.inside_edges(F.col("x"), F.col("y"), F.col("edges"))
    counts = tested.groupBy("lon", "lat").agg(F.count(F.when(inside, 1)).alias("inside"))
    out = plots(spark).join(near, ["lon", "lat"]).join(counts, ["lon", "lat"])
    return out.select("plot_id", (F.col("line") != "far").alias("near"), "inside")
