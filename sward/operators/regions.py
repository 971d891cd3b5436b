"""Location features: nearest region, containment, nearby lines and raster values.

All lookups run on *sites*, the distinct coordinates of the plots, so that a coordinate shared
by many plots is worked out once.  Candidates come from equi-joins on grid cells; geometry is
evaluated on candidates only.
"""

from dataclasses import dataclass

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from sward.functions import geo
from sward.functions.text import yes_no
from sward.session import cut_lineage
from sward.sources.readers import tile_raster

# Sites are keyed by their coordinates alone, so that one shuffle by them serves every lookup;
# the projection is worked out again where it is needed.
SITE = ["lon", "lat"]

# Vegetation-map codes that count as dunes.
DUNE_CODES = [f"P{i}" for i in range(1, 17)]

# Bodies of water by coast group.
COAST_GROUPS = {
    "ARC_COAST": [
        "White Sea", "Arctic Ocean", "Barentsz Sea", "Kara Sea", "Laptev Sea", "Norwegian Sea",
    ],
    "ATL_COAST": [
        "Strait of Gibraltar", "Bristol Channel", "Irish Sea and St. George's Channel",
        "Inner Seas off the West Coast of Scotland", "North Atlantic Ocean", "Bay of Biscay",
        "Celtic Sea", "English Channel", "North Sea", "Skagerrak",
    ],
    "BAL_COAST": [
        "Gulf of Riga", "Baltic Sea", "Gulf of Finland", "Gulf of Bothnia", "Kattegat",
    ],
    "BLA_COAST": ["Black Sea", "Sea of Azov"],
    "MED_COAST": [
        "Alboran Sea", "Ionian Sea", "Tyrrhenian Sea", "Adriatic Sea",
        "Mediterranean Sea - Eastern Basin", "Aegean Sea", "Sea of Marmara",
        "Balearic (Iberian Sea)", "Mediterranean Sea - Western Basin", "Ligurian Sea",
    ],
}
COAST_DISTANCE = 5000.0
NO_COAST = "N_COAST"
DUNE, NO_DUNE = "Y_DUNES", "N_DUNES"

REGION_CELL = 100_000.0
BAND = 50_000.0
# Halvings of a region cell down to the finest cells of a polygon's cover.
COVER_DEPTH = 3
# Width that the coarsest of the doubling grids has for a cell, in metres: several times the
# projected world, so that one neighbourhood covers it.
TOP_CELL = 204_800_000.0


def sites(plots):
    """Distinct complete coordinates of the plots."""
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return plots.select(*SITE).where(known).distinct()


def projected(points):
    """Sites with their projected coordinates ``x`` and ``y``."""
    return points.withColumns(
        {"x": geo.mercator_x(F.col("lon")), "y": geo.mercator_y(F.col("lat"))}
    )


def outlines(polygons):
    """One row per polygon: ``geom_id, name``, its edges as an array and its bounding box.

    Rings may be open or closed: the edge that closes a closed ring has no length.
    """

    def edges(ring):
        def edge(p, i):
            q = F.get(ring, (i + 1) % F.size(ring))
            return F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
            )

        return F.transform(ring, edge)

    shapes = polygons.select("geom_id", "name", F.flatten(F.transform("rings", edges)).alias("edges"))
    return shapes.select(
        "*",
        F.array_min("edges.x1").alias("x0"), F.array_min("edges.y1").alias("y0"),
        F.array_max("edges.x1").alias("x1"), F.array_max("edges.y1").alias("y1"),
    )


def ring_edges(polygons):
    """Edges of all rings: ``(geom_id, name, x1, y1, x2, y2)``."""
    return outlines(polygons).select("geom_id", "name", F.inline("edges"))


BOX = ["geom_id", "x0", "y0", "x1", "y1"]


def _steps(low, high):
    return F.sequence(low.cast("long"), high.cast("long"))


def _box_cells(boxes, size):
    """Boxes repeated for each grid cell they touch."""
    wide = boxes.withColumn(
        "cx", F.explode(_steps(geo.cell(F.col("x0"), size), geo.cell(F.col("x1"), size)))
    )
    return wide.withColumn(
        "cy", F.explode(_steps(geo.cell(F.col("y0"), size), geo.cell(F.col("y1"), size)))
    )


def _with_cell(points, size):
    df = projected(points)
    return df.withColumns({"cx": geo.cell(F.col("x"), size), "cy": geo.cell(F.col("y"), size)})


def _boxes_over(points, boxes, size):
    """Points left-joined with the boxes that contain them."""
    p = _with_cell(points, size).alias("p")
    b = _box_cells(boxes, size).alias("b")
    covered = F.col("p.x").between(F.col("b.x0"), F.col("b.x1")) & F.col("p.y").between(
        F.col("b.y0"), F.col("b.y1")
    )
    same = (F.col("p.cx") == F.col("b.cx")) & (F.col("p.cy") == F.col("b.cy"))
    return p.join(b, same & covered, "left").select(
        *[F.col(f"p.{c}") for c in SITE], F.col("b.geom_id")
    )


def _top_level(size):
    """Coarsest level of the doubling grid over cells of ``size`` metres."""
    return max(0, math.ceil(math.log2(TOP_CELL / size)))


def _neighbourhood(cells, keep):
    """Keys of the 3 x 3 neighbourhood of each cell at its level of the doubling grid."""
    scaled = cells.selectExpr(
        *keep, "level", "floor(cx / pow(2.0D, level)) AS px", "floor(cy / pow(2.0D, level)) AS py"
    )
    wide = scaled.selectExpr(*keep, "level", "py", "explode(sequence(px - 1, px + 1)) AS kx")
    return wide.selectExpr(*keep, "level", "kx", "explode(sequence(py - 1, py + 1)) AS ky")


def _box_levels(boxes, size):
    """Boxes keyed by every cell they touch on every level of the doubling grid."""
    levels = boxes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_top_level(size)))))
    step = F.pow(F.lit(2.0), F.col("level")) * size

    def span(low, high):
        return F.explode(_steps(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))

    return levels.withColumn("kx", span("x0", "x1")).withColumn("ky", span("y0", "y1"))


def _around(cells, index, size):
    """Rows of ``index`` that can be nearest to a point of each cell, keyed by ``(cx, cy)``.

    For each cell the finest level is found whose neighbourhood touches a row of the index.  That
    row is nearer than 4 cells of that level, and every row as near as that lies in the
    neighbourhood two levels up, so what is taken there is complete.
    """
    tried = cells.selectExpr("cx", "cy", f"explode(sequence(0, {_top_level(size)})) AS level")
    found = (
        _neighbourhood(tried, ["cx", "cy"])
        .join(index.select("level", "kx", "ky"), ["level", "kx", "ky"], "left_semi")
        .groupBy("cx", "cy")
        .agg(F.least(F.min("level") + 2, F.lit(_top_level(size))).alias("level"))
    )
    return _neighbourhood(found, ["cx", "cy"]).join(index, ["level", "kx", "ky"])


def _boxes_near(cells, boxes, size):
    """Per cell the boxes that can be nearest to a point of it: ``(cx, cy, boxes)``."""
    near = _around(cells, _box_levels(boxes, size), size)
    # Distinct polygons per cell: bounded by the number of polygons.
    return near.groupBy("cx", "cy").agg(F.collect_set(F.struct(*BOX)).alias("boxes"))


def _edge_levels(edges, size):
    """Edges keyed by every cell they pass on every level of the doubling grid.

    Each column of cells only takes the heights the edge has in it, so a long diagonal costs cells
    along its length.  A quarter of a cell of slack covers rounding of the heights.
    """
    levels = edges.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_top_level(size)))))
    step = F.pow(F.lit(2.0), F.col("level")) * size
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    wide = levels.withColumn("kx", F.explode(_steps(F.floor(left / step), F.floor(right / step))))
    slope = F.try_divide(y2 - y1, x2 - x1)

    def height(x):
        return F.coalesce(y1 + (x - x1) * slope, y1)

    from_x, to_x = F.greatest(left, F.col("kx") * step), F.least(right, (F.col("kx") + 1) * step)
    upright = F.abs(x2 - x1) < 1e-6
    low = F.when(upright, F.least(y1, y2)).otherwise(F.least(height(from_x), height(to_x)))
    high = F.when(upright, F.greatest(y1, y2)).otherwise(F.greatest(height(from_x), height(to_x)))
    rows = _steps(F.floor((low - step / 4) / step), F.floor((high + step / 4) / step))
    return wide.withColumn("ky", F.explode(rows))


EDGE = ["x1", "y1", "x2", "y2"]


def _edges_near(cells, edges, size):
    """Per cell the edges that can be nearest to a point of it: ``(cx, cy, geom_id, x1, y1, x2, y2)``.

    A point is at most half a diagonal away from its cell's centre, so an edge farther from the
    centre than the nearest one by more than a diagonal is nearest to no point of the cell.
    """
    near = _around(cells, _edge_levels(edges, size), size)
    centre = [(F.col(c) + 0.5) * size for c in ("cx", "cy")]
    far = geo.segment_distance(*centre, *[F.col(c) for c in EDGE])
    # An edge comes once for each of the nine cells that it passes; repeats do no harm.
    least = F.min("far").over(Window.partitionBy("cx", "cy"))
    near = near.withColumn("far", far).withColumn("least", least)
    return near.where(F.col("far") <= F.col("least") + size * math.sqrt(2) + 1e-3).select("cx", "cy", "geom_id", *EDGE)


def _edge_bands(shapes, band):
    """Edges of a polygon gathered by horizontal band: all a ray test at that height needs."""
    edge = F.col("edge")
    low = F.floor(F.least(edge["y1"], edge["y2"]) / band)
    high = F.floor(F.greatest(edge["y1"], edge["y2"]) / band)
    banded = shapes.select("geom_id", F.explode("edges").alias("edge")).withColumn(
        "band", F.explode(_steps(low, high))
    )
    return banded.groupBy("geom_id", "band").agg(F.collect_list("edge").alias("edges"))


def _candidates(points, boxes, size):
    """Sites with the ids of all polygons whose bounding box is nearest to them."""
    over = _boxes_over(points, boxes, size).groupBy(*SITE).agg(
        F.collect_set("geom_id").alias("over")
    )
    over = _with_cell(over, size)
    cells = over.where(F.size("over") == 0).select("cx", "cy").distinct()
    hit = over.join(_boxes_near(cells, boxes, size), ["cx", "cy"], "left")

    def measure(b):
        far = geo.box_distance(F.col("x"), F.col("y"), b["x0"], b["y0"], b["x1"], b["y1"])
        return F.struct(far.alias("far"), b["geom_id"].alias("geom_id"))

    hit = hit.withColumn("far", F.when(F.size("over") == 0, F.transform("boxes", measure)))
    tied = F.filter("far", lambda c: c["far"] == F.array_min("far.far"))
    geoms = F.when(F.size("over") > 0, F.col("over")).otherwise(tied["geom_id"])
    return hit.select(*SITE, "x", "y", geoms.alias("geoms"))


def nearest_region(points, polygons, cell_size=REGION_CELL, band=BAND):
    """Region of each site: of the polygons whose bounding box is nearest, the nearest one.

    Boxes containing the site are all at distance 0.  Equal distances go to the lowest id.  A
    single candidate is taken as it is; several are tested for containment with the edges of
    the site's band, and only where none contains the site is the full outline measured.
    """
    shapes = outlines(polygons)
    x, y = F.col("x"), F.col("y")
    several = F.size("geoms") > 1
    each = _candidates(points, shapes.select(*BOX), cell_size).select(
        *SITE, "x", "y",
        F.when(several, F.floor(y / band)).alias("band"),
        (~several).alias("only"),
        F.explode("geoms").alias("geom_id"),
    )
    tested = each.join(_edge_bands(shapes, band), ["geom_id", "band"], "left")
    within = F.col("only") | F.coalesce(geo.inside_edges(x, y, F.col("edges")), F.lit(False))
    decided = tested.groupBy(*SITE).agg(
        F.min(F.when(within, F.col("geom_id"))).alias("inside_id"),
        F.collect_list("geom_id").alias("geoms"),
    )
    open_geoms = F.when(F.col("inside_id").isNull(), F.col("geoms"))
    measured = projected(decided).select(
        *SITE, "x", "y", "inside_id", F.explode_outer(open_geoms).alias("geom_id")
    ).join(shapes.select("geom_id", "edges"), "geom_id", "left")
    far = geo.edges_distance(x, y, F.col("edges"))
    best = measured.groupBy(*SITE).agg(
        F.coalesce(
            F.first("inside_id"), F.min_by("geom_id", F.struct(far, F.col("geom_id")))
        ).alias("geom_id")
    )
    return best.join(shapes.select("geom_id", "name"), "geom_id")


def nearest_polygon(points, polygons, cell_size=REGION_CELL, depth=COVER_DEPTH, band=BAND):
    """Region of each site: the polygon at the least distance, 0 inside it and on its boundary.

    Unlike ``nearest_region``, which first chooses by bounding boxes, no polygon is left out: of a
    box over the site the polygon itself may be farther than one whose box lies elsewhere.
    Distances are compared in micrometres; equal ones go to the lowest id.  Sites in no polygon
    search a doubling grid of edges, the others are settled by the polygons' covers.
    """
    shapes = outlines(polygons)
    held = containing(points, shapes, geo.covers_edges, cell_size, depth, band)
    # Written once: the sites that are settled here and those that are not are used apart.
    settled = cut_lineage(held.groupBy(*SITE).agg(F.min(F.when(F.col("within"), F.col("geom_id"))).alias("geom_id")))
    left = _with_cell(settled.where("geom_id IS NULL").select(*SITE), cell_size)
    near = _edges_near(left.select("cx", "cy").distinct(), ring_edges(polygons).select("geom_id", *EDGE), cell_size)
    far = F.round(geo.segment_distance(*[F.col(c) for c in ("x", "y", *EDGE)]), 6)
    best = left.join(near, ["cx", "cy"]).groupBy(*SITE).agg(
        F.min_by("geom_id", F.struct(far, F.col("geom_id"))).alias("geom_id")
    )
    found = settled.where("geom_id IS NOT NULL").unionByName(best)
    return found.join(shapes.select("geom_id", "name"), "geom_id")


#: Ways to choose a region: by bounding boxes first, or by the polygons alone.
REGION_MODES = {"bbox": nearest_region, "exact": nearest_polygon}


def cell_cover(shapes, cell_size=REGION_CELL, depth=COVER_DEPTH, band=BAND):
    """Quadtree cells of each polygon: ``(geom_id, level, kx, ky, full)``.

    Cells that an edge passes are cut in four until they are ``depth`` halvings below ``cell_size``;
    what no edge passes is inside as a whole or outside as a whole, which its centre tells.  Full
    cells of all levels and the passed ones of the finest cover the polygon without overlap.
    """
    size = cell_size / 2**depth
    key = ["geom_id", "level", "kx", "ky"]
    edges = shapes.select("geom_id", F.inline("edges"))
    passed = cut_lineage(_edge_levels(edges, size).select(*key).distinct())
    quarters = passed.where("level > 0").selectExpr("geom_id", "level - 1 AS level", "explode(array(2 * kx, 2 * kx + 1)) AS kx", "ky")
    quarters = quarters.selectExpr("geom_id", "level", "kx", "explode(array(2 * ky, 2 * ky + 1)) AS ky")
    step = F.pow(F.lit(2.0), F.col("level")) * size
    centres = quarters.join(passed, key, "left_anti").withColumns({
        "x": (F.col("kx") + 0.5) * step, "y": (F.col("ky") + 0.5) * step,
    })
    tested = centres.withColumn("band", F.floor(F.col("y") / band)).join(_edge_bands(shapes, band), ["geom_id", "band"])
    full = tested.where(geo.inside_edges(F.col("x"), F.col("y"), F.col("edges")))
    return full.select(*key, F.lit(True).alias("full")).unionByName(
        passed.where("level = 0").select(*key, F.lit(False).alias("full"))
    )


def _cells_over(points, cover, cell_size, depth):
    """Sites with the cells of the cover that they lie in; a null ``geom_id`` where there is none."""
    size = cell_size / 2**depth
    step = F.pow(F.lit(2.0), F.col("level")) * size
    levels = projected(points).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_top_level(size)))))
    keyed = levels.withColumns({"kx": F.floor(F.col("x") / step), "ky": F.floor(F.col("y") / step)})
    return keyed.join(cover, ["level", "kx", "ky"], "left").select(*SITE, "x", "y", "geom_id", "full")


def containing(points, shapes, test, cell_size=REGION_CELL, depth=COVER_DEPTH, band=BAND):
    """Sites with each polygon of their cells and whether it holds them: ``geom_id``, ``within``.

    Sites in full cells are answered by the join; only those in cells that an edge passes get the ray
    ``test``, with the edges of their band.
    """
    over = _cells_over(points, cell_cover(shapes, cell_size, depth, band), cell_size, depth)
    over = over.withColumn("band", F.when(~F.col("full"), F.floor(F.col("y") / band)))
    tested = over.join(_edge_bands(shapes, band), ["geom_id", "band"], "left")
    within = F.col("full") | test(F.col("x"), F.col("y"), F.col("edges"))
    return tested.select(*SITE, "geom_id", F.coalesce(within, F.lit(False)).alias("within"))


def within_any(points, polygons, cell_size=REGION_CELL, depth=COVER_DEPTH, band=BAND):
    """Whether each site lies strictly inside at least one polygon: column ``within``."""
    held = containing(points, outlines(polygons), geo.inside_edges, cell_size, depth, band)
    return held.groupBy(*SITE).agg(F.max("within").alias("within"))


def dune_label(points, polygons, **grid):
    """Sites with ``Y_DUNES`` or ``N_DUNES``; ``polygons`` are already the dune ones."""
    out = within_any(points, polygons, **grid)
    return out.select(*SITE, yes_no(F.col("within"), DUNE, NO_DUNE).alias("dune"))


def dune_polygons(polygons, code_col="name"):
    return polygons.where(F.col(code_col).isin(DUNE_CODES))


def dissolve(segments, groups=None, name_col="name"):
    """Replace the name of each line by its group and drop lines outside all groups."""
    groups = groups or COAST_GROUPS
    pairs = [F.lit(v) for group, names in groups.items() for n in names for v in (n, group)]
    return segments.withColumn(
        "grp", F.try_element_at(F.create_map(*pairs), F.col(name_col))
    ).where(F.col("grp").isNotNull())


def _line_cells(segments, reach):
    """Segments repeated for each cell of size ``reach`` that a point within reach may be in.

    Each column of cells only takes the heights the segment has near that column, so a long
    diagonal costs cells along its length, not over its bounding box.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    wide = segments.withColumn(
        "cx", F.explode(_steps(geo.cell(left - reach, reach), geo.cell(right + reach, reach)))
    )
    from_x = F.greatest(left, F.least(right, (F.col("cx") - 1) * reach))
    to_x = F.least(right, F.greatest(left, (F.col("cx") + 2) * reach))
    slope = (y2 - y1) / (x2 - x1)

    def height(x):
        return y1 + (x - x1) * slope

    # Half a cell of slack covers rounding of the interpolated heights.
    upright = F.abs(x2 - x1) < 1e-6
    low = F.when(upright, F.least(y1, y2)).otherwise(F.least(height(from_x), height(to_x)))
    high = F.when(upright, F.greatest(y1, y2)).otherwise(
        F.greatest(height(from_x), height(to_x))
    )
    return wide.withColumn(
        "cy",
        F.explode(_steps(geo.cell(low - 1.5 * reach, reach), geo.cell(high + 1.5 * reach, reach))),
    )


def nearest_within(points, segments, reach=COAST_DISTANCE, default=NO_COAST, out="coast"):
    """Group of the nearest line at most ``reach`` away, else ``default``; ties by name."""
    p = _with_cell(points, reach)
    s = _line_cells(segments, reach).select("cx", "cy", "grp", "x1", "y1", "x2", "y2")
    far = geo.segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    hit = p.join(s, ["cx", "cy"], "left").select(*SITE, "grp", far.alias("far"))
    near = F.when(F.col("far") <= reach, F.struct("far", "grp"))
    best = hit.groupBy(*SITE).agg(F.min(near).alias("near"))
    return best.select(*SITE, F.coalesce(F.col("near.grp"), F.lit(default)).alias(out))


@dataclass(frozen=True)
class GeoTransform:
    """Corner, signed cell size and shape of a raster; fields are numbers or columns."""

    x0: object
    y0: object
    dx: object
    dy: object
    rows: object
    cols: object

    def cell_of(self, x, y):
        """Row and column of the nearest cell, clamped to the raster."""

        def at(c, origin, step, n):
            n = n if not isinstance(n, int) else F.lit(n)
            k = F.floor((c - origin) / step)
            return F.greatest(F.lit(0), F.least(k, n - 1)).cast("int")

        return at(y, self.y0, self.dy, self.rows), at(x, self.x0, self.dx, self.cols)


def raster_value(points, tiles, transform, out="altitude"):
    """Raster value at each site; outside the extent the border cell counts.

    ``tiles`` as made by ``readers.tile_raster``: one row per tile meets the sites, and the value is
    taken from its array.  A table of cells is tiled first; write the tiles where it is used again.
    """
    if "values" not in tiles.columns:
        tiles = cut_lineage(tile_raster(tiles))
    tile = F.lit(tiles.select(F.max("tile")).scalar())
    row, col = transform.cell_of(F.col("x"), F.col("y"))
    placed = projected(points).withColumns({"row": row, "col": col}).select(
        *SITE, F.floor(F.col("row") / tile).cast("int").alias("tile_row"), F.floor(F.col("col") / tile).cast("int").alias("tile_col"),
        (F.col("row") % tile * tile + F.col("col") % tile).cast("int").alias("at"),
    )
    hit = placed.join(tiles.select("tile_row", "tile_col", "values"), ["tile_row", "tile_col"], "left")
    return hit.select(*SITE, F.get("values", F.col("at")).alias(out))


def locate(plots, raster=None, countries=None, ecoregions=None, dunes=None, coasts=None, mode="bbox"):
    """Attach altitude, country, ecoregion, dune and coast to plots, as far as given.

    ``raster`` is a pair ``(tiles, transform)``, ``coasts`` a segment table with ``grp``, ``mode``
    one of ``REGION_MODES``.  The distinct coordinates are written once, since every lookup starts from them.
    """
    points = cut_lineage(sites(plots))
    parts = []
    if raster is not None:
        parts.append(raster_value(points, *raster))
    for name, polygons in (("country", countries), ("ecoregion", ecoregions)):
        if polygons is not None:
            hit = REGION_MODES[mode](points, polygons)
            parts.append(hit.select(*SITE, F.col("name").alias(name)))
    if dunes is not None:
        parts.append(dune_label(points, dunes))
    if coasts is not None:
        parts.append(nearest_within(points, coasts))
    # Every lookup keeps all sites, except that without any polygon no region is found.
    out = points
    for part in parts:
        out = out.join(part, SITE, "left")
    return plots.join(out, SITE, "left") if parts else plots
