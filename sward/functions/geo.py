"""Projection, gridding and plane geometry as column expressions."""

import math

from pyspark.sql import functions as F

# WGS-84 semi-major axis (km) and flattening, the Web-Mercator sphere radius (m),
# and the two circumferences (km) used to wrap western and southern coordinates.
WGS84_A_KM = 6378.137
WGS84_F = 1 / 298.257223563
MERCATOR_RADIUS = 6378137.0
EQUATOR_KM = 40075.017
MERIDIAN_KM = 40007.863


def meridian_terms():
    """Factors of the meridian-arc series in km: latitude, sin 2, sin 4, sin 6, sin 8."""
    n = WGS84_F / (2 - WGS84_F)
    scale = WGS84_A_KM / (1 + n)
    return [
        scale * (1 + n**2 / 4 + n**4 / 64),
        scale * -1.5 * (n - n**3 / 8),
        scale * 15 / 16 * (n**2 - n**4 / 4),
        scale * -35 / 48 * n**3,
        scale * 315 / 512 * n**4,
    ]


def round_even(c, digits):
    """Round half to even on the scaled double."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def mercator_x(lon):
    return F.lit(MERCATOR_RADIUS) * F.radians(lon)


def mercator_y(lat):
    return F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def easting_km(lon):
    """Distance along the equator from longitude 0, counted eastwards.

    Valid up to about 179.39 degrees, where the shortest path leaves the equator.
    """
    lon = lon.cast("double")
    km = F.lit(WGS84_A_KM) * F.radians(F.abs(lon))
    return F.when(lon < 0, EQUATOR_KM - km).otherwise(km)


def northing_km(lat):
    """Meridian distance from latitude 0, counted northwards round the globe."""
    lat = lat.cast("double")
    phi = F.radians(F.abs(lat))
    first, *rest = meridian_terms()
    km = F.lit(first) * phi
    for k, factor in enumerate(rest, start=1):
        km = km + F.lit(factor) * F.sin(phi * (2.0 * k))
    return F.when(lat < 0, MERIDIAN_KM - km).otherwise(km)


def bin_index(coord, width):
    """Zero-based bin of a non-negative coordinate."""
    if width <= 0:
        raise ValueError("bin width must be positive")
    bad = F.raise_error(F.lit("coordinate to bin is negative"))
    return F.when(coord >= 0, F.floor(coord / width)).when(coord < 0, bad.cast("long"))


def block_id(lon, lat, east_km, north_km):
    """Name of the grid block a point falls into."""
    return F.format_string(
        "e%04dn%04d",
        bin_index(easting_km(lon), east_km),
        bin_index(northing_km(lat), north_km),
    )


def in_window(lon, lat, center, half_width, half_height):
    """True inside a map window round ``center`` (lon, lat)."""
    return lon.between(center[0] - half_width, center[0] + half_width) & lat.between(
        center[1] - half_height, center[1] + half_height
    )


def cell(c, size):
    """Signed grid cell of a projected coordinate."""
    return F.floor(c / F.lit(float(size)))


def box_distance(x, y, x0, y0, x1, y1):
    """Distance from a point to a closed rectangle, zero inside."""
    dx = F.greatest(x0 - x, x - x1, F.lit(0.0))
    dy = F.greatest(y0 - y, y - y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(x, y, x1, y1, x2, y2):
    """Distance from a point to a segment; a zero-length segment is a point."""
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, ((x - x1) * dx + (y - y1) * dy) / squared).otherwise(0.0)
    t = F.greatest(F.least(along, F.lit(1.0)), F.lit(0.0))
    ex, ey = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def crosses_ray(x, y, e):
    """True where the ray from the point towards larger x crosses the edge."""
    at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
    return ((e["y1"] > y) != (e["y2"] > y)) & (x < at)


def on_edge(x, y, e):
    """True where the point lies exactly on the edge."""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (cross == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def inside_edges(x, y, edges):
    """Even-odd test of a point against an array of edges, boundary excluded."""
    odd = F.size(F.filter(edges, lambda e: crosses_ray(x, y, e))) % 2 == 1
    return odd & ~F.exists(edges, lambda e: on_edge(x, y, e))


def covers_edges(x, y, edges):
    """Even-odd test of a point against an array of edges, boundary included."""
    odd = F.size(F.filter(edges, lambda e: crosses_ray(x, y, e))) % 2 == 1
    return odd | F.exists(edges, lambda e: on_edge(x, y, e))


def edges_distance(x, y, edges):
    """Distance from a point to the nearest edge of an array."""
    return F.array_min(
        F.transform(edges, lambda e: segment_distance(x, y, e["x1"], e["y1"], e["x2"], e["y2"]))
    )
