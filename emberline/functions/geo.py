"""Spherical geometry as column expressions. Distances use a sphere of 6 371 000 m; bearings are degrees from north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
M_PER_DEGREE = 111320.0


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres between two points; null if a coordinate is."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_M * F.asin(F.when(h > 1, 1.0).otherwise(F.sqrt(h)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, 0 to 360."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    y, x = F.sin(d - b) * F.cos(c), F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def project_point(lat, lon, bearing, metres) -> tuple[Column, Column]:
    """The point that lies ``metres`` away along ``bearing``: (lat, lon)."""
    a, b, t, d = F.radians(lat), F.radians(lon), F.radians(bearing), metres / EARTH_M
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    on = b + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), F.pmod(F.degrees(on) + 540.0, F.lit(360.0)) - 180.0


def mean_direction(degrees) -> Column:
    """Circular mean of a group's directions (aggregate)."""
    r = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))) + 360.0, F.lit(360.0))


def bbox(ring: Column) -> Column:
    """Struct (west, south, east, north) of an array of (lon, lat)."""
    x, y = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))


def expand_bbox_m(box: Column, metres: float) -> Column:
    """A bounding box grown by metres on each side; a degree of longitude counts at least a fifth of one of latitude."""
    dy = metres / M_PER_DEGREE
    dx = F.lit(metres) / (M_PER_DEGREE * F.greatest(F.lit(0.2), F.cos(F.radians((box["south"] + box["north"]) / 2))))
    return F.struct((box["west"] - dx).alias("west"), (box["south"] - dy).alias("south"), (box["east"] + dx).alias("east"), (box["north"] + dy).alias("north"))


def _edges(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def on_edge(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies on the ring itself."""

    def touches(e):
        p, q = e["p"], e["q"]
        cross = (q["lon"] - p["lon"]) * (lat - p["lat"]) - (q["lat"] - p["lat"]) * (lon - p["lon"])
        return (F.abs(cross) <= 1e-12) & lon.between(F.least(p["lon"], q["lon"]), F.greatest(p["lon"], q["lon"])) & lat.between(F.least(p["lat"], q["lat"]), F.greatest(p["lat"], q["lat"]))

    return F.exists(_edges(ring), touches)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against one ring."""

    def crosses(e):
        p, q = e["p"], e["q"]
        rise = q["lat"] - p["lat"]
        x = (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.when(rise == 0, 1e-15).otherwise(rise) + p["lon"]
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < x)

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def covers(lon: Column, lat: Column, rings: Column) -> Column:
    """Whether a polygon or multipolygon (rings; holes by even-odd) covers a point, its boundary included."""
    inside = F.aggregate(rings, F.lit(0), lambda n, r: n + in_ring(lon, lat, r).cast("int")) % 2 == 1
    return inside | F.exists(rings, lambda r: on_edge(lon, lat, r))


def ring_area_km2(ring: Column) -> Column:
    """Planar area of one ring at its mean latitude's scale."""
    lat = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"])
    return F.abs(twice) / 2 * M_PER_DEGREE * M_PER_DEGREE * F.cos(F.radians(lat)) / 1e6


def polygon_area_km2(rings: Column) -> Column:
    """The first ring less the holes that follow, never below 0."""
    holes = F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring_area_km2(r))
    return F.greatest(F.lit(0.0), ring_area_km2(rings[0]) - holes)


def segment_distance_m(lat, lon, p, q) -> tuple[Column, Column]:
    """(metres from a point to a segment, share of the segment before the nearest place), in a local flat projection."""
    ky = math.radians(1) * EARTH_M
    kx = ky * F.cos(F.radians((lat + p["lat"] + q["lat"]) / 3))
    ax, ay, bx, by = (p["lon"] - lon) * kx, (p["lat"] - lat) * ky, (q["lon"] - lon) * kx, (q["lat"] - lat) * ky
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)), t


def round_half_up(x: Column) -> Column:
    """Rounding with halves going up, also below zero."""
    return F.floor(x + 0.5)
