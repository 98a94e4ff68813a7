"""Distances on the ellipsoid and points that stand for shapes, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _edges, haversine_m
from .similarity import _once

#: The WGS 84 ellipsoid.
MAJOR_M, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR_M = MAJOR_M * (1 - FLATTENING)
ROUNDS = 40


def _arc(u1: Column, u2: Column, lam: Column) -> dict[str, Column]:
    """The arc between two reduced latitudes on the auxiliary sphere, ``lam`` apart: sine, cosine and length, and its azimuth's terms."""
    su1, cu1, su2, cu2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)
    sine = F.hypot(cu2 * F.sin(lam), cu1 * su2 - su1 * cu2 * F.cos(lam))
    cosine = su1 * su2 + cu1 * cu2 * F.cos(lam)
    alpha = F.when(sine == 0, 0.0).otherwise(cu1 * cu2 * F.sin(lam) / sine)
    return {"sine": sine, "cosine": cosine, "alpha": alpha, "middle": su1 * su2}


def _next(u1: Column, u2: Column, gap: Column, lam: Column) -> Column:
    """The next estimate of the longitude difference on the auxiliary sphere."""
    arc = _arc(u1, u2, lam)

    def of(sine, cosine, alpha, middle):
        def with_square(square):
            mean = F.when(square == 0, 0.0).otherwise(cosine - 2 * middle / square)
            c = FLATTENING / 16 * square * (4 + FLATTENING * (4 - 3 * square))
            return gap + (1 - c) * FLATTENING * alpha * (F.atan2(sine, cosine) + c * sine * (mean + c * cosine * (2 * mean * mean - 1)))

        return _once(with_square, 1 - alpha * alpha)

    return _once(of, *arc.values())


def _metres(u1: Column, u2: Column, lam: Column) -> Column:
    arc = _arc(u1, u2, lam)

    def of(sine, cosine, alpha, middle):
        square = 1 - alpha * alpha
        mean = F.when(square == 0, 0.0).otherwise(cosine - 2 * middle / square)
        u = square * (MAJOR_M**2 - MINOR_M**2) / MINOR_M**2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        turn = lambda mean, a, b: MINOR_M * a * (F.atan2(sine, cosine) - b * sine * (mean + b / 4 * (cosine * (2 * mean * mean - 1) - b / 6 * mean * (4 * sine * sine - 3) * (4 * mean * mean - 3))))
        return _once(turn, mean, a, b)

    return _once(of, *arc.values())


def spheroid_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres along the WGS 84 ellipsoid between two points: Vincenty's inverse problem, iterated; null if a coordinate is.

    Within a millimetre where the iteration settles. Points so nearly antipodal that it does not (some 0.6 degrees) have
    no single geodesic that it could find; they get the great circle's length on the mean sphere, within 0.6 %.
    """
    reduced = lambda lat: F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))
    gap = F.radians(F.pmod(lon2 - lon1 + 540.0, F.lit(360.0)) - 180.0)

    def of(u1, u2, gap):
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), gap, lambda lam, _: _next(u1, u2, gap, lam))
        settled = lambda lam, more: F.when((F.abs(more - lam) <= 1e-11) & (F.abs(lam) <= math.pi), _metres(u1, u2, lam))
        return _once(lambda lam: _once(settled, lam, _next(u1, u2, gap, lam)), lam)

    return F.coalesce(_once(of, reduced(lat1), reduced(lat2), gap), haversine_m(lat1, lon1, lat2, lon2))


def box_centre(box: Column) -> Column:
    """The middle of a bounding box (west, south, east, north): struct (lon, lat)."""
    return F.struct(((box["west"] + box["east"]) / 2).alias("lon"), ((box["south"] + box["north"]) / 2).alias("lat"))


def point_on_surface(rings: Column) -> Column:
    """A point inside a polygon (rings; holes by even-odd): struct (lon, lat), null for shapes without an inside.

    The middle of the widest stretch inside that a line of latitude cuts out, half way between the vertices next to the
    middle of the shape's height; of equally wide ones the westernmost.
    """

    def on(edges, y):
        cuts = F.filter(edges, lambda e: (e["p"]["lat"] > y) != (e["q"]["lat"] > y))
        at = F.array_sort(F.transform(cuts, lambda e: e["p"]["lon"] + (y - e["p"]["lat"]) / (e["q"]["lat"] - e["p"]["lat"]) * (e["q"]["lon"] - e["p"]["lon"])))

        def widest(xs):
            stretch = lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), (-i).alias("i"), ((F.get(xs, 2 * i) + F.get(xs, 2 * i + 1)) / 2).alias("x"))
            best = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), stretch))
            return F.when(F.size(xs) > 1, F.struct(best["x"].alias("lon"), y.alias("lat")))

        return _once(widest, at)

    def level(ys):
        middle = (F.array_min(ys) + F.array_max(ys)) / 2
        return (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2

    heights = _once(level, F.transform(F.flatten(rings), lambda p: p["lat"]))
    return _once(on, F.flatten(F.transform(rings, _edges)), heights)
