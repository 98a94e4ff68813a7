"""The greatest distance within groups of places, exactly, from their spherical convex hulls.

All places of a group lie within the diameter of either end of its farthest pair, that is in a cap on whose rim that end
is. A cap under a hemisphere is convex, and the gnomonic projection keeps convexity, so both ends are corners of the
group's hull there. Hulls of parts are hulled again, so no task sees more of a group than the corners of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M

PLACES = "key string, lat double, lon double"
MOST = 4096  # places of a group that are held before they are hulled


def _unit(p: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(p[:, 0]), np.radians(p[:, 1])
    return np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), 1)


def corners(p: np.ndarray) -> np.ndarray:
    """The hull's corners of rows (lat, lon); all of them if no hemisphere about their mean holds them."""
    p = np.unique(p, axis=0)
    if len(p) < 4:
        return p
    u = _unit(p)
    c = u.mean(0)
    if not (u @ c > 1e-6 * np.linalg.norm(c)).all():
        return p
    c /= np.linalg.norm(c)
    e = np.cross((0.0, 0.0, 1.0) if abs(c[2]) < 0.9 else (1.0, 0.0, 0.0), c)
    e /= np.linalg.norm(e)
    depth = u @ c
    flat = np.stack((u @ e / depth, u @ np.cross(c, e) / depth), 1)
    order = np.lexsort((flat[:, 1], flat[:, 0])).tolist()
    x, y = flat[:, 0].tolist(), flat[:, 1].tolist()
    kept: set[int] = set()
    for way in (order, order[::-1]):
        chain: list[int] = []
        for i in way:
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) > 0:
                    break
                chain.pop()
            chain.append(i)
        kept.update(chain)
    return p[sorted(kept)]


def farthest(p: np.ndarray) -> float:
    """Metres between the two rows (lat, lon) farthest apart."""
    p, most = np.radians(corners(p)), 0.0
    for first in range(0, len(p), 256):
        a = p[first : first + 256, None]
        h = np.sin((p[:, 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(p[:, 0]) * np.sin((p[:, 1] - a[..., 1]) / 2) ** 2
        most = max(most, float(h.max()))
    return 2 * EARTH_M * float(np.arcsin(min(1.0, np.sqrt(most))))


def _groups(batches: Iterator[pa.RecordBatch], give):
    """Runs of equal keys in ``batches``, each held as its corners once it is long: what ``give(key, places)`` makes of them."""
    key, held = None, np.zeros((0, 2))
    for batch in batches:
        keys = np.array(batch.column(0).to_pylist(), object)
        places = np.stack((batch.column(1).to_numpy(), batch.column(2).to_numpy()), 1)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
        for k, p in zip(keys[[0, *cuts]] if len(keys) else [], np.split(places, cuts) if len(keys) else [], strict=True):
            if k != key:
                if len(held):
                    yield give(key, held)
                key, held = k, p
            else:
                held = np.concatenate((held, p))
            if len(held) > MOST:
                held = corners(held)
    if len(held):
        yield give(key, held)


def _hulled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, p in _groups(batches, lambda k, p: (k, corners(p))):
        yield pa.RecordBatch.from_arrays([pa.array([key] * len(p), pa.string()), pa.array(p[:, 0]), pa.array(p[:, 1])], ["key", "lat", "lon"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = list(_groups(batches, lambda k, p: (k, farthest(p))))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([d for _, d in out], pa.float64())], ["key", "d"])


def diameters(places: DataFrame, key: str, salt: int = 64, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``key`` (as text) and ``diameter_m``, the greatest distance between two places of each group; rows without a place are left out.

    A group is dealt over ``salt`` tasks by its places first; only the corners found there come together.
    """
    rows = places.select(F.col(key).cast("string").alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).where("key is not null and lat is not null and lon is not null")
    parts = rows.withColumn("salt", F.pmod(F.xxhash64("lat", "lon"), F.lit(salt))).repartition("key", "salt").sortWithinPartitions("key").select("key", "lat", "lon").mapInArrow(_hulled, PLACES)
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(_measured, "key string, d double").select(F.col("key").alias(key), F.col("d").alias("diameter_m"))
