"""Event clustering: an order-dependent greedy fold, run exactly and in parallel.

Detections influence each other only along chains of pairs within the largest radius, and never across a gap in event
time longer than the window. Such groups are found with joins (:func:`chains`); each is then folded in arrival order as
a stream of batches, with its events in an index of cells, so a detection looks at the events around it alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geo import EARTH_M
from ..functions.times import micros
from ..session import cut
from .components import connected_components
from .grid import dwithin_join

EVENT_SCHEMA = "id long, event_id string, opened boolean"


def chains(df: DataFrame, radius_m: float, window_h: float) -> DataFrame:
    """``id`` and ``chain``: groups that a gap in space or time parts from all others.

    Points are snapped together first (equal places are one node), so a busy site costs no pairs of its own; links
    between sites come from a grid join. Then a time gap longer than the window splits a group.
    """
    pts = cut(df.select("id", "lat", "lon", "acq"))
    sites = pts.groupBy("lat", "lon").agg(F.min("id").alias("site"))
    other = sites.select(F.col("site").alias("site2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    edges = dwithin_join(sites, other, radius_m, extra=F.col("site") < F.col("site2")).select(F.col("site").alias("src"), F.col("site2").alias("dst"))
    labels = connected_components(edges)
    named = pts.join(sites, ["lat", "lon"]).join(labels, F.col("site") == labels.node, "left").select("id", "acq", F.coalesce("component", "site").alias("group"))
    order = Window.partitionBy("group").orderBy("acq", "id")
    gap = F.when(micros("acq") - F.lag(micros("acq")).over(order) > int(window_h * 3.6e9), F.col("id")).otherwise(F.when(F.row_number().over(order) == 1, F.col("id")))
    return named.withColumn("gap", gap).select("id", F.last("gap", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"))


class Index:
    """Open events by cells of one radius: bands of latitude, each cut into as many cells as its circle has room for."""

    def __init__(self, radius_m: float):
        self.step = max(math.degrees(radius_m / EARTH_M), 1e-6) * 1.0001
        self.cells: dict[tuple[int, int], dict] = {}

    def _around(self, band: int) -> int:
        edge = min(90.0, max(abs(band), abs(band + 1)) * self.step + self.step)
        return max(1, int(360 * math.cos(math.radians(edge)) / self.step))

    def place(self, lat: float, lon: float) -> tuple[int, int]:
        band = math.floor(lat / self.step)
        n = self._around(band)
        return band, math.floor((lon + 180) / 360 * n) % n

    def near(self, lat: float, lon: float) -> Iterator[dict]:
        """Events in the cells that a circle of one radius about a point can reach."""
        here = math.floor(lat / self.step)
        for band in (here - 1, here, here + 1):
            n = self._around(band)
            at = math.floor((lon + 180) / 360 * n)
            for cell in {(at + i) % n for i in (-1, 0, 1)}:
                yield from self.cells.get((band, cell), {}).values()

    def put(self, event: dict) -> None:
        event["cell"] = self.place(event["lat"], event["lon"])
        self.cells.setdefault(event["cell"], {})[event["id"]] = event

    def move(self, event: dict, lat: float, lon: float) -> None:
        del self.cells[event["cell"]][event["id"]]
        event["lat"], event["lon"] = lat, lon
        self.put(event)


def _metres(a: float, b: float, c: float, d: float) -> float:
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


class Folder:
    """The fold's state: events by place, and what a detection in arrival order does to them. Times are microseconds."""

    def __init__(self, window_h: float, radius_m: float, region_mode: str):
        self.wait, self.strict, self.events = int(window_h * 3.6e9), region_mode == "strict", Index(radius_m)

    def add(self, i: int, acq: int, lat: float, lon: float, radius: float, region) -> tuple[int, bool]:
        """The event (its opener's id) that a detection joins, and whether it opened it."""
        best = None
        for e in self.events.near(lat, lon):
            fits = e["first"] - self.wait <= acq <= e["last"] + self.wait and (e["region"] == region or not self.strict and (region is None or e["region"] is None))
            if fits and (d := _metres(lat, lon, e["lat"], e["lon"])) <= radius and (best is None or (d, -e["last"], e["id"]) < best[0]):
                best = (d, -e["last"], e["id"]), e
        if best is None:
            self.events.put({"id": i, "first": acq, "last": acq, "lat": lat, "lon": lon, "region": region})
            return i, True
        e = best[1]
        e["first"] = min(e["first"], acq)
        if acq >= e["last"]:
            e["last"] = acq
            self.events.move(e, lat, lon)
        return e["id"], False

    def open_since(self, oldest: int) -> list[dict]:
        """The events that a detection from ``oldest`` on may still join, to be kept and put back by :meth:`restore`."""
        return [e for cell in self.events.cells.values() for e in cell.values() if e["last"] + self.wait >= oldest]

    def restore(self, events: list[dict]) -> None:
        for e in events:
            self.events.put(e)


def _fold(window_h: float, radius_m: float, region_mode: str):
    """Fold rows (chain, id, acq in microseconds, lat, lon, radius, region), chain after chain in arrival order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, folder = None, None
        for batch in batches:
            ids, names, fresh = [], [], []
            for own, i, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != chain:
                    chain, folder = own, Folder(window_h, radius_m, region_mode)
                event, opened = folder.add(i, *row)
                ids.append(i), names.append(f"e{event}"), fresh.append(opened)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(fresh, pa.bool_())], ["id", "event_id", "opened"])

    return run


def cluster_events(df: DataFrame, window_h: float = 24, radius_m: float = 1000, region_mode: str = "core") -> DataFrame:
    """``id``, ``event_id`` and whether the detection opened it.

    ``df`` has ``id, acq, received_at, lat, lon, radius_m, region_id``. In arrival order (``received_at``, then id) each
    detection joins the nearest event whose last location is within its own radius, whose span plus the window holds
    its time, and whose region is equal (``strict``) or equal or unknown (``core``); ties go to the newest event, then to
    the one of the least opener. Else it opens one. ``radius_m`` must be no less than any row's. Rows lacking time or
    place are left out. A chain is folded in one task, as its order asks, but streams through it: the task holds the
    chain's events, not its detections.
    """
    rows = df.where("acq is not null and lat is not null and lon is not null").select("id", "acq", "received_at", "lat", "lon", F.col("radius_m").cast("double"), F.col("region_id").cast("long"))
    named = rows.join(chains(rows, radius_m, window_h), "id").repartition("chain").sortWithinPartitions("chain", "received_at", "id")
    return named.select("chain", "id", micros("acq").alias("acq"), "lat", "lon", "radius_m", "region_id").mapInArrow(_fold(window_h, radius_m, region_mode), EVENT_SCHEMA)
