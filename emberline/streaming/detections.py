"""The same operators on streams: dedup, late rows, hourly coverage, sessions, lifecycle, clustering, and refreshed rollups."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import EARTH_M
from ..functions.times import micros
from ..operators.cluster import Folder
from ..operators.components import connected_components
from ..operators.events import merge_parts, rollup_of_parts, rollup_parts
from ..operators.grid import dwithin_join
from ..operators.ingest import detection_hash
from ..session import cut
from .state import Buckets, bucket_of


def hashed(stream: DataFrame) -> DataFrame:
    c = F.col
    return stream.withColumn("detection_hash", detection_hash(c("source"), c("satellite"), c("instrument"), c("acq"), c("lat"), c("lon")))


def dedup_stream(stream: DataFrame, late: str = "48 hours") -> DataFrame:
    """The first row of each hash; state lasts as long as rows may be late."""
    return hashed(stream).withWatermark("acq", late).dropDuplicatesWithinWatermark(["detection_hash"])


def hourly_coverage(stream: DataFrame, late: str = "24 hours") -> DataFrame:
    """Rows a source and tumbling hour."""
    n = stream.withWatermark("acq", late).groupBy(F.window("acq", "1 hour"), "source").agg(F.count("*").alias("n"))
    return n.select("source", F.col("window.start").alias("hour"), "n")


def sessions(stream: DataFrame, gap: str = "24 hours", late: str = "24 hours") -> DataFrame:
    """A fast approximation of events: rows of one cell less than ``gap`` apart."""
    s = stream.withWatermark("acq", late).groupBy(F.session_window("acq", gap), "cell").agg(F.count("*").alias("n"), F.max("frp").alias("max_frp"))
    return s.select("cell", F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("until"), "n", "max_frp")


def lifecycle_stream(stream: DataFrame, close_h: int = 24, late: str = "24 hours") -> DataFrame:
    """Per cell the count and span so far; a timer closes it ``close_h`` hours of event time after its last row."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"cell": [key[0]], "first_us": [first], "last_us": [last], "n": [n], "status": ["closed"]})
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        for pdf in batches:
            t = pdf["us"]
            if len(t):
                first = int(t.min()) if first is None else min(first, int(t.min()))
                last = int(t.max()) if last is None else max(last, int(t.max()))
                n += len(t)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last // 1000 + close_h * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"cell": [key[0]], "first_us": [first], "last_us": [last], "n": [n], "status": ["active" if n >= 3 else "confirmed" if n == 2 else "new"]})

    rows = stream.withWatermark("acq", late).select("cell", "acq", F.unix_micros("acq").alias("us"))
    return rows.groupBy("cell").applyInPandasWithState(step, "cell string, first_us long, last_us long, n long, status string", "first_us long, last_us long, n long", "update", GroupStateTimeout.EventTimeTimeout)


def cluster_stream(stream: DataFrame, window_h: float = 24, radius_m: float = 1000, late_h: float = 24) -> DataFrame:
    """Clustering as rows arrive: ``id, event_id, opened``, as :func:`~..operators.cluster.cluster_events` in ``strict`` mode gives.

    Strict events keep to one region, so a region is a key (rows without one are a key too), and its state is the events
    that a row may still join: those within the window of the watermark. Rows of a micro-batch are folded by ``received_at``, then
    id, so the result is the batch's if micro-batches come in that order and no row is later than ``late_h``.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        folder = Folder(window_h, radius_m, "strict")
        if state.exists:
            folder.restore(json.loads(state.get[0]))
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["received_us", "id"])
        out = []
        for r in rows.itertuples():
            event, opened = folder.add(int(r.id), int(r.us), float(r.lat), float(r.lon), float(r.radius_m), int(key[0]))
            out.append((int(r.id), f"e{event}", opened))
        oldest = state.getCurrentWatermarkMs() * 1000
        kept = [{k: v for k, v in e.items() if k != "cell"} for e in folder.open_since(oldest)]
        state.update((json.dumps(kept),))
        last = max((e["last"] for e in kept), default=oldest)
        state.setTimeoutTimestamp(max(last // 1000 + int((window_h + late_h) * 3_600_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "event_id", "opened"])

    rows = stream.where("acq is not null and lat is not null and lon is not null").withWatermark("acq", f"{int(late_h * 3600)} seconds")
    rows = rows.select(F.coalesce(F.col("region_id").cast("long"), F.lit(-1)).alias("region"), "acq", F.unix_micros("acq").alias("us"), F.unix_micros("received_at").alias("received_us"), "id", "lat", "lon", F.col("radius_m").cast("double"))
    return rows.groupBy("region").applyInPandasWithState(step, "id long, event_id string, opened boolean", "events string", "append", GroupStateTimeout.EventTimeTimeout)


def route_late(main: str, late: str, marks: str, late_h: float = 24):
    """For ``foreachBatch``: rows later than ``late_h`` behind the newest time of earlier batches go to the folder ``late``, others to ``main``.

    Each batch has its own part of the three folders and writes it anew if it is run again; ``marks`` holds each one's newest time.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = lambda path, n=number: f"{path}/batch={n}"
        newest = batch.agg(F.max(F.unix_micros("acq")).alias("newest"))
        if number:
            before = spark.read.schema("newest long, batch long").parquet(marks).where(F.col("batch") < number).agg(F.max("newest").alias("m"))
            limit = F.coalesce(F.unix_micros("acq") < F.col("m") - int(late_h * 3.6e9), F.lit(False))
            split = batch.crossJoin(before).withColumn("_late", limit).drop("m")  # one row
        else:
            split = batch.withColumn("_late", F.lit(False))
        split.where("not _late").drop("_late").write.mode("overwrite").parquet(part(main))
        split.where("_late").drop("_late").write.mode("overwrite").parquet(part(late))
        newest.write.mode("overwrite").parquet(part(marks))

    return run


def refresh_rollups(members: str, rollups: str, buckets: int = 256, idle_h: float = 72):
    """For ``foreachBatch`` over detections with their ``event_id``: keep them, and refresh the rollups of the events they belong to.

    A rollup is kept as a sum of parts in :class:`~.state.Buckets`: a batch adds its own to those in the buckets that it
    touches, and reads neither earlier detections nor other buckets. Events idle for ``idle_h`` before the batch's newest
    row move out of the buckets, so these hold what is active; a later row of such an event starts another part, which
    :func:`current_rollups` adds up again. A batch that is run again finds what it found the first time.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{members}/batch={number}")
        fresh = rollup_parts(spark.read.schema(batch.schema).parquet(f"{members}/batch={number}"))
        newest = fresh.agg(F.max(micros("last_seen"))).first()[0]
        table = Buckets(spark, rollups, fresh.schema)
        bucket = bucket_of("event_id", buckets)
        touched = [r[0] for r in fresh.select(bucket).distinct().collect()]
        merged = merge_parts(fresh.unionByName(table.before(number, touched))).withColumn("idle", F.coalesce(micros("last_seen") < F.lit(newest).cast("long") - int(idle_h * 3.6e9), F.lit(False))).persist()
        merged.where("idle").drop("idle").write.mode("overwrite").parquet(f"{rollups}/idle/batch={number}")
        table.replace(number, merged.where("not idle").drop("idle").withColumn("bucket", bucket), touched)
        merged.unpersist()

    return run


def current_rollups(spark, rollups: str) -> DataFrame:
    """The rollup of each event as of the newest batch that is through: idle and active parts added up."""
    idle = spark.read.parquet(f"{rollups}/idle")
    table = Buckets(spark, rollups, idle.drop("batch").schema)
    done = idle.where(F.col("batch") <= table.committed()[0]).drop("batch")
    return rollup_of_parts(merge_parts(done.unionByName(table.current())))


OPEN_EVENTS = "event long, first long, last long, lat double, lon double, region long"


def _resume(window_h: float, radius_m: float, region_mode: str):
    """Fold rows (group, part, fresh, received, id, first, last, lat, lon, radius, region), a chain's open events first: assignments, and events as the chain leaves them."""
    names = ["id", "event", "opened", "first", "last", "lat", "lon", "region"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def left(folder: Folder | None) -> list[tuple]:
        events = [e for cell in folder.events.cells.values() for e in cell.values()] if folder else []
        return [(None, e["id"], None, e["first"], e["last"], e["lat"], e["lon"], e["region"]) for e in events]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, folder = None, None
        for batch in batches:
            out = []
            for group, part, fresh, _, i, first, last, lat, lon, radius, region in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, part) != chain:
                    out += left(folder)
                    chain, folder = (group, part), Folder(window_h, radius_m, region_mode)
                if fresh:
                    out.append((i, *folder.add(i, first, lat, lon, radius, region), None, None, None, None, None))
                else:
                    folder.restore([{"id": i, "first": first, "last": last, "lat": lat, "lon": lon, "region": region}])
            yield table(out)
        yield table(left(folder))

    return run


def _chained(nodes: DataFrame, radius_m: float, window_h: float) -> DataFrame:
    """Rows and open events with ``group`` and ``part``: joined through places near rows, parted where a gap exceeds the window."""
    sites = cut(nodes.groupBy("lat", "lon").agg(F.min("id").alias("site"), F.bool_or("fresh").alias("fresh")))
    other = sites.select(F.col("site").alias("site2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    edges = dwithin_join(sites.where("fresh"), other, radius_m, extra=F.col("site") != F.col("site2")).select(F.col("site").alias("src"), F.col("site2").alias("dst"))
    named = nodes.join(sites.select("lat", "lon", "site"), ["lat", "lon"]).join(connected_components(edges), F.col("site") == F.col("node"), "left").withColumn("group", F.coalesce("component", "site"))
    order = Window.partitionBy("group").orderBy("first", "id")
    gap = F.col("first") - F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)) > int(window_h * 3.6e9)
    marked = named.withColumn("gap", F.coalesce(gap.cast("int"), F.lit(0)))
    return marked.withColumn("part", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def cluster_batches(assigned: str, state: str, window_h: float = 24, radius_m: float = 1000, region_mode: str = "core", late_h: float = 24, buckets: int = 256):
    """For ``foreachBatch``: clustering as rows arrive, in either mode; ``id, event_id, opened`` of each batch go to the folder ``assigned``.

    Nothing is keyed by region, so regions that are unknown force no key. Open events lie in :class:`~.state.Buckets` of cells
    of a degree; a batch reads the cells around its rows, finds the chains of rows and open events that can affect each
    other (places by a grid join, then gaps in time) and folds each in arrival order from the state its events had.
    The result is that of :func:`~..operators.cluster.cluster_events` if batches come in the order of ``received_at``, then id, and
    no row is later than ``late_h`` behind the newest of its batch: events that no such row can join leave the state. Rows
    lacking time or place are left out; a batch that is run again writes the same.
    """
    reach = math.degrees(radius_m / EARTH_M)
    wide = F.when(F.abs("lat") + reach >= 89, 180).otherwise(F.least(F.lit(180), F.ceil(reach / F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(89.0))))).cast("int")))
    cell = lambda y, x: bucket_of(F.struct(y.cast("long"), F.pmod(x.cast("long"), F.lit(360))), buckets)
    tall = math.ceil(reach)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("acq is not null and lat is not null and lon is not null").select(micros("received_at").alias("received"), "id", micros("acq").alias("first"), micros("acq").alias("last"), "lat", "lon", F.col("radius_m").cast("double").alias("radius"), F.col("region_id").cast("long").alias("region"), F.lit(True).alias("fresh"))
        rows = rows.persist()
        newest = rows.agg(F.max("first")).first()[0]
        y, x = F.floor("lat"), F.floor("lon")
        around = rows.select("lat", "lon", wide.alias("wide"), F.explode(F.sequence(y - tall, y + tall)).alias("y")).select("y", F.explode(F.sequence(x - F.col("wide"), x + F.col("wide"))).alias("x")).distinct()
        touched = [r[0] for r in around.select(cell(F.col("y"), F.col("x"))).distinct().collect()]
        table = Buckets(spark, state, OPEN_EVENTS)
        seeds = table.before(number, touched).select(F.lit(None).cast("long").alias("received"), F.col("event").alias("id"), "first", "last", "lat", "lon", F.lit(None).cast("double").alias("radius"), "region", F.lit(False).alias("fresh"))
        named = _chained(cut(rows.unionByName(seeds)), radius_m, window_h).repartition("group", "part").sortWithinPartitions("group", "part", "fresh", "received", "id")
        kind = "id long, event long, opened boolean, first long, last long, lat double, lon double, region long"
        folded = named.select("group", "part", "fresh", "received", "id", "first", "last", "lat", "lon", "radius", "region").mapInArrow(_resume(window_h, radius_m, region_mode), kind).persist()
        folded.where("id is not null").select("id", F.concat(F.lit("e"), "event").alias("event_id"), "opened").write.mode("overwrite").parquet(f"{assigned}/batch={number}")
        oldest = F.lit(newest).cast("long") - int((window_h + late_h) * 3.6e9)
        kept = folded.where(F.col("id").isNull() & (F.col("last") >= oldest)).drop("id", "opened").withColumn("bucket", cell(F.floor("lat"), F.floor("lon")))
        table.replace(number, kept, touched)
        folded.unpersist()
        rows.unpersist()

    return run
