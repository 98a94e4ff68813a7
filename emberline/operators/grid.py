"""Spatial joins over a grid of cells: every join is an equi-join on a cell, then an exact distance or polygon test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geo import EARTH_M, covers, haversine_m
from ..session import Scratch, cut


def _cell(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    return F.floor(lat / step).cast("long"), F.floor(lon / step).cast("long")


def dwithin_join(a: DataFrame, b: DataFrame, radius_m: float, lat_a="lat", lon_a="lon", lat_b="lat2", lon_b="lon2", extra: Column | None = None, distance: str = "distance_m", max_lat: float = 80.0, on: tuple[str, ...] = (), cells: bool = False, coarse: int = 1) -> DataFrame:
    """Pairs of rows at most ``radius_m`` apart, with their distance.

    Cells are squares of degrees one radius high; the rows of ``b`` (give the smaller side) are copied to the cells
    that their circle can reach, which is three cells high and, towards the poles, wider. Longitudes wrap at 180
    degrees. ``extra`` is tested beside the distance (say, a time window). Columns ``on`` (say, slots of time) must be equal
    too and are dropped, unless ``cells`` keeps them and ``_cy, _cx``: a row of ``a`` has one cell, and pairs are dealt by these
    columns, so what is ranked or summed by them and the row needs no other shuffle. Rows without coordinates match nothing. The copies are dealt by cell: Spark takes them for no more than
    the rows they come from, and would gather nine times a table on the driver to send it to every task.
    With ``coarse`` from 2 on cells are so many radii high, and a row goes to those that its circle does reach, few more than one:
    for rows that ``on`` keeps to small groups. Rows beyond ``max_lat`` degrees are searched as if at that latitude plus the circle's own width allows.
    """
    least = max(math.degrees(radius_m / EARTH_M), 1e-6) * 1.0001
    step = least * coarse
    round_ = round(360 / step) or 1
    step_lon = 360 / round_ if round_ > 1 else 360.0
    ya, xa = F.floor(F.col(lat_a) / step).cast("long"), F.pmod(F.floor((F.col(lon_a) + 180) / step_lon).cast("long"), F.lit(round_))
    yb, xb = F.floor(F.col(lat_b) / step).cast("long"), F.floor((F.col(lon_b) + 180) / step_lon).cast("long")
    wide = F.ceil(F.lit(step / step_lon) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col(lat_b)) + step, F.lit(89.9)))), F.lit(1e-3))).cast("int")
    wide = F.least(wide, F.lit(round_ // 2 + 1))
    reach = b.where(F.col(lat_b).isNotNull() & F.col(lon_b).isNotNull())
    ys, xs = F.sequence(yb - 1, yb + 1), F.sequence(xb - wide, xb + wide)
    if coarse > 1:
        far, at = F.abs(F.col(lat_b)) + least, F.col(lon_b) + 180
        by = F.least(F.when(far >= 89, 180.0).otherwise(least / F.cos(F.radians(F.least(far, F.lit(89.0))))), F.lit(180.0))
        ys = F.sequence(F.floor((F.col(lat_b) - least) / step).cast("long"), F.floor((F.col(lat_b) + least) / step).cast("long"))
        xs = F.sequence(F.floor((at - by) / step_lon).cast("long"), F.floor((at + by) / step_lon).cast("long"))
    reach = reach.withColumn("_cy", F.explode(ys))
    reach = reach.withColumn("_cx", F.explode(F.array_distinct(F.transform(xs, lambda c: F.pmod(c, F.lit(round_))))))
    left = a.withColumn("_cy", ya).withColumn("_cx", xa)
    pairs = left.join(reach.hint("merge"), ["_cy", "_cx", *on]).drop(*(() if cells else ("_cy", "_cx", *on))).withColumn(distance, haversine_m(F.col(lat_a), F.col(lon_a), F.col(lat_b), F.col(lon_b)))
    keep = (F.abs(F.col(lat_a) - F.col(lat_b)) <= least) & (F.col(distance) <= radius_m)  # the first is cheap and sends off a third
    return pairs.where(keep if extra is None else keep & extra)


def nearest(pairs: DataFrame, key, order: list, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` pairs of each ``key`` by ``order``."""
    key = [key] if isinstance(key, str) else key
    out = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def nearest_within(a: DataFrame, b: DataFrame, key: str, radius_m: int, order: list, k: int = 1, rank: str | None = None, extra: Column | None = None, on: tuple[str, ...] = (), steps: tuple[int, ...] = (64, 16, 4, 1), **columns) -> DataFrame:
    """The first ``k`` rows of ``b`` within the radius of each row of ``a`` by rounded ``distance_m``, then ``order``.

    As :func:`dwithin_join` and :func:`nearest`, but circles grow (the radius over each of ``steps``), and a row whose first
    ``k`` lie within a circle is not sought in the next, so crowded places make few pairs. ``key`` is distinct in ``a``. If one is
    wanted, pairs are not ordered: the least rounded distance is found where they meet, and only pairs at it are made again.
    """
    out, open_, place, scratch = None, a, [F.round("distance_m"), *order], Scratch(a.sparkSession, "nearest")
    for n in steps:
        most = radius_m // n
        reach = radius_m if n == 1 else most + 1
        if k == 1:
            met = dwithin_join(open_, b, reach, extra=extra, on=on, cells=True, **columns)
            least = met.groupBy("_cy", "_cx", *on, key).agg(F.min(F.round("distance_m")).alias("_m")).select(F.col(key).alias("_key"), "_m")
            least = cut(least if n == 1 else least.where(F.col("_m") <= most))
            full, there = least.select(F.col("_key").alias(key)), F.round("distance_m") <= F.col("_m")
            pairs = dwithin_join(open_.join(least, F.col(key) == F.col("_key")).drop("_key"), b, reach, extra=there if extra is None else extra & there, on=on, **columns).drop("_m")
            best = cut(nearest(pairs, key, place, 1, "_n"))
        else:
            pairs = dwithin_join(open_, b, reach, extra=extra, on=on, **columns)
            best = cut(nearest(pairs, key, place, k, "_n"))
            if n > 1:
                full = best.where((F.col("_n") == k) & (F.round("distance_m") <= most)).select(key)
                best = best.join(full, key, "left_semi")
        if n > 1:
            left = scratch.keep(open_.join(full, key, "left_anti"), "open")
            if open_ is not a:
                scratch.drop(open_)
            open_ = left
        out = best if out is None else out.unionByName(best)
    scratch.only()
    return out.withColumnRenamed("_n", rank) if rank else out.drop("_n")


def covering(points: DataFrame, regions: DataFrame, step: float = 0.5, lat="lat", lon="lon") -> DataFrame:
    """Pairs of points and regions (``region_id``, ``rings``) that cover them.

    A region is copied to the cells of its bounding box; points meet it there by an equi-join, then the ring test decides.
    """
    box = F.flatten("rings")
    xs, ys = F.transform(box, lambda p: p["lon"]), F.transform(box, lambda p: p["lat"])
    spread = regions.select("region_id", "rings", F.explode(F.sequence(F.floor(F.array_min(ys) / step), F.floor(F.array_max(ys) / step))).alias("_cy"), F.array_min(xs).alias("_w"), F.array_max(xs).alias("_e"))
    spread = spread.select("region_id", "rings", "_cy", F.explode(F.sequence(F.floor(F.col("_w") / step), F.floor(F.col("_e") / step))).alias("_cx"))
    y, x = _cell(F.col(lat), F.col(lon), step)
    return points.withColumn("_cy", y).withColumn("_cx", x).join(spread, ["_cy", "_cx"]).where(covers(F.col(lon), F.col(lat), F.col("rings"))).drop("_cy", "_cx", "rings")


def assign_region(points: DataFrame, regions: DataFrame, key: str, step: float = 0.5, lat="lat", lon="lon") -> DataFrame:
    """All points with ``region_id``: the lowest id that covers them, null if none does."""
    best = covering(points.select(key, lat, lon), regions, step, lat, lon).groupBy(key).agg(F.min("region_id").alias("region_id"))
    return points.join(best, key, "left")


def spatial_gate(points: DataFrame, regions: DataFrame, key: str = "idx") -> DataFrame:
    """Per point ``inside`` and ``region_code``, the key kept."""
    named = assign_region(points, regions.select("region_id", "rings"), key).join(regions.select("region_id", "code"), "region_id", "left")
    return named.select(key, F.col("region_id").isNotNull().alias("inside"), F.col("code").alias("region_code"))


def merge_keyed(base: DataFrame, delta: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """Upsert: a row of ``delta`` replaces the one with its keys; in ``keep_old`` columns a null does not."""
    rest = [c for c in base.columns if c not in keys]
    a, b = base.alias("a"), delta.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    pick = lambda c: F.when(F.col("b._new") & (F.col(f"b.{c}").isNotNull() if c in keep_old else F.lit(True)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return joined.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *map(pick, rest))


def insert_new(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Add the rows of ``delta`` whose keys are new; of equal new keys one stays."""
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))


def unpivot(df: DataFrame, ids: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, metrics, name, value)
