"""Readers of sensor files; each works on ``spark.read`` and, given a schema, on ``spark.readStream``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import norm_confidence


def _number(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit("")).try_cast("double")


def read_firms_csv(spark: SparkSession, path: str, source_id: str, as_of, window_h: int = 24, kind: str = "text") -> DataFrame:
    """Polar-orbit CSV with a header: date and ``hhmm`` time as UTC; rows without a place or time, older than the window, or more than
    ten minutes ahead are left out. A byte-order mark and quoted fields are read as usual."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    acq = F.try_to_timestamp(F.concat("acq_date", F.lit(" "), F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    names = [c for c in ("satellite", "instrument", "daynight") if c in raw.columns]
    df = raw.select(F.lit(source_id).alias("source"), acq.alias("acq"), _number("latitude").alias("lat"), _number("longitude").alias("lon"), _number("frp").alias("frp"), norm_confidence(F.col("confidence"), kind).alias("confidence"), *names)
    at = F.lit(as_of).cast("timestamp")
    fresh = F.col("acq").between(at - F.make_dt_interval(F.lit(0), F.lit(window_h)), at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10)))
    return df.where(fresh & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))


def _first_of(df: DataFrame, *names: str) -> Column:
    have = [_number(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def read_geostationary_frp(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Geostationary FRP CSV (gzip too): the slot in the file's name (``_yyyyMMddHHmm``), or a row's own ``yyyyMMddHHmmss``."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.select("*", F.col("_metadata.file_name").alias("_file")).toDF(*[c.strip().lower() for c in raw.columns], "_file")
    slot = F.try_to_timestamp(F.regexp_extract("_file", r"_(\d{12})", 1), F.lit("yyyyMMddHHmm"))
    own = F.try_to_timestamp(F.col("acquisition_time"), F.lit("yyyyMMddHHmmss")) if "acquisition_time" in raw.columns else F.lit(None).cast("timestamp")
    df = raw.select(F.coalesce(own, slot).alias("acq"), _first_of(raw, "latitude", "lat").alias("lat"), _first_of(raw, "longitude", "lon").alias("lon"), _first_of(raw, "frp", "frp_mw").alias("frp"), _first_of(raw, "confidence", "fire_confidence").alias("confidence"))
    if bbox:
        w, s, e, n = bbox
        df = df.where(F.col("lon").between(w, e) & F.col("lat").between(s, n))
    return df.where("acq is not null and lat is not null and lon is not null")


def read_geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection's polygons: ``region_id, code, rings``; a ring needs four places and must close."""
    point = "array<array<array<double>>>"
    schema = "type string, features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path).where("type = 'FeatureCollection'").select(F.posexplode("features").alias("i", "f"))
    g = F.col("f.geometry")
    polygons = F.when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], point))).when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], f"array<{point}>"))
    rings = F.transform(F.flatten(polygons), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    name = F.coalesce(*(F.col("f.properties")[k] for k in ("name", "NAME_1", "shapeName")))
    out = raw.select(F.col("i").cast("long").alias("region_id"), F.coalesce(name, F.concat(F.lit("region "), "i")).alias("code"), rings.alias("rings"))
    return out.where(F.forall("rings", lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1))) & (F.size("rings") > 0))


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header in every file. With ``mark`` each file starts with a byte-order mark, and only cells that need quotes have them."""
    if mark:
        df = df.toDF("\ufeff" + df.columns[0], *df.columns[1:])
    df.write.option("header", True).option("quoteAll", not mark).option("escape", '"').csv(path)


def geometry_centre(geometry: Column) -> Column:
    """Centre of a GeoJSON geometry's box (a point is its own), from coordinates nested to any depth, or of ``POINT (x y)`` text."""
    pair = r"\[\s*(-?\d[\d.eE+-]*)\s*,\s*(-?\d[\d.eE+-]*)"
    axis = lambda i: F.transform(F.regexp_extract_all(geometry, F.lit(pair), F.lit(i)), lambda x: x.try_cast("double"))
    wkt = r"(?i)POINT\s*\(\s*(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\s*\)"
    own = lambda i: F.regexp_extract(geometry, wkt, i).try_cast("double")
    middle = lambda i: F.coalesce((F.array_min(axis(i)) + F.array_max(axis(i))) / 2, own(i))
    return F.struct(middle(2).alias("lat"), middle(1).alias("lon"))


def place_feed(df: DataFrame, geometry: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Rows of an event feed whose geometry's centre lies in the box; ``lat`` and ``lon`` added."""
    w, s, e, n = bbox
    placed = df.withColumn("_c", geometry_centre(F.col(geometry))).withColumns({"lat": F.col("_c.lat"), "lon": F.col("_c.lon")}).drop("_c")
    return placed.where(F.col("lat").between(s, n) & F.col("lon").between(w, e))


def read_event_feed(spark: SparkSession, path: str, bbox: tuple[float, float, float, float]) -> DataFrame:
    """A GeoJSON FeatureCollection of events of any geometry: ``id, properties, lat, lon`` inside the box."""
    schema = "type string, features array<struct<id: string, properties: map<string,string>, geometry: string>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f")).select("f.id", "f.properties", "f.geometry")
    return place_feed(f, "geometry", bbox).drop("geometry")


#: A channel's source and match radius in metres.
SLSTR = {"MWIR": ("COPERNICUS_S3_SL_2_FRP_MWIR1KM", 1200, 1000), "SWIR": ("COPERNICUS_S3_SL_2_FRP_SWIR500M", 700, 500)}


def read_slstr_frp(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """FRP CSV whose header line stands anywhere: a file's header is its line that names latitude and longitude.

    Lines meet their file's header by the file's name; those without numeric coordinates are left out.
    """
    source, radius, resolution = SLSTR[channel]
    cells = F.transform(F.split(F.lower("value"), ","), lambda c: F.trim(c))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), cells.alias("cells"))
    head = F.exists("cells", lambda c: c.startswith("lat")) & F.exists("cells", lambda c: c.startswith("lon"))
    heads = lines.where(head).groupBy("file").agg(F.min("cells").alias("names"))
    rows = lines.where(~head).join(heads, "file").where(F.size("cells") == F.size("names")).select(F.map_from_arrays("names", "cells").alias("m"))
    first = lambda *names: F.coalesce(*(F.col("m")[n].try_cast("double") for n in names))
    at = F.coalesce(*(F.try_to_timestamp(F.upper(F.col("m")[n])) for n in ("time", "acq_time", "datetime")))
    out = rows.select(F.lit(source).alias("source"), at.alias("acq"), first("latitude", "lat").alias("lat"), first("longitude", "lon").alias("lon"), first(f"frp_{channel.lower()}", "frp").alias("frp"), norm_confidence(F.coalesce(F.col("m")["confidence"], F.lit("")), "share").alias("confidence"))
    return out.where("lat is not null and lon is not null and acq is not null").withColumns({"match_radius_m": F.lit(radius), "resolution_m": F.lit(resolution)})


def msg_pixels(df: DataFrame) -> DataFrame:
    """Decoded pixels (``slot`` time, ``hhmm``, ``lat100`` and ``lon100`` in hundredths): degrees, and the pixel's own time of day if it has one."""
    minutes = F.floor(F.col("hhmm") / 100) * 60 + F.col("hhmm") % 100
    own = F.date_trunc("day", "slot") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    return df.withColumns({"lat": F.col("lat100") / 100, "lon": F.col("lon100") / 100, "acq": F.coalesce(own, F.col("slot"))}).drop("lat100", "lon100", "hhmm", "slot")


def regions_geojson(regions: DataFrame) -> DataFrame:
    """One GeoJSON feature a region: its id, its code and its rings, nothing else."""
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return regions.select("region_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("region_id", "code").alias("properties"), geometry.alias("geometry"))).alias("feature"))
