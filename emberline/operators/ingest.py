"""From rows of sensors to deduplicated detections inside an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .grid import covering


def norm_confidence(col: Column, kind: str = "text") -> Column:
    """Confidence letters: ``modis`` 80 and 30 split h, n, l; ``share`` takes 0..1 or 0..100; text passes through."""
    number = F.expr("1.0") * col.try_cast("double")
    if kind == "share":
        number = F.when(number <= 1, number * 100).otherwise(number)
    letters = F.when(number >= 80, "h").when(number >= 30, "n").when(number.isNotNull(), "l")
    return F.coalesce(letters, F.lower(F.trim(col))) if kind in ("modis", "share") else F.lower(F.trim(col))


def detection_hash(source, satellite, instrument, ts, lat, lon) -> Column:
    """Sha-256 of the row's identity: names, UTC microseconds, coordinates to six places; nulls are empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = lambda c: text(F.round(c, 6).cast("decimal(12,6)"))
    return F.sha2(F.concat_ws("|", text(source), text(satellite), text(instrument), F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")), place(lat), place(lon)), 256)


def detection_hash_geo(source, ts, lat, lon) -> Column:
    """The geostationary variant: whole seconds and five places."""
    place = lambda c: F.coalesce(F.round(c, 5).cast("decimal(11,5)").cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")), place(lat), place(lon)), 256)


def dedup(df: DataFrame, key: str = "detection_hash", order: list[str] | None = None) -> DataFrame:
    """The first arrival of each key, kept map-side: no more than one row a key and task is shuffled."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*(order or ["received_at", "id"]))).alias("_first"))
    return first.select(*(F.col(key) if c == key else F.col("_first")[c].alias(c) for c in df.columns))


def filter_aoi(points: DataFrame, aoi: DataFrame, key: str = "id") -> DataFrame:
    """The points that any area covers."""
    return points.join(covering(points.select(key, "lat", "lon"), aoi).select(key).distinct(), key, "left_semi")


def ingest_report(df: DataFrame, aoi: DataFrame, key: str = "id") -> DataFrame:
    """One row: received, outside, duplicate, inserted."""
    inside = covering(df.select(key, "lat", "lon"), aoi).select(key).distinct().withColumn("inside", F.lit(True))
    marked = df.join(inside, key, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    n = F.row_number().over(Window.partitionBy("inside", "detection_hash").orderBy("received_at", key))
    return marked.withColumn("n", n).agg(
        F.count("*").alias("received"), F.count_if(~F.col("inside")).alias("outside"),
        F.count_if(F.col("inside") & (F.col("n") > 1)).alias("duplicates"), F.count_if(F.col("inside") & (F.col("n") == 1)).alias("inserted"),
    )


def hotspot_daily(df: DataFrame, grid: float = 0.0025, family: str = "family") -> DataFrame:
    """Day, cell and sensor family: mean place, count, greatest FRP, how many of high confidence."""
    high = F.lower("confidence").isin("h", "high") | (F.col("confidence").try_cast("double") >= 80)
    return df.groupBy(F.col(family).alias("sensor_family"), F.to_date("acq").alias("day"), F.floor(F.col("lat") / grid).cast("int").alias("cell_lat"), F.floor(F.col("lon") / grid).cast("int").alias("cell_lon")).agg(
        F.avg("lat").alias("latitude"), F.avg("lon").alias("longitude"), F.count("*").alias("detection_count"), F.max("frp").alias("max_frp"), F.count_if(high).alias("high_confidence_count")
    )


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows not older than ``days`` at ``as_of``."""
    return df.where(F.col(ts) >= F.lit(as_of) - F.make_dt_interval(F.lit(days)))


def choose_source(days: DataFrame, availability: DataFrame) -> DataFrame:
    """For each day and family the most preferred dataset (``rank``) whose span holds the day."""
    return days.join(availability, "family").where("day between min_day and max_day").groupBy("family", "day").agg(F.min_by("dataset", F.struct("rank", "dataset")).alias("dataset"))


def pending(files: DataFrame, processed: DataFrame, key: str = "name") -> DataFrame:
    """Files not processed yet."""
    return files.join(processed, key, "left_anti")


def audit_sources(available: DataFrame, known: DataFrame, expected: DataFrame) -> DataFrame:
    """Each id known, available or expected: role, ``unknown`` and ``missing`` marks, and ``ok`` or ``attention``."""
    ids = available.select("id", F.lit(1).alias("a")).join(known.select("id", "role", F.lit(1).alias("k")), "id", "full_outer").join(expected.select("id", F.lit(1).alias("e")), "id", "full_outer")
    unknown, missing = F.col("a").isNotNull() & F.col("k").isNull(), F.col("e").isNotNull() & F.col("a").isNull()
    return ids.select("id", "role", unknown.alias("unknown"), missing.alias("missing"), F.when(unknown | missing, "attention").otherwise("ok").alias("status"))


def norm_parameter(col: Column) -> Column:
    """A sensor parameter's name: lower case, no blanks, subscript digits as plain ones."""
    return F.translate(F.regexp_replace(F.lower(col), r"\s+", ""), "₀₁₂₃₄₅₆₇₈₉", "0123456789")


def clean_html(col: Column) -> Column:
    """Text of a page: scripts, styles and tags out, common entities decoded, white space collapsed."""
    x = F.regexp_replace(col, r"(?is)<(script|style)\b.*?</\1>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def upsert_documents(base: DataFrame, delta: DataFrame, catalog: DataFrame) -> DataFrame:
    """Merge documents of enabled sources by source and external id; content hash added; a null time or place keeps the old."""
    good = delta.join(catalog.where("enabled").select("source_key"), "source_key", "left_semi").where("trim(external_id) <> '' and trim(title) <> ''")
    good = good.withColumn("content_hash", F.sha2(F.concat_ws("|", "title", F.coalesce("body", F.lit(""))), 256))
    from .grid import merge_keyed

    return merge_keyed(base, good.select(*base.columns), ["source_key", "external_id"], keep_old=["published_at", "lat", "lon"])


def to_geojson(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON point feature a row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
