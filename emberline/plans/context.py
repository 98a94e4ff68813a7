"""Queries of what surrounds events: recurrence near a point, links to documents, second sensors, winds, scenes, places; polygons and files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import documents, enrich, events, grid, ingest, objects
from ..session import shared_path
from ..sources import files
from .adapters import AS_OF, DET, IN_REGION, REG, as_of, detections, regions, table
from .base import query
from .core import ROLL, H

W, WI = f"WITH {DET}", f"WITH {DET}, {REG}, {IN_REGION}"
SPOT = (51.919, 36.729)
FROM_SPOT = H.format(a="51.919", b="36.729", c="{lat}", d="{lon}")


@query(f"""{W}, old AS (SELECT acq::DATE - 3 AS day, floor(lat / 0.05)::INT AS cell_lat, floor(lon / 0.05)::INT AS cell_lon, avg(lat) AS lat, avg(lon) AS lon, source AS sensor, count(*) AS n, max(frp) AS frp, count(*) FILTER (confidence = 'h') AS high FROM det GROUP BY ALL),
 a AS (SELECT * FROM old WHERE day >= {AS_OF}::DATE - 20 AND {FROM_SPOT.format(lat="lat", lon="lon")} <= 5000),
 l AS (SELECT acq::DATE AS day, floor(lat / 0.05)::INT AS cell_lat, floor(lon / 0.05)::INT AS cell_lon, avg(lat) AS lat, avg(lon) AS lon, instrument AS sensor, count(*) AS n, max(frp) AS frp, count(*) FILTER (confidence = 'h') AS high FROM det WHERE acq >= {AS_OF} - INTERVAL 20 DAY AND {FROM_SPOT.format(lat="lat", lon="lon")} <= 5000 GROUP BY 1, 2, 3, 6),
 g AS (SELECT day, cell_lat, cell_lon, avg(lat) AS lat, avg(lon) AS lon, list_sort(list(DISTINCT sensor)) AS sensors, sum(n)::BIGINT AS detections, max(frp) AS max_frp, sum(high)::BIGINT AS high_confidence, CASE WHEN bool_or(live) THEN 'live' ELSE 'archive' END AS kind FROM (SELECT *, false AS live FROM a UNION ALL SELECT *, true FROM l) GROUP BY 1, 2, 3)
 SELECT day, cell_lat, cell_lon, array_to_string(sensors, ',') AS sensors, detections, max_frp, high_confidence, kind, round({FROM_SPOT.format(lat="lat", lon="lon")}) AS distance_m FROM g WHERE {FROM_SPOT.format(lat="lat", lon="lon")} <= 5000 ORDER BY day DESC, distance_m, cell_lat, cell_lon LIMIT 50""")
def d5_hotspots_near(spark, d):
    """The newest hotspot days about a place, from an archive three days older and the detections themselves."""
    det = detections(spark, d)
    archive = ingest.hotspot_daily(det, 0.05, "source").withColumn("day", F.date_sub("day", 3))
    out = enrich.hotspots_near(archive, det, *SPOT, 9000, as_of(det), 20, 80, grid=0.05)
    return out.select("day", "cell_lat", "cell_lon", F.array_join("sensors", ",").alias("sensors"), "detections", "max_frp", "high_confidence", "kind", "distance_m")


NEAR = H.format(a="p.lat", b="p.lon", c="e.latest_lat", d="e.latest_lon")


@query(f"""{WI}, {ROLL}, e AS (SELECT r.*, (SELECT min(region_id) FROM reg WHERE latest_lon BETWEEN west AND east AND latest_lat BETWEEN south AND north) AS region_id FROM roll r),
 p AS (SELECT id, acq + INTERVAL 6 HOUR AS acq, lat + 0.01 AS lat, lon, region_id FROM det_r), j AS (SELECT p.id, e.event_id, {NEAR} AS m FROM p JOIN e ON p.region_id = e.region_id AND e.last_seen >= p.acq - INTERVAL 24 HOUR AND e.first_seen <= p.acq + INTERVAL 24 HOUR AND abs(p.lat - e.latest_lat) < 0.1 WHERE {NEAR} <= 5000),
 b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(m, 3), event_id) = 1) SELECT p.id, b.event_id, round(m)::BIGINT AS metres FROM p LEFT JOIN b USING (id)""")
def c7_attach_secondary(spark, d):
    """Every detection, moved a little in place and time, as a second sensor's pixel."""
    det = grid.assign_region(detections(spark, d), regions(spark, d), "id")
    e = events.event_rollup(det)
    placed = grid.assign_region(e.select("event_id", F.col("latest_lat").alias("lat"), F.col("latest_lon").alias("lon")), regions(spark, d), "event_id").select("event_id", "region_id")
    pixels = det.select("id", F.expr("acq + interval 6 hour").alias("acq"), (F.col("lat") + 0.01).alias("lat"), "lon", "region_id")
    return events.attach_secondary(pixels, e.join(placed, "event_id")).select("id", "event_id", F.round("distance_m").cast("long").alias("metres"))


@query(f"{W} SELECT id, CASE WHEN frp / 40 > 2 AND coalesce(CASE WHEN id % 5 > 0 THEN id % 10 / 20 END, 0) >= 0.3 THEN 'strong' WHEN frp / 40 > 1 OR coalesce(CASE WHEN id % 5 > 0 THEN id % 10 / 20 END, 0) >= 0.25 THEN 'elevated' WHEN frp IS NOT NULL OR id % 5 > 0 THEN 'background' ELSE 'insufficient' END AS level FROM det")
def d9_atmosphere_level(spark, d):
    det = detections(spark, d)
    return det.select("id", events.atmosphere_level(F.col("frp") / 40, F.when(F.col("id") % 5 > 0, F.col("id") % 10 / 20)).alias("level"))


STEP = """degrees(asin(sin(radians(lat)) * cos(v / 6371000.0) + cos(radians(lat)) * sin(v / 6371000.0) * cos(radians(t)))) AS lat,
 ((degrees(radians(lon) + atan2(sin(radians(t)) * sin(v / 6371000.0) * cos(radians(lat)), cos(v / 6371000.0) - sin(radians(lat)) * (sin(radians(lat)) * cos(v / 6371000.0) + cos(radians(lat)) * sin(v / 6371000.0) * cos(radians(t))))) + 540) % 360) - 180 AS lon"""


@query(f"""WITH RECURSIVE {DET}, {ROLL}, walk AS (SELECT event_id, substr(event_id, 2)::INT AS site, 0 AS hour, latest_lat AS lat, latest_lon AS lon FROM roll UNION ALL
 SELECT event_id, site, hour + 1, {STEP} FROM (SELECT *, ((site + hour + 1) % 12 + 0.5) * 3600.0 AS v, (site * 40 + (hour + 1) * 10 + 180) % 360 AS t FROM walk WHERE hour < 6))
 SELECT event_id, hour, round(lat, 6) AS lat, round(lon, 6) AS lon FROM walk WHERE hour IN (1, 3, 6)""")
def d11_plume(spark, d):
    """Where six hours of wind carry air from each event: the places after one, three and six."""
    e = events.event_rollup(detections(spark, d))
    wind = e.select("event_id", F.substring("event_id", 2, 20).cast("int").alias("site"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("hour"))
    wind = wind.select("event_id", "hour", ((F.col("site") + F.col("hour")) % 12 + 0.5).alias("speed"), ((F.col("site") * 40 + F.col("hour") * 10) % 360).cast("double").alias("from_deg"))
    out = enrich.plume(e, wind).select("event_id", F.explode("path").alias("p")).select("event_id", "p.*")
    return out.where("hour in (1, 3, 6)").select("event_id", "hour", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"{W} SELECT source, round((degrees(atan2(avg(sin(radians(site * 7 % 360))), avg(cos(radians(site * 7 % 360))))) + 360) % 360, 4) AS mean_deg FROM det GROUP BY 1")
def g9_mean_direction(spark, d):
    return detections(spark, d).groupBy("source").agg(F.round(geo.mean_direction(F.col("site") * 7 % 360), 4).alias("mean_deg"))


@query(f"WITH {REG} SELECT region_id, round(west - 1500 / (111320 * greatest(0.2, cos(radians((south + north) / 2)))), 9) AS west, round(south - 1500 / 111320.0::DOUBLE, 9) AS south, round(east + 1500 / (111320 * greatest(0.2, cos(radians((south + north) / 2)))), 9) AS east, round(north + 1500 / 111320.0::DOUBLE, 9) AS north FROM reg")
def g10_expand_bbox(spark, d):
    box = regions(spark, d).select("region_id", geo.expand_bbox_m(geo.bbox(F.col("rings")[0]), 1500).alias("b"))
    return box.select("region_id", *(F.round(f"b.{c}", 9).alias(c) for c in ("west", "south", "east", "north")))


SCENE = f"""sc AS (SELECT event_id || '-' || floor(epoch(acq) / 43200)::BIGINT AS scene_id, event_id, acq, frp + 50 AS nir, (id % 97 + 1)::DOUBLE AS swir, id % 23 AS scl, site % 50 AS cloud FROM det),
 px AS (SELECT event_id, scene_id, min(acq) AS taken_at, any_value(cloud) AS cloud, avg((scl NOT IN (0, 1, 3, 8, 9, 10, 11))::INT) AS valid, quantile_cont((nir - swir) / (nir + swir), 0.5) FILTER (scl NOT IN (0, 1, 3, 8, 9, 10, 11)) AS nbr FROM sc GROUP BY 1, 2),
 s AS (SELECT px.*, (epoch_us(r.first_seen + INTERVAL 15 DAY) - epoch_us(taken_at)) / 3.6e9 AS age FROM px JOIN roll r USING (event_id) WHERE valid >= 0.55 AND cloud <= 35)"""


@query(f"""{W}, {ROLL}, {SCENE}, p AS (SELECT event_id, arg_min(nbr, age) FILTER (age BETWEEN 1 AND 1080) AS b, arg_max(nbr, age) FILTER (age BETWEEN -1080 AND -24) AS a FROM s GROUP BY 1)
 SELECT event_id, round(b - a, 6) AS dnbr, CASE WHEN b - a IS NULL THEN 'insufficient' WHEN b - a >= 0.3 THEN 'strong' WHEN b - a >= 0.15 THEN 'moderate' WHEN b - a >= 0.05 THEN 'weak' ELSE 'none' END AS change FROM p""")
def d14_surface_change(spark, d):
    """Half days of an event as scenes, its detections as their pixels; change about a moment fifteen days in."""
    det = detections(spark, d)
    half = F.floor(F.unix_timestamp("acq") / 43200).cast("long").cast("string")
    px = det.select("event_id", F.concat_ws("-", "event_id", half).alias("scene_id"), "acq", "site", (F.col("frp") + 50).alias("nir"), (F.col("id") % 97 + 1).cast("double").alias("swir"), (F.col("id") % 23).alias("scl"))
    scenes = px.groupBy("scene_id").agg(F.min("acq").alias("taken_at"), (F.min("site") % 50).alias("cloud"))
    e = events.event_rollup(det).withColumn("first_seen", F.expr("first_seen + interval 15 day"))
    return enrich.surface_change(px, scenes, e).select("event_id", F.round("dnbr", 6).alias("dnbr"), "change")


@query(f"{W} SELECT event_id, CASE WHEN any_value(site) % 5 = 0 THEN 'ok' WHEN any_value(site) % 5 < 4 THEN 'partial' ELSE 'error' END AS status, CASE WHEN any_value(site) % 9 > 0 THEN least(360.0::DOUBLE, 15 * pow(2.0, any_value(site) % 9 - 1)) ELSE 0 END AS wait_min FROM det GROUP BY 1")
def d15_fire_weather_status(spark, d):
    cache = detections(spark, d).select("event_id", (F.col("site") % 5).alias("failed_layers"), F.lit(4).alias("layers"), (F.col("site") % 9).alias("failures")).distinct()
    return enrich.fire_weather_status(cache).select("event_id", "status", "wait_min")


COVER = H.format(a="f.lat", b="f.lon", c="r.latest_lat", d="r.latest_lon")


@query(f"""{W}, {ROLL}, f AS (SELECT lat, lon, ['forest', 'farm', 'water', 'scrub'][id % 4 + 1] AS category, 20 + id % 60 AS base FROM det WHERE confidence <> 'l'),
 j AS (SELECT r.event_id, category, base * (0.55 + 0.45 * (1 - {COVER} / 5000)) AS s FROM f JOIN roll r ON abs(f.lat - r.latest_lat) < 0.1 AND {COVER} <= 5000), p AS (SELECT event_id, category, max(s) + 2 * (count(*) - 1) AS score FROM j GROUP BY 1, 2)
 SELECT event_id, arg_max(category, (round(score, 6), category)) AS category, round(max(score), 3) AS score FROM p GROUP BY 1""")
def d20_landcover_context(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("forest", "farm", "water", "scrub"))), (F.col("id") % 4 + 1).cast("int"))
    f = detections(spark, d).where("confidence <> 'l'").select("lat", "lon", kind.alias("category"), (20 + F.col("id") % 60).alias("base"))
    return enrich.landcover_context(events.event_rollup(detections(spark, d)), f)


PLACE = H.format(a="p.lat", b="p.lon", c="r.latest_lat", d="r.latest_lon")


@query(f"""{W}, {ROLL}, p AS (SELECT site AS place_id, min({{'name': source || site, 'lat': lat, 'lon': lon}}) AS s FROM det WHERE site % 6 > 0 GROUP BY 1),
 j AS (SELECT r.event_id, place_id, p.name, {PLACE} AS m FROM (SELECT place_id, s.name AS name, s.lat AS lat, s.lon AS lon FROM p) p JOIN roll r ON abs(p.lat - r.latest_lat) < 0.6 AND {PLACE} <= 50000) SELECT event_id, place_id, name, row_number() OVER (PARTITION BY event_id ORDER BY round(m), place_id)::INT AS rank FROM j QUALIFY rank <= 15""")
def d25_nearby_places(spark, d):
    """Sites as places that several sources name; some have no name."""
    det = detections(spark, d)
    places = det.select(F.col("site").alias("place_id"), F.when(F.col("site") % 6 > 0, F.concat("source", "site")).alias("name"), "lat", "lon")
    return enrich.nearby_places(events.event_rollup(det), places, 50000).select("event_id", "place_id", "name", "rank")


@query("SELECT p_partkey AS id, array_to_string(list_filter([p_name, CASE WHEN p_size % 2 = 0 THEN 'Town ' || p_size END], lambda x: x IS NOT NULL), '|') AS names FROM part")
def d25_clean_names(spark, d):
    """Alternate names with an address, an id, a code, a blank and a repeat among them."""
    p = table(spark, d, "part")
    junk = [F.concat(F.lit("https://x.org/"), "p_partkey"), F.concat(F.lit("Q"), "p_partkey"), F.lit("AB12"), F.lit("  ")]
    names = F.array(junk[0], F.col("p_name"), *junk[1:], F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Town "), "p_size")).otherwise(F.col("p_name")), F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(enrich.clean_names(names), "|").alias("names"))


WORDS = "['that', 'this', 'there', 'tion', 'under', 'enough']"
DOCS = f"dd AS (SELECT doc_id, ['quake', 'alert', 'other'][doc_id % 3 + 1] AS rule, TIMESTAMP '2024-01-01' + doc_id % 720 * INTERVAL 1 HOUR AS published_at, CASE WHEN doc_id % 4 > 0 THEN 44 + doc_id * 37 % 800 / 100.0::DOUBLE END AS lat, CASE WHEN doc_id % 4 > 0 THEN 22 + doc_id * 53 % 1800 / 100.0::DOUBLE END AS lon, lower(text) AS body FROM documents)"
APART = H.format(a="lat", b="lon", c="latest_lat", d="latest_lon")


@query(f"""{W}, {ROLL}, {DOCS}, e AS (SELECT event_id, last_seen, latest_lat, latest_lon, CASE WHEN s % 7 > 0 THEN {WORDS}[s % 6 + 1] END AS place, CASE WHEN s % 5 > 0 THEN {WORDS}[s % 4 + 1] || 'n' END AS region FROM (SELECT *, substr(event_id, 2)::INT AS s FROM roll)),
 j AS (SELECT *, abs(epoch_us(published_at) - epoch_us(last_seen)) / 1e6 AS gap, CASE WHEN lat IS NOT NULL THEN {APART} END AS m FROM dd JOIN e ON abs(epoch_us(published_at) - epoch_us(last_seen)) / 1e6 <= CASE rule WHEN 'quake' THEN 43200 ELSE 259200 END AND (lat IS NULL OR abs(lat - latest_lat) < 1)),
 s AS (SELECT *, CASE WHEN m IS NULL THEN 0 WHEN rule = 'quake' THEN CASE WHEN m <= 5000 THEN 55 WHEN m <= 15000 THEN 40 WHEN m <= 25000 THEN 25 ELSE 0 END WHEN m <= 5000 THEN 50 WHEN m <= 25000 THEN 40 WHEN m <= 50000 THEN 30 WHEN m <= CASE rule WHEN 'alert' THEN 100000 ELSE 75000 END THEN 15 ELSE 0 END AS place_score,
  CASE WHEN rule = 'quake' THEN CASE WHEN gap <= 3600 THEN 35 WHEN gap <= 10800 THEN 25 ELSE 10 END WHEN gap <= 10800 THEN 30 WHEN gap <= 43200 THEN 24 WHEN gap <= 86400 THEN 18 ELSE 10 END AS time_score, least(50, CASE WHEN contains(body, place) THEN 35 ELSE 0 END + CASE WHEN contains(body, region) THEN 20 ELSE 0 END) AS text_score FROM j),
 r AS (SELECT *, least(100, place_score + time_score + text_score) AS score FROM s WHERE CASE WHEN lat IS NOT NULL THEN m <= CASE rule WHEN 'quake' THEN 25000 WHEN 'alert' THEN 100000 ELSE 75000 END AND place_score + time_score >= CASE rule WHEN 'quake' THEN 50 ELSE 30 END ELSE text_score >= 20 AND time_score >= 10 END)
 SELECT doc_id, event_id, place_score, time_score, text_score, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, gap, event_id)::INT AS rank FROM r QUALIFY rank <= CASE rule WHEN 'quake' THEN 5 ELSE 25 END""")
def t9_link_documents(spark, d):
    """Documents of three kinds of source, a quarter without a place, against all events; names are words that texts may hold."""
    n = lambda c, k: (F.col(c) % k + 1).cast("int")
    words = F.array(*map(F.lit, ("that", "this", "there", "tion", "under", "enough")))
    t = table(spark, d, "documents")
    docs = t.select(
        "doc_id", F.element_at(F.array(*map(F.lit, ("quake", "alert", "other"))), n("doc_id", 3)).alias("rule"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int))").alias("published_at"),
        F.when(F.col("doc_id") % 4 > 0, 44 + F.col("doc_id") * 37 % 800 / 100).alias("lat"), F.when(F.col("doc_id") % 4 > 0, 22 + F.col("doc_id") * 53 % 1800 / 100).alias("lon"), "text",
    )
    e = events.event_rollup(detections(spark, d)).withColumn("s", F.substring("event_id", 2, 20).cast("int"))
    e = e.withColumn("place", F.when(F.col("s") % 7 > 0, F.element_at(words, n("s", 6)))).withColumn("region", F.when(F.col("s") % 5 > 0, F.concat(F.element_at(words, n("s", 4)), F.lit("n"))))
    return documents.link_documents(docs, e).drop("distance_m")


CORNERS = ((24.00037, 45.00041), (38.00037, 45.00041), (31.00037, 51.50041), (24.00037, 45.00041))
HOLE = ((29.00013, 46.00017), (33.00013, 46.00017), (33.00013, 48.00017), (29.00013, 48.00017), (29.00013, 46.00017))
BOX = ((36.00037, 49.00041), (39.00037, 49.00041), (39.00037, 51.00041), (36.00037, 51.00041), (36.00037, 49.00041))


@query(f"{W} SELECT id FROM det WHERE lat >= 45.00041 AND (lat - 45.00041) * 7 <= (lon - 24.00037) * 6.5 AND (lat - 45.00041) * 7 <= (38.00037 - lon) * 6.5 AND NOT (lon > 29.00013 AND lon < 33.00013 AND lat > 46.00017 AND lat < 48.00017) UNION SELECT id FROM det WHERE lon BETWEEN 36.00037 AND 39.00037 AND lat BETWEEN 49.00041 AND 51.00041")
def p4_within_polygon(spark, d):
    """A triangle with a hole, in pieces as large as a search may be, and a box apart from it."""
    plans = (*objects.pieces(CORNERS, (HOLE,)), *objects.pieces(BOX))
    return objects.within_polygon(detections(spark, d).select("id", "lat", "lon"), *plans).select("id")


def written(df, name):
    """Lines of text in the shared folder, as a feed would leave them."""
    path = shared_path(df.sparkSession, name)
    df.write.text(path)
    return path


def lines(df, *columns, head):
    """Lines of a CSV behind ``head`` in every file, one a partition."""
    body = df.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return body.repartition(8).mapInArrow(run, "value string")


@query(f"{W} SELECT source, satellite, acq::DATE + hour(acq) * INTERVAL 1 HOUR + minute(acq) * INTERVAL 1 MINUTE AS acq, lat, lon, frp, CASE WHEN frp >= 80 THEN 'h' WHEN frp >= 30 THEN 'n' ELSE 'l' END AS confidence FROM (SELECT * REPLACE ('S' AS source) FROM det WHERE id % 10 > 0) WHERE date_trunc('minute', acq) BETWEEN {AS_OF} - INTERVAL 24 HOUR AND {AS_OF} + INTERVAL 10 MINUTE")
def a1_read_firms(spark, d):
    """The table as a sensor's CSV, written out and read with its window; a tenth of the rows has no place."""
    det = detections(spark, d)
    place = F.when(F.col("id") % 10 > 0, F.col("lat"))
    rows = det.select(place.alias("latitude"), "lon", "frp", F.col("frp").alias("c"), F.date_format("acq", "yyyy-MM-dd").alias("day"), F.date_format("acq", "Hmm").alias("t"), "satellite", "instrument")
    path = written(lines(rows, *rows.columns, head="latitude,longitude,frp,confidence,acq_date,acq_time,satellite,instrument"), "firms")
    out = files.read_firms_csv(spark, path, "S", as_of(det), kind="modis")
    return out.select("source", "satellite", F.col("acq").cast("timestamp_ntz").alias("acq"), "lat", "lon", "frp", "confidence")


@query(f"{W} SELECT date_trunc('second', acq) AS acq, lat, lon, frp, id % 100 / 100.0::DOUBLE AS confidence FROM det WHERE lon BETWEEN 24 AND 36 AND lat BETWEEN 45 AND 50 AND id % 9 > 0")
def a3_read_geostationary(spark, d):
    """The table as a geostationary product's CSV with its other column names; rows without a place drop out."""
    det = detections(spark, d)
    rows = det.select(F.date_format("acq", "yyyyMMddHHmmss").alias("t"), F.when(F.col("id") % 9 > 0, F.col("lat")).alias("lat"), "lon", "frp", (F.col("id") % 100 / 100).alias("c"))
    path = written(lines(rows, *rows.columns, head="ACQUISITION_TIME,LAT,LON,FRP_MW,FIRE_CONFIDENCE"), "geostationary")
    out = files.read_geostationary_frp(spark, path, (24, 45, 36, 50))
    return out.select(F.col("acq").cast("timestamp_ntz").alias("acq"), "lat", "lon", "frp", "confidence")


@query(f"{W} SELECT 'COPERNICUS_S3_SL_2_FRP_SWIR500M' AS source, date_trunc('second', acq) AS acq, lat, lon, frp, 700 AS match_radius_m FROM det WHERE id % 8 > 0")
def a4_read_slstr(spark, d):
    """The table as a two-channel product whose header follows other lines."""
    det = detections(spark, d)
    rows = det.select(F.date_format("acq", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.when(F.col("id") % 8 > 0, F.col("lat").cast("string")).otherwise("none").alias("lat"), "lon", "frp", (F.col("frp") * 2).alias("m"), F.lit("0.9").alias("c"))
    path = written(lines(rows, *rows.columns, head="# product\nnote,1\nTime,Latitude,Longitude,FRP_SWIR,FRP_MWIR,Confidence"), "slstr")
    return files.read_slstr_frp(spark, path, "SWIR").select("source", F.col("acq").cast("timestamp_ntz").alias("acq"), "lat", "lon", "frp", "match_radius_m")


@query(f"WITH {REG} SELECT code, west, south, east, north FROM reg WHERE zone <> 4")
def a6_read_geojson(spark, d):
    """Regions as one collection of features, some of them as multipolygons, some with a ring that does not close."""
    r = regions(spark, d).orderBy("region_id")
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["lon"], p["lat"]))
    ring = F.when(F.col("zone") == 4, F.slice(ring, 1, 4)).otherwise(ring)
    named = F.to_json(F.create_map(F.when(F.col("region_id") % 2 == 0, "name").otherwise("NAME_1"), F.col("code")))
    shape = F.when(F.col("zone") == 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), F.to_json(ring), F.lit("]]}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(ring), F.lit("]}")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), named, F.lit(',"geometry":'), shape, F.lit("}"))
    one = r.select(feature.alias("f")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    out = files.read_geojson_polygons(spark, written(one, "geojson")).select("code", geo.bbox(F.col("rings")[0]).alias("b"))
    return out.select("code", "b.*")


@query("SELECT doc_id, text, lang FROM documents")
def a14_write_csv(spark, d):
    """Whole texts out to CSV with quotes and line breaks in them, and read back."""
    path = shared_path(spark, "csv")
    files.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema("doc_id long, text string, lang string").csv(path)
    return back.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
