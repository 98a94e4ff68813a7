"""Queries of ingest, clustering, event analytics and audits over the detections adapter."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.times import micros
from ..operators import cluster, enrich, events, grid, ingest, integrity
from .adapters import AS_OF, DET, IN_REGION, REG, as_of, detections, regions
from .base import query

W = f"WITH {DET}"
WR = f"WITH {DET}, {REG}"
WI = f"WITH {DET}, {REG}, {IN_REGION}"
H = "(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"
HASH = "sha256(concat_ws('|', source, satellite, instrument, strftime(acq, '%Y-%m-%dT%H:%M:%S.%f'), round(lat, 6)::DECIMAL(12,6)::VARCHAR, round(lon, 6)::DECIMAL(12,6)::VARCHAR))"
ROLL = """roll AS (SELECT event_id, min(acq) AS first_seen, max(acq) AS last_seen, count(*) AS observations, arg_max(frp, (acq, id)) AS latest_frp, max(frp) AS max_frp, arg_max(confidence, (acq, id)) AS latest_confidence,
 arg_max(lat, (acq, id)) AS latest_lat, arg_max(lon, (acq, id)) AS latest_lon, list_sort(list(DISTINCT satellite)) AS satellites, list_sort(list(DISTINCT instrument)) AS instruments, list_sort(list(DISTINCT source)) AS sources FROM det GROUP BY 1)"""
KEY = "CASE source WHEN 'VIIRS_NOAA20_NRT' THEN 'NOAA20_VIIRS' WHEN 'VIIRS_SNPP_NRT' THEN 'SNPP_VIIRS' WHEN 'EUMETSAT_MTG_MTFRPPIXEL' THEN 'MTG_FCI' WHEN 'LSA_SAF_MSG_FRP_PIXEL' THEN 'MSG_SEVIRI' ELSE upper(satellite) || '_SLSTR' END"


def hashed(spark, d):
    c = F.col
    return detections(spark, d).withColumn("detection_hash", ingest.detection_hash(c("source"), c("satellite"), c("instrument"), c("acq"), c("lat"), c("lon")))


def flat(df, *names):
    """Arrays as comma-joined strings, for comparison."""
    return df.withColumns({n: F.array_join(n, ",") for n in names})


@query(f"{W} SELECT id, {HASH} AS detection_hash FROM det")
def c1_detection_hash(spark, d):
    return hashed(spark, d).select("id", "detection_hash")


@query(f"{W} SELECT id, sha256(concat_ws('|', source, strftime(acq, '%Y-%m-%dT%H:%M:%S'), round(lat, 5)::DECIMAL(11,5)::VARCHAR, round(lon, 5)::DECIMAL(11,5)::VARCHAR)) AS detection_hash FROM det")
def c2_geostationary_hash(spark, d):
    return detections(spark, d).select("id", ingest.detection_hash_geo(F.col("source"), F.col("acq"), F.col("lat"), F.col("lon")).alias("detection_hash"))


@query(f"{W}, twice AS (SELECT * FROM det UNION ALL SELECT * REPLACE (received_at + INTERVAL 1 HOUR AS received_at) FROM det WHERE id % 7 = 0) SELECT id, min(received_at) AS received_at FROM twice GROUP BY id")
def c3_dedup(spark, d):
    det = hashed(spark, d)
    again = det.where("id % 7 = 0").withColumn("received_at", F.expr("received_at + interval 1 hour"))
    return ingest.dedup(det.unionByName(again)).select("id", "received_at")


@query(f"{WI}, twice AS (SELECT * FROM det UNION ALL SELECT * REPLACE (id + 1000000000 AS id, received_at + INTERVAL 1 HOUR AS received_at) FROM det WHERE id % 7 = 0) SELECT count(*) AS received, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (inside AND id >= 1000000000) AS duplicates, count(*) FILTER (inside AND id < 1000000000) AS inserted FROM (SELECT id, EXISTS (SELECT 1 FROM reg WHERE zone < 3 AND lon BETWEEN west AND east AND lat BETWEEN south AND north) AS inside FROM twice)")
def c3_ingest_report(spark, d):
    det = hashed(spark, d)
    again = det.where("id % 7 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "received_at": F.expr("received_at + interval 1 hour")})
    return ingest.ingest_report(det.unionByName(again), regions(spark, d).where("zone < 3"))


@query(f"{WR} SELECT id FROM det WHERE EXISTS (SELECT 1 FROM reg WHERE zone < 3 AND lon BETWEEN west AND east AND lat BETWEEN south AND north)")
def c4_filter_aoi(spark, d):
    return ingest.filter_aoi(detections(spark, d), regions(spark, d).where("zone < 3")).select("id")


@query(f"{WI} SELECT id, region_id FROM det_r")
def g2_assign_region(spark, d):
    return grid.assign_region(detections(spark, d), regions(spark, d), "id").select("id", "region_id")


@query(f"{WI} SELECT d.id AS idx, d.region_id IS NOT NULL AS inside, r.code AS region_code FROM det_r d LEFT JOIN reg r USING (region_id)")
def g8_spatial_gate(spark, d):
    return grid.spatial_gate(detections(spark, d).withColumnRenamed("id", "idx"), regions(spark, d))


SITES = "sites AS (SELECT site, min(lat) AS lat, min(lon) AS lon FROM det GROUP BY site)"


@query(f"{W}, {SITES} SELECT a.site, b.site AS site2, round({H.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')})::BIGINT AS metres FROM sites a JOIN sites b ON a.site < b.site WHERE {H.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} <= 60000")
def g1_dwithin_join(spark, d):
    s = detections(spark, d).groupBy("site").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    pairs = grid.dwithin_join(s, s.toDF("site2", "lat2", "lon2"), 60000, extra=F.col("site") < F.col("site2"))
    return pairs.select("site", "site2", F.round("distance_m").cast("long").alias("metres"))


@query(f"{W}, {SITES}, p AS (SELECT a.site, b.site AS site2, {H.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')} AS m FROM sites a JOIN sites b ON a.site <> b.site) SELECT site, site2, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(m), site2)::INT AS rn FROM p WHERE m <= 90000) WHERE rn <= 3")
def g3_nearest(spark, d):
    s = detections(spark, d).groupBy("site").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return grid.nearest_within(s, s.toDF("site2", "lat2", "lon2"), "site", 90000, ["site2"], 3, "rank", F.col("site") != F.col("site2")).select("site", "site2", "rank")


@query(f"{W} SELECT site, round({H.format(a='min(lat)', b='min(lon)', c='max(lat)', d='max(lon)')})::BIGINT AS metres, round(min(lat), 3) AS south FROM det GROUP BY site")
def g9_geodesy(spark, d):
    g = detections(spark, d).groupBy("site").agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("e"))
    return g.select("site", F.round(geo.haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("e"))).cast("long").alias("metres"), F.round("a", 3).alias("south"))


@query(f"{WR} SELECT region_id, west, south, east, north, round(3.6::DOUBLE * 1.6::DOUBLE * 111320::DOUBLE * 111320::DOUBLE * cos(radians((3 * south + 2 * north) / 5)) / 1e6, 3) AS area_km2 FROM reg")
def g12_region_box_area(spark, d):
    r = regions(spark, d).select("region_id", geo.bbox(F.col("rings")[0]).alias("b"), F.round(geo.polygon_area_km2(F.col("rings")), 3).alias("area_km2"))
    return r.select("region_id", "b.*", "area_km2")


@query(f"{W}, delta AS (SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 1000000000 END AS id, frp + 1 AS frp, CASE WHEN id % 4 = 0 THEN NULL ELSE 'x' END AS confidence FROM det) SELECT coalesce(b.id, d.id) AS id, CASE WHEN d.id IS NULL THEN b.frp ELSE d.frp END AS frp, coalesce(d.confidence, b.confidence) AS confidence FROM det b FULL JOIN delta d ON b.id = d.id")
def g4_merge_keyed(spark, d):
    """Every detection merged with a changed copy of all of them: even ones replace, odd ones come as new."""
    det = detections(spark, d)
    delta = det.select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(1_000_000_000)).alias("id"), (F.col("frp") + 1).alias("frp"), F.when(F.col("id") % 4 != 0, "x").alias("confidence"))
    return grid.merge_keyed(det.select("id", "frp", "confidence"), delta, ["id"], keep_old=["confidence"])


@query(f"{W}, delta AS (SELECT id + CASE WHEN id % 2 = 0 THEN 0 ELSE 1000000000 END AS id, frp + 1 AS frp FROM det) SELECT id, frp FROM det UNION ALL SELECT id, frp FROM delta WHERE id >= 1000000000")
def g4_insert_new(spark, d):
    det = detections(spark, d).select("id", "frp")
    delta = det.select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(1_000_000_000)).alias("id"), (F.col("frp") + 1).alias("frp"))
    return grid.insert_new(det, delta, ["id"])


@query(f"{W} SELECT id, 'lat' AS metric, round(lat, 3) AS value FROM det UNION ALL SELECT id, 'frp', round(frp, 3) FROM det")
def g6_unpivot(spark, d):
    return grid.unpivot(detections(spark, d).select("id", F.round("lat", 3).alias("lat"), F.round("frp", 3).alias("frp")), ["id"], ["lat", "frp"])


@query("SELECT event_id AS id, (json_extract(props, '$.k'))::INT AS k FROM events")
def g7_json_records(spark, d):
    from .adapters import table

    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k int").alias("p")).select("id", "p.k")


def clustered(spark, d, mode="core"):
    det = grid.assign_region(detections(spark, d), regions(spark, d), "id")
    radius = F.when(F.col("resolution_m") == 375, 750).otherwise(1000)
    return cluster.cluster_events(det.withColumn("radius_m", radius), region_mode=mode)


FAR = "(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians(e.lat) - radians(o.lat)) / 2), 2) + cos(radians(o.lat)) * cos(radians(e.lat)) * pow(sin((radians(e.lon) - radians(o.lon)) / 2), 2)))))"
CORE, STRICT = "(e.region IS NULL OR o.region_id IS NULL OR e.region = o.region_id)", "e.region IS NOT DISTINCT FROM o.region_id"
RADIUS = "CASE WHEN o.resolution_m = 375 THEN 750 ELSE 1000 END"


def folded(region, radius, where="true"):
    """The clustering in SQL: one detection a step of a recursion, in arrival order, with the open events in a list.

    Rows arrive within three hours of their time, so an event 27 hours older than a row meets no later one.
    """
    return f"""WITH RECURSIVE {DET}, {REG}, {IN_REGION},
ord AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY received_at, id) AS i FROM det_r WHERE {where}),
fold(key, i, event_id, opened, open) USING KEY (key) AS (
  SELECT -1::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, []::STRUCT(k BIGINT, first TIMESTAMP, last TIMESTAMP, lat DOUBLE, lon DOUBLE, region BIGINT)[]
  UNION
  SELECT unnest([-1, id]), i, 'e' || coalesce(best.k, id), best IS NULL, open FROM (
    SELECT o.id, o.i, best, CASE WHEN best IS NULL THEN list_append(open, {{'k': o.id, 'first': o.acq, 'last': o.acq, 'lat': o.lat, 'lon': o.lon, 'region': o.region_id}})
      ELSE list_transform(open, lambda e: CASE WHEN e.k <> best.k THEN e WHEN o.acq >= e.last THEN {{'k': e.k, 'first': least(e.first, o.acq), 'last': o.acq, 'lat': o.lat, 'lon': o.lon, 'region': e.region}}
        ELSE {{'k': e.k, 'first': least(e.first, o.acq), 'last': e.last, 'lat': e.lat, 'lon': e.lon, 'region': e.region}} END) END AS open
    FROM (SELECT o AS o, list_filter(f.open, lambda e: e.last + INTERVAL 27 HOUR >= o.acq) AS open,
        list_min(list_filter(list_transform(list_filter(f.open, lambda e: o.acq BETWEEN e.first - INTERVAL 24 HOUR AND e.last + INTERVAL 24 HOUR AND {region}), lambda e: {{'d': {FAR}, 'l': -epoch_us(e.last), 'k': e.k}}), lambda x: x.d <= {radius})) AS best
      FROM fold f JOIN ord o ON o.i = f.i + 1 WHERE f.key = -1)))"""


@query(f"{folded(CORE, RADIUS)} SELECT key AS id, event_id, opened FROM fold WHERE key >= 0")
def c5_cluster_events(spark, d):
    return clustered(spark, d)


@query(f"{folded(STRICT, RADIUS)} SELECT key AS id, event_id, opened FROM fold WHERE key >= 0")
def c6_cluster_events_strict(spark, d):
    return clustered(spark, d, "strict")


@query(f"""{folded(CORE, 1000, "region_id IS NOT NULL")}, m AS (SELECT d.*, f.event_id AS event FROM det_r d JOIN fold f ON f.key = d.id),
 e AS (SELECT event, min(region_id) AS region_id, count(*) AS n, max(frp) AS max_frp, count(DISTINCT satellite) AS satellites, (epoch_us(max(acq)) - epoch_us(min(acq))) / 3.6e9 AS hours FROM m GROUP BY 1)
 SELECT region_id, count(*) AS events, sum(n)::BIGINT AS detections, max(n) AS largest, count(*) FILTER (satellites >= 2) AS confirmed, round(max(max_frp), 3) AS max_frp, round(max(hours), 3) AS longest_h FROM e GROUP BY 1""")
def event_analytics_by_region(spark, d):
    """Flagship: area gate, hash dedup, clustering, rollup; what the clusters of each region are."""
    det = ingest.dedup(grid.assign_region(hashed(spark, d), regions(spark, d), "id").where("region_id is not null"))
    members = det.drop("event_id").join(cluster.cluster_events(det.withColumn("radius_m", F.lit(1000.0))).select("id", "event_id"), "id")
    per = events.event_rollup(members).join(members.groupBy("event_id").agg(F.min("region_id").alias("region_id")), "event_id")
    hours = (micros("last_seen") - micros("first_seen")) / 3.6e9
    return per.groupBy("region_id").agg(
        F.count("*").alias("events"), F.sum("observations").alias("detections"), F.max("observations").alias("largest"), F.count_if(F.size("satellites") >= 2).alias("confirmed"),
        F.round(F.max("max_frp"), 3).alias("max_frp"), F.round(F.max(hours), 3).alias("longest_h"),
    )


@query(f"{W}, {ROLL} SELECT * REPLACE (array_to_string(satellites, ',') AS satellites, array_to_string(instruments, ',') AS instruments, array_to_string(sources, ',') AS sources) FROM roll")
def c8_event_rollup(spark, d):
    return flat(events.event_rollup(detections(spark, d)), "satellites", "instruments", "sources")


@query(f"{W} SELECT event_id, array_to_string(list_sort(list(DISTINCT satellite)), ',') AS sources, count(DISTINCT satellite)::INT AS n_sources FROM det GROUP BY 1")
def c9_event_sources(spark, d):
    return flat(events.event_sources(detections(spark, d)), "sources")


@query(f"{W} SELECT event_id, count(DISTINCT {KEY}) AS n_platforms, CASE WHEN count(DISTINCT {KEY}) >= 3 THEN 'high' WHEN count(DISTINCT {KEY}) = 2 THEN 'confirmed' ELSE 'single' END AS level FROM det GROUP BY 1")
def c10_multisource(spark, d):
    return events.multisource(detections(spark, d))


RANK = "CASE WHEN instrument = 'VIIRS' THEN 1 WHEN source = 'COPERNICUS_S3_SL_2_FRP_SWIR500M' THEN 2 WHEN source = 'EUMETSAT_MTG_MTFRPPIXEL' OR instrument = 'MODIS' THEN 3 WHEN source = 'LSA_SAF_MSG_FRP_PIXEL' THEN 4 ELSE 9 END"


@query(f"{W} SELECT event_id, lat, lon, id AS best_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {RANK}, acq DESC, id) AS n FROM det) WHERE n = 1")
def c11_best_location(spark, d):
    return events.best_location(detections(spark, d))


LIFE = f"CASE WHEN last_seen < {AS_OF} - INTERVAL 24 HOUR THEN 'closed' WHEN last_seen < {AS_OF} - INTERVAL 3 HOUR THEN 'inactive' WHEN observations >= 3 OR len(satellites) >= 2 THEN 'active' WHEN observations >= 2 THEN 'confirmed' ELSE 'new' END"


@query(f"{W}, {ROLL} SELECT event_id, {LIFE} AS status FROM roll")
def c12_lifecycle(spark, d):
    det = detections(spark, d)
    return events.lifecycle(events.event_rollup(det).withColumn("n_sources", F.size("satellites")), as_of(det)).select("event_id", "status")


@query(f"{W}, {ROLL}, prev AS (SELECT event_id, count(*) AS n, arg_max(frp, (acq, id)) AS f FROM det WHERE acq < {AS_OF} - INTERVAL 48 HOUR GROUP BY 1), j AS (SELECT r.*, coalesce(n, 0) < observations AND f > 0 AND latest_frp > 0 AS grew, f FROM roll r LEFT JOIN prev USING (event_id)) SELECT event_id, CASE WHEN grew AND latest_frp >= f * 1.3 THEN 'strengthening' WHEN grew AND latest_frp <= f * 0.7 THEN 'weakening' WHEN observations >= 3 OR (epoch_us(last_seen) - epoch_us(first_seen)) / 6e7 >= 60 THEN 'active' WHEN observations >= 2 OR len(satellites) >= 2 THEN 'confirmed' ELSE 'new' END AS change FROM j")
def c13_change_class(spark, d):
    det = detections(spark, d)
    old = det.where(F.col("acq") < F.lit(as_of(det)) - F.make_dt_interval(F.lit(2)))
    return events.change_class(events.event_rollup(det), events.event_rollup(old)).select("event_id", "change")


@query(f"{W}, {ROLL} SELECT event_id, NOT (first_seen < TIMESTAMP '2024-01-02') OR last_seen >= TIMESTAMP '2024-01-01 18:00:00' AS notify, first_seen < TIMESTAMP '2024-01-02' AND NOT last_seen >= TIMESTAMP '2024-01-01 18:00:00' AS suppressed FROM roll")
def c14_bootstrap_flags(spark, d):
    return events.bootstrap_flags(events.event_rollup(detections(spark, d)), F.expr("timestamp_ntz'2024-01-02 00:00:00'"), 6).select("event_id", "notify", "suppressed")


GEO_SOURCES = "('EUMETSAT_MTG_MTFRPPIXEL', 'LSA_SAF_MSG_FRP_PIXEL')"


@query(f"{W} SELECT event_id, bool_or(source NOT IN {GEO_SOURCES}) AS polar, count(*) FILTER (source IN {GEO_SOURCES}) AS n_geo, max(acq) >= {AS_OF} - INTERVAL 3 HOUR AND (bool_or(source NOT IN {GEO_SOURCES}) OR (count(*) FILTER (source IN {GEO_SOURCES}) >= 2 AND epoch(date_trunc('second', max(acq) FILTER (source IN {GEO_SOURCES}))) - epoch(date_trunc('second', min(acq) FILTER (source IN {GEO_SOURCES}))) >= 480)) AS promoted FROM det GROUP BY 1")
def c15_promote(spark, d):
    det = detections(spark, d)
    return events.promote(det, as_of(det), ["EUMETSAT_MTG_MTFRPPIXEL", "LSA_SAF_MSG_FRP_PIXEL"]).select("event_id", "polar", "n_geo", "promoted")


Q = f"q AS (SELECT r.*, {LIFE} AS status, CASE WHEN length(event_id) % 2 = 0 THEN first_seen + INTERVAL 20 DAY END AS sent_at, false AS closed_sent, last_seen + INTERVAL 5 DAY AS enriched_at FROM roll r)"


@query(f"{W}, {ROLL}, {Q} SELECT event_id, CASE WHEN sent_at IS NULL AND status <> 'closed' THEN 'new' WHEN sent_at IS NULL THEN NULL WHEN status = 'closed' AND NOT closed_sent THEN 'close' WHEN last_seen > sent_at THEN 'update' WHEN enriched_at > sent_at THEN 'enrichment' END AS reason, greatest(last_seen, enriched_at) AS changed_at FROM q WHERE reason IS NOT NULL ORDER BY changed_at, event_id LIMIT 100")
def c16_sync_queue(spark, d):
    det = detections(spark, d)
    e = events.lifecycle(events.event_rollup(det).withColumn("n_sources", F.size("satellites")), as_of(det))
    e = e.withColumns({"sent_at": F.expr("case when length(event_id) % 2 = 0 then first_seen + interval 20 day end"), "closed_sent": F.lit(False), "enriched_at": F.expr("last_seen + interval 5 day")})
    return events.sync_queue(e, as_of(det)).select("event_id", "reason", "changed_at")


@query(f"{W}, n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY acq DESC, id DESC) AS n FROM det WHERE frp >= 0), t AS (SELECT event_id, avg(frp) FILTER (n <= 3) AS a, avg(frp) FILTER (n BETWEEN 4 AND 6) AS b FROM n WHERE n <= 6 GROUP BY 1) SELECT event_id, round(a, 3) AS latest, round(b, 3) AS before, CASE WHEN b > 0 THEN CASE WHEN (a - b) / b * 100 >= 30 THEN 'rising' WHEN (a - b) / b * 100 <= -30 THEN 'falling' ELSE 'stable' END ELSE 'insufficient' END AS trend FROM t")
def d1_frp_trend(spark, d):
    return events.frp_trend(detections(spark, d)).select("event_id", F.round("latest", 3).alias("latest"), F.round("before", 3).alias("before"), "trend")


@query(f"{W}, p AS (SELECT DISTINCT event_id, lat, lon FROM det) SELECT event_id, round(max({H.format(a='a.lat', b='a.lon', c='b.lat', d='b.lon')}))::BIGINT AS diameter_m FROM p a JOIN p b USING (event_id) GROUP BY 1")
def d2_cluster_diameter(spark, d):
    return events.cluster_diameter(detections(spark, d)).select("event_id", F.round("diameter_m").cast("long").alias("diameter_m"))


@query(f"{W}, n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY acq DESC, id DESC) AS n FROM det), c AS (SELECT event_id, avg(lat) FILTER (n BETWEEN 4 AND 6) AS a, avg(lon) FILTER (n BETWEEN 4 AND 6) AS b, avg(lat) FILTER (n <= 3) AS c, avg(lon) FILTER (n <= 3) AS d FROM n WHERE n <= 6 GROUP BY 1) SELECT event_id, round({H.format(a='a', b='b', c='c', d='d')}, 1) AS moved_m, round((degrees(atan2(sin(radians(d) - radians(b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d) - radians(b)))) + 360) % 360, 2) AS bearing FROM c")
def d3_cluster_motion(spark, d):
    return events.cluster_motion(detections(spark, d)).select("event_id", F.round("moved_m", 1).alias("moved_m"), F.round("bearing", 2).alias("bearing"))


REL = "least(100, CASE latest_confidence WHEN 'h' THEN 70 WHEN 'n' THEN 50 ELSE 25 END + least(15, (observations - 1) * 5) + CASE WHEN len(satellites) >= 2 THEN 10 ELSE 0 END + CASE WHEN max_frp >= 100 THEN 15 WHEN max_frp >= 30 THEN 10 WHEN max_frp >= 10 THEN 5 ELSE 0 END + CASE WHEN hrs >= 3 THEN 10 WHEN hrs >= 1 THEN 5 ELSE 0 END)::INT"


@query(f"{W}, {ROLL}, r AS (SELECT *, (epoch_us(date_trunc('second', last_seen)) - epoch_us(date_trunc('second', first_seen))) / 3.6e9 AS hrs FROM roll) SELECT event_id, {REL} AS reliability, CASE WHEN {REL} >= 80 THEN 'high' WHEN {REL} >= 55 THEN 'medium' ELSE 'low' END AS reliability_level FROM r")
def d16_reliability(spark, d):
    return events.reliability(events.event_rollup(detections(spark, d))).select("event_id", "reliability", "reliability_level")


POINTS = {
    "satellite_confirmation": "CASE WHEN np >= 3 THEN 25 WHEN np = 2 THEN 18 ELSE 8 END", "thermal_intensity": "CASE WHEN max_frp >= 100 THEN 25 WHEN max_frp >= 50 THEN 20 WHEN max_frp >= 20 THEN 14 WHEN max_frp >= 5 THEN 7 WHEN max_frp > 0 THEN 3 ELSE 0 END",
    "persistence": "CASE WHEN mins >= 180 THEN 10 WHEN mins >= 60 THEN 7 WHEN mins >= 15 THEN 4 ELSE 0 END + CASE WHEN observations >= 10 THEN 10 WHEN observations >= 5 THEN 7 WHEN observations >= 2 THEN 4 ELSE 1 END",
    "dynamics": "CASE WHEN site % 3 = 0 THEN 8 WHEN site % 3 = 1 THEN 3 ELSE 0 END + CASE WHEN site % 2 = 0 THEN 2 ELSE 0 END",
    "civilian_context": "least(15, CASE WHEN site * 700 >= 50000 THEN 10 WHEN site * 700 >= 10000 THEN 8 WHEN site * 700 >= 1000 THEN 5 WHEN site > 0 THEN 2 ELSE 0 END + CASE WHEN site % 4 = 0 THEN 5 ELSE 0 END)", "independent_context": "CASE WHEN site % 5 = 0 THEN 1 ELSE 0 END",
}
PRI = f"""pri AS (SELECT r.event_id, last_seen, least(100, {" + ".join(POINTS.values())})::INT AS priority, array_to_string(list_filter([{", ".join(f"CASE WHEN {v} > 0 THEN '{k}=' || ({v}) END" for k, v in POINTS.items())}], lambda x: x IS NOT NULL), ',') AS reasons
 FROM (SELECT *, (epoch_us(last_seen) - epoch_us(first_seen)) / 6e7 AS mins, substr(event_id, 2)::INT AS site FROM roll) r JOIN (SELECT event_id, count(DISTINCT {KEY}) AS np FROM det GROUP BY 1) USING (event_id))"""


def prioritised(spark, d):
    det = detections(spark, d)
    e = events.event_rollup(det).join(events.multisource(det), "event_id").withColumn("site", F.substring("event_id", 2, 20).cast("int"))
    e = e.withColumns({"trend": F.expr("case site % 3 when 0 then 'rising' when 1 then 'stable' else 'falling' end"), "diameter_m": F.expr("case when site % 2 = 0 then 1500D else 10D end"), "population_5km": F.col("site") * 700.0,
                       "flags": F.expr("if(site % 4 = 0, array('settlement_near_2km'), array())"), "evidence_classes": F.expr("if(site % 5 = 0, array('ground'), array())")})
    return events.priority(e), as_of(det)


@query(f"{W}, {ROLL}, {PRI} SELECT event_id, priority, reasons, CASE WHEN priority >= 75 THEN 'high' WHEN priority >= 55 THEN 'elevated' WHEN priority >= 30 THEN 'normal' ELSE 'low' END AS priority_level FROM pri")
def d17_priority(spark, d):
    told = F.transform("reasons", lambda x: F.concat_ws("=", x["factor"], x["points"].cast("string")))
    return prioritised(spark, d)[0].select("event_id", "priority", "priority_level", F.array_join(told, ",").alias("reasons"))


@query(f"{W}, {ROLL}, {PRI} SELECT event_id, priority FROM pri WHERE last_seen >= {AS_OF} - INTERVAL 48 HOUR AND priority >= 60 ORDER BY priority DESC, last_seen DESC, event_id LIMIT 25")
def d18_priority_feed(spark, d):
    e, at = prioritised(spark, d)
    return events.priority_events(e, at, 48, 60, 25).select("event_id", "priority")


LAT = "count(*) AS n, round(avg(m), 3) AS mean_min, round(quantile_cont(m, 0.5), 3) AS p50_min, round(quantile_cont(m, 0.95), 3) AS p95_min, round(max(m), 3) AS max_min, count(*) FILTER (m > 90) AS over_90, count(*) FILTER (m > 10) AS over_10"


@query(f"{W} SELECT source, {LAT} FROM (SELECT source, (epoch_us(received_at) - epoch_us(acq)) / 6e7 AS m FROM det) GROUP BY 1")
def d22_latency_health(spark, d):
    return events.latency_health(detections(spark, d), "source")


@query(f"{W} SELECT source AS sensor_family, acq::DATE AS day, floor(lat / 0.05)::INT AS cell_lat, floor(lon / 0.05)::INT AS cell_lon, round(avg(lat), 6) AS latitude, round(avg(lon), 6) AS longitude, count(*) AS detection_count, max(frp) AS max_frp, count(*) FILTER (confidence = 'h') AS high_confidence_count FROM det GROUP BY ALL")
def a8_hotspot_daily(spark, d):
    return ingest.hotspot_daily(detections(spark, d), 0.05, "source").withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


@query(f"{W} SELECT id FROM det WHERE acq >= {AS_OF} - INTERVAL 10 DAY")
def a15_retain(spark, d):
    det = detections(spark, d)
    return ingest.retain(det, "acq", 10, as_of(det)).select("id")


@query(f"{W} SELECT id, CASE WHEN CAST(frp AS DOUBLE) >= 80 THEN 'h' WHEN frp >= 30 THEN 'n' ELSE 'l' END AS level, lower(confidence) AS text FROM det")
def a2_norm_confidence(spark, d):
    return detections(spark, d).select("id", ingest.norm_confidence(F.col("frp").cast("string"), "modis").alias("level"), ingest.norm_confidence(F.col("confidence")).alias("text"))


@query(f"{W} SELECT DISTINCT source, acq::DATE::VARCHAR AS name FROM det WHERE day(acq) % 3 <> 0")
def a5_pending(spark, d):
    files = detections(spark, d).select("source", F.to_date("acq").cast("string").alias("name")).distinct()
    return ingest.pending(files, files.where("day(to_date(name)) % 3 = 0").select("name").distinct()).select("source", "name")


@query(f"{W} SELECT 'f' || (site % 3) AS family, acq::DATE AS day, CASE WHEN day(acq::DATE) >= 10 AND site % 3 <> 2 THEN 'standard' ELSE 'nrt' END AS dataset FROM det GROUP BY ALL")
def a7_choose_source(spark, d):
    days = detections(spark, d).select(F.concat(F.lit("f"), F.col("site") % 3).alias("family"), F.to_date("acq").alias("day")).distinct()
    day = datetime.date
    rows = [(f"f{i}", "nrt", 2, day(2000, 1, 1), day(2100, 1, 1)) for i in range(3)] + [(f"f{i}", "standard", 1, day(2024, 1, 10) if i < 2 else day(2090, 1, 1), day(2100, 1, 1)) for i in range(3)]
    avail = spark.createDataFrame(rows, "family string, dataset string, rank int, min_day date, max_day date")
    return days.withColumn("dom", F.dayofmonth("day")).drop("dom").join(avail.select("family").distinct(), "family", "left_semi").transform(lambda x: ingest.choose_source(x, avail))


RUNS = "runs AS (SELECT source, max(received_at) AS run_at, (count(*) % 4)::INT AS fetched, NULL::VARCHAR AS last_error FROM det GROUP BY 1)"


@query(f"{W}, {RUNS} SELECT d.source, count(*) FILTER (d.received_at > {AS_OF} - INTERVAL 1 HOUR) AS n_1h, count(*) FILTER (d.received_at > {AS_OF} - INTERVAL 6 HOUR) AS n_6h, count(*) FILTER (d.received_at > {AS_OF} - INTERVAL 24 HOUR) AS n_24h, CASE WHEN floor((epoch(date_trunc('second', {AS_OF})) - epoch(date_trunc('second', any_value(run_at)))) / 60) > 45 THEN 'stale' WHEN any_value(fetched) = 0 THEN 'empty_fetch' ELSE 'active' END AS status FROM det d JOIN runs USING (source) GROUP BY 1 UNION ALL SELECT 'SILENT', 0, 0, 0, 'unknown'")
def f3_source_coverage(spark, d):
    det = detections(spark, d)
    sources = det.select("source").distinct().unionByName(spark.sql("select 'SILENT' source"))
    runs = det.groupBy("source").agg(F.max("received_at").alias("run_at"), (F.count("*") % 4).cast("int").alias("fetched"), F.lit(None).cast("string").alias("last_error"))
    return integrity.source_coverage(det, sources, runs, as_of(det)).select("source", "n_1h", "n_6h", "n_24h", "status")


@query(f"{W}, h AS (SELECT DISTINCT date_trunc('hour', received_at) AS hour FROM det), s AS (SELECT DISTINCT source FROM det) SELECT s.source, h.hour, count(d.id) AS n FROM s CROSS JOIN h LEFT JOIN det d ON d.source = s.source AND date_trunc('hour', d.received_at) = h.hour GROUP BY ALL")
def f4_coverage_hourly(spark, d):
    det = detections(spark, d)
    return integrity.coverage_hourly(det, det.select("source").distinct(), det.select(F.date_trunc("hour", "received_at").alias("hour")).distinct())


SAMPLES = "samples AS (SELECT source, (hour(received_at) // 6)::INT AS slot, 'count' AS metric, count(*)::DOUBLE AS value FROM det GROUP BY source, slot, received_at::DATE UNION ALL SELECT source, (hour(received_at) // 6)::INT, 'frp', sum(frp) FROM det GROUP BY source, hour(received_at) // 6, received_at::DATE)"


@query(f"{W}, {SAMPLES}, m AS (SELECT source, slot, metric, count(*) AS n, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM samples GROUP BY ALL) SELECT s.source, s.slot, s.metric, any_value(n) AS n, round(any_value(med), 3) AS median, round(any_value(p10), 3) AS p10, round(any_value(p90), 3) AS p90, round(quantile_cont(abs(value - med), 0.5), 3) AS mad, any_value(n) >= 6 AS ready FROM samples s JOIN m USING (source, slot, metric) GROUP BY ALL")
def f5_baseline(spark, d):
    det = detections(spark, d).withColumn("slot", F.floor(F.hour("received_at") / 6).cast("int"))
    per = det.groupBy("source", "slot", F.to_date("received_at").alias("day")).agg(F.count("*").cast("double").alias("count"), F.sum("frp").alias("frp"))
    out = integrity.baseline(grid.unpivot(per, ["source", "slot", "day"], ["count", "frp"]), ["source", "slot", "metric"])
    return out.withColumns({c: F.round(c, 3) for c in ("median", "p10", "p90", "mad")})


@query(f"{W}, s AS (SELECT source, (epoch_us(received_at) - epoch_us(acq)) / 6e7 AS v FROM det), m AS (SELECT source, count(*) AS n, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM s GROUP BY 1) SELECT source, any_value(n) AS n, round(any_value(med), 3) AS median, round(any_value(p10), 3) AS p10, round(any_value(p90), 3) AS p90, round(quantile_cont(abs(v - med), 0.5), 3) AS mad, any_value(n) >= 12 AS ready FROM s JOIN m USING (source) GROUP BY 1")
def f6_lag_baseline(spark, d):
    return integrity.lag_baseline(detections(spark, d)).withColumns({c: F.round(c, 3) for c in ("median", "p10", "p90", "mad")})


@query(f"{WI}, g AS (SELECT region_id, count(*) AS n, count(*) FILTER (id % 13 <> 0) AS matched FROM det_r GROUP BY 1) SELECT r.region_id, r.code, coalesce(n, 0) AS upstream, coalesce(matched, 0) AS matched, coalesce(n - matched, 0) AS missing FROM reg r LEFT JOIN g USING (region_id)")
def f8_geo_integrity(spark, d):
    up = grid.assign_region(hashed(spark, d), regions(spark, d), "id")
    return integrity.geo_integrity(up, up.where("id % 13 <> 0"), regions(spark, d)).select("region_id", "code", "upstream", "matched", "missing")


FIND = f"e AS (SELECT event_id, first_seen, max(acq) >= {AS_OF} - INTERVAL 24 HOUR AS fresh, site % 2 = 0 AS required, site % 5 = 0 AS sent FROM (SELECT *, min(acq) OVER (PARTITION BY event_id) AS first_seen FROM det) GROUP BY event_id, first_seen, site), f AS (SELECT event_id, CASE WHEN fresh AND NOT required AND first_seen >= TIMESTAMP '2024-01-01 06:00:00' THEN 'notification_gap' WHEN required AND first_seen < {AS_OF} - INTERVAL 45 MINUTE THEN 'delivery_backlog' WHEN NOT required AND first_seen < TIMESTAMP '2024-01-01 06:00:00' THEN 'bootstrap_suppressed' WHEN NOT required THEN 'other_suppressed' END AS kind FROM e WHERE NOT sent)"
SEV = "CASE kind WHEN 'notification_gap' THEN 'error' WHEN 'delivery_backlog' THEN 'warning' ELSE 'info' END"


def found(spark, d):
    det = detections(spark, d)
    e = det.groupBy("event_id", "site").agg(F.min("acq").alias("first_seen")).selectExpr("event_id", "first_seen", "site % 2 = 0 required", "site % 5 = 0 sent")
    return integrity.notification_findings(e, det, as_of(det), F.expr("timestamp_ntz'2024-01-01 06:00:00'"))


@query(f"{W}, {FIND} SELECT event_id, kind, {SEV} AS severity FROM f WHERE kind IS NOT NULL")
def f1_notification_findings(spark, d):
    return found(spark, d).select("event_id", "kind", "severity")


@query(f"{W}, {FIND}, s AS (SELECT {SEV} AS s FROM f WHERE kind IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warning, CASE WHEN count(*) FILTER (s = 'error') > 0 THEN 'error' WHEN count(*) FILTER (s = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS status FROM s")
def f2_findings_summary(spark, d):
    return integrity.findings_summary(found(spark, d))


@query(f"{W} SELECT source AS monitor, floor((epoch(date_trunc('second', {AS_OF})) - epoch(date_trunc('second', max(acq)))) / 60)::BIGINT AS age_min, 'stale' AS reason FROM det GROUP BY 1 HAVING floor((epoch(date_trunc('second', {AS_OF})) - epoch(date_trunc('second', max(acq)))) / 60) > 10 UNION ALL SELECT 'never', NULL, 'never_run'")
def f10_watchdog(spark, d):
    det = detections(spark, d)
    states = det.groupBy(F.col("source").alias("monitor")).agg(F.max("acq").alias("last_run"), F.lit(None).cast("string").alias("error"))
    limits = states.select("monitor").unionByName(spark.sql("select 'never' monitor")).withColumn("limit_min", F.lit(10))
    return integrity.watchdog(states, limits, as_of(det))


@query(f"{WI} SELECT 'orphan_detections' AS \"check\", count(*) FILTER (site % 9 = 0) AS n, CASE WHEN count(*) FILTER (site % 9 = 0) = 0 THEN 'pass' ELSE 'fail' END AS result FROM det_r UNION ALL SELECT 'outside_regions', count(*) FILTER (region_id IS NULL), CASE WHEN count(*) FILTER (region_id IS NULL) = 0 THEN 'pass' ELSE 'warn' END FROM det_r UNION ALL SELECT 'duplicate_hashes', 0, 'pass' UNION ALL SELECT 'invalid_rings', 0, 'pass'")
def f9_diagnostics(spark, d):
    det = grid.assign_region(hashed(spark, d), regions(spark, d), "id")
    return integrity.diagnostics(det, det.where("site % 9 <> 0").select("event_id").distinct(), regions(spark, d))


NEAR = H.format(a="r.latest_lat", b="r.latest_lon", c="d.lat", d="d.lon")


@query(f"""{W}, {ROLL}, r AS (SELECT event_id, latest_lat, latest_lon, first_seen + INTERVAL 20 DAY AS first_seen FROM roll),
 live AS (SELECT r.event_id, r.first_seen, d.acq::DATE AS day, count(DISTINCT d.event_id) AS n FROM r JOIN det d ON d.event_id <> r.event_id AND d.acq < r.first_seen AND abs(d.lat - r.latest_lat) < 0.3 AND {NEAR} <= 25000 GROUP BY ALL),
 cells AS (SELECT source, acq::DATE - 40 AS day, avg(lat) AS lat, avg(lon) AS lon FROM det GROUP BY source, acq::DATE, floor(lat / 0.05), floor(lon / 0.05)),
 old AS (SELECT r.event_id, r.first_seen, d.day, count(*) AS n FROM r JOIN cells d ON d.day < r.first_seen::DATE AND abs(d.lat - r.latest_lat) < 0.3 AND {NEAR} <= 25200 GROUP BY ALL),
 days AS (SELECT event_id, first_seen, day, max(n) AS n, first_seen::DATE - day AS age FROM (FROM live UNION ALL FROM old) GROUP BY 1, 2, 3),
 per AS (SELECT event_id, sum(n) FILTER (age <= 30) AS e30, count(*) FILTER (age <= 30) AS d30, sum(n) FILTER (age <= 90) AS e90, count(*) FILTER (age <= 90) AS d90, sum(n) FILTER (age <= 365) AS e365, count(*) FILTER (age <= 365) AS d365 FROM days GROUP BY 1),
 z AS (SELECT r.event_id, coalesce(e30, 0)::BIGINT AS events_30d, coalesce(d30, 0) AS days_30d, coalesce(e90, 0)::BIGINT AS events_90d, coalesce(d90, 0) AS days_90d, coalesce(e365, 0)::BIGINT AS events_365d, coalesce(d365, 0) AS days_365d FROM r LEFT JOIN per USING (event_id))
 SELECT *, CASE WHEN days_365d >= 10 OR events_365d >= 15 THEN 'persistent' WHEN days_365d >= 3 OR events_365d >= 5 THEN 'recurrent' WHEN events_365d >= 1 THEN 'occasional' ELSE 'new' END AS hotspot_class FROM z""")
def d4_history(spark, d):
    """Recurrence around each event before a day twenty days in, with an archive of cells forty days older."""
    det = detections(spark, d)
    archive = ingest.hotspot_daily(det, 0.05, "source").withColumn("day", F.date_sub("day", 40))
    return enrich.history(events.event_rollup(det).withColumn("first_seen", F.expr("first_seen + interval 20 day")), det, archive, 25000)
