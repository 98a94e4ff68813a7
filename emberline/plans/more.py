"""Queries of feeds, production audits, search by words and evidence lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import norm_name
from ..operators import enrich, events, grid, ingest, integrity, names, objects, production, resolve, search
from ..sources import files
from .adapters import AS_OF, DET, IN_REGION, REG, as_of, detections, regions, table
from .base import query
from .core import ROLL, H
from .objects import BI

W, WI = f"WITH {DET}", f"WITH {DET}, {REG}, {IN_REGION}"
POLAR = ["VIIRS_NOAA20_NRT", "VIIRS_SNPP_NRT"]
MTG, S3 = "EUMETSAT_MTG_MTFRPPIXEL", "COPERNICUS_S3_"
DAY = "(epoch_us({a}) - epoch_us({b})) / 6e7"


@query("SELECT event_id AS id, replace(replace(lower(event_type), ' ', ''), '₂', '2') || '2.5' AS parameter FROM events")
def a9_norm_parameter(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), ingest.norm_parameter(F.concat(F.upper("event_type"), F.lit(" ₂.₅"))).alias("parameter"))


@query(f"{W} SELECT id, lat, CASE WHEN id % 3 = 2 THEN (lon + lon + 0.5) / 2 ELSE lon END AS lon FROM det WHERE lat BETWEEN 45 AND 50 AND CASE WHEN id % 3 = 2 THEN (lon + lon + 0.5) / 2 ELSE lon END BETWEEN 24 AND 38")
def a10_event_feed(spark, d):
    det = detections(spark, d).select("id", "lat", "lon")
    pair = lambda x: F.array(F.col("lon") + x, "lat")
    json = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    line = json("LineString", F.array(pair(0), pair(0.5)))
    shape = F.when(F.col("id") % 3 == 0, json("Point", pair(0))).when(F.col("id") % 3 == 1, F.concat(F.lit("POINT ("), "lon", F.lit(" "), "lat", F.lit(")"))).otherwise(line)
    return files.place_feed(det.select("id", shape.alias("geometry")), "geometry", (24, 45, 38, 50)).select("id", "lat", "lon")


#: The whole table is the base; the delta changes every row but those whose title stays blank, and brings each row in twelve anew.
UPSERT = """base AS (SELECT source AS source_key, doc_id::VARCHAR AS external_id, 'title ' || doc_id AS title, text AS body, doc_id::DOUBLE AS lat FROM documents),
 delta AS (SELECT source AS source_key, CASE WHEN doc_id % 12 = 1 THEN 'new-' || doc_id ELSE doc_id::VARCHAR END AS external_id, 'new ' || doc_id AS title, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS body, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE -doc_id::DOUBLE END AS lat FROM documents WHERE source <> (SELECT min(source) FROM documents) AND doc_id % 7 <> 0)"""


@query(f"WITH {UPSERT} SELECT coalesce(b.source_key, d.source_key) AS source_key, coalesce(b.external_id, d.external_id) AS external_id, CASE WHEN d.title IS NULL THEN b.title ELSE d.title END AS title, CASE WHEN d.title IS NULL THEN sha256(b.body) ELSE sha256(d.title || '|' || coalesce(d.body, '')) END AS content_hash, coalesce(d.lat, b.lat) AS lat FROM base b FULL JOIN delta d USING (source_key, external_id)")
def a11_upsert_documents(spark, d):
    t = table(spark, d, "documents").withColumns({"source_key": F.col("source"), "external_id": F.col("doc_id").cast("string")})
    null = lambda kind: F.lit(None).cast(kind)
    keys = ["source_key", "external_id"]
    base = t.select(*keys, F.concat(F.lit("title "), "doc_id").alias("title"), F.col("text").alias("body"), F.sha2("text", 256).alias("content_hash"), null("timestamp").alias("published_at"), F.col("doc_id").cast("double").alias("lat"), null("double").alias("lon"))
    title = F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit("new "), "doc_id"))
    changed = t.withColumn("external_id", F.when(F.col("doc_id") % 12 == 1, F.concat(F.lit("new-"), "doc_id")).otherwise(F.col("external_id")))
    delta = changed.select(*keys, title.alias("title"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("body"), null("timestamp").alias("published_at"), F.when(F.col("doc_id") % 4 != 0, -F.col("doc_id").cast("double")).alias("lat"), null("double").alias("lon"))
    catalog = t.select("source_key").distinct().join(t.agg(F.min("source").alias("least"))).select("source_key", (F.col("source_key") != F.col("least")).alias("enabled"))
    return ingest.upsert_documents(base, delta, catalog).select(*keys, "title", "content_hash", "lat")


@query(f"WITH {REG} SELECT region_id, code, west, south, east, north FROM reg")
def a16_export_geography(spark, d):
    """Out to GeoJSON and read back from it."""
    shape = "struct<properties: struct<region_id: bigint, code: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>"
    f = files.regions_geojson(regions(spark, d)).select(F.from_json("feature", shape).alias("f"))
    axis = lambda i: F.transform(F.col("f.geometry.coordinates")[0], lambda p: p[i])
    return f.select("f.properties.*", F.array_min(axis(0)).alias("west"), F.array_min(axis(1)).alias("south"), F.array_max(axis(0)).alias("east"), F.array_max(axis(1)).alias("north"))


@query(f"{W} SELECT id, round(lat * 100)::BIGINT / 100 AS lat, round(lon * 100)::BIGINT / 100 AS lon, CASE WHEN id % 4 = 0 THEN acq ELSE date_trunc('day', acq) + (id % 24) * INTERVAL 1 HOUR + (id % 60) * INTERVAL 1 MINUTE END AS acq FROM det")
def a17_msg_pixels(spark, d):
    hundredths = lambda c: F.round(F.col(c) * 100).cast("long").alias(f"{c}100")
    p = detections(spark, d).select("id", hundredths("lat"), hundredths("lon"), F.when(F.col("id") % 4 != 0, F.col("id") % 24 * 100 + F.col("id") % 60).alias("hhmm"), F.col("acq").alias("slot"))
    return files.msg_pixels(p).withColumn("acq", F.col("acq").cast("timestamp_ntz"))


@query(f"{W}, s AS (SELECT DISTINCT source AS id FROM det) SELECT id, CASE WHEN id LIKE 'VIIRS%' THEN 'polar' END AS role, id NOT LIKE 'VIIRS%' AS unknown, false AS missing, CASE WHEN id LIKE 'VIIRS%' THEN 'ok' ELSE 'attention' END AS status FROM s UNION ALL SELECT 'MODIS_NRT', 'polar', false, true, 'attention'")
def a18_audit_sources(spark, d):
    here = detections(spark, d).select(F.col("source").alias("id")).distinct()
    known = spark.createDataFrame([(s, "polar") for s in [*POLAR, "MODIS_NRT"]], "id string, role string").join(here.unionByName(spark.sql("select 'MODIS_NRT' id")), "id", "left_semi")
    return ingest.audit_sources(here, known, spark.sql("select 'MODIS_NRT' id"))


DAILY = f"""per AS (SELECT source, received_at::DATE AS day, count(*)::DOUBLE AS fetched, count(*) FILTER (confidence <> 'l')::DOUBLE AS recent, max({DAY.format(a='received_at', b='acq')}) AS worker, sum(frp) AS upstream, max(frp) AS delay FROM det GROUP BY 1, 2),
 long AS (UNPIVOT per ON fetched, recent, worker, upstream, delay INTO NAME metric VALUE value), med AS (SELECT source, metric, quantile_cont(value, 0.5) AS median, count(*) >= 6 AS ready FROM long GROUP BY 1, 2),
 base AS (SELECT l.source, l.metric, any_value(m.median) AS median, any_value(m.ready) AS ready, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, quantile_cont(abs(value - m.median), 0.5) AS mad FROM long l JOIN med m USING (source, metric) GROUP BY 1, 2)"""
LIMIT = {m: (f"{{x}} < least(p10 * {f}, median - 4 * greatest(mad, {s})) AND median >= {n}" if side == "low" else f"{{x}} > greatest(p90 * {f}, median + 4 * greatest(mad, {s}))") for m, (_, side, f, s, n) in production.METRICS.items()}
JUDGED = "judged AS (SELECT l.source, l.day, string_agg(CASE metric " + " ".join(f"WHEN '{m}' THEN CASE WHEN ready AND {LIMIT[m].format(x='value')} THEN '{v[0]}' END" for m, v in production.METRICS.items()) + " END, ',' ORDER BY CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(production.METRICS)) + " END) AS reasons, any_value(ready) AS known FROM long l JOIN base b USING (source, metric) GROUP BY 1, 2)"


def daily(spark, d):
    det = detections(spark, d)
    lag = (F.expr("unix_micros(cast(received_at as timestamp))") - F.expr("unix_micros(cast(acq as timestamp))")) / 6e7
    per = det.groupBy("source", F.to_date("received_at").alias("day")).agg(F.count("*").cast("double").alias("fetched"), F.count_if(F.col("confidence") != "l").cast("double").alias("recent"), F.max(lag).alias("worker"), F.sum("frp").alias("upstream"), F.max("frp").alias("delay"))
    return per, integrity.baseline(grid.unpivot(per, ["source", "day"], list(production.METRICS)), ["source", "metric"])


@query(f"{W}, {DAILY}, {JUDGED} SELECT source, day, CASE WHEN NOT known THEN 'learning' WHEN reasons IS NULL THEN 'normal' WHEN source LIKE 'VIIRS%' THEN 'anomaly' ELSE 'watch' END AS state, CASE WHEN NOT known OR reasons IS NULL THEN 0 WHEN source LIKE 'VIIRS%' THEN 2 ELSE 1 END AS streak, coalesce(reasons, '') AS reasons FROM judged")
def f13_assess_production(spark, d):
    """Each day of a source against its own baselines."""
    per, base = daily(spark, d)
    now = per.withColumns({"family": F.when(F.col("source").startswith("VIIRS"), "polar").otherwise("other"), "status": F.lit("active")})
    prev = per.select("source").distinct().withColumn("streak", F.col("source").startswith("VIIRS").cast("int"))
    return production.assess(now, base, prev).select("source", "day", "state", "streak", F.array_join("reasons", ",").alias("reasons"))


FEED = {"feed": ("low_feed", LIMIT["fetched"].format(x="value")), "worker": ("high_worker_lag", LIMIT["worker"].format(x="value")), "lag": ("high_ingestion_delay", LIMIT["delay"].format(x="value"))}


@query(f"{W}, {DAILY}, mark AS (SELECT l.source, string_agg(CASE metric WHEN 'fetched' THEN CASE WHEN ready AND {FEED['feed'][1]} THEN 'low_feed' END WHEN 'worker' THEN CASE WHEN ready AND {FEED['worker'][1]} THEN 'high_worker_lag' END WHEN 'delay' THEN CASE WHEN ready AND {FEED['lag'][1]} THEN 'high_ingestion_delay' END END, ',' ORDER BY CASE metric WHEN 'fetched' THEN 0 WHEN 'worker' THEN 1 ELSE 2 END) AS reasons, any_value(ready) AS known FROM long l JOIN base b USING (source, metric) WHERE l.day = (SELECT max(day) FROM per) GROUP BY 1) SELECT source, CASE WHEN NOT known THEN 'learning' WHEN reasons IS NULL THEN 'normal' ELSE 'watch' END AS state, coalesce(reasons, '') AS reasons FROM mark")
def f7_assess(spark, d):
    per, base = daily(spark, d)
    last = per.join(F.broadcast(per.agg(F.max("day").alias("day"))), "day")
    now = last.select("source", F.lit("active").alias("status"), F.col("fetched").alias("feed"), "worker", F.col("delay").alias("lag"))
    renamed = base.withColumn("metric", F.when(F.col("metric") == "fetched", "feed").when(F.col("metric") == "delay", "lag").otherwise(F.col("metric")))
    return integrity.assess(now, renamed, per.select("source", F.lit(0).alias("streak")).distinct()).select("source", "state", F.array_join("reasons", ",").alias("reasons"))


CFG = [("VIIRS_NOAA20_NRT", "polar", 45, None), ("VIIRS_SNPP_NRT", "polar", 5000, None), (MTG, "geostationary", 5000, 5), ("LSA_SAF_MSG_FRP_PIXEL", "geostationary", 5000, 5000), ("SENTINEL3_SLSTR", "copernicus", 5000, 720), ("MODIS_NRT", "polar", 45, None)]
CFG_SQL = "cfg AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{f}', {w}, {u if u else 'NULL::INT'})" for s, f, w, u in CFG) + ") t(source, family, worker_min, upstream_min))"
NAMED = "named AS (SELECT *, CASE WHEN source LIKE 'COPERNICUS!_S3!_%' ESCAPE '!' THEN 'SENTINEL3_SLSTR' ELSE source END AS src FROM det)"


@query(f"""{W}, {CFG_SQL}, {NAMED}, g AS (SELECT src AS source, count(*) FILTER (acq >= {AS_OF} - INTERVAL 1 HOUR) AS n_1h, count(*) FILTER (acq >= {AS_OF} - INTERVAL 6 HOUR) AS n_6h, count(*) FILTER (acq >= {AS_OF} - INTERVAL 24 HOUR) AS n_24h, max(acq) AS latest,
 max(received_at) - INTERVAL 3 HOUR AS success, (count(*) % 2)::INT AS fetched, max(acq) - INTERVAL 2 HOUR AS upstream, max(acq)::DATE - (count(*) % 4)::INT AS max_date FROM named GROUP BY 1),
 a AS (SELECT c.*, coalesce(n_1h, 0) AS n_1h, coalesce(n_6h, 0) AS n_6h, coalesce(n_24h, 0) AS n_24h, latest, success, fetched, max_date, round({DAY.format(a=AS_OF, b='success')}, 1) AS wa, round({DAY.format(a=AS_OF, b='upstream')}, 1) AS ua FROM cfg c LEFT JOIN g USING (source))
 SELECT source, n_1h, n_6h, n_24h, wa AS worker_age_min, ua AS upstream_age_min, CASE WHEN success IS NULL THEN 'unknown' WHEN wa > worker_min THEN 'stale' WHEN ua > upstream_min THEN 'source_lag' WHEN family = 'polar' AND fetched = 0 THEN 'empty_fetch' WHEN family = 'polar' AND max_date < {AS_OF}::DATE - 1 THEN 'source_lag' ELSE 'active' END AS status, CASE WHEN latest IS NULL THEN 'unknown' WHEN n_24h = 0 THEN 'quiet' ELSE 'observed' END AS activity FROM a""")
def f12_coverage_production(spark, d):
    return covered(spark, d).drop("family")


def covered(spark, d):
    det = detections(spark, d)
    name = F.when(F.col("source").startswith(S3), "SENTINEL3_SLSTR").otherwise(F.col("source")).alias("source")
    g = det.groupBy(name).agg(F.max("received_at").alias("r"), F.max("acq").alias("a"), F.count("*").alias("n"))
    runs = g.select("source", F.expr("r - interval 3 hour").alias("success_at"), (F.col("n") % 2).cast("int").alias("fetched"), F.expr("a - interval 2 hour").alias("upstream_at"), F.lit(None).cast("string").alias("last_error"))
    registry = g.select("source", F.expr("date_sub(cast(a as date), cast(n % 4 as int))").alias("max_date"))
    return production.coverage(det, spark.createDataFrame(CFG, "source string, family string, worker_min int, upstream_min int"), runs, registry, as_of(det), {S3: "SENTINEL3_SLSTR"})


LATE = "date_trunc('day', first_seen) + INTERVAL 1 HOUR"


@query(f"""{W}, p AS (SELECT event_id, any_value(site) AS site, min(acq) AS first_seen, max(acq) AS last, count(*) AS detections, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
 bool_or(acq >= {AS_OF} - INTERVAL 24 HOUR AND source LIKE 'VIIRS%') AS polar, bool_or(acq >= {AS_OF} - INTERVAL 24 HOUR AND source = '{MTG}') AS mtg, bool_or(acq >= {AS_OF} - INTERVAL 24 HOUR AND source LIKE 'COPERNICUS%') AS s3 FROM det GROUP BY 1),
 k AS (SELECT *, CASE WHEN site % 2 = 1 AND polar THEN 'notification_gap' WHEN site % 2 = 0 AND site % 3 = 0 AND {LATE} < {AS_OF} - INTERVAL 45 MINUTE THEN 'delivery_backlog' WHEN site % 2 = 0 THEN NULL WHEN mtg AND s3 THEN 'support_only_several' WHEN mtg THEN 'support_only_geostationary' WHEN s3 THEN 'support_only_slstr' WHEN last < {AS_OF} - INTERVAL 24 HOUR THEN 'historical_suppressed' ELSE 'other_suppressed' END AS kind FROM p WHERE site % 5 <> 0 AND site % 7 <> 0)
 SELECT event_id, kind, CASE kind WHEN 'notification_gap' THEN 'error' WHEN 'delivery_backlog' THEN 'warning' ELSE 'info' END AS severity, sources, detections FROM k WHERE kind IS NOT NULL""")
def f14_findings_production(spark, d):
    det = detections(spark, d)
    e = det.groupBy("event_id", "site").agg(F.min("acq").alias("first_seen"))
    late = e.where("site % 3 = 0").select("event_id", F.lit("new").alias("sync_reason"), F.expr("cast(date_trunc('day', first_seen) as timestamp_ntz) + interval 1 hour").alias("eligible_at"))
    rows = e.selectExpr("event_id", "case when site % 7 = 0 then 'closed' else 'active' end status", "site % 2 = 0 required", "site % 5 = 0 sent")
    return production.findings(rows, det, late, as_of(det), POLAR, MTG, S3).withColumn("sources", F.array_join("sources", ","))


CACHES = "e AS (SELECT DISTINCT event_id, site FROM det), c AS (SELECT *, CASE WHEN site % 3 = 0 THEN NULL WHEN site % 4 = 0 THEN 'error' ELSE 'ready' END AS air, CASE WHEN site % 5 = 0 THEN NULL ELSE 'ready' END AS weather FROM e)"


@query(f"{W}, {CACHES} SELECT 'air' AS cache, count(*) FILTER (air = 'ready') AS ready, count(*) FILTER (air = 'error') AS failed, count(*) FILTER (air IS NULL) AS missing FROM c UNION ALL SELECT 'weather', count(*) FILTER (weather = 'ready'), 0, count(*) FILTER (weather IS NULL) FROM c")
def f11_cache_health(spark, d):
    e = detections(spark, d).select("event_id", "site").distinct()
    air = e.where("site % 3 <> 0").select("event_id", F.when(F.col("site") % 4 == 0, "error").otherwise("ready").alias("status"))
    return production.cache_health(e, {"air": air, "weather": e.where("site % 5 <> 0").select("event_id", F.lit("ready").alias("status"))})


@query(f"{W}, e AS (SELECT event_id, any_value(site) AS site, min(acq) AS f, max(acq) AS l FROM det GROUP BY 1) SELECT count(*) AS events, count(*) FILTER (f >= {AS_OF} - INTERVAL 24 HOUR) AS new_24h, count(*) FILTER (l >= {AS_OF} - INTERVAL 24 HOUR) AS touched_24h, count(*) FILTER (site % 2 = 0 AND site % 5 <> 0) AS pending FROM e")
def h4_admin_summary(spark, d):
    det = detections(spark, d)
    e = det.groupBy("event_id", "site").agg(F.min("acq").alias("first_seen"), F.max("acq").alias("last_seen"))
    return production.admin_summary(e.withColumns({"required": F.col("site") % 2 == 0, "sent": F.col("site") % 5 == 0}), as_of(det))


AT = (51.919, 36.729)
NEAR = f"n AS (SELECT CASE WHEN id % 2 = 0 THEN 'document' ELSE 'evidence' END AS kind, id, source, acq, {H.format(a='51.919', b='36.729', c='lat', d='lon')} AS m FROM det WHERE acq >= {AS_OF} - INTERVAL 8760 HOUR)"


@query(f"{W}, {NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY acq DESC, m, id) AS r FROM n WHERE m <= 10000) SELECT kind, id, round(m)::BIGINT AS distance_m FROM k WHERE r <= 100 ORDER BY acq DESC, m, id LIMIT 100")
def h5_area_evidence(spark, d):
    det = detections(spark, d).withColumn("title", F.col("satellite")).withColumnRenamed("acq", "observed_at")
    at = F.lit(det.agg(F.max("observed_at").cast("string")).first()[0]).cast("timestamp_ntz")
    return search.area_evidence({"document": det.where("id % 2 = 0"), "evidence": det.where("id % 2 = 1")}, *AT, at, 10000, 8760, 100).select("kind", "id", "distance_m")


@query(f"{W} SELECT id, sha256(concat_ws('|', source, round(lat, 5)::DECIMAL(11,5)::VARCHAR, round(lon, 5)::DECIMAL(11,5)::VARCHAR, (id % 10 * 500)::VARCHAR)) AS query_key FROM det")
def h6_query_key(spark, d):
    return detections(spark, d).select("id", search.query_key(F.col("source"), F.col("lat"), F.col("lon"), F.col("id") % 10 * 500).alias("query_key"))


@query(f"{W}, p AS (SELECT event_id, source, any_value(site) % 3 <> 0 AS applicable, count(*) >= 2 AS active FROM det GROUP BY 1, 2) SELECT event_id, count(*) FILTER (applicable) AS applicable, count(*) FILTER (applicable AND active) AS active, round(100 * count(*) FILTER (applicable AND active) / nullif(count(*) FILTER (applicable), 0))::INT AS percent FROM p GROUP BY 1")
def h7_report_coverage(spark, d):
    parts = detections(spark, d).groupBy("event_id", "site", "source").agg(F.count("*").alias("n"))
    return production.report_coverage(parts.select("event_id", "source", (F.col("site") % 3 != 0).alias("applicable"), (F.col("n") >= 2).alias("active")))


@query(f"""{W}, {ROLL}, s AS (SELECT event_id, count(DISTINCT source) AS n, count(*) FILTER (id % 4 = 0) AS docs FROM det GROUP BY 1), g AS (SELECT event_id, max(frp) AS frp FROM det WHERE site % 3 = 0 GROUP BY 1), t AS (SELECT event_id, substr(event_id, 2)::INT AS k FROM roll)
 SELECT r.event_id, observations, s.n AS sources, round(g.frp, 3) AS peak, CASE WHEN g.event_id IS NULL THEN 'not_cached' ELSE 'ready' END AS trend_status, CASE WHEN k % 4 = 0 THEN 'error' ELSE 'ready' END AS ground_status, CASE WHEN k % 2 = 0 THEN latest_confidence END AS level, CASE WHEN k % 2 = 0 THEN 'ready' ELSE 'not_cached' END AS atmosphere_status,
 nullif(docs, 0) AS documents, CASE WHEN docs = 0 THEN 'not_cached' ELSE 'ready' END AS documents_status, round((epoch_us(last_seen) - epoch_us(first_seen)) / 3.6e9, 3) AS hours FROM roll r JOIN s USING (event_id) JOIN t USING (event_id) LEFT JOIN g USING (event_id)""")
def h8_evidence_bundle(spark, d):
    """Seven parts of an event's evidence, some missing for some events, one with a status of its own."""
    det = detections(spark, d)
    roll = events.event_rollup(det).withColumn("k", F.substring("event_id", 2, 20).cast("int"))
    hours = (F.unix_micros(F.col("last_seen").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 3.6e9
    parts = {
        "core": roll.select("event_id", "observations"), "provenance": det.groupBy("event_id").agg(F.count_distinct("source").alias("n")), "trend": det.where("site % 3 = 0").groupBy("event_id").agg(F.max("frp").alias("frp")),
        "ground": roll.select("event_id", F.lit(1).alias("sensors"), F.when(F.col("k") % 4 == 0, "error").alias("status")), "atmosphere": roll.where("k % 2 = 0").select("event_id", F.col("latest_confidence").alias("level")),
        "documents": det.where("id % 4 = 0").groupBy("event_id").agg(F.count("*").alias("n")), "timeline": roll.select("event_id", hours.alias("hours")),
    }
    out = enrich.event_context(roll, parts)
    return out.select("event_id", "core.observations", F.col("provenance.n").alias("sources"), F.round("trend.frp", 3).alias("peak"), "trend_status", "ground_status", "atmosphere.level", "atmosphere_status", F.col("documents.n").alias("documents"), "documents_status", F.round("timeline.hours", 3).alias("hours"))


ENT = "ent AS (SELECT site::VARCHAR AS entity_id, count(DISTINCT source) AS n_sources, max(frp) AS confidence FROM det GROUP BY 1)"


def entities(det):
    return det.groupBy(F.col("site").cast("string").alias("entity_id")).agg(F.collect_set("source").alias("sources"), F.max("frp").alias("confidence"))


@query(f"{W}, {ENT} SELECT entity_id, entity_id = '1' AS exact, n_sources FROM ent WHERE entity_id LIKE '1%' ORDER BY entity_id = '1' DESC, n_sources DESC, confidence DESC, entity_id LIMIT 20")
def h9_find_entity(spark, d):
    return search.find_entity(entities(detections(spark, d)), "1", 20).select("entity_id", "exact", F.size("sources").cast("long").alias("n_sources"))


@query(f"{W}, {ENT} SELECT entity_id, n_sources::INT AS n_sources, (SELECT count(*) FROM det d WHERE d.site::VARCHAR = entity_id AND d.id % 4 = 0) AS n_records, (SELECT count(*) FROM det d WHERE d.site::VARCHAR = entity_id AND d.id % 9 = 0) AS n_proposals FROM ent")
def h9_registry_summary(spark, d):
    det = detections(spark, d)
    some = lambda k: det.where(f"id % {k} = 0").select(F.col("site").cast("string").alias("entity_id"))
    return search.registry_summary(entities(det), some(4), some(9))


@query(f"{W}, e AS (SELECT event_id, max(acq) AS last, max(frp) AS m FROM det GROUP BY 1), s AS (SELECT CASE WHEN m >= 150 THEN 'error' WHEN m >= 80 THEN 'warning' ELSE 'quiet' END AS state FROM e) SELECT state, count(*) AS n, CASE state WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS severity FROM s GROUP BY 1")
def h10_monitor_summary(spark, d):
    e = detections(spark, d).groupBy("event_id").agg(F.max("frp").alias("m"))
    state = F.when(F.col("m") >= 150, "error").when(F.col("m") >= 80, "warning").otherwise("quiet")
    return production.monitor_summary(e.withColumn("state", state), "state", ["error", "warning"])


@query("SELECT p_partkey AS id, round(CASE p_partkey % 4 WHEN 0 THEN pi() * p_size * p_size * 1e6 / 1e6 WHEN 1 THEN (2 * p_retailprice * 3000 + pi() * 9e6) / 1e6 WHEN 2 THEN p_retailprice ELSE 0 END, 3) AS area_km2 FROM part")
def p11_study_area(spark, d):
    p = table(spark, d, "part")
    mode = F.element_at(F.array(*map(F.lit, ("radius", "route", "polygon", "text"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    area = search.study_area_km2(mode, F.col("p_size") * F.lit(1000.0), F.col("p_retailprice"), F.lit(3000.0), F.col("p_retailprice"))
    return p.select(F.col("p_partkey").alias("id"), F.round(area, 3).alias("area_km2"))


ASK = "q AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN n_name || ' ' || o_orderpriority WHEN o_orderkey % 3 = 1 THEN o_orderpriority || ' ' || n_name ELSE o_orderpriority END AS query FROM orders JOIN nation ON n_nationkey = o_custkey % 25), k AS (SELECT query, trim(regexp_replace(lower(query), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS q FROM q), al AS (SELECT DISTINCT n_nationkey AS code, trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS alias FROM nation)"


@query(f"WITH {ASK}, m AS (SELECT query, code, alias, trim(substr(q, length(alias) + 1)) AS object, 'prefix' AS position FROM k JOIN al ON starts_with(q, alias || ' ') UNION ALL SELECT query, code, alias, trim(substr(q, 1, length(q) - length(alias))), 'suffix' FROM k JOIN al ON ends_with(q, ' ' || alias)) SELECT query, code, object, position FROM m WHERE object <> '' QUALIFY row_number() OVER (PARTITION BY query ORDER BY length(alias) DESC, position, code) = 1")
def p16_split_query(spark, d):
    o = table(spark, d, "orders").withColumn("n_nationkey", (F.col("o_custkey") % 25).cast("int")).join(table(spark, d, "nation"), "n_nationkey")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(" ", "n_name", "o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(" ", "o_orderpriority", "n_name")).otherwise(F.col("o_orderpriority"))
    return search.split_query(o.select(text.alias("query")).distinct(), table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("alias")))


NORM = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
TOWN = f"t AS (SELECT n_nationkey AS id, {NORM.format(x='n_name')} AS n, CASE n_regionkey WHEN 0 THEN 'city' WHEN 1 THEN 'village' ELSE 'place' END AS place, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS pop FROM nation), q AS (SELECT DISTINCT {NORM.format(x='n_name')} || CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 's' ELSE 'land' END AS q FROM customer JOIN nation ON n_nationkey = c_nationkey), g AS (SELECT *, {BI.format(x='q')} AS gx, {BI.format(x='n')} AS gy FROM q, t), s AS (SELECT *, CASE WHEN q = n THEN 1 ELSE 2.0 * list_sum(list_transform(list_distinct(gx), lambda g: least(len(list_filter(gx, lambda z: z = g)), len(list_filter(gy, lambda z: z = g))))) / (len(gx) + len(gy)) END AS score FROM g)"


@query(f"WITH {TOWN} SELECT q AS query, arg_max(id, v) AS place_id, round(arg_max(score, v), 3) AS name_score, arg_max(CASE place WHEN 'city' THEN 15000 WHEN 'village' THEN 4500 ELSE 7000 END, v) AS radius_m FROM (SELECT *, (score * 1000 + CASE place WHEN 'city' THEN 40 WHEN 'village' THEN 20 ELSE 0 END + least(9, log10(greatest(1, pop))), -id) AS v FROM s WHERE score >= 0.78) GROUP BY 1")
def p19_settlement_target(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    end = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "s").otherwise("land")
    q = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(norm_name(F.col("n_name")), end).alias("query")).distinct()
    place = F.when(F.col("n_regionkey") == 0, "city").when(F.col("n_regionkey") == 1, "village").otherwise("place")
    people = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("population"))
    places = n.join(people, "n_nationkey", "left").select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name"), place.alias("place"), "population")
    return search.settlement_target(q, places).select("query", "place_id", "name_score", "radius_m")


#: Categories are the distinct names of parts; the asked names are those of the parts, whole, in other words, misspelt, cut or generic.
CATEGORY_ASK = "CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'a ' || p_name || ' of ' || p_type WHEN 2 THEN replace(p_name, 'l', 'll') || CASE WHEN p_size % 2 = 0 THEN 's' ELSE '' END WHEN 3 THEN p_type || ' ' || (p_partkey % 40) WHEN 4 THEN substr(p_name, 2) ELSE 'Object' END"


@query(f"""WITH asked AS (SELECT DISTINCT {CATEGORY_ASK} AS query FROM part), q AS (SELECT query, {NORM.format(x="query")} AS q FROM asked), al AS (SELECT DISTINCT p_name AS code, {NORM.format(x="alias")} AS a FROM (SELECT p_name, unnest([p_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)]) AS alias FROM part)),
 p AS (SELECT query, q, code, a, {BI.format(x="q")} AS gx, {BI.format(x="a")} AS gy FROM q, al WHERE q <> ''),
 s AS (SELECT *, CASE WHEN q = a THEN 3 WHEN contains(' ' || q || ' ', ' ' || a || ' ') THEN 2 ELSE 1 END AS kind, coalesce(2.0 * list_sum(list_transform(list_distinct(gx), lambda g: least(len(list_filter(gx, lambda z: z = g)), len(list_filter(gy, lambda z: z = g))))) / nullif(len(gx) + len(gy), 0), 0) AS dice FROM p),
 c AS (SELECT query, kind, code, max(CASE kind WHEN 2 THEN length(a) WHEN 1 THEN dice ELSE 1 END) AS v FROM s WHERE kind > 1 OR dice >= 0.86 GROUP BY ALL), top AS (SELECT *, max(kind) OVER (PARTITION BY query) AS best FROM c), led AS (SELECT *, max(v) OVER (PARTITION BY query) AS first FROM top WHERE kind = best),
 n AS (SELECT query, best, min(code) AS code, count(*) AS codes FROM led WHERE CASE best WHEN 1 THEN first - v < 0.08 ELSE v = first END GROUP BY 1, 2)
 SELECT query, CASE WHEN codes = 1 THEN code END AS code, CASE WHEN q.q = 'object' THEN 'generic' WHEN codes IS NULL THEN 'none' WHEN codes > 1 THEN 'ambiguous' ELSE ['similar', 'contained', 'exact'][best] END AS how FROM q LEFT JOIN n USING (query) WHERE q.q <> ''""")
def p13_resolve_category(spark, d):
    p = table(spark, d, "part")
    turned = F.concat(F.substring_index("p_name", " ", -1), F.lit(" "), F.substring_index("p_name", " ", 1))
    catalogue = p.select(F.col("p_name").alias("code"), F.explode(F.array("p_name", turned)).alias("alias")).distinct()
    return search.resolve_category(p.selectExpr(f"{CATEGORY_ASK} AS query").distinct(), catalogue, ["object"])


WORDS3 = "list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) > 2))"
REGISTRY_LIKE = f"CASE WHEN {{x}} = '' OR {{y}} = '' THEN 0 WHEN {{x}} = {{y}} THEN 1 WHEN length({{x}}) >= 8 AND contains({{y}}, {{x}}) OR length({{y}}) >= 8 AND contains({{x}}, {{y}}) THEN 0.94 ELSE coalesce(len(list_intersect({WORDS3}, {WORDS3.format(x='{y}')})) / nullif(len(list_distinct(list_concat({WORDS3}, {WORDS3.format(x='{y}')}))), 0), 0) END::DOUBLE"
TITLE = "p_name || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN ' register' ELSE ' map' END"
PUBLISHER = "CASE WHEN p_size % 4 = 0 THEN p_name || ' works' WHEN p_size % 4 = 1 THEN p_name || ' works and more' WHEN p_size % 4 = 2 THEN p_brand END"
NOTES = "CASE WHEN p_size % 5 > 0 THEN 'A list of ' || p_type || ' things by ' || p_name || ' ' || p_brand END"


@query(f"""WITH e AS (SELECT min(p_partkey) AS entity_id, {NORM.format(x="p_name")} AS n FROM part GROUP BY p_name), term AS (SELECT entity_id, unnest([n, 'new ' || split_part(n, ' ', 2) || ' shop', n || ' works']) AS term FROM e),
 ds AS (SELECT min(p_partkey) AS dataset_id, {NORM.format(x="title")} AS t, coalesce({NORM.format(x="notes")}, '') AS o, coalesce({NORM.format(x="publisher")}, '') AS p FROM (SELECT p_partkey, {TITLE} AS title, {NOTES} AS notes, {PUBLISHER} AS publisher FROM part) GROUP BY title, notes, publisher),
 pair AS (SELECT DISTINCT entity_id, dataset_id FROM (SELECT entity_id, unnest({WORDS3.format(x="term")}) AS w FROM term) JOIN (SELECT dataset_id, unnest({WORDS3.format(x="t || ' ' || o || ' ' || p")}) AS w FROM ds) USING (w)),
 r AS (SELECT entity_id, dataset_id, max(greatest({REGISTRY_LIKE.format(x="term", y="t")}, 0.75::DOUBLE * {REGISTRY_LIKE.format(x="term", y="o")})) AS best, bool_or(t = term) AS exact_title, bool_or(length(term) >= 8 AND contains(t, term)) AS title_contains, max(CASE WHEN ends_with(term, ' works') THEN {REGISTRY_LIKE.format(x="term", y="p")} ELSE 0 END) AS run_by FROM pair JOIN term USING (entity_id) JOIN ds USING (dataset_id) GROUP BY 1, 2),
 s AS (SELECT *, floor(100 * greatest(best, CASE WHEN run_by >= 0.85 THEN 0.88::DOUBLE ELSE 0 END) + 0.5)::INT AS c FROM r), u AS (SELECT *, run_by >= 0.82 AS publisher_match, greatest(c, CASE WHEN exact_title THEN 96 WHEN title_contains THEN 90 ELSE 0 END, CASE WHEN run_by >= 0.82 THEN 88 ELSE 0 END) AS score FROM s)
 SELECT entity_id, dataset_id, score, exact_title, title_contains, publisher_match, CASE WHEN score >= 90 AND (exact_title OR title_contains OR publisher_match) THEN 'probable' ELSE 'candidate' END AS status FROM u WHERE score >= 55""")
def p22_link_registry(spark, d):
    """Names of parts as entities, with an alias and an operator, against a register made of all parts."""
    p = table(spark, d, "part")
    registry = p.selectExpr("p_partkey", f"{TITLE} AS title", f"{NOTES} AS notes", f"{PUBLISHER} AS publisher").groupBy("title", "notes", "publisher").agg(F.min("p_partkey").alias("dataset_id"))
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id"))
    alias = F.concat(F.lit("new "), F.substring_index("name", " ", -1), F.lit(" shop"))
    return resolve.link_registry(names.withColumns({"aliases": F.array(alias), "operators": F.array(F.concat("name", F.lit(" works")))}), registry)


GEO = "k AS (SELECT doc_id, doc_id % 4 AS e, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents)"


GEO_STATUS = "CASE WHEN e < 2 AND contains(t, 'that') THEN 'nearest_place' WHEN e < 2 AND contains(t, 'ther') THEN 'region' WHEN e = 2 AND contains(t, 'this') THEN 'local_reference' WHEN contains(t, 'tion') THEN 'other_known_place' WHEN regexp_matches(t, ' la ') THEN 'country_only' WHEN regexp_matches(t, ' und ') THEN 'foreign_location_signal' ELSE 'none' END"
GEO_SCORE = "CASE geo_status WHEN 'nearest_place' THEN 100 WHEN 'region' THEN 90 WHEN 'local_reference' THEN 85 WHEN 'other_known_place' THEN 10 WHEN 'country_only' THEN 35 ELSE 0 END"


def placed(spark, d):
    """Documents of four events with their place status; two events have a place and a region, one a local name."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("event_id"), "text")
    contexts = docs.select("event_id").distinct().where("event_id < 2").withColumns({"place": F.lit("That"), "region": F.lit("there")})
    places = docs.where("event_id = 2").select("event_id", F.lit("this").alias("name")).distinct().unionByName(spark.sql("select cast(null as bigint) event_id, 'tion' name"))
    return names.geo_status(docs, contexts, places, " la ", " und ")


@query(f"WITH {GEO} SELECT *, {GEO_SCORE} AS geo_score FROM (SELECT doc_id, {GEO_STATUS} AS geo_status FROM k)")
def t8_geo_status(spark, d):
    return placed(spark, d).drop("event_id")
