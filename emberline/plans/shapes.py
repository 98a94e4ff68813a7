"""Queries over shapes, the ellipsoid, JSON records, event search, object filters and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, shapes
from ..operators import enrich, events, objects, records
from .adapters import AS_OF, DET, _columns, as_of, detections, table
from .base import query
from .core import ROLL, H
from .objects import HP, SECT, W, within

#: JSON arrays from all events: two records each, with a broken one, a bare number or a text that is no array at times.
JSON = """CASE WHEN event_id % 13 = 0 THEN '{' || props WHEN event_id % 17 = 0 THEN '[]' ELSE '[' || props || ', ' || CASE event_id % 4 WHEN 0 THEN '{"k": "many"}' WHEN 1 THEN '{"k": ' || event_id || ', "s": "a, b"}' WHEN 2 THEN CAST(event_id AS STRING) ELSE '{"s": "only"}' END || ', ' || props || ']' END"""


@query("""SELECT event_id AS id, place::INT AS place, CASE WHEN place <> 2 AND place > 0 THEN k WHEN place = 2 AND event_id % 4 = 1 THEN event_id END AS k, CASE WHEN place = 2 AND event_id % 4 = 1 THEN 'a, b' WHEN place = 2 AND event_id % 4 = 3 THEN 'only' END AS s,
 CASE WHEN place = 0 THEN '{' || props WHEN place = 2 AND event_id % 4 = 0 THEN '{"k":"many"}' WHEN place = 2 AND event_id % 4 = 2 THEN event_id::VARCHAR END AS malformed
 FROM (SELECT event_id, props, json_extract(props, '$.k')::BIGINT AS k, unnest(CASE WHEN event_id % 13 = 0 THEN [0] WHEN event_id % 17 = 0 THEN [] ELSE [1, 2, 3] END) AS place FROM events)""")
def g7_json_arrays(spark, d):
    return records.json_records(table(spark, d, "events").selectExpr("event_id AS id", f"{JSON} AS records"), "id", "records", "k bigint, s string")


#: Shapes about a place, by kind: a U open to the north, a box with a hole in its middle, a triangle; vertices as (ring, dx, dy).
KINDS = (
    ((0, 0.0, 0.0), (0, 0.2, 0.0), (0, 0.2, 0.2), (0, 0.17, 0.2), (0, 0.17, 0.05), (0, 0.05, 0.05), (0, 0.05, 0.2), (0, 0.0, 0.2), (0, 0.0, 0.0)),
    ((0, 0.0, 0.0), (0, 0.2, 0.0), (0, 0.2, 0.2), (0, 0.0, 0.2), (0, 0.0, 0.0), (1, 0.04, 0.05), (1, 0.15, 0.05), (1, 0.15, 0.16), (1, 0.04, 0.16), (1, 0.04, 0.05)),
    ((0, 0.0, 0.0), (0, 0.2, 0.03), (0, 0.1, 0.2), (0, 0.0, 0.0)),
)
VERTICES = ", ".join(f"({k}, {r}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for k, kind in enumerate(KINDS) for i, (r, x, y) in enumerate(kind))


@query(f"""WITH {DET}, v AS (SELECT id, ring, i, lon + dx AS x, lat + dy AS y FROM det JOIN (VALUES {VERTICES}) s(kind, ring, i, dx, dy) ON kind = id % 3), e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY id, ring ORDER BY i)),
 m AS (SELECT id, (min(y) + max(y)) / 2 AS m, (min(x) + max(x)) / 2 AS cx FROM v GROUP BY id), l AS (SELECT id, any_value(cx) AS cx, any_value(m) AS cy, (max(y) FILTER (y <= m) + min(y) FILTER (y > m)) / 2 AS y FROM v JOIN m USING (id) GROUP BY id),
 c AS (SELECT id, l.y, x + (l.y - e.y) / (y2 - e.y) * (x2 - x) AS xa FROM e JOIN l USING (id) WHERE (e.y > l.y) <> (y2 > l.y)), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY xa) AS n, lead(xa) OVER (PARTITION BY id ORDER BY xa) AS xb FROM c),
 b AS (SELECT id, arg_max((xa + xb) / 2, (round(xb - xa, 9), -n)) AS lon FROM n WHERE n % 2 = 1 GROUP BY id) SELECT id, round(b.lon, 6) AS lon, round(l.y, 6) AS lat, round(cx, 6) AS centre_lon, round(cy, 6) AS centre_lat, true AS covered FROM b JOIN l USING (id)""")
def g10_surface_points(spark, d):
    """A shape at every detection, with its point on the surface, the centre of its box, and whether the shape covers the point."""
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = lambda kind, r: F.array(*(corner(x, y) for q, x, y in kind if q == r))
    shape = lambda kind: F.array(*(ring(kind, r) for r in sorted({v[0] for v in kind})))
    rings = F.when(F.col("id") % 3 == 0, shape(KINDS[0])).when(F.col("id") % 3 == 1, shape(KINDS[1])).otherwise(shape(KINDS[2]))
    out = detections(spark, d).select("id", "lat", "lon").withColumn("rings", rings)
    out = out.withColumns({"p": shapes.point_on_surface(F.col("rings")), "c": shapes.box_centre(geo.bbox(F.flatten("rings")))})
    six = lambda c: F.round(c, 6)
    return out.select("id", six("p.lon").alias("lon"), six("p.lat").alias("lat"), six("c.lon").alias("centre_lon"), six("c.lat").alias("centre_lat"), geo.covers(F.col("p.lon"), F.col("p.lat"), F.col("rings")).alias("covered"))


@query(f"""WITH RECURSIVE {DET}, c AS (SELECT 1 / 298.257223563::DOUBLE AS f, 6378137.0::DOUBLE AS a, 49.5::DOUBLE AS lat2, 31.25::DOUBLE AS lon2), u AS (SELECT id, f, a, atan((1 - f) * tan(radians(lat))) AS u1, atan((1 - f) * tan(radians(lat2))) AS u2, radians(lon2 - lon) AS gap FROM det, c),
 it AS (SELECT id, gap AS lam, 0 AS n FROM u UNION ALL SELECT id, gap + (1 - cc) * f * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))), n + 1 FROM (SELECT *, CASE WHEN sq = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / sq END AS cm, f / 16 * sq * (4 + f * (4 - 3 * sq)) AS cc FROM (SELECT *, atan2(ss, cs) AS sg, 1 - sa * sa AS sq FROM (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM
  (SELECT it.id, it.n, it.lam, f, u1, u2, gap, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it JOIN u USING (id) WHERE n < 10)))) z),
 e AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (SELECT id, a, a * (1 - f) AS b, u1, u2, lam, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it JOIN u USING (id) WHERE n = 10)),
 g AS (SELECT *, 1 - sa * sa AS sq, (1 - sa * sa) * (a * a - b * b) / (b * b) AS k FROM e), h AS (SELECT *, CASE WHEN sq = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / sq END AS cm, 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))) AS aa, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS bb FROM g)
 SELECT id, round(b * aa * (atan2(ss, cs) - bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))), 3) AS distance_m FROM h""")
def g11_spheroidal_distance(spark, d):
    """Every detection's distance on the ellipsoid to one place."""
    return detections(spark, d).select("id", F.round(shapes.spheroid_m(F.col("lat"), F.col("lon"), F.lit(49.5), F.lit(31.25)), 3).alias("distance_m"))


#: Columns that events of the library have and the rollup of the test tables lacks.
STATE = "CASE CAST(substr(event_id, 2) AS INT) % 3 WHEN 0 THEN 'North Bay' WHEN 1 THEN 'northern plain' END AS region, CASE CAST(substr(event_id, 2) AS INT) % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'closed' ELSE 'active' END AS lifecycle_status, CASE WHEN CAST(substr(event_id, 2) AS INT) % 5 = 0 THEN 'closed' ELSE 'open' END AS status, CAST(substr(event_id, 2) AS INT) % 2 = 0 AS sent"
SEARCHES = {
    "region": ({"region": "NORTH"}, "region ILIKE '%north%'"), "bay": ({"region": "bay"}, "region ILIKE '%bay%'"), "closed": ({"status": "closed"}, "lifecycle_status = 'closed' OR status = 'closed'"), "active": ({"status": "active"}, "lifecycle_status = 'active'"),
    "sent": ({"sent": True}, "sent"), "unsent": ({"sent": False}, "NOT sent"), "prefix": ({"prefix": "E1"}, "starts_with(event_id, 'e1')"), "source": ({"source": "LSA_SAF_MSG_FRP_PIXEL"}, "list_contains(sources, 'LSA_SAF_MSG_FRP_PIXEL')"),
    "since": ({"since": "2024-01-29 00:00:00"}, "last_seen >= TIMESTAMP '2024-01-29'"), "until": ({"until": "2024-01-01 06:00:00"}, "first_seen <= TIMESTAMP '2024-01-01 06:00:00'"),
    "frp": ({"min_frp": 120}, "max_frp >= 120"), "observations": ({"min_observations": 12}, "observations >= 12"), "platforms": ({"min_platforms": 4}, "len(satellites) >= 4"), "all": ({"region": "north", "status": "active", "sent": True, "min_frp": 20, "min_platforms": 2}, "region ILIKE '%north%' AND lifecycle_status = 'active' AND sent AND max_frp >= 20 AND len(satellites) >= 2"),
}
NEAR = H.format(a="48.0", b="30.0", c="latest_lat", d="latest_lon")


@query(f"WITH {DET}, {ROLL}, e AS (SELECT *, {STATE} FROM roll) " + " UNION ALL ".join(f"(SELECT '{k}' AS search, event_id FROM e WHERE {w} ORDER BY last_seen DESC, event_id LIMIT 50)" for k, (_, w) in SEARCHES.items()) + f" UNION ALL (SELECT 'near', event_id FROM e WHERE {NEAR} <= 200000 ORDER BY round({NEAR}), last_seen DESC, event_id LIMIT 50)")
def h2_search_filters(spark, d):
    """Every filter of the event search, each by itself, five together, and by distance."""
    e = events.event_rollup(detections(spark, d)).selectExpr("*", *_columns(STATE))
    out = objects.search_events(e, lat=48.0, lon=30.0, radius_m=200_000, limit=50).select(F.lit("near").alias("search"), "event_id")
    for k, (filters, _) in SEARCHES.items():
        out = out.unionByName(objects.search_events(e, limit=50, **filters).select(F.lit(k).alias("search"), "event_id"))
    return out


@query(f"""WITH {DET}, {ROLL}, e AS (SELECT *, {STATE} FROM roll), t AS (SELECT {AS_OF} - INTERVAL 72 HOUR AS s), c AS (SELECT count(*) FILTER (first_seen >= s) AS a, count(*) FILTER (first_seen >= s AND lifecycle_status <> 'closed') AS b, count(*) FILTER (first_seen >= s AND lifecycle_status = 'closed') AS c, count(*) FILTER (last_seen >= s) AS d, count(*) FILTER (first_seen >= s AND len(satellites) >= 2) AS m FROM e, t),
 p AS (SELECT count(*) AS n, max(frp) AS most, round(avg(frp), 2) AS mean FROM det, t WHERE acq >= s AND frp IS NOT NULL)
 SELECT 'events' AS part, unnest(['new', 'active_new', 'closed_new', 'touched', 'multisource_new']) AS name, unnest([a, b, c, d, m]) AS n, NULL::DOUBLE AS value FROM c UNION ALL SELECT 'source', source, count(*), NULL FROM det, t WHERE acq >= s GROUP BY source UNION ALL SELECT 'frp', unnest(['max', 'avg']), n, unnest([most, mean]) FROM p""")
def h3_analytics_summary(spark, d):
    det = detections(spark, d)
    return objects.analytics_summary(events.event_rollup(det).selectExpr("*", *_columns(STATE)), det, as_of(det), 72)


ADDRESS = "CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 20 AS STRING) || ' Mill-Street, ' || p_type END"
OPERATOR = "CASE WHEN p_partkey % 4 > 0 THEN 'The ' || p_brand || ' Company' END"
FILTERS = {
    "address": ({"address": "mill street  ECONOMY"}, "contains(lower(address), 'economy')"), "operator": ({"operator": "brand 3 company"}, "operator = 'The Brand#3 Company'"), "brand": ({"brand": "Red"}, "contains(lower(p_name), 'red')"),
    "confidence": ({"min_confidence": 30}, "confidence >= 30"), "source": ({"source": "map"}, "p_partkey % 2 = 0"), "with": ({"has_address": True}, "address IS NOT NULL"), "without": ({"has_address": False}, "address IS NULL"),
    "settlement": ({"settlement": "LARGE"}, "p_type = 'LARGE'"), "all": ({"address": "mill", "operator": "brand", "brand": "ring", "min_confidence": 10, "source": "map", "has_address": True}, "address IS NOT NULL AND operator IS NOT NULL AND contains(p_name, 'ring') AND confidence >= 10 AND p_partkey % 2 = 0"),
}


@query(f"WITH o AS (SELECT *, {ADDRESS} AS address, {OPERATOR} AS operator, CASE WHEN p_size > 5 THEN p_size END AS confidence FROM part) " + " UNION ALL ".join(f"SELECT '{k}' AS filter, p_partkey AS id FROM o WHERE {w}" for k, (_, w) in FILTERS.items()))
def p17_filter_all(spark, d):
    """Every attribute filter by itself, and all but one together."""
    o = table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS canonical_name", "p_type AS settlement", f"{ADDRESS} AS address", f"{OPERATOR} AS operator", "CASE WHEN p_size > 5 THEN p_size END AS confidence", "if(p_partkey % 2 = 0, array('map', 'open'), array('open')) AS sources")
    out = None
    for k, (filters, _) in FILTERS.items():
        part = objects.filter_objects(o, **filters).select(F.lit(k).alias("filter"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""{W}, cells AS (SELECT unnest([0, 500, 1000, 2000, 5000, 10000])::DOUBLE AS from_m, s.sector, s.spot FROM (SELECT unnest(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW']) AS sector, unnest(range(8)) AS spot) s), p AS (SELECT floor({HP} + 0.5) AS m, {SECT} AS sector FROM det WHERE {HP} <= 50000),
 g AS (SELECT * FROM cells WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.sector = cells.sector AND m >= from_m AND m < CASE from_m WHEN 0 THEN 500 WHEN 500 THEN 1000 WHEN 1000 THEN 2000 WHEN 2000 THEN 5000 WHEN 5000 THEN 10000 ELSE 50000 END)), n AS (SELECT count(*) AS n FROM g)
 SELECT 48 AS cell_count, n AS empty_cells, round(n / 48, 3) AS empty_fraction, from_m, sector FROM (SELECT * FROM g ORDER BY from_m, spot LIMIT 24), n""")
def p9_gap_summary(spark, d):
    """The empty cells about a place: how many, their share, and the first 24."""
    s = objects.gap_summary(within(spark, d), 49.0, 31.0, 50000)
    return s.select("cell_count", "empty_cells", "empty_fraction", F.explode("gaps").alias("g")).select("cell_count", "empty_cells", "empty_fraction", "g.*")


#: Every third event was sent some minutes after it was first received.
SENT = "SELECT event_id, min(received_at) + {minutes} AS sent_at FROM {det} WHERE CAST(substr(event_id, 2) AS INT) % 3 = 0 GROUP BY event_id"
LATENCY = "lat AS (SELECT event_id, first_seen, first_received_at, sent_at, round(worst, 1) AS source_latency_min, round((epoch_us(sent_at) - epoch_us(first_received_at)) / 6e7, 1) AS delivery_latency_min, round((epoch_us(sent_at) - epoch_us(first_seen)) / 6e7, 1) AS end_to_end_latency_min FROM (SELECT event_id, min(acq) AS first_seen, min(received_at) AS first_received_at, max(greatest(0, (epoch_us(received_at) - epoch_us(acq)) / 6e7)) AS worst FROM det GROUP BY event_id) LEFT JOIN sent USING (event_id))"
SENT_SQL = f"sent AS ({SENT.format(minutes='(any_value(substr(event_id, 2)::INT) * 7 % 41) * INTERVAL 1 MINUTE', det='det')})"


def sent(det):
    late = F.make_dt_interval(mins=F.expr("cast(substr(event_id, 2) as int) * 7 % 41"))
    return det.where("cast(substr(event_id, 2) as int) % 3 = 0").groupBy("event_id").agg(F.min("received_at").alias("first")).select("event_id", (F.col("first") + late).alias("sent_at"))


@query(f"{W}, {SENT_SQL}, {LATENCY} SELECT * FROM lat")
def d22_event_latency(spark, d):
    det = detections(spark, d)
    return events.event_latency(det, sent(det))


@query(f"{W}, {SENT_SQL}, {LATENCY} (SELECT 'source' AS kind, event_id, id, round(m, 1) AS latency_min FROM (SELECT event_id, id, greatest(0, (epoch_us(received_at) - epoch_us(acq)) / 6e7) AS m FROM det) ORDER BY m DESC, event_id, id LIMIT 10) UNION ALL (SELECT 'delivery', event_id, NULL, delivery_latency_min FROM lat WHERE sent_at IS NOT NULL ORDER BY epoch_us(sent_at) - epoch_us(first_received_at) DESC, event_id LIMIT 10)")
def d22_worst_latency(spark, d):
    det = detections(spark, d)
    return events.worst_latencies(det, sent(det))


TURN = "radians(dir + a)"
ARC = "(100000.0 / 6371000.0)"


@query(f"""{W}, {ROLL}, dirs AS (SELECT event_id, latest_lat, latest_lon, (degrees(atan2(avg(sin(radians(t))), avg(cos(radians(t))))) + 360) % 360 AS dir FROM (SELECT *, (substr(event_id, 2)::INT * 40 + h * 10 + 180) % 360 AS t FROM roll, (SELECT unnest(range(1, 7)) AS h) WHERE (substr(event_id, 2)::INT + h) % 5 > 0) GROUP BY ALL),
 arc AS (SELECT event_id, i, degrees(asin(sin(radians(latest_lat)) * cos({ARC}) + cos(radians(latest_lat)) * sin({ARC}) * cos({TURN}))) AS y, latest_lon, latest_lat, a, dir FROM dirs, (SELECT unnest(range(1, 8)) AS i, unnest([-22.5, -15, -7.5, 0, 7.5, 15, 22.5])::DOUBLE AS a)),
 v AS (SELECT event_id, i, y, (degrees(radians(latest_lon) + atan2(sin({TURN}) * sin({ARC}) * cos(radians(latest_lat)), cos({ARC}) - sin(radians(latest_lat)) * sin(radians(y)))) + 540) % 360 - 180 AS x FROM arc UNION ALL SELECT event_id, unnest([0, 8]), latest_lat, latest_lon FROM dirs),
 e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY event_id ORDER BY i)),
 hit AS (SELECT e.event_id, d.id FROM e JOIN det d ON (e.y > d.lat) <> (e.y2 > d.lat) AND d.lon < (e.x2 - e.x) * (d.lat - e.y) / (e.y2 - e.y) + e.x GROUP BY 1, 2 HAVING count(*) % 2 = 1)
 SELECT event_id, round(dir, 3) AS direction_deg, count(id) AS n_points FROM dirs LEFT JOIN (SELECT h.event_id, h.id FROM hit h JOIN det d ON d.id = h.id AND d.event_id <> h.event_id) USING (event_id) GROUP BY ALL""")
def d11_plume_sectors(spark, d):
    """How many detections of other events lie downwind of each event; a fifth of the hours has no wind."""
    det = detections(spark, d)
    e = events.event_rollup(det)
    wind = e.select("event_id", F.substring("event_id", 2, 20).cast("int").alias("site"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("hour"))
    speed = F.when((F.col("site") + F.col("hour")) % 5 > 0, 4.5)
    sectors = enrich.plume_sectors(e, wind.select("event_id", "hour", speed.alias("speed"), ((F.col("site") * 40 + F.col("hour") * 10) % 360).cast("double").alias("from_deg")))
    found = enrich.count_in_sectors(det, sectors).withColumnRenamed("n", "n_points")
    return sectors.join(found, "event_id", "left").select("event_id", F.round("direction_deg", 3).alias("direction_deg"), F.coalesce("n_points", F.lit(0)).alias("n_points"))
