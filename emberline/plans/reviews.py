"""Queries over the review of evidence, its feed and graph, and names of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, names, reviews
from .adapters import table
from .base import query
from .more import GEO, GEO_SCORE, GEO_STATUS, placed
from .texts import LEX_SQL, MENT, PUB, docs, mentions, t15_divergences

EVENT_SQL = "'e' || (doc_id % 50)"


def event():
    return F.concat(F.lit("e"), F.col("doc_id") % 50).alias("event_id")


ADMIN = """reg AS (SELECT n_nationkey AS region_id, lower(n_name) AS local_name, 'land ' || lower(n_name) AS name, lower(n_name) || 'ska' AS english_name, n_nationkey % 5 = 0 AS is_city FROM nation),
 ask AS (SELECT c_custkey AS id, lower(CASE c_custkey % 6 WHEN 0 THEN 'м. ' || n_name WHEN 1 THEN n_name || ' область' WHEN 2 THEN 'land ' || n_name WHEN 4 THEN ' ' WHEN 5 THEN 'м' || n_name END) AS l, lower(CASE c_custkey % 6 WHEN 3 THEN n_name || 'ska oblast' WHEN 4 THEN n_name || 'ia oblast' WHEN 5 THEN n_name || 'ii' END) AS en FROM customer JOIN nation ON n_nationkey = c_nationkey),
 base AS (SELECT id, l, regexp_replace(regexp_replace(trim(l), '^м(\\.\\s*|\\s+)', ''), '\\s+область$', '') AS b, regexp_replace(trim(en), '\\s+oblast$', '') AS e FROM ask),
 key AS (SELECT id, 0 AS rank, b AS key FROM base WHERE regexp_matches(l, '^м(\\.|\\s)') UNION ALL SELECT id, 1, b FROM base UNION ALL SELECT id, 2, b FROM base UNION ALL SELECT id, 3, e FROM base UNION ALL SELECT id, 4, regexp_replace(e, '(ia|a|yi|y)$', '') FROM base),
 own AS (SELECT region_id, 0 AS rank, local_name AS key FROM reg WHERE is_city UNION ALL SELECT region_id, 1, local_name FROM reg UNION ALL SELECT region_id, 2, name FROM reg UNION ALL SELECT region_id, 3, english_name FROM reg UNION ALL SELECT region_id, 4, regexp_replace(english_name, '(ska|skaia|skaya)$', '') FROM reg),
 one AS (SELECT rank, key, min(region_id) AS region_id FROM own GROUP BY 1, 2 HAVING rank < 4 OR count(DISTINCT region_id) = 1)"""


@query(f"WITH {ADMIN} SELECT id, arg_min(o.region_id, rank) AS region_id, CASE min(CASE WHEN o.region_id IS NOT NULL THEN rank END) WHEN 0 THEN 'city' WHEN 4 THEN 'stem' WHEN 1 THEN 'name' WHEN 2 THEN 'name' WHEN 3 THEN 'name' ELSE 'none' END AS how FROM key LEFT JOIN one o USING (rank, key) GROUP BY id")
def p24_map_admin_names(spark, d):
    n = table(spark, d, "nation")
    regions = n.selectExpr("n_nationkey region_id", "n_name local_name", "concat('Land ', n_name) name", "concat(n_name, 'ska') english_name", "n_nationkey % 5 = 0 is_city")
    asked = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).selectExpr(
        "c_custkey id", "case c_custkey % 6 when 0 then concat('м. ', n_name) when 1 then concat(n_name, ' область') when 2 then concat('land ', n_name) when 4 then ' ' when 5 then concat('м', n_name) end local_name",
        "case c_custkey % 6 when 3 then concat(n_name, 'ska oblast') when 4 then concat(n_name, 'ia oblast') when 5 then concat(n_name, 'ii') end english_name",
    )
    return names.map_admin_names(asked, regions).select("id", "region_id", "how")


CLASSES = ("strong", "close", "odd", None)
AWAY = f"away AS (SELECT doc_id AS item_id, geo_status FROM (SELECT doc_id, {GEO_STATUS} AS geo_status FROM k))"


@query(f"""WITH {GEO}, {AWAY}, c AS (SELECT doc_id AS item_id, {EVENT_SQL} AS event_id, doc_id % 3 AS w, {PUB} AS observed_at, (doc_id % 100)::INT AS points, lang, geo_status FROM documents JOIN away ON item_id = doc_id),
 e AS (SELECT event_id, max(observed_at) AS last_seen FROM c GROUP BY 1),
 f AS (SELECT event_id, item_id, CASE w WHEN 0 THEN 'fusion' WHEN 1 THEN 'public_osint' ELSE 'legacy_osint' END AS channel, CASE WHEN w < 2 THEN points ELSE CASE item_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 60 WHEN 2 THEN 40 ELSE 30 END END AS score, observed_at,
 CASE w WHEN 1 THEN (epoch_us(observed_at) - epoch_us(last_seen)) / 1e6 WHEN 0 THEN points::DOUBLE ELSE points * 60.0 END AS delta_s FROM c JOIN e USING (event_id) WHERE w <> 1 OR (lang <> 'de' AND geo_status NOT IN ('foreign_location_signal', 'other_known_place')))
 SELECT event_id, item_id, channel, score, delta_s, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, observed_at DESC, channel, item_id) AS rank FROM f) WHERE rank <= 75""")
def t13_evidence_feed(spark, d):
    """Three channels, a third of the documents each; posts in German stand for rejected ones."""
    c = docs(spark, d).select(event(), F.col("doc_id").alias("item_id"), F.col("published_at").alias("observed_at"), (F.col("doc_id") % 100).cast("int").alias("score"), "lang")
    kind = F.when(F.col("item_id") % 4 == 0, "strong").when(F.col("item_id") % 4 == 1, "close").when(F.col("item_id") % 4 == 2, "odd")
    links = c.where("item_id % 3 = 0").withColumns({"distance_m": F.col("score"), "delta_s": F.col("score")})
    posts = c.where("item_id % 3 = 1").withColumn("category", F.when(F.col("lang") == "de", "geo_rejected"))
    legacy = c.where("item_id % 3 = 2").withColumns({"correlation_class": kind, "distance_m": F.col("score"), "delta_min": F.col("score")})
    statuses = placed(spark, d).select(event(), F.col("doc_id").alias("item_id"), "geo_status")
    events = c.groupBy("event_id").agg(F.max("observed_at").alias("last_seen"))
    return documents.evidence_feed(events, links, posts, statuses, legacy).select("event_id", "item_id", "channel", "score", "delta_s", "rank")


@query(f"""WITH {LEX_SQL}, {MENT}, i AS (SELECT * FROM (SELECT {EVENT_SQL} AS event_id, doc_id AS item_id, source AS provider, n_chars % 7 AS value, doc_id // 3 AS cluster_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY {PUB} DESC, doc_id) AS r FROM documents) WHERE r <= 60),
 n AS (SELECT event_id, item_id, provider, 'entity:' || md5(kind || '|' || canonical) AS node, canonical AS label FROM i JOIN m ON doc_id = item_id), s AS (SELECT event_id, item_id, provider, 'claim:' || md5('number|' || value) AS node, value::VARCHAR AS label FROM i), g AS (SELECT event_id, item_id, provider, 'cluster:' || cluster_id AS node FROM i),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, type ORDER BY providers DESC, mentions DESC, node) AS r FROM (SELECT event_id, node, 'entity' AS type, min(label) AS label, count(*) AS mentions, count(DISTINCT provider) AS providers FROM n GROUP BY 1, 2 UNION ALL SELECT event_id, node, 'claim', min(label), count(*), count(DISTINCT provider) FROM s GROUP BY 1, 2)) WHERE r <= 60)
 SELECT event_id, node AS src, NULL AS dst, type, label, mentions, providers FROM top UNION ALL SELECT DISTINCT event_id, 'event:' || event_id, NULL, 'event', event_id, NULL::BIGINT, NULL::BIGINT FROM i UNION ALL SELECT event_id, 'item:' || item_id, NULL, 'document', provider || ' ' || item_id, NULL, NULL FROM i
 UNION ALL SELECT event_id, node, NULL, 'cluster', 'cluster (' || count(*) || ')', count(*), count(DISTINCT provider) FROM g GROUP BY 1, 2 UNION ALL SELECT event_id, 'item:' || item_id, 'event:' || event_id, 'linked_to', NULL, NULL, NULL FROM i
 UNION ALL SELECT event_id, 'item:' || item_id, node, rel, NULL, NULL, NULL FROM (SELECT event_id, item_id, node, 'mentions' AS rel FROM n UNION ALL SELECT event_id, item_id, node, 'asserts' FROM s UNION ALL SELECT event_id, item_id, node, 'member_of' FROM g)""")
def t16_event_graph(spark, d):
    """Nodes, then edges, of each event's newest 60 documents."""
    x = docs(spark, d)
    item = F.col("doc_id").alias("item_id")
    items = x.select(event(), item, F.concat_ws(" ", "provider", "doc_id").alias("title"), "provider", "published_at")
    claims = x.select(item, F.lit("number").alias("type"), (F.col("n_chars") % 7).alias("value"))
    nodes, edges = documents.event_graph(items, mentions(spark, d).select(item, "kind", "canonical"), claims, x.select(item, F.expr("doc_id div 3").alias("cluster_id")))
    none = lambda kind: F.lit(None).cast(kind)
    edges = edges.select("event_id", "src", "dst", F.col("relation").alias("type"), none("string").alias("label"), none("long").alias("mentions"), none("long").alias("providers"))
    return nodes.select("event_id", F.col("node").alias("src"), none("string").alias("dst"), "type", "label", "mentions", "providers").unionByName(edges)


FIRST, ACTED, SECOND = "2024-06-01 00:00:00", "2024-06-02 00:00:00", "2024-06-03 00:00:00"


def proposals(spark, d, first: bool):
    """What documents and divergences propose; at first those of even ids alone, with points one higher."""
    x = docs(spark, d)
    status = placed(spark, d).select("doc_id", "geo_status", (F.col("geo_score") + int(first)).alias("geo_score"))
    places = x.join(status, "doc_id").select(F.col("doc_id").alias("item"), event(), F.concat_ws(" ", "provider", "doc_id").alias("title"), "provider", "published_at", "geo_status", "geo_score")
    v = t15_divergences(spark, d).withColumn("status", F.when((F.col("id") + F.col("id2")) % 3 == 0, "resolved").otherwise("unresolved"))
    if first:
        places, v = places.where("item % 2 = 0"), v.where("id % 2 = 0")
    return reviews.propose_reviews(places, v.withColumn("id", F.concat_ws("-", "id", "id2")))


def taken(spark, d):
    """Two actions a document at most: one of every third, some with a status that is none, and a later one of every sixth."""
    x = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("key"), "doc_id")
    x = x.withColumn("n", F.explode(F.when(F.col("doc_id") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    status = F.when(F.col("n") == 1, "accepted").otherwise(F.element_at(F.array(*map(F.lit, (*reviews.ACTIONS, "bogus"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return x.select(
        (F.col("doc_id") * 2 + F.col("n")).alias("action_id"), F.lit("semantic_item").alias("kind"), "key", F.lit("weak_location_support").alias("reason"), status.alias("status"),
        F.concat(F.lit(" r"), "n").alias("reviewer"), F.when(F.col("n") == 0, " ").otherwise("seen").alias("note"), (F.lit(ACTED).cast("timestamp") + F.col("n") * F.expr("interval 1 hour")).alias("at"),
    )


def queue_first(spark, d):
    return reviews.merge_reviews(None, proposals(spark, d, True), F.lit(FIRST).cast("timestamp"))


def queue_second(spark, d):
    return reviews.merge_reviews(reviews.apply_reviews(queue_first(spark, d), taken(spark, d)), proposals(spark, d, False), F.lit(SECOND).cast("timestamp"))


DIVERGE = f"c AS (SELECT doc_id AS id, {EVENT_SQL} AS event_id, 'n' || (doc_id % 2) AS type, n_chars % 7 AS value, source AS provider, {PUB} AS published_at FROM documents), v AS (SELECT a.event_id, a.type, a.id, b.id AS id2, a.value, b.value AS value2 FROM c a JOIN c b USING (event_id, type) WHERE a.id < b.id AND a.value <> b.value AND a.provider <> b.provider AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 172800000000 AND (a.id + b.id) % 3 <> 0)"
QUEUE_SQL = f"""{GEO}, g AS (SELECT doc_id, geo_status, {GEO_SCORE} AS geo_score FROM (SELECT doc_id, {GEO_STATUS} AS geo_status FROM k)), {DIVERGE},
 p AS (SELECT 'semantic_item' AS kind, doc_id::VARCHAR AS key, CASE geo_status WHEN 'none' THEN 'weak_location_support' WHEN 'other_known_place' THEN 'location_mismatch' ELSE geo_status END AS reason, {EVENT_SQL} AS event_id, CASE geo_status WHEN 'none' THEN 'low' WHEN 'other_known_place' THEN 'medium' ELSE 'high' END AS severity, source || ' ' || doc_id AS title, geo_score, doc_id % 2 = 0 AS early FROM documents JOIN g USING (doc_id) WHERE geo_status IN ('none', 'other_known_place', 'foreign_location_signal')
  UNION ALL SELECT 'divergence', id || '-' || id2, 'numeric_claim_divergence', event_id, 'medium', 'Numeric claim divergence: ' || type, NULL, id % 2 = 0 FROM v),
 a AS (SELECT doc_id * 2 + n AS action_id, doc_id::VARCHAR AS key, CASE WHEN n = 1 THEN 'accepted' ELSE ['accepted', 'rejected', 'needs_more_evidence', 'bogus'][doc_id % 4 + 1] END AS status, 'r' || n AS reviewer, CASE WHEN n = 1 THEN 'seen' END AS note, TIMESTAMP '{ACTED}' + n * INTERVAL 1 HOUR AS acted_at FROM documents, unnest([0, 1]) u(n) WHERE doc_id % 3 = 0 AND (n = 0 OR doc_id % 6 = 0)),
 ok AS (SELECT a.*, row_number() OVER (PARTITION BY a.key ORDER BY acted_at, action_id) AS step FROM a JOIN p ON p.key = a.key AND p.reason = 'weak_location_support' AND early WHERE a.status <> 'bogus'),
 la AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC) = 1),
 q1 AS (SELECT p.kind, p.key, p.reason, event_id, severity, title, geo_score + 1 AS geo_score, coalesce(la.status, 'pending') AS status, reviewer, note, la.acted_at AS reviewed_at, TIMESTAMP '{FIRST}' AS created_at, coalesce(la.acted_at, TIMESTAMP '{FIRST}') AS updated_at FROM p LEFT JOIN la ON la.key = p.key AND p.reason = 'weak_location_support' WHERE early),
 q2 AS (SELECT p.kind, p.key, p.reason, event_id, severity, title, CASE WHEN la.key IS NULL THEN geo_score ELSE geo_score + 1 END AS geo_score, coalesce(la.status, 'pending') AS status, reviewer, note, la.acted_at AS reviewed_at, CASE WHEN early THEN TIMESTAMP '{FIRST}' ELSE TIMESTAMP '{SECOND}' END AS created_at, coalesce(la.acted_at, TIMESTAMP '{SECOND}') AS updated_at FROM p LEFT JOIN la ON la.key = p.key AND p.reason = 'weak_location_support')"""


def shown(queue):
    return queue.withColumn("geo_score", F.get_json_object("context", "$.geo_score").cast("int")).drop("context")


@query(f"WITH {QUEUE_SQL} SELECT * FROM q1")
def t18_apply_reviews(spark, d):
    return shown(reviews.apply_reviews(queue_first(spark, d), taken(spark, d)))


@query(f"WITH {QUEUE_SQL} SELECT * FROM q2")
def t18_merge_reviews(spark, d):
    return shown(queue_second(spark, d))


@query(f"WITH {QUEUE_SQL} SELECT key, action_id, acted_at, step::INT AS step, coalesce(lag(status) OVER (PARTITION BY key ORDER BY step), 'pending') AS before, status AS after, NULL AS error FROM ok UNION ALL SELECT NULL, action_id, NULL, NULL, NULL, NULL, CASE WHEN status = 'bogus' THEN 'invalid_status' ELSE 'review_not_found' END FROM a WHERE action_id NOT IN (SELECT action_id FROM ok)")
def t18_review_history(spark, d):
    """Every action: those taken with what they changed, the others with what was wrong."""
    queue, actions = queue_first(spark, d), taken(spark, d)
    done = reviews.review_history(queue, actions).drop("kind", "reason").withColumnRenamed("at", "acted_at")
    return done.unionByName(reviews.refused_actions(queue, actions), allowMissingColumns=True)


@query(f"WITH {QUEUE_SQL} SELECT kind, key, reason, event_id, severity FROM q2 WHERE status = 'pending' ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, created_at, kind, key, reason LIMIT 20")
def t18_pending_reviews(spark, d):
    return reviews.pending_reviews(queue_second(spark, d)).select("kind", "key", "reason", "event_id", "severity")


@query(f"""WITH {QUEUE_SQL}, s AS (SELECT {EVENT_SQL} AS event_id, ['claim', 'entity', 'event_link'][doc_id % 3 + 1] AS kind, doc_id % 4 = 0 AS independent, la.key IS NOT NULL AS reviewed, 'v' || (doc_id % 2) AS version FROM documents LEFT JOIN la ON la.key = doc_id::VARCHAR),
 n AS (SELECT event_id, string_agg(version || ':' || n, ',' ORDER BY version) AS versions FROM (SELECT event_id, version, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1), o AS (SELECT event_id, count(*) AS pending, count(*) FILTER (severity = 'high') AS high_priority FROM q2 WHERE status = 'pending' GROUP BY 1)
 SELECT event_id, count(*) AS statements, count(*) FILTER (kind = 'claim') AS claims, count(*) FILTER (kind = 'entity') AS entities, count(*) FILTER (kind = 'event_link') AS event_links, count(*) FILTER (independent) AS independent, count(*) FILTER (reviewed) AS reviewed, coalesce(any_value(pending), 0) AS pending, coalesce(any_value(high_priority), 0) AS high_priority, any_value(versions) AS versions FROM s LEFT JOIN n USING (event_id) LEFT JOIN o USING (event_id) GROUP BY 1""")
def t21_review_summary(spark, d):
    queue = queue_second(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("claim", "entity", "event_link"))), (F.col("doc_id") % 3 + 1).cast("int"))
    statements = table(spark, d, "documents").select(event(), kind.alias("kind"), F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("item"), (F.col("doc_id") % 4 == 0).alias("independent"), F.concat(F.lit("v"), F.col("doc_id") % 2).alias("version"))
    out = reviews.review_summary(reviews.reviewed_statements(statements, queue), queue)
    return out.withColumn("versions", F.array_join(F.transform("versions", lambda v: F.concat_ws(":", v["version"], v["statements"])), ","))
