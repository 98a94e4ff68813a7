"""Review of evidence, its feed and graph, region names and places of texts, against literal cases and plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from emberline.operators import documents, names, reviews
from emberline.sources import files

T = [datetime.datetime(2024, 6, d) for d in range(1, 9)]
PLACES = "item long, event_id string, title string, provider string, published_at timestamp, geo_status string, geo_score int"
DIVERGENCES = "id long, event_id string, type string, value double, value2 double, status string"
ACTIONS = "action_id long, kind string, key string, reason string, status string, reviewer string, note string, at timestamp"


def queue_of(df):
    return {(r.kind, r.key): r for r in df.collect()}


def test_reviews_merge_only_while_pending(spark):
    at = lambda i: F.lit(T[i])
    none = spark.createDataFrame([], DIVERGENCES)
    places = lambda rows: reviews.propose_reviews(spark.createDataFrame(rows, PLACES), none)
    first = places([(1, "a", "t" * 300, "p", None, "none", None), (1, "a", "u", "p", None, "none", 5), (2, "a", None, None, None, "other_known_place", 10), (3, "b", "x", "p", None, "foreign_location_signal", 0), (4, "b", "x", "p", None, "region", 90), (5, None, "x", "p", None, None, None)])
    queue = reviews.merge_reviews(None, first, at(0)).cache()
    got = queue_of(queue)
    assert {k[1]: (r.reason, r.severity, r.status) for k, r in got.items()} == {"1": ("weak_location_support", "low", "pending"), "2": ("location_mismatch", "medium", "pending"), "3": ("foreign_location_signal", "high", "pending")}
    assert len(got["semantic_item", "1"].title) == 240
    item = lambda n, key, status, day, who="r", note=None, reason="location_mismatch": (n, "semantic_item", key, reason, status, who, note, T[day])
    actions = spark.createDataFrame([item(1, "2", "rejected", 2), item(2, "2", "accepted", 2, "  ", " n "), item(3, "2", "undone", 3), item(4, "9", "accepted", 2), item(5, "2", None, 3), item(0, "2", "needs_more_evidence", 1)], ACTIONS)
    acted = reviews.apply_reviews(queue, actions).cache()
    r = queue_of(acted)["semantic_item", "2"]
    assert (r.status, r.reviewer, r.note, r.reviewed_at, r.created_at, r.updated_at) == ("accepted", None, "n", T[2], T[0], T[2])
    assert {x.action_id: x.error for x in reviews.refused_actions(queue, actions).collect()} == {3: "invalid_status", 5: "invalid_status", 4: "review_not_found"}
    assert [(x.action_id, x.before, x.after) for x in reviews.review_history(queue, actions).orderBy("step").collect()] == [(0, "pending", "needs_more_evidence"), (1, "needs_more_evidence", "rejected"), (2, "rejected", "accepted")]
    later = queue_of(reviews.merge_reviews(acted, places([(1, "z", "new", "q", None, "none", 7), (2, "z", "new", "q", None, "other_known_place", 7), (6, "z", "new", "q", None, "none", 7)]), at(4)))
    assert (later["semantic_item", "1"].event_id, later["semantic_item", "1"].updated_at, '"geo_score":7' in later["semantic_item", "1"].context) == ("a", T[4], True)
    assert later["semantic_item", "2"] == r and later["semantic_item", "6"].created_at == T[4] and later["semantic_item", "3"].updated_at == T[0]
    assert [x.key for x in reviews.pending_reviews(acted).collect()] == ["3", "1"] and [x.key for x in reviews.pending_reviews(acted, 0).collect()] == ["3"] and [x.key for x in reviews.pending_reviews(acted, event="a").collect()] == ["1"]
    statements = spark.createDataFrame([("a", "claim", "c1", "2", True, "v1"), ("a", "entity", "2", None, None, "v2"), ("c", "event_link", "l", "3", False, None)], "event_id string, kind string, key string, item string, independent boolean, version string")
    seen = reviews.reviewed_statements(statements, acted)
    assert {x.key: x.review_status for x in seen.collect()} == {"c1": "accepted", "2": "unreviewed", "l": "unreviewed"}
    s = {x.event_id: x for x in reviews.review_summary(seen, acted).collect()}
    assert (s["a"].statements, s["a"].independent, s["a"].reviewed, s["a"].pending, s["a"].high_priority) == (2, 1, 1, 1, 0)
    assert (s["b"].statements, s["b"].pending, s["b"].high_priority) == (0, 1, 1) and s["c"].event_links == 1
    assert reviews.apply_reviews(queue, spark.createDataFrame([], ACTIONS)).count() == 3


def test_reviews_equal_a_plain_loop(spark):
    rng, queue, known = random.Random(4), None, {}
    for turn in range(2):
        rows = [(i, f"e{i % 3}", f"t{turn}", "p", None, "none", rng.randrange(90)) for i in rng.sample(range(40), 25)]
        for i, e, _, _, _, _, score in rows:
            old = known.setdefault(str(i), {"event": e, "status": "pending"})
            if old["status"] == "pending":
                old["score"] = score
        fresh = reviews.propose_reviews(spark.createDataFrame(rows, PLACES), spark.createDataFrame([], DIVERGENCES))
        queue = reviews.merge_reviews(queue, fresh, F.lit(T[turn]))
        acts = [(n, "semantic_item", str(rng.randrange(50)), "weak_location_support", rng.choice([*reviews.ACTIONS, "x"]), "r", None, T[rng.randrange(3)]) for n in range(30)]
        for a in sorted(acts, key=lambda a: (a[7], a[0])):
            if a[2] in known and a[4] != "x":
                known[a[2]]["status"] = a[4]
        queue = reviews.apply_reviews(queue, spark.createDataFrame(acts, ACTIONS))
    got = queue.select("key", "event_id", "status", F.get_json_object("context", "$.geo_score").cast("int").alias("score")).collect()
    assert {r.key: (r.event_id, r.status, r.score) for r in got} == {k: (v["event"], v["status"], v["score"]) for k, v in known.items()} and len(got) == len(known)


def test_admin_names(spark):
    regions = spark.createDataFrame([(1, "Київ", "Kyiv City", "Kyiv", True), (2, "Київська", "Kyivska", "Kyivska", False), (3, "Миколаївська", None, "Mykolaivska", False), (4, None, None, "Lvivska", False), (5, None, None, "Lvivskaya", False), (6, "", "", "", None)], "region_id long, local_name string, name string, english_name string, is_city boolean")
    asked = [(1, "м. Київ", None), (2, "Київська область", None), (3, "Миколаївська область", None), (4, None, "Mykolaiv Oblast"), (5, None, "Lviv oblast"), (6, None, "Lvivska oblast"), (7, "", ""), (8, None, None), (9, "м.Львів", None), (10, " kyivska ", None)]
    got = {r.id: (r.region_id, r.how) for r in names.map_admin_names(spark.createDataFrame(asked, "id long, local_name string, english_name string"), regions).collect()}
    assert got == {1: (1, "city"), 2: (2, "name"), 3: (3, "name"), 4: (3, "stem"), 5: (None, "none"), 6: (4, "name"), 7: (None, "none"), 8: (None, "none"), 9: (None, "none"), 10: (2, "name")}


def test_places_of_texts(spark):
    docs = spark.createDataFrame([(1, 1, "У Полтавській громаді"), (1, 2, "У Полтавській громаді"), (2, 1, "near Hadyachka, polt"), (3, 1, "Lubny!"), (4, 1, "kremen and Land"), (5, 1, "land of far"), (6, 1, "far"), (7, 1, None), (8, None, "kremen"), (9, 2, "Lubny")], "doc_id long, event_id long, text string")
    contexts = spark.createDataFrame([(1, "Hadyach", "Полтавська область"), (1, None, "Poltavska"), (2, "abc", "")], "event_id long, place string, region string")
    places = spark.createDataFrame([(1, "Lubny"), (1, "Hadyach"), (None, "Kremen"), (None, "abc"), (None, None)], "event_id long, name string")
    got = {(r.doc_id, r.event_id): (r.geo_status, r.geo_score) for r in names.geo_status(docs, contexts, places, " land ", " far ").collect()}
    assert got == {
        (1, 1): ("region", 90), (1, 2): ("none", 0), (2, 1): ("nearest_place", 100), (3, 1): ("local_reference", 85), (4, 1): ("other_known_place", 10), (5, 1): ("country_only", 35),
        (6, 1): ("foreign_location_signal", 0), (7, 1): ("none", 0), (8, None): ("other_known_place", 10), (9, 2): ("none", 0),
    }


def test_feed_and_graph(spark):
    events = spark.createDataFrame([("a", T[3])], "event_id string, last_seen timestamp")
    links = spark.createDataFrame([("a", 1, 70, T[0], 5.0, 6.0), ("a", 2, None, None, None, None)], "event_id string, item_id long, score int, observed_at timestamp, distance_m double, delta_s double")
    posts = spark.createDataFrame([("a", i, 70, T[i % 8], c) for i, c in ((3, None), (4, "geo_rejected"), (5, "news"), (6, None))], "event_id string, item_id long, score int, observed_at timestamp, category string")
    statuses = spark.createDataFrame([("a", 6, "other_known_place"), ("a", 5, "region"), ("b", 3, "foreign_location_signal")], "event_id string, item_id long, geo_status string")
    legacy = spark.createDataFrame([("a", 7, c, T[i], None, 2.0) for i, c in enumerate(("high", "medium", "what", None))], "event_id string, item_id long, correlation_class string, observed_at timestamp, distance_m double, delta_min double")
    rows = documents.evidence_feed(events, links, posts, statuses, legacy).orderBy("rank").collect()
    assert [(r.channel[0], r.item_id, r.score) for r in rows] == [("l", 7, 80), ("p", 5, 70), ("p", 3, 70), ("f", 1, 70), ("l", 7, 60), ("l", 7, 40), ("l", 7, 30), ("f", 2, None)]
    assert rows[2].delta_s == 0.0 and rows[0].delta_s == 120.0
    items = spark.createDataFrame([("a", i, f"t{i}", f"p{i % 2}", T[i % 8]) for i in range(8)] + [("b", 9, None, None, None)], "event_id string, item_id long, title string, provider string, published_at timestamp")
    mentions = spark.createDataFrame([(i, "k", f"m{j}") for i in range(8) for j in range(i + 1)], "item_id long, kind string, canonical string")
    claims, clusters = spark.createDataFrame([(7, "n", 1.5)], "item_id long, type string, value double"), spark.createDataFrame([(7, 1), (6, 1), (0, 2)], "item_id long, cluster_id long")
    nodes, edges = documents.event_graph(items, mentions, claims, clusters, k=3)
    got = sorted((r.event_id, r.type, r.label or "") for r in nodes.collect())
    assert [x for x in got if x[0] == "b"] == [("b", "document", ""), ("b", "event", "b")]
    assert [x[2] for x in got if x[0] == "a" and x[1] == "document"] == ["t5", "t6", "t7"] and ("a", "cluster", "cluster (2)") in got and sum(x[1] == "entity" for x in got) == 3
    assert {r.relation: r["count"] for r in edges.groupBy("relation").count().collect()} == {"linked_to": 4, "member_of": 2, "mentions": 6 + 7 + 8, "asserts": 1}


def test_csv_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', None), (2, "é", "x")], "id long, t string, u string")
    files.write_csv(df.coalesce(1), str(tmp_path / "c"), mark=True)
    (part,) = (tmp_path / "c").glob("*.csv")
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,t,u\n") and "2,é,x".encode() in raw and b'"a ""b"", c\nd"' in raw
