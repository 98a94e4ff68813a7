"""What a step holds, sends or writes as its input grows, beside its results."""

import datetime
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.functions import similarity
from emberline.operators import documents, enrich, grid, resolve
from emberline.plans import objects, shapes as shape_plans, texts
from emberline.plans.base import ORACLE_SQL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_in_cells_are_not_gathered_on_the_driver(spark):
    """the copies of a small table were broadcast, whatever their number."""
    a = spark.range(20).select(F.col("id").alias("i"), (F.col("id") / 10).alias("lat"), F.lit(22.0).alias("lon"))
    b = a.select(F.col("i").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = grid.dwithin_join(a, b, 12_000)
    assert "Broadcast" not in plan(pairs)
    assert sorted((r.i, r.j) for r in pairs.collect()) == [(i, j) for i in range(20) for j in range(20) if abs(i - j) <= 1]


def test_trigrams_of_a_text_are_found_once(spark, tmp_path):
    """they were found for both pairs that a text is in, from the text itself."""
    rows = [(0, "Fire at the plant"), (1, "fire, at the PLANTS"), (2, None), (3, "  "), (4, "\U00010400x plant"), (6, "plant")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = texts.t4_trgm_similarity_texts(spark, str(tmp_path))
    assert "regexp_replace" not in plan(out)
    tri = lambda t: {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for i in range(len(w) + 1)}
    sets = {i: tri(t) for i, t in rows}
    expected = {i: round(len(sets[i] & sets[i + 1]) / (len(sets[i] | sets[i + 1]) or 1), 6) for i in sets if i + 1 in sets}
    assert {r.doc_id: r.similarity for r in out.collect()} == expected
    pair = spark.createDataFrame([(rows[0][1], rows[1][1])], "a string, b string").select(F.round(similarity.trgm_similarity(F.col("a"), F.col("b")), 6)).first()
    assert pair[0] == expected[0]


def test_history_counts_events_that_stray_and_those_that_do_not(spark):
    """events of a day are one row if they keep together; the rest are met one by one. Both count once."""
    rng, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = []
    for e in range(60):
        stretch = 0.3 if e % 10 == 0 else 0.004  # every tenth strays
        rows += [(f"e{e}", start + datetime.timedelta(hours=rng.randrange(240)), 45 + 0.05 * rng.random() + stretch * rng.random(), 22 + 0.3 * rng.random() + stretch * rng.random()) for _ in range(40)]
    det = spark.createDataFrame(rows, "event_id string, acq timestamp_ntz, lat double, lon double")
    e = det.groupBy("event_id").agg(F.min_by("lat", "acq").alias("latest_lat"), F.min_by("lon", "acq").alias("latest_lon"), F.lit(start + datetime.timedelta(hours=200)).cast("timestamp_ntz").alias("first_seen"))
    plain = grid.dwithin_join(det.withColumnRenamed("event_id", "other"), e, 12_000, lat_b="latest_lat", lon_b="latest_lon", extra=(F.col("other") != F.col("event_id")) & (F.col("acq") < F.col("first_seen")))
    expected = plain.groupBy("event_id", F.to_date("acq").alias("day")).agg(F.count_distinct("other").alias("n")).collect()
    archive = det.limit(0).select(F.to_date("acq").alias("day"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    live = enrich._live_days(e, det, 12_000).select("event_id", "day", "n").collect()
    assert {(r.event_id, r.day): r.n for r in live} == {(r.event_id, r.day): r.n for r in expected}
    out = enrich.history(e, det, archive, 12_000).collect()
    assert {r.event_id: r.events_365d for r in out} == {f"e{i}": sum(r.n for r in expected if r.event_id == f"e{i}") for i in range(60)}


def moved(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_clusters_move_sets_not_trigrams(spark):
    """each trigram of each set was a row, in several shuffles, and each pair that met anew in every rare trigram."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.sample(vocabulary, 60)), i * 40) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m int").select("doc_id", "text", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m)").alias("published_at"))
    before = moved(spark)
    assert {r.doc_id: r.cluster_id for r in documents.cluster_documents(docs).collect()} == {i: i for i in range(200)}
    assert moved(spark) - before < 40 * len(rows)


@pytest.mark.parametrize("part, windows", [(1, 4), (4_000, 1), (20_000, 2)])
def test_parts_of_a_dense_block_lose_no_pair(spark, monkeypatch, part, windows):
    """blocks that one task could not hold are cut by size of set; times reach over slots and lie on both sides of 1970."""
    monkeypatch.setattr(documents, "PART", part)
    monkeypatch.setattr(documents, "WINDOWS", windows)
    rng = random.Random(part)
    bases = [["".join(rng.choice("abcdeé\U00010400") for _ in range(5)) for _ in range(rng.randrange(3, 60))] for _ in range(8)]
    rows = []
    for i in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(rng.choice(bases))
        rows.append((i * 31 % 97, " ".join(words), rng.choice((rng.randrange(6), rng.randrange(-400, 400)))))
    grams = lambda t: {f"  {w} "[k : k + 3] for w in t.split() for k in range(len(w) + 1)}
    sets = {i: (grams(t), h) for i, t, h in rows}
    alike = lambda i, j: len(sets[i][0] & sets[j][0]) / len(sets[i][0] | sets[j][0])
    near = {(i, j): alike(i, j) for i in sets for j in sets if i < j and abs(sets[i][1] - sets[j][1]) <= 72}
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int").select("doc_id", "text", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, h)").alias("published_at"))
    found = documents.similar_documents(docs).collect()
    assert len(found) == len({(r.doc_id, r.other) for r in found})
    assert {(r.doc_id, r.other): r.similarity for r in found} == {k: v for k, v in near.items() if v >= 0.72}
    clusters, heads = {}, []
    for i in sorted(sets, key=lambda i: (sets[i][1], i)):
        best = max(((alike(i, j), -j) for j in heads if sets[i][1] - sets[j][1] <= 72 and alike(i, j) >= 0.72), default=None)
        clusters[i] = i if best is None else -best[1]
        heads += [i] if best is None else []
    assert {r.doc_id: r.cluster_id for r in documents.cluster_documents(docs).collect()} == clusters


def test_normalised_texts_are_whole(spark, tmp_path):
    """F8: all beyond the first 12 000 characters was lost."""
    long = "Fire  at https://a.b/c the PLANT! " * 2_000
    rows = [(0, long), (1, "x" * 30_000), (2, "\uff21" * 13_000), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r.text for r in texts.t1_norm_text(spark, str(tmp_path)).collect()}
    assert out == {0: ("fire at the plant! " * 2_000).strip(), 1: "x" * 30_000, 2: "a" * 13_000, 3: None, 4: ""}


def test_sites_that_share_a_place_are_resolved_apart(spark, tmp_path):
    """sites 80 000 apart lie on one place; their like-named records were taken for one object."""
    sites = [s + 80_000 * k for s in range(30) for k in range(3)]
    spark.createDataFrame([(s,) for s in sites if s % 4], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(5 * s + k,) for s in sites for k in range(5)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = objects.p20_resolve_entities(spark, str(tmp_path))
    duck = duckdb.connect()
    for name in ("supplier", "customer"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cur = duck.execute(ORACLE_SQL["p20_resolve_entities"])
    assert sorted(map(tuple, got.select(*[c[0] for c in cur.description]).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("within, expected", [(None, [1, 1, 3, 3, 3]), ("search", [1, 2, 3, 4, 3])])
def test_records_of_other_searches_do_not_meet(spark, within, expected):
    """neither by place nor by exact id, if the column is named."""
    rows = [(1, "map", "Alpha Bakery", 49.0, None, 1), (2, "open", "Alpha Bakery", 49.0, None, 2), (3, "authority", "One", 50.0, "Q1", None), (4, "map", "Other", 51.0, "Q1", 3), (5, "open", "Third", 52.0, "Q1", None)]
    df = spark.createDataFrame(rows, "id long, source string, name string, lat double, exact_id string, search int").selectExpr("*", "'shop' AS category", "31D AS lon", "cast(if(source = 'authority', 3, 5 - id) AS int) AS rank", "0D AS distance_m")
    assert [r.entity_id for r in resolve.resolve_entities(df, within=within).orderBy("id").collect()] == expected


def test_the_first_of_equal_records_gives_the_value(spark, tmp_path):
    """of equal confidence and source the greatest value was taken, SQL (one thread) takes the first row."""
    rows = [(i, "2024-01-01 00:00:00", i % 37, ("click", "view")[i // 80 % 2], float(i // 160 % 2)) for i in range(700)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = {r[0]: r[2] for r in duck.execute(ORACLE_SQL["p23_merge_profiles"]).fetchall()}
    assert {r.entity_id: r.value for r in objects.p23_merge_profiles(spark, str(tmp_path)).collect()} == expected


def test_links_move_no_pairs(spark):
    """every pair of a document and an event within reach or of a name went through several shuffles; the best of each stay."""
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    places, regions = ["alpha", "bravo", "al", "delta", None], ["north", "south", "alpha", None]
    hours = lambda n: start + datetime.timedelta(hours=rng.randrange(n))
    events = [(f"e{i}", hours(60), 50 + rng.random(), 30 + rng.random(), rng.choice(places), rng.choice(regions)) for i in range(1500)]
    docs = [(i, rng.choice(["quake", "alert", "other"]), hours(150), *((50 + rng.random(), 30 + rng.random()) if i % 3 else (None, None)), " ".join(rng.sample(["Alpha", "bravo", "al", "delta", "NORTH", "south", "x"], rng.randrange(5)))) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, rule string, published_at timestamp_ntz, lat double, lon double, text string")
    e = spark.createDataFrame(events, "event_id string, last_seen timestamp_ntz, latest_lat double, latest_lon double, place string, region string")
    before = moved(spark)
    got = {(r.doc_id, r.rank): (r.event_id, r.place_score, r.time_score, r.text_score, r.score) for r in documents.link_documents(d, e).collect()}
    assert moved(spark) - before < 200 * len(events)  # copies of events in cells and slots for the most part
    step = lambda steps, v: next((n for most, n in steps if v <= most), 0)
    radians, expected, pairs = math.radians, {}, 0
    for doc, rule, at, lat, lon, text in docs:
        r, found = documents.LINK_RULES[rule], []
        for event, seen, y, x, place, region in events:
            gap = abs((at - seen).total_seconds())
            names = {n for n in (place, region) if n and len(n) > 2 and n in text.lower()}
            words = min(50, 35 * (place in names) + 20 * (region in names))
            metres = 0 if lat is None else 2 * 6371000 * math.asin(math.sqrt(math.sin(radians(y - lat) / 2) ** 2 + math.cos(radians(lat)) * math.cos(radians(y)) * math.sin(radians(x - lon) / 2) ** 2))
            near, soon = 0 if lat is None else step(r["place"], metres), step(r["time"], gap)
            if gap <= r["most_s"] and ((words >= 20 and soon >= 10) if lat is None else (metres <= r["most_m"] and near + soon >= r["least"])):
                found.append((-min(100, near + soon + words), gap, event, near, soon, words))
        pairs += len(found)
        for k, (score, _, event, near, soon, words) in enumerate(sorted(found)[: r["k"]]):
            expected[doc, k + 1] = (event, near, soon, words, -score)
    assert got == expected and pairs > 10 * len(expected) > 50_000
    with pytest.raises(ValueError):
        documents.link_documents(d, e, {"other": documents.LINK_RULES["other"] | {"time": ((60, 5), (120, 10))}})


def test_pairs_are_not_ordered_to_find_the_nearest(spark, monkeypatch):
    """all pairs of the circle that holds a row's nearest were sorted, on disk where they are many."""
    rng, ordered, nearest = random.Random(9), [], grid.nearest
    monkeypatch.setattr(grid, "nearest", lambda pairs, *a, **k: ordered.append(pairs.count()) or nearest(pairs, *a, **k))
    place = lambda: (49 + 0.1 * rng.random(), 31 + 0.1 * rng.random())
    spots = [place() for _ in range(100)]
    a = [(i, *(place() if i else (10.0, 10.0))) for i in range(150)]
    b = [(j, *rng.choice(spots), rng.randrange(3)) for j in range(300)]  # several on a spot
    got = grid.nearest_within(spark.createDataFrame(a, "i long, lat double, lon double"), spark.createDataFrame(b, "j long, lat2 double, lon2 double, v int"), "i", 80_000, ["v", F.desc("j")], extra=F.col("j") % 3 != F.col("i") % 3).collect()
    metres = lambda p, q: 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2))
    expected = {i: min((round(metres(at, to)), v, -j) for j, *to, v in b if j % 3 != i % 3) for i, *at in a if i}
    assert {r.i: (round(r.distance_m), r.v, -r.j) for r in got} == expected
    assert len(got) == len(expected) and sum(ordered) < 5 * len(a)


@pytest.mark.parametrize("tile, points, sectors", [(1.0, 500_000, 4_000), (0.3, 40, 7)])
def test_points_in_sectors_are_counted_without_pairs(spark, monkeypatch, tile, points, sectors):
    """each point in each sector was a row; places on edges and corners, and an event's own, count as they did."""
    monkeypatch.setattr(enrich, "TILE", tile)
    monkeypatch.setattr(enrich, "POINTS", points)
    monkeypatch.setattr(enrich, "SECTORS", sectors)
    rng = random.Random(7)
    rows = [(f"e{i % 40}", 48 + rng.randrange(200) / 100, 30 + rng.randrange(300) / 100) for i in range(3000)] + [("e1", None, 30.0)]
    ring = lambda *p: [[(float(x), float(y)) for x, y in p]]
    shapes = [(f"e{i}", ring((x, y), (x + 1, y + 0.5), (x + 1.25, y), (x + 1, y - 0.5), (x, y))) for i in range(30) for x, y in [(30 + rng.randrange(200) / 100, 48 + rng.randrange(200) / 100)]]
    shapes += [("e50", ring((30, 48), (31, 48), (31, 49), (30, 49), (30, 48))), ("e51", ring((5, 5), (6, 5), (6, 6), (5, 5)))]
    det = spark.createDataFrame(rows, "event_id string, lat double, lon double")
    s = spark.createDataFrame(shapes, "event_id string, rings array<array<struct<lon double, lat double>>>")
    pairs = enrich.in_sectors(det.withColumnRenamed("event_id", "own"), s).where("own <> event_id").groupBy("event_id").count().collect()
    monkeypatch.setattr(enrich, "in_sectors", None)
    got = {r.event_id: r.n for r in enrich.count_in_sectors(det, s).collect()}
    assert got == {r[0]: r[1] for r in pairs} and got["e50"] > 500 and "e51" not in got
    assert shape_plans.d11_plume_sectors(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("area, many, few, cells", [(0.5, 200_000, 2_000, 4_000_000), (0.07, 50, 3, 1_000)])
def test_history_makes_no_pairs(spark, monkeypatch, area, many, few, cells):
    """each day of an event met each event in reach as a row; across 180 degrees and by the poles they meet as before."""
    rng, start = random.Random(4), datetime.datetime(2024, 1, 1)
    spots = [(50.0, 30.0), (0.0, 179.99), (0.0, -179.99), (89.95, 10.0), (89.95, -170.0), (-60.0, 0.0)]
    rows = []
    for i in range(900):
        y, x = spots[rng.randrange(6)]
        rows.append((f"e{rng.randrange(60)}", start + datetime.timedelta(hours=rng.randrange(120)), y + rng.randrange(10) / 250, (x + rng.randrange(10) / 250 + 180) % 360 - 180))
    rows += [("e1", None, 50.0, 30.0), (None, start, 50.0, 30.0), ("e2", start, None, 30.0)]
    ends = [(f"e{i}", *spots[i % 6], start + datetime.timedelta(hours=rng.randrange(130))) for i in range(60)] + [("far", 10.0, 10.0, start), ("none", None, None, start), ("always", 50.0, 30.0, None)]
    det = spark.createDataFrame(rows, "event_id string, acq timestamp_ntz, lat double, lon double")
    e = spark.createDataFrame(ends, "event_id string, latest_lat double, latest_lon double, first_seen timestamp_ntz")
    archive = det.where("acq is not null and lat is not null").select(F.to_date("acq").alias("day"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    metres = lambda p, q: 2 * 6371000 * math.asin(min(1, math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2)))
    expected = {}
    for name, y, x, first in ends:
        others, old = {}, {}
        for other, at, *p in rows:
            if None not in (y, first, at, p[0]) and (m := metres((y, x), p)) <= 12_200:
                if at < first and other not in (None, name) and m <= 12_000:
                    others.setdefault(at.date(), set()).add(other)
                if at.date() < first.date():
                    old[at.date()] = old.get(at.date(), 0) + 1
        days = {k: max(len(others.get(k, ())), old.get(k, 0)) for k in others.keys() | old.keys()}
        expected[name] = (sum(days.values()), len(days))
    for name, value in (("AREA", area), ("MANY", many), ("FEW", few), ("CELLS", cells), ("dwithin_join", None)):
        monkeypatch.setattr(enrich, name, value)
    got = {r.event_id: (r.events_365d, r.days_365d) for r in enrich.history(e, det, archive, 12_000).collect()}
    assert got == expected and max(expected.values())[0] > 300


def test_coarse_cells_lose_no_pair_and_copy_less(spark):
    """each record went to fifteen cells in every round, though a site holds six."""
    rng = random.Random(13)
    spots = [(50.0, 30.0), (0.0, 179.999), (0.0, -179.999), (-60.0, 0.0), (85.0, 10.0)]
    rows = [(i, rng.randrange(3), y + rng.randrange(-20, 20) / 5_000, (x + rng.randrange(-20, 20) / 5_000 + 180) % 360 - 180) for i in range(400) for y, x in [rng.choice(spots)]]
    a = spark.createDataFrame(rows, "i long, g int, lat double, lon double")
    b = a.select(F.col("i").alias("j"), "g", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    metres = lambda p, q: 2 * 6371000 * math.asin(min(1, math.sqrt(math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2)))
    expected = sorted((i, j) for i, g, *p in rows for j, h, *q in rows if g == h and metres(p, q) <= 180)
    sent = []
    for coarse in (1, 16):
        before = moved(spark)
        assert sorted((r.i, r.j) for r in grid.dwithin_join(a, b, 180, on=("g",), coarse=coarse).collect()) == expected
        sent.append(moved(spark) - before)
    assert len(expected) > 2 * len(rows) and sent[1] < 4 * len(rows) < sent[0]
