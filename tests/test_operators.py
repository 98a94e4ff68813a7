"""Operators against brute force, and boundary values of their rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import geo, similarity
from emberline.operators import cluster, components, documents, enrich, events, exposure, grid, hull, ingest, objects, quantiles, search
from emberline.sources import files
from emberline.streaming import detections as streaming


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371000.0 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, rng.choice([rng.uniform(-89, 89), rng.uniform(60, 62)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)])) for i in range(250)] + [(250, None, 1.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    for r in (90_000, 400_000):
        got = {(x.id, x.id2) for x in grid.dwithin_join(df, df.toDF("id2", "lat2", "lon2"), r).select("id", "id2").collect()}
        want = {(p[0], q[0]) for p in pts for q in pts if p[1] is not None and q[1] is not None and metres(p[1], p[2], q[1], q[2]) <= r}
        assert got == want


def test_polygon_with_hole(spark):
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    reg = spark.createDataFrame([(1, [ring(34.0, 49.0, 35.0, 50.0), ring(34.4, 49.4, 34.6, 49.6)])], "region_id long, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([(1, 49.2, 34.2), (2, 49.5, 34.5), (3, 49.0, 34.5), (4, 51.0, 34.5)], "id long, lat double, lon double")
    assert {r.id: r.region_id for r in grid.assign_region(pts, reg, "id").collect()} == {1: 1, 2: None, 3: 1, 4: None}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: root(i) for i in up}


@pytest.mark.parametrize("mode", ["core", "strict"])
def test_clustering_equals_one_sequential_fold(spark, mode):
    rng = random.Random(5)
    import datetime

    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(160):
        s = rng.randrange(9)
        acq = t0 + datetime.timedelta(hours=rng.uniform(0, 300))
        rows.append((i, acq, acq + datetime.timedelta(minutes=rng.randrange(3000)), 49 + s * 0.05 + rng.uniform(-0.008, 0.008), 31 + rng.uniform(-0.008, 0.008), rng.choice([375.0, 750.0, 1000.0]), rng.choice([None, 1, 2]) if mode == "core" else s % 2))
    df = spark.createDataFrame(rows, "id long, acq timestamp_ntz, received_at timestamp_ntz, lat double, lon double, radius_m double, region_id long")
    got = {r.id: r.event_id for r in cluster.cluster_events(df, region_mode=mode).collect()}
    ev, want, w = [], {}, datetime.timedelta(hours=24)
    for i, acq, _, lat, lon, rad, reg in sorted(rows, key=lambda r: (r[2], r[0])):
        best = None
        for k, e in enumerate(ev):
            if e["first"] - w <= acq <= e["last"] + w and (reg == e["reg"] or (mode == "core" and (reg is None or e["reg"] is None))):
                d = metres(e["lat"], e["lon"], lat, lon)
                if d <= rad and (best is None or (d, -e["last"].timestamp(), k) < best[:3]):
                    best = (d, -e["last"].timestamp(), k, e)
        if best:
            e = best[3]
            e["first"] = min(e["first"], acq)
            if acq >= e["last"]:
                e.update(last=acq, lat=lat, lon=lon)
        else:
            e = dict(id=f"e{i}", first=acq, last=acq, lat=lat, lon=lon, reg=reg)
            ev.append(e)
        want[i] = e["id"]
    assert got == want


def test_route_equals_plain_loop(spark):
    plan = objects.SpatialPlan("route", route=((34.5, 49.5), (35.0, 49.5), (35.3, 49.8)), corridor_m=3000)
    rng = random.Random(2)
    pts = [(i, rng.uniform(49.4, 49.9), rng.uniform(34.4, 35.4)) for i in range(150)]
    got = {r.id: (r.distance_m, r.segment) for r in objects.within_route(spark.createDataFrame(pts, "id long, lat double, lon double"), plan).collect()}
    want = {}
    for i, lat, lon in pts:
        best = None
        for k, (p, q) in enumerate(zip(plan.route, plan.route[1:])):
            ky = math.radians(1) * 6371000.0
            kx = ky * math.cos(math.radians((lat + p[1] + q[1]) / 3))
            ax, ay, bx, by = (p[0] - lon) * kx, (p[1] - lat) * ky, (q[0] - lon) * kx, (q[1] - lat) * ky
            dx, dy = bx - ax, by - ay
            t = max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            d = round(math.hypot(ax + t * dx, ay + t * dy), 3)
            if best is None or d < best[0]:
                best = (d, k)
        if best[0] <= 3000:
            want[i] = (math.floor(best[0] + 0.5), best[1])
    assert got == want and got
    for bad in ({"mode": "radius", "lat": 0, "lon": 0, "radius_m": 100_000}, {"mode": "nearest", "lat": 0, "lon": 0, "radius_m": 1000, "k": 101}):
        with pytest.raises(ValueError):
            objects.SpatialPlan(**bad)


def test_temporal_profile(spark):
    import datetime

    ref = datetime.datetime(2024, 1, 1, 1, 7)
    items = [("e", ref, "a", "document", datetime.datetime(2024, 1, 1, 0, 30, 18), "seen", "x", None, None), ("e", ref, "a", "document", datetime.datetime(2024, 1, 1, 0, 30, 18), "seen", "x", None, None), ("e", ref, "b", "warning", datetime.datetime(2024, 1, 1, 1, 47), "seen", "y", None, 3600.0), ("e", ref, "b", "warning", None, "seen", "y", None, None)]
    df = spark.createDataFrame(items, "event_id string, reference timestamp_ntz, source string, family string, source_time timestamp_ntz, time_semantics string, label string, ingested_at timestamp_ntz, scale_seconds double")
    lines = enrich.timeline(df)
    assert [(r.offset_seconds, r.relation) for r in lines.orderBy("n").collect()] == [(-2202, "before"), (2400, "after")]
    fam = enrich.family_summary(lines, spark.createDataFrame([("document", 3600.0, 0.5), ("warning", 7200.0, 0.5)], "family string, default_scale double, weight double"))
    assert {r.family: r.proximity for r in fam.collect()} == {"document": 39, "warning": 33}
    assert enrich.consistency(fam).first().level == "partial"


def test_scores_at_their_bounds(spark):
    a = spark.createDataFrame([(None, None), (2.5, 0.3), (2.5, None), (0.5, 0.25), (0.5, None)], "ai double, aod double")
    assert [r[0] for r in a.select(events.atmosphere_level(F.col("ai"), F.col("aod"))).collect()] == ["insufficient", "strong", "elevated", "elevated", "background"]
    c = spark.createDataFrame([("80",), ("79",), ("29",), ("x",)], "c string")
    assert [r[0] for r in c.select(ingest.norm_confidence(F.col("c"), "modis")).collect()] == ["h", "n", "l", "x"]


EXPOSED = "population_1km double, built_fraction_1km_pct double, population_5km double, built_fraction_5km_pct double, total long, buildings long, residential_landuse long, industrial_landuse long, commercial_landuse long, retail_landuse long, forest_landuse long, agricultural_landuse long, amenities long, shops long, offices long, transport long, industrial_objects long, area_km2 double, want string"


def test_exposure(spark):
    rows = [
        (18000.0, 48.0, 180000.0, 34.0, 900, 700, 35, 2, 8, 4, 0, 0, 90, 60, 20, 15, 2, 3.14, "dense_urban"), (180.0, 7.0, 2400.0, 5.0, 150, 90, 1, 14, 1, 0, 0, 0, 2, 0, 1, 4, 18, 12.5, "industrial"),
        (5000.0, 21.0, 42000.0, 18.0, 400, 260, 12, 10, 3, 2, 0, 0, 35, 18, 8, 9, 15, 20.0, "mixed"), (70.0, 1.1, 900.0, 1.6, 8, 5, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 78.0, "rural"),
        (None, None, None, None, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, None, "unknown"), (40.0, 0.8, 500.0, 1.2, 14, 3, 0, 0, 0, 0, 7, 0, 0, 0, 0, 0, 0, 12.566, "forest"), (90.0, 1.3, 900.0, 1.8, 16, 6, 0, 0, 0, 0, 0, 8, 0, 0, 0, 0, 0, 12.566, "agricultural"),
    ]
    df = spark.createDataFrame(rows, EXPOSED)
    got = {r.want: r for r in exposure.exposure(df).collect()}
    assert all(k == r.exposure for k, r in got.items()) and got["dense_urban"].confidence >= 0.7 and got["unknown"].confidence == 0 and got["unknown"].reasons == []
    assert [x["input"] for x in got["industrial"].reasons] == ["built", "people", "building_density", "industrial", "activity"] and got["industrial"].reasons[3]["value"] == 32
    cut = {r.want: r for r in exposure.exposure(df.selectExpr("*", "true truncated", "5 industrial_buildings")).collect()}
    assert (got["rural"].confidence, cut["rural"].confidence) == (0.96, 0.92) and cut["industrial"].reasons[3]["value"] == 37
    bare = exposure.exposure(df.select("population_1km", "want")).collect()
    assert {r.want: r.completeness for r in bare}["dense_urban"] == 0.6 and len(bare) == 7


def test_exposure_classes(spark):
    names = "population_1km population_5km built_fraction_1km_pct built_fraction_5km_pct total buildings residential_landuse industrial_landuse commercial_landuse retail_landuse forest_landuse agricultural_landuse amenities shops offices transport industrial_objects area_km2".split()
    rows = [dict(population_1km=18000.0, built_fraction_1km_pct=50.0, total=500.0, buildings=900.0, residential_landuse=30.0, area_km2=3.0), dict(population_1km=100.0, built_fraction_1km_pct=1.0, total=10.0, forest_landuse=9.0, area_km2=3.0), dict(population_1km=50.0, built_fraction_1km_pct=1.0, total=3.0, area_km2=3.0), {}]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} double" for n in names))
    assert [r.exposure for r in exposure.exposure(df).collect()] == ["dense_urban", "forest", "rural", "unknown"]


@pytest.mark.parametrize("n", [1, 2, 3, 65, 200, 5000])
def test_diameters(spark, n):
    rng = random.Random(n)
    ring = [(50 + 0.01 * math.cos(a := rng.uniform(0, 7)) * (r := 1 - rng.random() ** 3 * 0.01), 30 + 0.0155 * math.sin(a) * r) for _ in range(n)]
    spots = [(60 + rng.randrange(40) / 100, 179.8 + rng.randrange(40) / 100) for _ in range(n)]
    spots = [(y, x - 360 if x > 180 else x) for y, x in spots]
    rows = [(k, *p) for k, some in (("a", ring), ("b", spots), ("c", [(1.0, 2.0)] * n)) for p in some] + [("d", None, 1.0), (None, 1.0, 1.0)]
    got = {r.k: r.diameter_m for r in hull.diameters(spark.createDataFrame(rows, "k string, lat double, lon double").repartition(5), "k", salt=4).collect()}
    for k, some in (("a", ring), ("b", spots)):
        some = list(set(some))
        want = max(metres(*p, *q) for p in some for q in some) if n < 1000 else None
        assert want is None or math.isclose(got[k], want, rel_tol=1e-9, abs_tol=1e-6)
    if n == 5000:
        import numpy as np

        for k, some in (("a", ring), ("b", spots)):
            p = np.radians(np.array(some))
            far = max(float((np.sin((p[:, 0] - y) / 2) ** 2 + np.cos(p[:, 0]) * math.cos(y) * np.sin((p[:, 1] - x) / 2) ** 2).max()) for y, x in p)
            assert math.isclose(got[k], 2 * 6371000.0 * math.asin(math.sqrt(far)), rel_tol=1e-9)
    assert got["c"] == 0 and set(got) == {"a", "b", "c"}


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 5) for _ in range(700)], "b": [3.0] * 50, "c": [1.0], "d": [float(rng.randrange(3)) for _ in range(200)], "e": [1e9, *(rng.random() for _ in range(300))]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("f", None), ("a", None)], "k string, v double")
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose([got[k].p10, got[k].p50, got[k].p95, got[k].p100], np.quantile(vs, [0.1, 0.5, 0.95, 1.0]))


def test_exact_quantiles_of_large_groups_with_outliers_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"a": rng.exponential(size=9001), "b": np.r_[rng.normal(size=5000), 1e300, -1e300], "c": rng.integers(0, 3, 7000).astype(float), "d": np.full(3000, 2.5), "e": np.arange(2047.0), "f": np.arange(2048.0)[::-1], "g": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, g in groups.items() for v in g] + [("a", None), (None, 1.0)], "k string, x double").repartition(7)
    points = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p501": 0.501, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "x", points, count="n").collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        assert got[k].n == len(g)
        for name, p in points.items():
            assert abs(got[k][name] - np.quantile(g, p)) <= 1e-9 * max(1, abs(np.quantile(g, p))), (k, name)


def test_polygon_search(spark):
    ring = lambda w, s, e, n: ((w, s), (e, s), (e, n), (w, n), (w, s))
    plan = objects.SpatialPlan("polygon", ring=ring(34.0, 49.0, 35.0, 50.0), holes=(ring(34.4, 49.4, 34.6, 49.6),))
    other = objects.SpatialPlan("polygon", ring=ring(40.0, 49.0, 40.5, 49.5))
    pts = spark.createDataFrame([(1, 49.2, 34.2), (2, 49.5, 34.5), (3, 49.1, 40.1), (4, 48.0, 34.5), (5, None, 34.5)], "id long, lat double, lon double")
    assert {r.id for r in objects.within_polygon(pts, plan).collect()} == {1} and {r.id for r in objects.within_polygon(pts, plan, other).collect()} == {1, 3}
    whole = objects.SpatialPlan("polygon", ring=ring(34.0, 49.0, 35.0, 50.0)).study_area_km2()
    row = spark.range(1).select(F.expr("array(array(named_struct('lon', 34D, 'lat', 49D), named_struct('lon', 35D, 'lat', 49D), named_struct('lon', 35D, 'lat', 50D), named_struct('lon', 34D, 'lat', 50D), named_struct('lon', 34D, 'lat', 49D)))").alias("r"))
    assert math.isclose(whole, row.select(geo.polygon_area_km2(F.col("r"))).first()[0]) and 0 < plan.study_area_km2() < whole
    with pytest.raises(ValueError, match="out of bounds"):
        objects.SpatialPlan("polygon", ring=ring(0.0, 0.0, 30.0, 30.0))


def test_attach_secondary(spark):
    t = lambda h: f"2024-01-02 {h:02d}:00:00"
    e = spark.createDataFrame([("near", 1, t(5), t(6), 50.0, 30.0), ("far", 1, t(5), t(6), 50.02, 30.0), ("else", 2, t(5), t(6), 50.0, 30.0)], "event_id string, region_id long, first_seen string, last_seen string, latest_lat double, latest_lon double")
    e = e.withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen", "last_seen")})
    px = [(1, t(7), 50.001, 30.0, 1), (2, t(7), 50.019, 30.0, 1), (3, t(7), 50.2, 30.0, 1), (4, t(7), 50.0, 30.0, None), (5, t(7), 50.0, 30.0, 2), (6, "2024-01-03 07:00:00", 50.0, 30.0, 1)]
    pixels = spark.createDataFrame(px, "id long, acq string, lat double, lon double, region_id long").withColumn("acq", F.col("acq").cast("timestamp"))
    assert {r.id: r.event_id for r in events.attach_secondary(pixels, e).collect()} == {1: "near", 2: "far", 3: None, 4: None, 5: "else", 6: None}


def test_link_documents(spark):
    stamp = lambda c: F.col(c).cast("timestamp")
    docs = [(1, "quake", "2024-01-01 00:30:00", 50.0, 30.0, ""), (2, "quake", "2024-01-01 11:00:00", 50.2, 30.0, ""), (3, "other", "2024-01-02 12:00:00", 50.5, 30.0, ""), (4, "other", "2024-01-03 12:00:00", None, None, "smoke over Testville today"), (5, "other", "2024-01-03 12:00:00", None, None, "smoke in Northland"), (6, "alert", "2024-01-01 02:00:00", None, None, "no name"), (7, "none", "2024-01-01 00:00:00", 50.0, 30.0, "")]
    d = spark.createDataFrame(docs, "doc_id long, rule string, published_at string, lat double, lon double, text string").withColumn("published_at", stamp("published_at"))
    e = spark.createDataFrame([("a", "2024-01-01 00:00:00", 50.0, 30.0, "Testville", "north")], "event_id string, last_seen string, latest_lat double, latest_lon double, place string, region string").withColumn("last_seen", stamp("last_seen"))
    got = {r.doc_id: (r.place_score, r.time_score, r.text_score, r.score) for r in documents.link_documents(d, e).collect()}
    assert got == {1: (55, 35, 0, 90), 4: (0, 10, 35, 45), 5: (0, 10, 20, 30)}


def test_streams_keep_to_the_batch_result(spark, tmp_path):
    import datetime

    rng, t0 = random.Random(11), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        at = t0 + datetime.timedelta(minutes=17 * i)
        rows.append((i, at - datetime.timedelta(minutes=rng.randint(0, 300)), at, 50 + rng.randrange(6) / 300, 30 + rng.randrange(6) / 300, rng.choice([1, 2, None]), 750.0, f"s{i % 3}", "x", "y", 1.0 + i, "h"))
    schema = "id long, acq timestamp, received_at timestamp, lat double, lon double, region_id long, radius_m double, source string, satellite string, instrument string, frp double, confidence string"
    src = spark.createDataFrame(rows, schema).orderBy("id")
    for n in range(5):
        src.where(f"id between {60 * n} and {60 * n + 59}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def run(writer, name):
        q = writer.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()

    run(streaming.cluster_stream(stream(), late_h=48).writeStream.format("parquet").option("path", str(tmp_path / "clusters")).outputMode("append"), "c1")
    want = {(r.id, r.event_id, r.opened) for r in cluster.cluster_events(src, region_mode="strict").collect()}
    assert {(r.id, r.event_id, r.opened) for r in spark.read.parquet(str(tmp_path / "clusters")).collect()} == want
    named = spark.createDataFrame([(i, e) for i, e, _ in want], "id long, event_id string")
    members = stream().join(named, "id")
    run(members.writeStream.foreachBatch(streaming.refresh_rollups(str(tmp_path / "members"), str(tmp_path / "rollups"))), "c2")
    pick = lambda df: sorted((r.event_id, r.observations, r.max_frp, r.first_seen, r.last_seen) for r in df.collect())
    assert pick(streaming.current_rollups(spark, str(tmp_path / "rollups"))) == pick(events.event_rollup(src.join(named, "id")))
    run(stream().writeStream.foreachBatch(streaming.route_late(*(str(tmp_path / x) for x in ("main", "late", "marks")), late_h=2)), "c3")
    main, late = (spark.read.parquet(str(tmp_path / x)) for x in ("main", "late"))
    newest, expected = None, set()
    for n in range(5):
        part = [r for r in rows if 60 * n <= r[0] < 60 * n + 60]
        expected |= {r[0] for r in part if newest and r[1] < newest - datetime.timedelta(hours=2)}
        newest = max([r[1] for r in part] + ([newest] if newest else []))
    assert {r.id for r in late.collect()} == expected and expected and main.count() + len(expected) == 300


def test_alias_resolution(spark):
    q = spark.createDataFrame([("NR",), ("North Region",), ("nort region",), ("zzz",), ("shared",), ("",)], "query string")
    a = spark.createDataFrame([("nr", "north region"), ("sr", "southern land"), ("nr", "shared"), ("sr", "shared")], "code string, alias string")
    assert {r.query: r.code for r in objects.resolve_alias(q, a).collect()} == {"NR": "nr", "North Region": "nr", "nort region": "nr", "zzz": None, "shared": None, "": None}


def test_similarity(spark):
    d = spark.createDataFrame([("night", "nacht"), ("", "a"), ("Main Street School", "main street school annex")], "a string, b string")
    got = [(round(r[0], 3), round(r[1], 3)) for r in d.select(similarity.dice(F.col("a"), F.col("b")), similarity.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (0.25, 0.25) and got[1] == (0.0, 0.0) and got[2][1] == 0.92


def test_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("﻿latitude,longitude,frp,confidence,acq_date,acq_time,satellite\n49.1,31.2,5.5,85,2024-01-02,0105,N\n49.1,31.2,,n,2024-01-01,105,N\nx,31,1,n,2024-01-02,0105,N\n49,31,1,n,2024-01-02,0930,N\n")
    got = files.read_firms_csv(spark, str(tmp_path / "f.csv"), "S", "2024-01-02 09:00:00", kind="modis").collect()
    assert [(r.lat, r.confidence, r.acq.hour) for r in got] == [(49.1, "h", 1)]
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"NAME_1":"A"},"geometry":{"type":"Polygon","coordinates":[[[30,50],[31,50],[31,51],[30,51],[30,50]]]}},{"properties":{},"geometry":{"type":"Polygon","coordinates":[[[30,50],[31,50],[30,50]]]}}]}')
    assert [(r.code, len(r.rings[0])) for r in files.read_geojson_polygons(spark, str(tmp_path / "a.geojson")).collect()] == [("A", 5)]


def test_streams_equal_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id id", "event_type source", "cast(event_id % 4 as string) satellite", "'i' instrument", "cast(ts as timestamp) acq", "44D lat", "22D lon", "value frp", "cast(user_id as string) cell")
    src.unionByName(src.where("id % 5 = 0")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(streaming.dedup_stream(stream()), "append", "d").count() == src.count()
    hours = run(streaming.hourly_coverage(stream()), "complete", "h")
    assert hours.agg(F.sum("n")).first()[0] == src.count() + src.where("id % 5 = 0").count()
    assert run(streaming.lifecycle_stream(stream()), "update", "l").count() >= src.select("cell").distinct().count()


def test_geodesy(spark):
    one = spark.range(1).select(geo.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("east"), geo.round_half_up(F.lit(-2.5)).alias("r"), *[c.alias(n) for c, n in zip(geo.project_point(F.lit(49.0), F.lit(31.0), F.lit(90.0), F.lit(1000.0)), ("lat", "lon"))]).first()
    assert round(one.east, 6) == 90 and one.r == -2 and abs(metres(49, 31, one.lat, one.lon) - 1000) < 0.01


def test_search_by_words(spark):
    a = spark.createDataFrame([("F", "fuel station"), ("F", "petrol"), ("S", "school"), ("T", "school bus stop"), ("B", "same"), ("C", "same")], "code string, alias string")
    q = spark.createDataFrame([(x,) for x in ("School", "new school bus stop north", "petroll", "same", "objects", "", "zzz", "petrol school")], "query string")
    got = {r.query: (r.code, r.how) for r in search.resolve_category(q, a, ["objects"]).collect()}
    assert got["School"] == ("S", "exact") and got["new school bus stop north"] == ("T", "contained") and got["petroll"] == ("F", "similar")
    assert got["same"] == (None, "ambiguous") and got["objects"] == (None, "generic") and got["zzz"] == (None, "none") and got["petrol school"][1] == "ambiguous"
    p = spark.createDataFrame([(1, "Alfa", "city", 100), (2, "alfa", "village", 9), (3, "beta", "town", None), (4, None, "city", 1)], "place_id long, name string, place string, population long")
    found = {r.query: (r.place_id, r.radius_m) for r in search.settlement_target(spark.createDataFrame([("alfa",), ("betas",), ("gamma",), (None,)], "query string"), p).collect()}
    assert found == {"alfa": (1, 15000), "betas": (3, 9000)}


def test_slstr_and_feed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# product\nnote,1\nTime,Latitude,Longitude,FRP_SWIR,confidence\n2024-01-02T03:04:05,49.5,31.5,7.5,0.9\nx,nan?,1,2,3\n")
    r = files.read_slstr_frp(spark, str(tmp_path / "s.csv"), "SWIR").collect()
    assert [(x.lat, x.lon, x.frp, x.confidence, x.match_radius_m, x.acq.minute) for x in r] == [(49.5, 31.5, 7.5, "h", 700, 4)]
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"id":"a","properties":{"n":"1"},"geometry":{"type":"Polygon","coordinates":[[[30,50],[32,50],[32,51],[30,50]]]}},{"id":"b","properties":{},"geometry":{"type":"Point","coordinates":[3,5]}},{"id":"c","properties":{},"geometry":null}]}')
    assert [(x.id, x.lat, x.lon) for x in files.read_event_feed(spark, str(tmp_path / "f.json"), (22, 44, 41, 53)).collect()] == [("a", 50.5, 31.0)]


def test_clusters_and_similarity_see_whole_texts(spark, tmp_path):
    from emberline.plans import texts

    body = lambda x: " ".join(str(i * i).translate(str.maketrans("0123456789", x)) for i in range(3000))
    rows = [(0, "one heading\n" + body("abcdefghij")), (1, "one heading\n" + body("klmnopqrst")), (2, "another title\n" + body("abcdefghij")), (300, "one heading\n" + body("abcdefghij"))]
    path = str(tmp_path)
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    assert {r.doc_id: r.cluster_id for r in texts.t3_cluster_documents(spark, path).collect()} == {0: 0, 1: 1, 2: 0, 300: 300}
    assert {r.doc_id: r.similarity < 0.9 for r in texts.t4_trgm_similarity_texts(spark, path).collect()} == {0: True, 1: True}


def test_document_clusters_by_brute_force(spark):

    rng = random.Random(6)
    words = lambda n: [rng.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "Über", "x1"]) + str(rng.randrange(40)) for _ in range(n)]
    bases = [words(rng.randrange(4, 14)) for _ in range(12)]
    rows = [(5000, None, 0), (5001, "", 5), (5002, "?!", 6), (5003, "no time", None)]
    for i in range(180):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = words(1)[0]
        rng.shuffle(w) if rng.random() < 0.3 else None
        rows.append((i * 7 % 1009, " ".join(w), rng.randrange(200)))
    rows += [(2000 + i, "one text that is repeated very often.", rng.randrange(400)) for i in range(120)]

    def grams(t):
        return {f"  {w} "[k : k + 3] for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() for k in range(len(w) + 1)}

    def alike(a, b):
        return len(a & b) / len(a | b)

    clusters, heads, pairs = {}, [], set()
    sets = {i: grams(t) for i, t, _ in rows}
    dated = sorted((h, i) for i, _, h in rows if h is not None and sets[i])
    for h, i in dated:
        best = max(((s, -j) for g, j in heads if h - g <= 72 and (s := alike(sets[i], sets[j])) >= 0.72), default=None)
        clusters[i] = i if best is None else -best[1]
        heads += [(h, i)] if best is None else []
        pairs |= {(min(i, j), max(i, j)) for g, j in dated if j != i and abs(g - h) <= 72 and alike(sets[i], sets[j]) >= 0.72}
    df = spark.createDataFrame(rows, "doc_id long, text string, h int").select("doc_id", "text", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h)").alias("published_at")).repartition(3)
    got = {r.doc_id: r.cluster_id for r in documents.cluster_documents(df).collect()}
    assert got == {i: clusters.get(i, i) for i, _, _ in rows} and len(set(got.values())) < 150
    assert {(r.doc_id, r.other) for r in documents.similar_documents(df).collect()} == pairs


def test_names_in_texts(spark):
    docs = spark.createDataFrame([(1, "abcd abc bc"), (2, None), (3, ""), (4, "éabc." + "x" * 100_000), (5, "a")], "doc_id long, text string").repartition(2)
    names = spark.createDataFrame([("abc",), ("bc",), ("abc",), (None,), ("",), ("éa",), ("zz",)], "name string")
    found = lambda **k: sorted(tuple(r) for r in documents.names_in_texts(docs, names, **k).collect())
    assert found() == [(1, "abc"), (1, "bc"), (4, "abc"), (4, "bc"), (4, "éa")] == found(block_chars=2)
    assert found(whole_words=True) == [(1, "abc"), (1, "bc")]
    assert documents.names_in_texts(docs, names.limit(0)).collect() == []
    lexicon = spark.createDataFrame([("k", "one", "abc", None, 5), ("k", "one", None, "x{9}", 7), ("k", "two", "zz", None, 1)], "kind string, canonical string, word string, pattern string, confidence int")
    assert sorted(map(tuple, documents.extract_entities(docs, lexicon).collect())) == [(1, "k", "one", 5), (4, "k", "one", 7)]


def test_components_of_a_long_path_settle(spark):
    ids = list(range(400))
    random.Random(7).shuffle(ids)
    got = components.connected_components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src long, dst long")).collect()
    assert len(got) == 400 and {r.component for r in got} == {0}


def test_halves_go_up_whatever_the_order_of_weights(spark):
    rows = [("e", p, w) for p, w in ((0, 0.4), (0, 0.2), (1, 0.1), (18, 0.3))]  # the mean is 5.5, as doubles 5.499999999999999
    for some in (rows, rows[::-1]):
        assert enrich.consistency(spark.createDataFrame(some, "event_id string, proximity long, weight double").coalesce(1)).first().alignment == 6


def test_coordinates_as_they_stand(spark):
    df = spark.createDataFrame([(1, "at 96.199 50.1817, or 50.123, 30.456")], "doc_id long, text string")
    found = lambda **k: {(r.lat, r.lon) for r in documents.extract_coordinates(df, **k).collect()}
    assert found() == {(50.123, 30.456)} and found(on_globe=False) == {(96.199, 50.1817), (50.123, 30.456)}


def test_exposure_of_missing_inputs(spark):
    df = spark.createDataFrame([(0, 0, 5.0)], "total long, buildings long, agricultural_landuse double")
    mixed = lambda **k: exposure.exposure(df, **k).first().scores["mixed"]
    assert mixed() == 0 and mixed(missing=1.0) == 1


def test_profiles_of_equal_confidence(spark):
    rows = [(1, "f", v, 0.5, "s") for v in "abc"]
    for some in (rows, rows[::-1]):
        got = objects.merge_profiles(spark.createDataFrame(some, "entity_id long, field string, value string, confidence double, source string").coalesce(1)).first()
        assert got.value == "c" and got["values"] == ["a", "b", "c"]


def test_growing_circles_equal_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(50, 51), rng.uniform(30, 32)) for i in range(60)] + [(60, None, 1.0), (61, 10.0, 10.0)]
    b = [(i, rng.choice([rng.uniform(50, 51), 50.5]), rng.choice([rng.uniform(30, 32), 31.0])) for i in range(80)]
    got = grid.nearest_within(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "id2 long, lat2 double, lon2 double"), "id", 60_000, ["id2"], 3, "rank").collect()
    near = lambda p: sorted((round(m), q[0]) for q in b if p[1] is not None and (m := metres(p[1], p[2], q[1], q[2])) <= 60_000)[:3]
    assert {(r.id, r.rank, r.id2) for r in got} == {(p[0], k + 1, x[1]) for p in a for k, x in enumerate(near(p))}


def test_nearest_in_time_makes_no_pairs(spark):
    rng = random.Random(4)
    left, right = [(i, i % 2, rng.randrange(40_000)) for i in range(100)], [(i, i % 2, rng.randrange(40_000)) for i in range(100)]
    at = lambda rows, names: spark.createDataFrame(rows, "id long, g long, s long").selectExpr(*names, "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) t")
    df = enrich.nearest_in_time(at(left, ("id", "g")), at(right, ("id other", "g")).withColumnRenamed("t", "t2"), "id", "t", "t2", 600, ["g"])
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    want = {p[0]: min(((abs(q[2] - p[2]), q[2]) for q in right if q[1] == p[1] and abs(q[2] - p[2]) <= 600), default=None) for p in left}
    assert {r.id: abs(r.offset_us) // 1_000_000 for r in df.collect()} == {k: v[0] for k, v in want.items() if v}


def test_polygon_in_pieces(spark):
    ring, hole = ((24.00037, 45.00041), (38.00037, 45.00041), (31.00037, 51.50041), (24.00037, 45.00041)), ((29.00013, 46.00017), (33.00013, 46.00017), (33.00013, 48.00017), (29.00013, 48.00017), (29.00013, 46.00017))
    plans = objects.pieces(ring, (hole,))
    rng = random.Random(5)
    pts = [(i, rng.uniform(44, 52), rng.uniform(23, 39)) for i in range(800)]
    inside = lambda y, x: y >= 45.00041 and (y - 45.00041) * 7 <= min(x - 24.00037, 38.00037 - x) * 6.5 and not (29.00013 < x < 33.00013 and 46.00017 < y < 48.00017)
    assert len(plans) > 4 and {r.id for r in objects.within_polygon(spark.createDataFrame(pts, "id long, lat double, lon double"), *plans).collect()} == {i for i, y, x in pts if inside(y, x)}


def test_normal_forms_beside_plain_texts(spark):
    texts = ["plain", None, "", "\ufb01n \u2460", "caf\u0065\u0301"] * 30
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1).select("i", documents.nfkc(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got[:5]] == ["plain", None, "", "fin 1", "caf\u00e9"] and [r.n for r in got] == [r.n for r in got[:5]] * 30
