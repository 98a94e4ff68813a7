"""The ellipsoid against published distances, points on surfaces, JSON records."""

from pyspark.sql import functions as F

from emberline.functions import geo, shapes
from emberline.operators import records


def test_spheroidal_distances(spark):
    dms = lambda d, m, s: d + m / 60 + s / 3600
    published = [
        (-dms(37, 57, 3.72030), dms(144, 25, 29.52440), -dms(37, 39, 10.15610), dms(143, 55, 35.38390), 54972.271), (40.6, -73.8, 51.6, -0.5, 5551759.400), (0.0, 0.0, 90.0, 0.0, 10001965.729),
        (0.0, 0.0, 0.0, 1.0, 111319.491), (10.0, 179.5, 10.0, -179.5, None), (12.0, 34.0, 12.0, 34.0, 0.0),
    ]
    df = spark.createDataFrame([(i, *p[:4]) for i, p in enumerate(published)] + [(9, 0.0, 0.0, 0.1, 179.9), (10, None, 0.0, 0.0, 0.0)], "i int, a double, b double, c double, d double")
    got = {r.i: r.m for r in df.select("i", shapes.spheroid_m(*(F.col(c) for c in "abcd")).alias("m")).collect()}
    for i, p in enumerate(published):
        if p[4] is not None:
            assert abs(got[i] - p[4]) <= 0.001, (i, got[i])
    assert abs(got[4] - 109639.3) < 1 and abs(got[9] / 20003931 - 1) < 0.006 and got[10] is None


def test_points_on_surfaces(spark):
    box = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    cases = {
        "box": [box], "hole": [box, [(1, 1), (3.5, 1), (3.5, 3), (1, 3), (1, 1)]], "u": [[(0, 0), (6, 0), (6, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5), (0, 0)]], "flat": [[(0, 0), (1, 0), (2, 0), (0, 0)]],
        "two": [box, [(10, 0), (19, 0), (19, 4), (10, 4), (10, 0)]], "open": [[(0, 0), (2, 0), (1, 3)]],
    }
    rows = [(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in cases.items()]
    df = spark.createDataFrame(rows, "k string, rings array<array<struct<lon: double, lat: double>>>")
    out = df.select("k", shapes.point_on_surface(F.col("rings")).alias("p"), "rings").withColumn("covered", geo.covers(F.col("p.lon"), F.col("p.lat"), F.col("rings")))
    got = {r.k: (tuple(r.p) if r.p else None, r.covered) for r in out.collect()}
    assert got["box"] == ((2.0, 2.0), True) and got["hole"] == ((0.5, 2.0), True) and got["u"][0] == (5.0, 3.0) and got["two"] == ((14.5, 2.0), True) and got["open"][1]
    assert got["flat"][0] is None
    assert tuple(df.where("k = 'box'").select(shapes.box_centre(geo.bbox(F.col("rings")[0])).alias("c")).first().c) == (2.0, 2.0)


def test_json_records(spark):
    df = spark.createDataFrame([(1, '[{"k": 1, "s": "x"}, {"k": "no"}, 7, {"s": "y", "z": 1}, null, "t"]'), (2, "[]"), (3, None), (4, "nonsense"), (5, '{"k": 1}')], "id int, a string")
    got = {(r.id, r.place): (r.k, r.s, r.malformed) for r in records.json_records(df, "id", "a", "k bigint, s string").collect()}
    assert got[1, 1] == (1, "x", None) and got[1, 2] == (None, None, '{"k":"no"}') and got[1, 3] == (None, None, "7") and got[1, 4] == (None, "y", None)
    assert {k for k in got if k[0] == 1} == {(1, i) for i in range(1, 7)} and not any(k[0] in (2, 3) for k in got) and got[4, 0] == (None, None, "nonsense")


def test_event_search_bounds(spark):
    import pytest

    from emberline.operators import objects

    e = spark.createDataFrame([("E1", 49.0, 31.0), ("e2", 49.001, 31.0)], "event_id string, latest_lat double, latest_lon double").withColumn("last_seen", F.lit(1)).withColumn("region", F.lit(None).cast("string"))
    assert [r.event_id for r in objects.search_events(e, lat=49.0, lon=31.0, radius_m=100).collect()] == ["E1"] and objects.search_events(e, prefix="E").count() == 2 and objects.search_events(e, region="x").count() == 0
    for bad in ({"lat": 1.0}, {"lat": 91.0, "lon": 0.0}, {"lat": 1.0, "lon": 1.0, "radius_m": 99}, {"radius_m": 500_001}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            objects.search_events(e, **bad)
    assert [tuple(r) for r in e.select(geo.haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))).collect()] == [(None,), (None,)]
