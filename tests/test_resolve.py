"""Entity resolution in rounds against the rule one record at a time; registry links against literal cases."""

import math
import random

from pyspark.sql import functions as F

from emberline.functions.similarity import name_similarity
from emberline.operators import resolve

RECORD = "id long, source string, name string, category string, lat double, lon double, exact_id string, rank int, distance_m double, extra string"


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def one_by_one(rows, alike):
    """The rule, a record at a time; rows as in RECORD."""
    real = lambda c: c not in (None, "", "wikidata_entity", "place", "infrastructure")
    blank = lambda x: "" if x is None else str(x)
    first = {}
    for r in rows:
        first[r[1:9]] = min(r[0], first.get(r[1:9], r[0]))
    order = sorted(rows, key=lambda r: (r[6] is None, -r[7], r[8] or 0.0, *map(blank, r[1:6]), blank(r[6]), first[r[1:9]], r[0]))
    entities, out = [], []
    for i, source, name, category, lat, lon, exact, rank, *_ in order:
        hit = next((e for e in entities if exact is not None and e["exact"] == exact), None)
        found = []
        if hit is None and lat is not None and not (exact is not None and source == "authority"):
            for e in entities:
                if source in e["sources"] or e["at"][0] is None or (real(category) and real(e["category"]) and category != e["category"]):
                    continue
                d, s = metres(e["at"], (lat, lon)), alike(e["name"], name)
                if d <= 180:
                    c = math.floor(s * 75 + max(0, 1 - d / 180) * 25 + 0.5)
                    c = max(c, 88) if s >= 0.88 and d <= 120 else max(c, 86) if s >= 0.78 and d <= 40 else c
                    found += [(-c, d, e["id"], e)] if c >= 80 else []
            found.sort(key=lambda x: x[:3])
        if hit is not None:
            method, confidence = "exact", 100
        elif found and -found[0][0] >= 86 and (len(found) == 1 or found[1][0] - found[0][0] >= 6):
            hit, method, confidence = found[0][3], "name_distance", -found[0][0]
        if hit is None:
            entities.append({"id": i, "name": name, "category": category, "at": (lat, lon), "exact": exact, "sources": [source], "rank": rank})
            out.append((i, i, "single_source", 100, tuple((f[2], -f[0]) for f in found[:2])))
            continue
        out.append((i, hit["id"], method, confidence, ()))
        hit["sources"].append(source)
        hit["exact"] = hit["exact"] or exact
        if rank > hit["rank"] and name:
            hit["name"] = name
        if hit["category"] and not real(hit["category"]) and real(category):
            hit["category"] = category
        if source == "map" and category:
            hit["category"], hit["at"] = category, (lat, lon)
    return sorted(out)


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], RECORD).repartition(3)
    return sorted((r.id, r.entity_id, r.method, r.confidence, tuple(map(tuple, r.proposed))) for r in resolve.resolve_entities(df).collect())


def similarities(spark, rows):
    names = spark.createDataFrame([(n,) for n in {r[2] for r in rows}], "a string")
    pairs = names.crossJoin(names.withColumnRenamed("a", "b")).select("a", "b", F.when(F.lower("a").isin("parking") | F.lower("b").isin("parking"), 0.0).otherwise(name_similarity(F.col("a"), F.col("b"))).alias("s")).collect()
    table = {(r.a, r.b): r.s for r in pairs}
    return lambda a, b: table[a, b]


def records(seed, n):
    rng = random.Random(seed)
    names = ["Alpha Bakery", "alpha bakery", "Alpha Bakerie", "Alpha Bakery North", "Beta Works", "Beta Work", "Parking", None, ""]
    sources = [("authority", 3), ("map", 2), ("open", 1), ("register", 0)]
    rows = []
    for i in range(n):
        source, rank = rng.choice(sources)
        lat, lon = 49 + rng.randrange(9) / 100 + rng.random() * 0.002, 31 + rng.random() * 0.003
        if rng.random() < 0.05:
            lat = lon = None
        exact = f"Q{rng.randrange(6)}" if rng.random() < (0.8 if source == "authority" else 0.1) else None
        rows.append((i + 1, source, rng.choice(names), rng.choice(["shop", "shop", "cafe", "place", None]), lat, lon, exact, rank, rng.choice([None, float(rng.randrange(500))])))
    for i in range(n // 4):  # equal records
        rows.append((n + i + 1, *rng.choice(rows[: n // 2])[1:]))
    return rows


def test_rounds_equal_one_by_one(spark):
    rows = records(2, 40)
    expected = one_by_one(rows, similarities(spark, rows))
    assert resolved(spark, rows) == expected
    assert len({x[2] for x in expected}) == 3 and any(x[4] for x in expected)


def test_literal_records(spark):
    far = 110 / (6371000 * math.pi / 180)  # 110 m north
    row = lambda i, source, name, north=0.0, category="shop", exact=None, rank=0: (i, source, name, category, 49.0 + north, 31.0, exact, rank, None)
    assert [x[:4] for x in resolved(spark, [row(1, "map", "Alpha Bakery", rank=2), row(2, "open", "alpha bakery", far, rank=1)])] == [(1, 1, "single_source", 100), (2, 1, "name_distance", 88)]
    cases = [
        [row(1, "map", "Alpha Bakery"), row(2, "map", "Alpha Bakery")],  # one source
        [row(3, "map", "Alpha Bakery", 0.1), row(4, "open", "Alpha Bakery", 0.1, category="cafe")], [row(5, "map", "Alpha Bakery", 0.2), row(6, "open", "Alpha Bakery", 0.2, category="place")],
        [row(7, "authority", "One", 0.3, exact="Q1", rank=3), row(8, "map", "Other", 1.3, exact="Q1", rank=2)], [row(9, "map", "Parking", 0.4), row(10, "open", "Parking", 0.4)],
    ]
    assert [x[1] for x in resolved(spark, [r for case in cases for r in case])] == [1, 2, 3, 4, 5, 5, 7, 7, 9, 10]
    assert resolved(spark, []) == []


def test_many_equal_records(spark):
    rows = [(i, "open", "Alpha Bakery", "shop", 49.0, 31.0, None, 1, None) for i in range(1, 501)] + [(3000, "map", "Alpha Bakery", "shop", 49.0, 31.0, None, 2, None), (3001, "register", "Alpha Bakery", "shop", 49.0, 31.0, None, 0, None)]
    got = {x[0]: x[1:] for x in resolved(spark, rows)}
    assert got[1][:2] == (3000, "name_distance") and all(got[i][0] == i for i in range(2, 501)) and got[3001] == (3001, "single_source", 100, ((2, 100), (3, 100)))[0:3] + (got[3001][3],)
    assert got == {x[0]: x[1:] for x in one_by_one(rows, lambda a, b: 1.0)}


def test_registry(spark):
    entities = spark.createDataFrame([(1, "Elm Street Works", ["Elm Works"], ["Northern Power Company"]), (2, "Elm", None, []), (3, None, None, None), (4, "Harbour Crane Number Nine", [], None)], "entity_id int, name string, aliases array<string>, operators array<string>")
    datasets = spark.createDataFrame(
        [(1, "Elm Street Works", None, None), (2, "List of elm street works 2024", "x", "y"), (3, "Plants", "none", "Northern power company"), (4, "Old Elm Street list", None, None), (5, "Harbours", "harbour crane number nine and ten", None), (6, "Elm", None, None), (7, "Nothing shared", None, None), (8, "Crane Number Nine Ten", None, "power company of the northern coast")],
        "dataset_id int, title string, notes string, publisher string",
    )
    got = {(r.entity_id, r.dataset_id): (r.score, r.status) for r in resolve.link_registry(entities, datasets).collect()}
    assert got[1, 1] == (100, "probable") and got[1, 2] == (94, "probable")  # contained: likeness 0.94 is above 90
    assert got[1, 3] == (88, "candidate")  # by the publisher alone
    assert (2, 4) not in got and got[2, 6] == (100, "probable")  # a name of three letters is not contained
    assert got[4, 5] == (71, "candidate") and got[4, 8] == (60, "candidate")
    assert not any(k[0] == 3 or k[1] == 7 for k in got)
