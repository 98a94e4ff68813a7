"""Search by words: categories, split queries, settlements; evidence near a place; entity lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geo import haversine_m
from ..functions.similarity import dice, norm_name
from .events import _hours

#: A settlement's rank and search radius by type.
PLACE_RANK = {"city": 4, "town": 3, "village": 2, "hamlet": 1}
PLACE_RADIUS_M = {"city": 15000, "town": 9000, "village": 4500, "hamlet": 2500}


def _pick(key: Column, table: dict, default: int) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def study_area_km2(mode: Column, radius_m: Column, length_m: Column, corridor_m: Column, polygon_km2: Column) -> Column:
    """Area that a plan covers: a circle, a corridor with round ends, or the polygon's own."""
    circle = lambda r: F.pi() * r * r
    return F.when(mode.isin("radius", "nearest"), circle(radius_m) / 1e6).when(mode == "route", (2 * length_m * corridor_m + circle(corridor_m)) / 1e6).when(mode == "polygon", polygon_km2).otherwise(0.0)


def query_key(mode: Column, lat: Column, lon: Column, radius_m: Column) -> Column:
    """The same key for the same question: coordinates count to five places."""
    place = lambda c: F.round(c, 5).cast("decimal(11,5)").cast("string")
    return F.sha2(F.concat_ws("|", mode, place(lat), place(lon), radius_m.cast("string")), 256)


def split_query(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query`` as a region (its longest alias at the start, else at the end) and what is sought: ``code, object, position``.

    Aliases meet queries by their first or last word; queries that are an alias alone, or have none, are left out.
    """
    q = queries.select("query", norm_name(F.col("query")).alias("q")).where("q <> ''").distinct()
    a = aliases.select("code", norm_name(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    word = lambda c, i: F.element_at(F.split(c, " "), i)
    head = q.join(a, word("q", 1) == word("alias", 1)).where(F.col("q").startswith(F.concat("alias", F.lit(" ")))).select("query", "code", "alias", F.expr("trim(substr(q, length(alias) + 1))").alias("object"), F.lit("prefix").alias("position"))
    tail = q.join(a, word("q", -1) == word("alias", -1)).where(F.col("q").endswith(F.concat(F.lit(" "), "alias"))).select("query", "code", "alias", F.expr("trim(substr(q, 1, length(q) - length(alias)))").alias("object"), F.lit("suffix").alias("position"))
    w = Window.partitionBy("query").orderBy(F.desc(F.length("alias")), "position", "code")
    return head.unionByName(tail).where("object <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query", "code", "object", "position")


def resolve_category(queries: DataFrame, catalogue: DataFrame, generic: list[str] = (), least: float = 0.86, margin: float = 0.08) -> DataFrame:
    """The category of each query: ``code`` and ``how`` (exact, contained, similar, generic, ambiguous, none).

    ``catalogue`` has ``code, alias``. An exact alias wins, then the longest alias among the query's words, then the
    most similar one from ``least`` that leads other codes by ``margin``; two codes at the same step are ambiguous.
    Similar aliases meet by shared bigrams; a query of generic words alone is generic.
    """
    q = queries.select("query", norm_name(F.col("query")).alias("q")).where("q <> ''").distinct()
    a = catalogue.select("code", norm_name(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    words = lambda c: F.split(c, " ")
    exact = q.join(a, q["q"] == a["alias"]).select("query", "code", F.lit(3.0).alias("step"), F.lit(1.0).alias("score"))
    inside = q.select("query", "q", F.explode(F.array_distinct(words("q"))).alias("w")).join(a.withColumn("w", F.element_at(words("alias"), 1)), "w")
    inside = inside.where(F.contains(F.concat(F.lit(" "), "q", F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" ")))).select("query", "code", F.lit(2.0).alias("step"), F.length("alias").cast("double").alias("score"))
    pair = lambda df, c, *keep: df.select(*keep, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2))))).alias("g"))
    met = pair(q.where("length(q) > 1"), "q", "query", "q").join(pair(a.where("length(alias) > 1"), "alias", "code", "alias"), "g").select("query", "q", "code", "alias").distinct()
    soft = met.withColumn("score", dice(F.col("q"), F.col("alias"))).where(F.col("score") >= least).select("query", "code", F.lit(1.0).alias("step"), "score")
    each = exact.unionByName(inside).unionByName(soft).groupBy("query", "code").agg(F.max(F.struct("step", "score")).alias("s"))
    w = Window.partitionBy("query").orderBy(F.desc("s"), "code")
    top = each.withColumn("next", F.lead("s").over(w)).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    lead = F.when(F.col("s.step") == 1, margin).otherwise(1e-9)
    tied = F.coalesce((F.col("s.step") == F.col("next.step")) & (F.col("s.score") - F.col("next.score") < lead), F.lit(False))
    how = F.when(tied, "ambiguous").when(F.col("s.step") == 3, "exact").when(F.col("s.step") == 2, "contained").otherwise("similar")
    out = queries.select("query").distinct().join(top.select("query", F.when(~tied, F.col("code")).alias("code"), how.alias("how")), "query", "left")
    plain = F.forall(words(norm_name(F.col("query"))), lambda x: F.array_contains(F.array(*map(F.lit, generic)).cast("array<string>"), x))
    return out.withColumn("how", F.coalesce("how", F.when(plain, "generic").otherwise("none")))


def settlement_target(queries: DataFrame, places: DataFrame, least: float = 0.78) -> DataFrame:
    """The settlement a query names: most similar name, then type, then population; with the search radius of its type.

    ``places`` has ``place_id, name, place, population``; equal values fall to the smallest id. A name that
    is similar enough misses at most a share of a query's bigrams, so only that many of its rarest ones, and one, look.
    """
    q = queries.select("query", norm_name(F.col("query")).alias("q")).where("q <> ''").distinct()
    p = places.select("place_id", "name", F.lower(F.trim("place")).alias("place"), "population", norm_name(F.col("name")).alias("n")).where("n <> ''")
    same = q.join(p, q["q"] == p["n"])
    grams = lambda df, c: df.where(F.length(c) > 1).withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2))))))
    held = grams(p, "n")
    rare = grams(q, "q").join(held.groupBy("g").agg(F.count("*").alias("c")), "g", "left")
    rare = rare.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("c", F.lit(0)), "g")))
    rare = rare.where(F.col("_n") <= F.floor((F.length("q") - 1) * (1 - least / (2 - least))) + 1)
    near = rare.select("query", "q", "g").join(held, "g").drop("g").where("q <> n").distinct()
    both = same.withColumn("score", F.lit(1.0)).unionByName(near.withColumn("score", dice(F.col("q"), F.col("n")))).where(F.col("score") >= least)
    value = F.col("score") * 1000 + 10 * _pick(F.col("place"), PLACE_RANK, 0) + F.least(F.lit(9.0), F.log10(F.greatest(F.lit(1.0), F.coalesce("population", F.lit(0)).cast("double"))))
    best = both.withColumn("v", value).groupBy("query").agg(F.max_by(F.struct("place_id", "name", "place", "score"), F.struct("v", (-F.col("place_id")).alias("i"))).alias("b")).select("query", "b.*")
    return best.select("query", "place_id", "name", F.round("score", 3).alias("name_score"), _pick(F.col("place"), PLACE_RADIUS_M, 7000).alias("radius_m"))


def area_evidence(kinds: dict[str, DataFrame], lat: float, lon: float, as_of, radius_m: float = 5000, hours: int = 168, limit: int = 30) -> DataFrame:
    """The newest items near a place: each kind's ``limit`` newest, then the newest of all.

    Each table has ``id, source, title, observed_at, lat, lon``; radius is held within 250 and 10 000 m, hours within a
    year, the limit within 100. The box of the radius comes first, so files can be skipped by their statistics.
    """
    radius, hours, limit = max(250, min(radius_m, 10000)), max(1, min(hours, 8760)), max(1, min(limit, 100))
    order, out = [F.desc_nulls_last("observed_at"), "distance_m", "id"], None
    for kind, df in sorted(kinds.items()):
        span = radius / 111_000
        near = df.where(F.col("lat").between(lat - span, lat + span) & (F.col("observed_at") >= F.lit(as_of) - _hours(hours)))
        near = near.withColumn("d", haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("d") <= radius)
        top = near.select(F.lit(kind).alias("kind"), "id", "source", "title", "observed_at", F.round("d").cast("long").alias("distance_m")).orderBy(*order).limit(limit)
        out = top if out is None else out.unionByName(top)
    return out.orderBy(*order, "kind").limit(limit)


def find_entity(entities: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities by exact id or start of the id: exact first, then most sources, then confidence."""
    hit = entities.where(F.col("entity_id").startswith(text)).withColumn("exact", F.col("entity_id") == text)
    return hit.orderBy(F.desc("exact"), F.desc(F.size("sources")), F.desc_nulls_last("confidence"), "entity_id").limit(limit)


def registry_summary(entities: DataFrame, links: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each entity with its number of sources, registry records (``entity_id, dataset_id``) and open proposals."""
    n = lambda df, name: df.groupBy("entity_id").agg(F.count("*").alias(name))
    return entities.select("entity_id", F.size("sources").alias("n_sources")).join(n(links, "n_records"), "entity_id", "left").join(n(proposals, "n_proposals"), "entity_id", "left").fillna(0, ["n_records", "n_proposals"])
