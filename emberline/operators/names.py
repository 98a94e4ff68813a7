"""Names of administrative regions as providers write them, and where in the world a document's words are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import norm_name
from .documents import names_in_texts

#: What a city's name begins with, what a region's ends with in either language, and the endings that stems lack, of
#: the region's own English name and of a given one. The city's prefix must be set off by a full stop or a space.
AFFIXES = {"city": r"^м(\.\s*|\s+)", "local": r"\s+область$", "english": r"\s+oblast$", "own_ending": r"(ska|skaia|skaya)$", "given_ending": r"(ia|a|yi|y)$"}
#: Endings that a region's stem in a text lacks, wherever they stand.
STEM_ENDINGS = r"(ська|ський|ське|ская|ский|ское|область|області|обл\.?)"


def _plain(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def map_admin_names(names: DataFrame, regions: DataFrame, affixes: dict = AFFIXES) -> DataFrame:
    """``names`` (``id, local_name, english_name``) with the ``region_id`` each means, and ``how``; null where none does.

    ``regions`` has ``region_id, local_name, name, english_name, is_city``. Case does not count. A local name with a city's
    prefix means the city of that name, if there is one. Then, first hit wins: the local name without affixes is a
    region's local name, or its other name; the English one is its English name; the stems of the English names are
    equal. Of equal names the smallest ``region_id`` counts; stems that fit several regions mean none.
    """
    local, english = _plain("local_name"), _plain("english_name")
    base = F.regexp_replace(F.regexp_replace(local, affixes["city"], ""), affixes["local"], "")
    en = F.regexp_replace(english, affixes["english"], "")
    step = lambda rank, key: F.struct(F.lit(rank).alias("rank"), F.nullif(key, F.lit("")).alias("key"))
    asked = names.select("id", F.explode(F.array(step(0, F.when(local.rlike(affixes["city"]), base)), step(1, base), step(2, base), step(3, en), step(4, F.regexp_replace(en, affixes["given_ending"], "")))).alias("s")).select("id", "s.*")
    own = F.array(step(0, F.when(F.col("is_city"), local)), step(1, local), step(2, _plain("name")), step(3, english), step(4, F.regexp_replace(english, affixes["own_ending"], "")))
    known = regions.select("region_id", F.explode(own).alias("s")).select("region_id", "s.*").where("key is not null").groupBy("rank", "key").agg(F.min("region_id").alias("region_id"), F.count_distinct("region_id").alias("n"))
    met = asked.distinct().join(known.where("rank < 4 or n = 1"), ["rank", "key"]).groupBy("id").agg(F.min(F.struct("rank", "region_id")).alias("m"))
    how = F.when(F.col("m.rank") == 0, "city").when(F.col("m.rank") == 4, "stem").when(F.col("m").isNotNull(), "name").otherwise("none")
    return names.join(met, "id", "left").select(*names.columns, F.col("m.region_id").alias("region_id"), how.alias("how"))


def region_words(name: Column, endings: str = STEM_ENDINGS) -> Column:
    """What in a text stands for a region: its name, its stem (without endings, ten letters), and the stem's first four and five letters."""
    full = norm_name(name)
    stem = F.left(F.trim(F.regexp_replace(full, endings, "")), F.lit(10))
    words = F.array(full, F.when(F.length(stem) >= 4, stem), F.when(F.length(stem) >= 4, F.left(stem, F.lit(4))), F.when(F.length(stem) >= 5, F.left(stem, F.lit(5))))
    return F.filter(F.array_distinct(F.array_compact(words)), lambda w: F.length(w) >= 4)


def geo_status(docs: DataFrame, contexts: DataFrame, places: DataFrame, country: str, foreign: str, endings: str = STEM_ENDINGS) -> DataFrame:
    """How a document's text places it: the ladder nearest place 100, region 90, local place 85, other place 10, country 35.

    ``docs`` has ``doc_id, event_id, text`` (a document may stand by several events); ``contexts`` has ``event_id, place, region``,
    several rows for names in several languages; ``places`` (a gazetteer) has ``event_id, name`` for local ones and a null
    event for the others. Names of four letters or more count anywhere in the text, regions by :func:`region_words`
    too; one automaton finds them all. ``country`` and ``foreign`` are patterns for the text between two spaces; a foreign
    signal counts only without any place.
    """
    text = F.concat(F.lit(" "), norm_name(F.col("text")), F.lit(" "))
    d = docs.select("doc_id", "event_id", F.coalesce(text.rlike(country), F.lit(False)).alias("country"), F.coalesce(text.rlike(foreign), F.lit(False)).alias("foreign"))
    place = contexts.select("event_id", norm_name(F.col("place")).alias("name")).where("length(name) >= 4").distinct()
    region = contexts.select("event_id", F.explode(region_words(F.col("region"), endings)).alias("name")).distinct()
    known = places.select("event_id", norm_name(F.col("name")).alias("name")).where("length(name) >= 4").distinct()
    told = lambda df, role: df.select("event_id", "name", F.lit(role).alias("role"))
    local = told(known.where("event_id is not null").join(place, ["event_id", "name"], "left_anti"), "local")
    own = told(place, "place").unionByName(told(region, "region")).unionByName(local)
    other = known.where("event_id is null").select("name")
    texts = docs.select("doc_id", F.trim(text).alias("text")).distinct()
    found = names_in_texts(texts, own.select("name").unionByName(other)).distinct()
    asked = d.select("doc_id", "event_id").distinct().join(found, "doc_id")
    roles = asked.join(own, ["event_id", "name"]).select("doc_id", "event_id", "role")
    elsewhere = asked.join(other, "name").join(place, ["event_id", "name"], "left_anti").select("doc_id", "event_id", F.lit("other").alias("role"))
    has = lambda r: F.coalesce(F.bool_or(F.col("role") == r), F.lit(False)).alias(f"has_{r}")
    met = roles.unionByName(elsewhere).groupBy(F.col("doc_id").alias("doc"), F.col("event_id").alias("event")).agg(*map(has, ("place", "region", "local", "other")))
    j = d.join(met, (F.col("doc_id") == F.col("doc")) & F.col("event_id").eqNullSafe(F.col("event")), "left")
    steps = [("has_place", "nearest_place", 100), ("has_region", "region", 90), ("has_local", "local_reference", 85), ("has_other", "other_known_place", 10), ("country", "country_only", 35), ("foreign", "foreign_location_signal", 0)]
    status, score = F, F
    for c, name, n in steps:
        hit = F.coalesce(c, F.lit(False))
        status, score = status.when(hit, name), score.when(hit, n)
    return j.select("doc_id", "event_id", status.otherwise("none").alias("geo_status"), score.otherwise(0).alias("geo_score"))
