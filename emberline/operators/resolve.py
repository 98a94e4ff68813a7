"""Records of the same object across sources become entities; entities meet registry records by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geo import round_half_up
from ..functions.similarity import name_similarity, norm_name, registry_similarity
from ..session import Scratch
from .grid import dwithin_join

#: Categories that go with any, names that say nothing, and the points of names and distances.
WILDCARDS = ("", "wikidata_entity", "place", "infrastructure")
GENERIC = (
    "industrial", "residential", "energy", "education", "transport", "government", "emergency", "healthcare", "commercial", "logistics", "telecom", "storage", "water", "cultural",
    "public service", "place", "infrastructure", "parking", "bus stop", "fence", "lift gate", "ferry terminal", "wikidata entity",
)
RADIUS_M, PROPOSE, ACCEPT, MARGIN = 180, 80, 86, 6
FLOORS = ((0.78, 40, 86), (0.88, 120, 88))
LEAST_NAME = (PROPOSE - 0.5 - 25) / 75  # a candidate's names are at least so similar
COARSE = 16  # radii to a cell where records of one search meet only each other
SAME = ("source", "name", "category", "lat", "lon", "exact_id", "rank", "distance_m", "within")  # records that agree in these are equal


def _alike(a: Column, b: Column) -> Column:
    plain = ~(norm_name(a).isin(*GENERIC) | norm_name(b).isin(*GENERIC))
    return F.when(plain, name_similarity(a, b)).otherwise(0.0)


def _confidence(name: Column, distance: Column) -> Column:
    out = round_half_up(name * 75 + F.greatest(F.lit(0.0), 1 - distance / RADIUS_M) * 25)
    for least, most, floor in FLOORS:
        out = F.when((name >= least) & (distance <= most), F.greatest(out, F.lit(floor))).otherwise(out)
    return out.cast("int")


def _real(category: Column) -> Column:
    return ~F.coalesce(category, F.lit("")).isin(*WILDCARDS)


def _nodes(rows: DataFrame) -> DataFrame:
    """Equal records as one node with the number of its copies; ``o`` is the order in which records are looked at."""
    key = list(SAME)
    nodes = rows.groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("n"))
    order = [F.col("exact_id").isNull().alias("a"), (-F.col("rank")).alias("b"), F.coalesce("distance_m", F.lit(0.0)).alias("c"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"k{i}") for i, c in enumerate(key[:5])), F.col("node").alias("z")]
    return nodes.withColumn("o", F.struct(*order))


def _entity(decided: DataFrame, copy: int) -> DataFrame:
    """An entity founded by copy ``j + copy`` of each node."""
    cols = (F.col("node").alias("e_node"), (F.col("j") + copy).alias("e_j"), "name", "category", "lat", "lon", "exact_id", F.array("source").alias("sources"), F.col("rank").alias("head_rank"), "within")
    return decided.select(*cols)


def _grown(entities: DataFrame, joined: DataFrame, placing: str) -> DataFrame:
    """Entities after one record each has joined: better names, a real category, and place and category of ``placing`` records."""
    j = joined.select("e_node", "e_j", *(F.col(c).alias(f"r_{c}") for c in ("source", "name", "category", "lat", "lon", "exact_id", "rank")))
    e = entities.join(j, ["e_node", "e_j"], "left")
    some = F.col("r_source").isNotNull()
    better = some & (F.col("r_rank") > F.col("head_rank")) & (F.coalesce("r_name", F.lit("")) != "")
    placed = some & (F.col("r_source") == placing) & (F.coalesce("r_category", F.lit("")) != "")
    category = F.when(placed, F.col("r_category")).when(some & ~_real(F.col("category")) & (F.coalesce("category", F.lit("")) != "") & _real(F.col("r_category")), F.col("r_category")).otherwise(F.col("category"))
    return e.select(
        "e_node", "e_j", F.when(better, F.col("r_name")).otherwise(F.col("name")).alias("name"), category.alias("category"), *(F.when(placed, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon")),
        F.coalesce("exact_id", "r_exact_id").alias("exact_id"), F.when(some, F.array_union("sources", F.array("r_source"))).otherwise(F.col("sources")).alias("sources"), "head_rank", "within",
    )


def resolve_entities(rows: DataFrame, authority: str = "authority", placing: str = "map", within: str | None = None) -> DataFrame:
    """Records of the same object across sources: ``id, entity_id, method, confidence, proposed``.

    ``rows`` has ``id`` (distinct), ``source, name, category, lat, lon, exact_id, rank, distance_m``. Records are looked at
    in order: those with an exact id first, then by rank (high first), distance, and their other columns. A record whose
    exact id an entity has joins it (``exact``, 100). Others, but for records of the ``authority`` with an exact id, look
    for entities within 180 m of fitting category (equal, or one is a wildcard) that have no record of their source yet:
    confidence is 75 * name + 25 * nearness, rounded, at least 88 from 0.88 within 120 m and 86 from 0.78 within 40 m;
    generic names are like none. The best from 86 on that leads by 6 is joined (``name_distance``). Else the record is an
    entity of its own (``single_source``, 100), with the two best from 80 on as ``proposed`` (entity_id, confidence).
    An entity takes the name of a record of higher rank than its first, a real category for ``wikidata_entity``, ``place``
    or ``infrastructure``, and category and place of ``placing`` records. ``entity_id`` is its first record's id. Records that differ
    in the column ``within`` (say, the search that found them), if it is given, never meet, be it by place or by exact id.

    Rounds of joins, no group in one task: a record is settled once no earlier open record can reach an entity that it
    can reach, that is none of another source within 360 m with a similar name, none beside a common candidate, and none of an
    exact id that occurs within 360 m. Equal records are one node, settled together once one of them stands alone. Records without coordinates
    only join by exact id. A record of any null column is a record like others.
    """
    scratch = Scratch(rows.sparkSession, "resolve")
    coarse = 1 if within is None else COARSE
    group = F.lit("") if within is None else F.coalesce(F.col(within).cast("string"), F.lit(""))
    rows = rows.select("id", group.alias("within"), *(F.col(c).cast(t).alias(c) for c, t in (("source", "string"), ("name", "string"), ("category", "string"), ("lat", "double"), ("lon", "double"), ("exact_id", "string"), ("rank", "int"), ("distance_m", "double"))))
    rows = rows.fillna({"source": "", "rank": 0}).withColumn("exact_id", F.when(F.col("exact_id").isNotNull(), F.struct("within", "exact_id")))
    nodes = scratch.keep(_nodes(rows), "nodes")
    side = lambda p: nodes.select("within", *(F.col(c).alias(f"{p}{c}") for c in ("node", "o", "source", "name", "lat", "lon", "exact_id")))
    near = dwithin_join(side("u_"), side("r_"), 2 * RADIUS_M, "u_lat", "u_lon", "r_lat", "r_lon", on=("within",), coarse=coarse)
    edges = scratch.keep(near.where((F.col("u_o") < F.col("r_o")) & (F.col("u_source") != F.col("r_source")) & (_alike(F.col("u_name"), F.col("r_name")) >= LEAST_NAME)).select(F.col("u_node").alias("u"), F.col("r_node").alias("node")), "edges")
    own = nodes.where("exact_id is not null").select("node", F.col("exact_id").alias("q"))
    by = scratch.keep(near.where("u_exact_id is not null").select(F.col("r_node").alias("node"), F.col("u_exact_id").alias("q")).unionByName(own).distinct(), "exact")
    busy = edges.select("node").unionByName(edges.select(F.col("u").alias("node"))).unionByName(by.select("node")).distinct()
    none = "cast(array() as array<struct<e_node: bigint, e_j: bigint, confidence: int>>)"
    act = ["node", "j", "n", "source", "name", "category", "lat", "lon", "exact_id", "rank", "within", "e_node", "e_j", "method", "confidence", "proposed"]
    alone = {"e_node": F.lit(None).cast("long"), "e_j": F.lit(None).cast("long"), "method": F.lit("single_source"), "confidence": F.lit(100)}
    acts = [nodes.join(busy, "node", "left_anti").withColumns({"j": F.lit(0).cast("long"), "proposed": F.expr(none)} | alone).select(*act)]
    open_ = scratch.keep(nodes.join(busy, "node").withColumn("j", F.lit(0).cast("long")), "open")
    entities = scratch.keep(_entity(open_.limit(0), 0), "entities")
    while not open_.isEmpty():
        other = entities.select("e_node", "e_j", F.col("name").alias("e_name"), F.col("category").alias("e_category"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "sources", "within")
        seen = dwithin_join(open_, other, RADIUS_M, extra=~F.array_contains("sources", F.col("source")), on=("within",), coarse=coarse)  # who has a record of the source stays out of reach
        seen = seen.withColumn("alike", _alike(F.col("name"), F.col("e_name"))).where(F.col("alike") >= LEAST_NAME)
        seen = scratch.keep(seen.select("node", "o", "source", "category", "exact_id", "e_node", "e_j", "e_category", "distance_m", "alike"), "seen")
        first = seen.groupBy("e_node", "e_j").agg(F.min("o").alias("least"))
        wait = edges.join(open_.select(F.col("node").alias("u")), "u").select("node")
        wait = wait.unionByName(seen.join(first, ["e_node", "e_j"]).where("o > least").select("node"))
        queue = open_.where("exact_id is not null").groupBy(F.col("exact_id").alias("q")).agg(F.min("o").alias("least"))
        wait = wait.unionByName(by.join(queue, "q").join(open_.select("node", "o"), "node").where("o > least").select("node"))
        ready = open_.join(wait.distinct(), "node", "left_anti")
        known = entities.where("exact_id is not null").groupBy("exact_id").agg(F.min(F.struct("e_node", "e_j")).alias("known"))
        fits = (~_real(F.col("e_category")) | ~_real(F.col("category")) | F.col("e_category").eqNullSafe(F.col("category")))
        may = F.col("exact_id").isNull() | (F.col("source") != authority)
        rated = seen.where(fits & may).withColumn("confidence", _confidence(F.col("alike"), F.col("distance_m"))).where(F.col("confidence") >= PROPOSE)
        place = Window.partitionBy("node").orderBy(F.desc("confidence"), "distance_m", "e_node", "e_j")
        two = rated.withColumn("k", F.row_number().over(place)).where("k <= 2").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "e_node", "e_j", "confidence"))).alias("two"))
        told = ready.join(known, "exact_id", "left").join(two, "node", "left").withColumn("best", F.get("two", F.lit(0)))
        leads = (F.col("best.confidence") >= ACCEPT) & F.coalesce(F.col("best.confidence") - F.get("two", F.lit(1))["confidence"] >= MARGIN, F.lit(True))
        exact, named = F.col("known").isNotNull(), F.coalesce(leads, F.lit(False))
        shown = F.when(exact | named, F.expr(none)).otherwise(F.coalesce(F.transform("two", lambda x: F.struct(x["e_node"], x["e_j"], x["confidence"])), F.expr(none)))
        told = told.withColumns({
            "method": F.when(exact, "exact").when(named, "name_distance").otherwise("single_source"), "confidence": F.when(~exact & named, F.col("best.confidence")).otherwise(100), "proposed": shown,
            **{c: F.when(exact, F.col(f"known.{c}")).when(named, F.col(f"best.{c}")) for c in ("e_node", "e_j")},
        })
        acted = scratch.keep(told.select(*act, "o", "distance_m"), "acted")
        acts.append(acted.select(*act))
        new, merged = acted.where("method = 'single_source'"), acted.where("method = 'name_distance'")
        grown = _grown(entities, acted.where("e_node is not null"), placing).unionByName(_entity(new, 0)).unionByName(_entity(new.where("exact_id is null and n > 1"), 1))  # of many equal entities two are enough to compete
        later = open_.join(acted.select("node"), "node", "left_anti").unionByName(merged.where("n > 1").withColumns({"n": F.col("n") - 1, "j": F.col("j") + 1}).select(*open_.columns))
        entities2, open2 = scratch.keep(grown, "entities"), scratch.keep(later, "open")
        scratch.drop(seen, entities, open_)
        entities, open_ = entities2, open2
    all_ = acts[0]
    for more in acts[1:]:
        all_ = all_.unionByName(more)
    # What was decided for a node's copies: by an exact id for all, by name for one; of those that stand alone, copies with an exact id join the first.
    one = (F.col("method") == "name_distance") | ((F.col("method") == "single_source") & F.col("exact_id").isNotNull())
    claims = all_.where("method = 'single_source' and exact_id is not null and n > 1").select("node", (F.col("j") + 1).alias("lo"), (F.col("j") + F.col("n")).alias("hi"), F.col("node").alias("e_node"), F.col("j").alias("e_j"), F.lit("exact").alias("method"), F.lit(100).alias("confidence"), F.expr(none).alias("proposed"))
    all_ = all_.select("node", F.col("j").alias("lo"), F.when(one, F.col("j") + 1).otherwise(F.col("j") + F.col("n")).alias("hi"), "e_node", "e_j", "method", "confidence", "proposed").unionByName(claims)
    named = rows.join(nodes.select("node", *(F.col(c).alias(f"n_{c}") for c in SAME)), _same())
    numbered = scratch.keep(named.select("id", "node", (F.row_number().over(Window.partitionBy("node").orderBy("id")) - 1).cast("long").alias("copy")), "numbered")
    out = numbered.join(all_, "node").where("copy >= lo and copy < hi")
    head = numbered.select(F.col("node").alias("e_node"), F.col("copy").alias("e_j"), F.col("id").alias("entity_id"))
    placed = out.join(head, ["e_node", "e_j"], "left").select("id", F.coalesce("entity_id", "id").alias("entity_id"), "method", "confidence", "proposed")
    ids = placed.where("size(proposed) > 0").select("id", F.posexplode("proposed").alias("k", "p")).select("id", "k", "p.*")
    ids = ids.withColumnRenamed("confidence", "c").join(head.withColumnRenamed("entity_id", "other"), ["e_node", "e_j"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "other", "c"))).alias("ranked"))
    shown = F.transform("ranked", lambda x: F.struct(x["other"].alias("entity_id"), x["c"].alias("confidence")))
    result = scratch.keep(placed.drop("proposed").join(ids, "id", "left").select("id", "entity_id", "method", "confidence", F.coalesce(shown, F.expr("cast(array() as array<struct<entity_id: bigint, confidence: int>>)")).alias("proposed")), "result")
    scratch.only(result)
    return result


def _same() -> Column:
    out = F.lit(True)
    for c in SAME:
        out = out & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    return out


def link_registry(entities: DataFrame, datasets: DataFrame, least: int = 55, notes_chars: int = 1200) -> DataFrame:
    """Entities and registry records that name them: ``entity_id, dataset_id, score, exact_title, title_contains, publisher_match, status``.

    ``entities`` has ``entity_id, name, aliases, operators`` (arrays), ``datasets`` ``dataset_id, title, notes, publisher``. An
    entity's terms are all its names. The score is 100 * the best of a term's likeness to the title, 0.75 of that to the
    notes' first characters, and 0.88 if an operator is like the publisher from 0.85; at least 96 if a term is the title,
    else 90 if the title contains a term of eight letters, and at least 88 if an operator is like the publisher from 0.82.
    ``probable`` from 90 on if one of the three holds, else ``candidate``. Pairs share a word of three letters, as in a search
    by words. Null names are none.
    """
    arrays = F.concat(*(F.coalesce(x, F.expr("cast(array() as array<string>)")) for x in (F.array("name"), F.col("aliases"), F.col("operators"))))
    term = entities.select("entity_id", F.explode(F.array_distinct(F.transform(arrays, lambda t: norm_name(t)))).alias("term")).where("term <> ''")
    run = entities.select("entity_id", F.explode("operators").alias("operator")).where("operator <> ''")
    d = datasets.select("dataset_id", "title", F.substring("notes", 1, notes_chars).alias("notes"), "publisher")
    words = lambda df, c, key: df.select(key, F.explode(F.array_distinct(F.filter(F.split(norm_name(c), " "), lambda w: F.length(w) > 2))).alias("w"))
    pairs = words(term, F.col("term"), "entity_id").distinct().join(words(d, F.concat_ws(" ", "title", "notes", "publisher"), "dataset_id"), "w").select("entity_id", "dataset_id").distinct()
    title = norm_name(F.col("title"))
    rated = pairs.join(term, "entity_id").join(d.drop("publisher"), "dataset_id").groupBy("entity_id", "dataset_id").agg(
        F.max(F.greatest(registry_similarity(F.col("term"), F.col("title")), 0.75 * registry_similarity(F.col("term"), F.col("notes")))).alias("best"),
        F.max(title == F.col("term")).alias("exact_title"), F.max((F.length("term") >= 8) & title.contains(F.col("term"))).alias("title_contains"),
    )
    shown = pairs.join(run, "entity_id").join(d.select("dataset_id", "publisher"), "dataset_id").groupBy("entity_id", "dataset_id").agg(F.max(registry_similarity(F.col("operator"), F.col("publisher"))).alias("run_by"))
    both = rated.join(shown, ["entity_id", "dataset_id"], "left").fillna(0.0, ["run_by"]).fillna(False, ["exact_title", "title_contains"])
    score = round_half_up(100 * F.greatest("best", F.when(F.col("run_by") >= 0.85, 0.88).otherwise(0.0)))
    score = F.when(F.col("exact_title"), F.greatest(score, F.lit(96.0))).when(F.col("title_contains"), F.greatest(score, F.lit(90.0))).otherwise(score)
    match = F.col("run_by") >= 0.82
    both = both.withColumn("publisher_match", match).withColumn("score", F.when(match, F.greatest(score, F.lit(88.0))).otherwise(score).cast("int")).where(F.col("score") >= least)
    sure = (F.col("score") >= 90) & (F.col("exact_title") | F.col("title_contains") | F.col("publisher_match"))
    return both.select("entity_id", "dataset_id", "score", "exact_title", "title_contains", "publisher_match", F.when(sure, "probable").otherwise("candidate").alias("status"))
