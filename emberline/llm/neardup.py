"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard.

1. Every text becomes the set of its 5-word shingles' 63-bit hashes; its k smallest are its sketch. Texts with equal
   sets (a 128-bit sum of the set tells) are one class with a number of its own and its smallest id's text as
   representative, whether or not ids are null or shared; copies go no further.
2. A representative may lack few values of a linked one's sketch: at most ``m`` (:func:`_lacks`), the hypergeometric
   mean plus seven standard deviations at the threshold (below 1e-8 a link at k = 64), and never more than an estimate
   of ``estimate`` allows. Who holds more values that no other sketch has is linked with none and drops out; the others'
   ``m`` + 1 least frequent values, of which a linked sketch shares one that is among its own, make the inverted lists.
3. Lists of up to ``list_size`` give all their pairs. A pair passes if its union sketch holds at least ``estimate``
   shared values of k, and is then decided on the full sets; sets within k are decided by their sketches.
4. A longer list is not paired. Its pivot is the member in most long lists; every member is verified against the pivot
   on the full sets, and members that are not linked with it meet others through the elements by which they differ from
   the pivot, or through all their elements if they lie far from it (:func:`_around_pivots`). That verification is
   exact and complete, so a long list loses no link, while a group of n near copies costs about n comparisons.
5. Components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import Scratch
from .memory import let_go
from .text import as_bytes, byte_slices, mix, named_apart, shingle_sets

SLICE = 900_000  # bytes of text that a task turns into sets at once
SKETCH = "doc_id long, text_key long, n long, fp_a long, fp_b long, sketch array<long>"


def sketches(docs: DataFrame, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hash of the text, set size, 128-bit fingerprint of the set and sketch of every whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for rows in byte_slices(batch, 1, SLICE):
                sets = shingle_sets(as_bytes(rows.column(1)))
                a = [int(mix(s).sum(dtype=np.uint64)) for s in sets]
                b = [int(mix(s ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64)) for s in sets]
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), signed(a), signed(b), pa.array([s[:k].astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "fp_a", "fp_b", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(run, SKETCH)


def _similar_sizes(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _lacks(percent: int, k: int, estimate: float) -> str:
    """The most values of the sketch of a set of ``n`` that the sketch of a linked set does not hold.

    Sketches of equal size differ by as many values on either side: by those, below the lower cut, of one set that the
    other set lacks. The larger set has at most n * 100 / percent elements, of which it lacks the given share, and its
    sketch is a sample of k of them without replacement.
    """
    n, miss = f"(n * 100 / {percent})", 1 - percent / 100
    spread = f"sqrt({k * miss * (1 - miss)} * greatest({n} - {k}, 0) / greatest({n} - 1, 1))"
    return f"cast(least(floor({miss:.4f} * {n} + 1e-6), ceil({k * miss:.4f} + 7 * {spread}), {int(k * (1 - estimate))}) as int)"


def _multiple(scratch: Scratch, values: DataFrame) -> DataFrame:
    """``values`` (rep, value) with the number ``c`` of rows of each value that occurs more than once.

    The counts are a table, one row a value, so a value that a third of all rows hold is joined from split partitions.
    """
    counts = scratch.keep(values.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    return values.join(counts, "value")


def _lists(scratch: Scratch, reps: DataFrame, percent: int, k: int, estimate: float) -> DataFrame:
    """The inverted lists: (value, rep, n) of the least frequent values of all representatives that may have a link."""
    sized = reps.select("rep", "n", F.size("sketch").alias("size"), F.expr(_lacks(percent, k, estimate)).alias("m"))
    kept = [df for df, _ in scratch.paths.values()]
    first = _multiple(scratch, reps.select("rep", F.explode("sketch").alias("value")))
    common = first.groupBy("rep").agg(F.collect_list("value").alias("values"))  # at most k
    open_ = scratch.keep(sized.join(common, "rep").where("size - size(values) <= m"), "open")
    again = _multiple(scratch, open_.select("rep", F.explode("values").alias("value")))
    ranked = again.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("ranked"))
    ranked = open_.join(ranked, "rep").withColumn("alone", F.expr("size - size(ranked)")).where("alone <= m")
    lists = scratch.keep(ranked.select("rep", "n", F.explode(F.slice("ranked", F.lit(1), F.expr("m + 1 - alone"))).alias("x")).select(F.col("x.value").alias("value"), "rep", "n"), "lists")
    scratch.only(*kept, lists)
    return lists


def _texts(need: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The texts of the representatives ``rep`` of ``need``, found by id and a hash of the text, as ``id`` and ``text``."""
    at = need.join(heads, "rep")
    found = docs.join(at, docs["id"].eqNullSafe(at["first_id"]) & (F.xxhash64(docs["text"]) == at["first_key"]))
    return found.select(at["rep"].alias("id"), docs["text"]).dropDuplicates(["id"])


def _sides(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    text = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(text(a), a).join(text(b), b).select(a, b, f"text_{a}", f"text_{b}")


def _links(scratch: Scratch, pairs: DataFrame, reps: DataFrame, docs: DataFrame, heads: DataFrame, k: int, percent: int, estimate: float) -> DataFrame:
    """The pairs (a, b) of representatives that are linked, exactly."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)).withColumn("i", F.array_intersect("s_a", "s_b"))
    small = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    whole = F.size("i") * 100 >= percent * (F.size("s_a") + F.size("s_b") - F.size("i"))
    near = F.size(F.array_intersect("i", "u")) >= estimate * F.size("u")
    judged = scratch.keep(both.where(F.when(small, whole).otherwise(near)).select("a", "b", small.alias("sure")), "judged")
    sure, open_ = judged.where("sure").select("a", "b"), judged.where("not sure").select("a", "b")
    texts = scratch.keep(_texts(open_.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, heads), "texts")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for rows in byte_slices(batch, 3, SLICE):
                keep = []
                for x, y in zip(as_bytes(rows.column(2)), as_bytes(rows.column(3)), strict=True):
                    x, y = shingle_sets([x, y])
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = scratch.keep(sure.unionByName(_sides(open_, texts, "a", "b").mapInArrow(exact, "a long, b long")), "links")
    scratch.drop(texts, judged)
    return links


PLACED = "pivot long, near boolean, rep long, n long, d long, linked boolean, items array<long>"


def _around_pivots(scratch: Scratch, lists: DataFrame, docs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The links among the members of long lists, exactly, but for pairs that are both linked with their list's pivot.

    With D(x) the symmetric difference of x's set and the pivot's, two sets differ by |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    elements, and are linked if that is at most r = (100 - percent) / (100 + percent) of their sizes together. So they
    share elements of their differences, and of the rarest of these: of two with |D(x)| >= |D(y)|, y holds at most half
    of r (n + m) and x at most all of it that the other lacks, so with the elements in order of frequency one of the
    first that many and one is shared. With the empty set for a pivot the same holds of the whole sets. Members with
    2 d <= n are near the pivot; one linked with such a member has 100 d <= (150 - percent) n * 100 / percent and is
    compared around the pivot too, others around the empty set.
    """
    plus, minus = 100 + percent, 100 - percent
    h = lists.groupBy("rep").agg(F.count("*").alias("h"))
    named = lists.join(h, "rep")
    top = named.groupBy("value").agg(F.max(F.struct("h", (-F.col("rep")).alias("r"), "rep")).alias("p")).select("value", F.col("p.rep").alias("pivot"))
    sides = scratch.keep(lists.join(scratch.keep(top, "pivots"), "value").select("pivot", "rep").distinct(), "sides")
    texts = scratch.keep(_texts(sides.select(F.explode(F.array("pivot", "rep")).alias("rep")).distinct(), docs, heads), "texts")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last, held = None, None
        for batch in batches:
            for rows in byte_slices(batch, 3, SLICE):
                out: list[tuple] = []
                pivots, reps = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                sets = shingle_sets(as_bytes(rows.column(3)))
                for i, (p, x, s) in enumerate(zip(pivots, reps, sets, strict=True)):
                    if p != last:
                        last, held = p, shingle_sets(as_bytes(rows.column(2).slice(i, 1)))[0]
                    gap, n = np.setxor1d(s, held, assume_unique=True).astype(np.int64), len(s)
                    d = len(gap)
                    if percent * d <= (150 - percent) * n:
                        out.append((p, True, x, n, d, plus * d <= minus * (n + len(held)), gap))
                    if 2 * d > n:
                        out.append((p, False, x, n, n, False, s.astype(np.int64)))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], [c.split()[0] for c in PLACED.split(", ")])

    placed = scratch.keep(_sides(sides, texts, "pivot", "rep").mapInArrow(differ, PLACED), "differences")
    scratch.drop(texts, sides)
    direct = placed.where("linked and pivot <> rep").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
    key = ["pivot", "near", "item"]
    item = placed.select("pivot", "near", "rep", "n", "d", "linked", F.explode("items").alias("item"))
    counts = scratch.keep(item.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1"), "items")
    ranked = item.join(counts, key).groupBy("pivot", "near", "rep").agg(*(F.first(c).alias(c) for c in ("n", "d", "linked")), F.array_sort(F.collect_list(F.struct("c", "item"))).alias("ranked"))
    most = F.floor(F.col("n") * minus / percent + 1e-6).cast("int")  # elements that a linked set with a smaller difference lacks
    ranked = ranked.withColumn("alone", F.col("d").cast("int") - F.size("ranked")).withColumn("half", F.floor(F.col("n") * minus / (2 * percent) + 1e-6).cast("int"))
    ranked = ranked.where(F.col("alone") <= most).withColumn("most", most)
    first = scratch.keep(ranked.select("pivot", "near", "rep", "n", "d", "linked", "alone", "half", F.posexplode(F.expr("slice(ranked, 1, most + 1 - alone)")).alias("at", "x")).selectExpr("pivot", "near", "rep", "n", "d", "linked", "half", "alone + at as place", "x.item as item"), "first")
    x, y = (first.select(*key, *(F.col(c).alias(f"{p}{c}") for c in ("rep", "n", "d", "linked", "half", "place"))) for p in ("x_", "y_"))
    lacks = f"({plus} * (x_d + y_d) - {minus} * (x_n + y_n))"
    fits = f"{2 * plus} * least(x_d - x_place, y_d - y_place) >= {lacks} and not (x_linked and y_linked) and " + _similar_sizes("x_n", "y_n", percent)
    met = x.join(y.where("y_place <= y_half"), key).where(f"(x_d > y_d or (x_d = y_d and x_rep > y_rep)) and {fits}").select("pivot", "near", "x_rep", "y_rep")
    whole = lambda p: placed.select("pivot", "near", *(F.col(c).alias(f"{p}{c}") for c in ("rep", "n", "d", "items")))
    both = met.distinct().join(whole("x_"), ["pivot", "near", "x_rep"]).join(whole("y_"), ["pivot", "near", "y_rep"])
    close = both.where(f"{2 * plus} * size(array_intersect(x_items, y_items)) >= {lacks}").select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))
    links = scratch.keep(direct.unionByName(close).distinct(), "links")
    scratch.drop(placed, first, counts)
    return links


def _judged(docs: DataFrame, percent: int = 85, k: int = 64, list_size: int = 16, estimate: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`near_duplicates` gives, with ``text_key``, a hash of the row's text."""
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = scratch.keep(sketches(rows, k, "id", "text"), "sketches")
    key = ["fp_a", "fp_b", "n"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    grouped = table.where("n > 0").groupBy(*key).agg(first.alias("f"), F.first("sketch").alias("sketch"))  # equal sets, equal sketches
    classes = scratch.keep(grouped.select(*key, F.monotonically_increasing_id().alias("rep"), F.col("f.id").alias("first_id"), F.col("f.key").alias("first_key"), "sketch"), "classes")
    heads, reps = classes.select("rep", "first_id", "first_key"), classes.select("rep", "n", "sketch")
    lists = _lists(scratch, reps, percent, k, estimate)
    counts = scratch.keep(lists.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "lengths")
    rare = lists.join(counts.where(F.col("c") <= list_size), "value")
    x, y = rare.select("value", F.col("rep").alias("a"), F.col("n").alias("p")), rare.select("value", F.col("rep").alias("b"), F.col("n").alias("q"))
    pairs = scratch.keep(x.join(y, "value").where("a < b and " + _similar_sizes("p", "q", percent)).select("a", "b").distinct(), "pairs")
    edges = _links(scratch, pairs, reps, rows, heads, k, percent, estimate)
    scratch.drop(pairs)
    crowd = scratch.keep(lists.join(counts.where(F.col("c") > list_size), "value").select("value", "rep"), "crowd")
    if not crowd.isEmpty():
        edges = edges.unionByName(_around_pivots(scratch, crowd, rows, heads, percent))
    labels = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    scratch.only(table, classes)  # the result reads no other
    placed = classes.drop("sketch").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("first_key").alias("key")))
    named = placed.join(placed.groupBy("component").agg(best.alias("best")), "component").select(*key, "best")
    out = table.select("doc_id", "text_key", *key).join(named, key, "left")
    linked = F.col("best").isNotNull()
    kept = ~linked | (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.key")))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(linked, F.col("best.id")).otherwise(F.col("doc_id")).alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 64, list_size: int = 16, estimate: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicate texts: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two texts are linked if 100 * shared >= ``percent`` * united shingles. Words are runs of bytes other than ASCII
    white space, A-Z lowered; fewer than five make one shingle, none an empty set that nothing is linked with.
    ``component_id`` is the smallest id reachable, null if there is none. Rows that share an id or have none are
    documents of their own, told apart by their texts. ``kept`` marks one text of each component: of the rows with the
    smallest id the one with the smallest hash; rows that repeat its id and text are marked too. Other columns of
    ``docs`` play no part; an empty table gives an empty result.
    """
    return _judged(docs, percent, k, list_size, estimate, id_col, text_col).drop("text_key")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One document of each group of near duplicates (the smallest id), all columns as they are; repeated rows once.

    Of rows that share the kept id and text one stays. Rows without words are kept, one for each id and text.
    """
    key = named_apart(docs.columns, "_text_key")
    kept = _judged(docs, id_col=id_col, text_col=text_col, **limits).where("kept").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct().alias("k")
    keyed: DataFrame = docs.withColumn(key, F.xxhash64(text_col)).alias("d")
    own: Column = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.id")) & (F.col(f"d.{key}") == F.col("k.key"))
    return keyed.join(kept, own, "left_semi").dropDuplicates([id_col, key]).drop(key)
