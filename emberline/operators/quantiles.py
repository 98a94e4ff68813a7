"""Exact quantiles of groups of any size: a sketch brackets the wanted ranks, and only values within the brackets are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut

#: The sketch is wrong by at most one rank in ``ACCURACY``; brackets reach 20 times as far to either side. Groups of fewer than
#: ``SMALL`` values, in which that is no whole rank or two, are ordered as they are.
ACCURACY, REACH, SMALL = 10_000, 0.002, 2_048


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], count: str | None = None) -> DataFrame:
    """Per group its ``keys`` and, by name, the quantiles of ``value``, linear between neighbours, and the number of values as ``count``.

    One pass sketches each group (map-side combined), which gives a bracket of values about each wanted rank. A second
    counts: values outside all brackets collapse, map-side, to one row for each stretch between brackets, those inside to
    one row a distinct value. Running sums over the stretches (two a point) tell which bracket holds a rank, and only a
    bracket's values are ordered, some 0.4 % of a large group. An outlier or a long tail changes nothing, as brackets
    follow ranks. The counts are checkpointed, so values are read twice. Null values and null keys are left out.
    """
    one = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = [min(max(p + side * REACH, 0.0), 1.0) for p in points.values() for side in (-1, 1)]
    sketch = one.groupBy(*keys).agg(F.percentile_approx("_v", ends, ACCURACY).alias("_ends"), F.count("*").alias("_total"))
    all_ = F.col("_total") < SMALL
    past = sum((((F.col("_v") > F.col("_ends")[i]) if i % 2 else (F.col("_v") >= F.col("_ends")[i])).cast("int") for i in range(len(ends))), F.lit(0))
    within = F.lit(False)
    for i in range(0, len(ends), 2):
        within = within | F.col("_v").between(F.col("_ends")[i], F.col("_ends")[i + 1])
    placed = one.join(sketch, keys).select(*keys, "_total", F.when(all_, 0).otherwise(past).alias("_b"), F.when(all_ | within, F.col("_v")).alias("_v"))
    counts = cut(placed.groupBy(*keys, "_total", "_b", "_v").agg(F.count("*").alias("_n")))
    before = lambda *by: Window.partitionBy(*keys, *by).orderBy("_b" if not by else "_v").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*keys, "_b", "_total").agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before()), F.lit(0)))
    place = lambda p: F.lit(p) * (F.col("_total") - 1)
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(part).alias("part"), f(place(p)).alias("rank"), (place(p) - F.floor(place(p))).alias("share")) for name, p in points.items() for part, f in (("low", F.floor), ("high", F.ceil))))
    hits = sums.select(*keys, "_b", "_before", "_n", F.explode(wanted).alias("w")).where("w.rank >= _before and w.rank < _before + _n")
    hits = hits.groupBy(*keys, "_b", "_before").agg(F.collect_list("w").alias("_w"))  # two a point at most
    inner = counts.join(hits, [*keys, "_b"]).withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(before("_b")), F.lit(0)))
    met = inner.select(*keys, "_total", "_v", F.explode(F.filter("_w", lambda w: (w["rank"] >= F.col("_first")) & (w["rank"] < F.col("_first") + F.col("_n")))).alias("w"))
    met = met.withColumn("_v", F.when(F.col("_v").isNull(), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col("_v")))
    at = lambda name, part: F.max(F.when((F.col("w.name") == name) & (F.col("w.part") == part), F.col("_v")))
    between = lambda name: at(name, "low") + (at(name, "high") - at(name, "low")) * F.max(F.when(F.col("w.name") == name, F.col("w.share")))
    out = met.groupBy(*keys).agg(*(between(name).alias(name) for name in points), F.max("_total").alias("_total"))
    return out.withColumnRenamed("_total", count) if count else out.drop("_total")
