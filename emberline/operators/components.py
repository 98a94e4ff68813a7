"""Connected components of an edge table, by rounds of min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge.

    ``edges`` has ``src`` and ``dst`` (long; either direction, repeats and loops allowed). Returns ``node`` and
    ``component``. Each round takes the smallest label among a vertex and its neighbours (a map-side combined
    minimum), tells it to the vertex that gave the old label, so that a whole group moves as one, then follows labels of
    labels: a chain of length n needs about log n rounds, in whatever order its vertices are numbered. Labels are tables
    in the shared folder, never on the driver; a round's table goes once the next is written. Null ends are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    pairs = pairs.where("a is not null and b is not null and a <> b")
    both = scratch.keep(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    start = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = scratch.keep(start.select("node", F.col("node").alias("old"), F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        told = labels.join(heard, labels.node == heard.a).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("lab"))
        least = told.where("lab < old").select(F.col("old").alias("node"), "lab").unionByName(told.select("node", "lab")).groupBy("node").agg(F.min("lab").alias("lab"))
        hooked = least.join(labels, "node").select("node", F.col("component").alias("old"), "lab")
        root = labels.select(F.col("node").alias("lab"), F.col("component").alias("up"))
        new = scratch.keep(hooked.join(root, "lab", "left").select("node", "old", F.least("lab", F.coalesce("up", "lab")).alias("component")), "labels")
        scratch.drop(labels)
        labels = new
        if new.where("component <> old").isEmpty():
            scratch.drop(both)
            return labels.select("node", "component")
    raise RuntimeError("components did not settle")
