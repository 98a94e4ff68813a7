"""Review of evidence: proposals, a queue that merges them while an item is pending, actions in order, and what they say of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .grid import nearest

#: Why a place status is looked at and how urgent that is; ranks of urgency; what an action may set.
PLACE_REASONS = {"foreign_location_signal": ("foreign_location_signal", "high"), "other_known_place": ("location_mismatch", "medium"), "none": ("weak_location_support", "low")}
SEVERITIES = {"high": 3, "medium": 2, "low": 1}
ACTIONS = ("accepted", "rejected", "needs_more_evidence")

ITEM = ["kind", "key", "reason"]
PROPOSED = ["event_id", "severity", "title", "context"]
QUEUE = [*ITEM, *PROPOSED, "status", "reviewer", "note", "reviewed_at", "created_at", "updated_at"]


def _mapped(c: Column, table: dict) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, v)
    return out


def propose_reviews(places: DataFrame, divergences: DataFrame) -> DataFrame:
    """What to look at: ``kind, key, reason, event_id, severity, title, context`` (JSON), one row an item and reason.

    ``places`` has ``item, event_id, title, provider, published_at, geo_status, geo_score``: items that their text puts
    abroad, elsewhere or nowhere. ``divergences`` has ``id, event_id, type, value, value2, status``: those unresolved.
    Of several rows for one item and reason the smallest stays.
    """
    status = F.col("geo_status")
    one = places.where(status.isin(*PLACE_REASONS)).select(
        F.lit("semantic_item").alias("kind"), F.col("item").cast("string").alias("key"), _mapped(status, {k: v[0] for k, v in PLACE_REASONS.items()}).alias("reason"), "event_id",
        _mapped(status, {k: v[1] for k, v in PLACE_REASONS.items()}).alias("severity"), F.left(F.col("title"), F.lit(240)).alias("title"),
        F.to_json(F.struct("provider", "published_at", "geo_status", F.coalesce(F.col("geo_score").cast("int"), F.lit(0)).alias("geo_score"))).alias("context"),
    )
    two = divergences.where("status = 'unresolved'").select(
        F.lit("divergence").alias("kind"), F.col("id").cast("string").alias("key"), F.lit("numeric_claim_divergence").alias("reason"), "event_id", F.lit("medium").alias("severity"),
        F.concat(F.lit("Numeric claim divergence: "), "type").alias("title"), F.to_json(F.struct(F.col("type").alias("claim_type"), "value", "value2")).alias("context"),
    )
    return one.unionByName(two).groupBy(*ITEM).agg(F.min(F.struct(*PROPOSED)).alias("p")).select(*ITEM, "p.*")


def merge_reviews(queue: DataFrame | None, proposals: DataFrame, at: Column) -> DataFrame:
    """The queue (columns ``QUEUE``; None: none yet) with the proposals of time ``at``.

    Items that are new start as ``pending``. Of those pending the context is renewed and ``updated_at`` set, the rest stays as it
    was first proposed; items that were acted upon keep all they have, and so do items that are proposed no more.
    """
    fresh = proposals.select(*ITEM, F.struct(*PROPOSED).alias("new"))
    none = lambda kind: F.lit(None).cast(kind)
    if queue is None:
        return fresh.select(*ITEM, "new.*", F.lit("pending").alias("status"), none("string").alias("reviewer"), none("string").alias("note"), none("timestamp").alias("reviewed_at"), at.alias("created_at"), at.alias("updated_at"))
    rest = [c for c in QUEUE if c not in ITEM]
    j = queue.select(*ITEM, F.struct(*rest).alias("old")).join(fresh, ITEM, "full")
    known, renewed = F.col("old").isNotNull(), F.col("new").isNotNull() & (F.col("old.status") == "pending")
    keep = lambda c, new: F.when(known, F.col(f"old.{c}")).otherwise(new).alias(c)
    touched = lambda c, new: F.when(known & ~renewed, F.col(f"old.{c}")).otherwise(new).alias(c)
    return j.select(
        *ITEM, *(keep(c, F.col(f"new.{c}")) for c in ("event_id", "severity", "title")), touched("context", F.col("new.context")), keep("status", F.lit("pending")),
        keep("reviewer", none("string")), keep("note", none("string")), keep("reviewed_at", none("timestamp")), keep("created_at", at), touched("updated_at", at),
    )


def _tidy(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def refused_actions(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """``action_id, error``: actions whose status is none of ``ACTIONS``, or whose item is not in the queue."""
    valid = F.coalesce(F.col("status").isin(*ACTIONS), F.lit(False))
    j = actions.select(*ITEM, "action_id", "status").join(queue.select(*ITEM, F.lit(True).alias("known")), ITEM, "left")
    error = F.when(~valid, "invalid_status").when(F.col("known").isNull(), "review_not_found")
    return j.select("action_id", error.alias("error")).where("error is not null")


def apply_reviews(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """The queue after the actions (``action_id, kind, key, reason, status, reviewer, note, at``) in order of time, then id.

    The last valid action on an item decides, whatever the item's status; what is only white space in ``reviewer`` and
    ``note`` is null. :func:`refused_actions` names the others, :func:`review_history` all that were taken.
    """
    done = actions.where(F.col("status").isin(*ACTIONS)).groupBy(*ITEM).agg(F.max_by(F.struct("status", _tidy("reviewer").alias("reviewer"), _tidy("note").alias("note"), "at"), F.struct("at", "action_id")).alias("a"))
    j = queue.join(done, ITEM, "left")
    acted = F.col("a").isNotNull()
    new = {"status": "status", "reviewer": "reviewer", "note": "note", "reviewed_at": "at", "updated_at": "at"}
    return j.select(*(F.when(acted, F.col(f"a.{new[c]}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in QUEUE))


def review_history(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """The actions taken, each with its place in its item's order and the status it found (the queue's before the first)."""
    j = actions.where(F.col("status").isin(*ACTIONS)).join(queue.select(*ITEM, F.col("status").alias("found")), ITEM)
    order = Window.partitionBy(*ITEM).orderBy("at", "action_id")
    return j.select(*ITEM, "action_id", "at", F.row_number().over(order).alias("step"), F.coalesce(F.lag("status").over(order), "found").alias("before"), F.col("status").alias("after"))


def reviewed_statements(statements: DataFrame, queue: DataFrame) -> DataFrame:
    """``statements`` (``kind, key, item``) with ``review_status``: that of the last action on the statement or on its item, else ``unreviewed``.

    A queue row of the kinds ``claim``, ``entity`` and ``event_link`` speaks of the statement with its key, one of the kind
    ``semantic_item`` of all statements taken from that item.
    """
    acted = queue.where("reviewed_at is not null").select("kind", "key", F.struct("reviewed_at", "reason", "status").alias("a"))
    own = acted.where(F.col("kind").isin("claim", "entity", "event_link")).groupBy("kind", "key").agg(F.max("a").alias("own"))
    of_item = acted.where("kind = 'semantic_item'").groupBy(F.col("key").alias("item")).agg(F.max("a").alias("of_item"))
    j = statements.withColumn("item", F.col("item").cast("string")).join(own, ["kind", "key"], "left").join(of_item, "item", "left")
    return j.withColumn("review_status", F.coalesce(F.greatest("own", "of_item")["status"], F.lit("unreviewed"))).select(*statements.columns, "review_status")


def pending_reviews(queue: DataFrame, limit: int = 20, event: str | None = None) -> DataFrame:
    """The most urgent pending items, oldest first among equals; ``limit`` is held within 1 and 100, ``event`` is one event's id."""
    rows = queue.where("status = 'pending'")
    rows = rows if event is None else rows.where(F.col("event_id") == event)
    return rows.orderBy(F.desc(F.coalesce(_mapped(F.col("severity"), SEVERITIES), F.lit(1))), "created_at", *ITEM).limit(max(1, min(limit, 100)))


def review_summary(statements: DataFrame, queue: DataFrame) -> DataFrame:
    """Per event the statements by kind, independent and reviewed ones, pending reviews and urgent ones, and statements by extractor version.

    ``statements`` has ``event_id, kind, independent, review_status, version``; an event in either table has a row.
    """
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("claim", "claims"), ("entity", "entities"), ("event_link", "event_links"))]
    of = statements.groupBy("event_id").agg(F.count("*").alias("statements"), *kinds, F.count_if("independent").alias("independent"), F.count_if(F.col("review_status") != "unreviewed").alias("reviewed"))
    each = statements.groupBy("event_id", "version").agg(F.count("*").alias("statements"))
    versions = each.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("version", "statements"))).alias("versions"))
    open_ = queue.where("status = 'pending'").groupBy("event_id").agg(F.count("*").alias("pending"), F.count_if(F.col("severity") == "high").alias("high_priority"))
    out = of.join(versions, "event_id").join(open_, "event_id", "full")
    counts = ["statements", "claims", "entities", "event_links", "independent", "reviewed", "pending", "high_priority"]
    return out.fillna(0, counts).select("event_id", *counts, "versions")
