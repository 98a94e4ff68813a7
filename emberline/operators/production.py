"""Audits with limits by source family: coverage, anomalies and findings of unsent events; counts for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros
from .events import _hours

#: Metrics of an assessment: mark, what counts as abnormal, factor of p10 or p90, least spread, least median.
METRICS = {
    "fetched": ("low_feed", "low", 0.70, 5.0, 20.0),
    "recent": ("low_recent_feed", "low", 0.60, 5.0, 30.0),
    "worker": ("high_worker_lag", "high", 1.5, 2.0, 0.0),
    "upstream": ("high_upstream_lag", "high", 1.5, 5.0, 0.0),
    "delay": ("high_ingestion_delay", "high", 1.5, 5.0, 0.0),
}


def coverage(det: DataFrame, limits: DataFrame, runs: DataFrame, registry: DataFrame, as_of, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One row a source of ``limits``: counts at 1, 6 and 24 hours by acquisition, ages of worker and upstream, status, activity.

    ``limits`` (a stated list of sources) has ``source, family, worker_min, upstream_min``; ``runs`` has ``source,
    success_at, fetched, upstream_at, last_error``; ``registry`` has ``source, max_date``. ``prefixes`` maps the start
    of a detection's source to the listed one. Only polar sources can be empty or behind their registry.
    """
    at = F.lit(as_of)
    seen = det.groupBy("source").agg(*(F.count_if(F.col("acq") >= at - _hours(h)).alias(f"n_{h}h") for h in (1, 6, 24)), F.max("acq").alias("latest_acq"))
    mapped = F.coalesce(*(F.when(F.col("source").startswith(p), F.lit(s)) for p, s in (prefixes or {}).items()), F.col("source"))
    seen = seen.withColumn("source", mapped).groupBy("source").agg(*(F.sum(c).alias(c) for c in ("n_1h", "n_6h", "n_24h")), F.max("latest_acq").alias("latest_acq"))
    last = runs.groupBy("source").agg(F.max_by(F.struct("success_at", "fetched", "upstream_at", "last_error"), F.struct("success_at", "fetched")).alias("r")).select("source", "r.*")
    dated = registry.groupBy("source").agg(F.max("max_date").alias("max_date"))
    j = limits.join(seen, "source", "left").join(last, "source", "left").join(dated, "source", "left").fillna(0, ["n_1h", "n_6h", "n_24h"])
    age = lambda c: F.round((micros(at) - micros(c)) / 6e7, 1)
    j = j.withColumn("worker_age_min", age("success_at")).withColumn("upstream_age_min", age("upstream_at"))
    polar = F.col("family") == "polar"
    status = (
        F.when(F.col("last_error").isNotNull(), "error").when(F.col("success_at").isNull(), "unknown").when(F.col("worker_age_min") > F.col("worker_min"), "stale")
        .when(F.col("upstream_age_min") > F.col("upstream_min"), "source_lag").when(polar & (F.col("fetched") == 0), "empty_fetch")
        .when(polar & (F.col("max_date") < F.date_sub(at.cast("date"), 1)), "source_lag").otherwise("active")
    )
    activity = F.when(F.col("latest_acq").isNull(), "unknown").when(F.col("n_24h") == 0, "quiet").otherwise("observed")
    return j.withColumn("status", status).withColumn("activity", activity).select("source", "family", "n_1h", "n_6h", "n_24h", "worker_age_min", "upstream_age_min", "status", "activity")


def assess(current: DataFrame, base: DataFrame, prev: DataFrame) -> DataFrame:
    """States of current values against baselines; all columns of ``current`` stay, so a history by hour works as well.

    ``current`` has ``source, family, status`` and any of the columns of ``METRICS``; ``base`` has ``source, metric,
    median, mad, p10, p90, ready``; ``prev`` has ``source, streak``. A polar source learns until its feed baseline is
    ready, others until the upstream one is.
    """
    one = F.struct("metric", F.struct("median", "mad", "p10", "p90", "ready").alias("b"))
    j = current.join(base.groupBy("source").agg(F.map_from_entries(F.collect_list(one)).alias("_m")), "source", "left").join(prev.select("source", F.col("streak").alias("_s")), "source", "left")
    ready = lambda m: F.coalesce(F.col("_m")[m]["ready"], F.lit(False))
    marks = {"source_health": F.col("status") != "active"}
    for m, (mark, side, factor, spread, least) in METRICS.items():
        if m in current.columns:
            b = F.col("_m")[m]
            wide, mid = 4 * F.greatest(F.coalesce(b["mad"], F.lit(0.0)), F.lit(spread)), F.coalesce(b["median"], F.lit(0.0))
            low = (F.col(m) < F.least(F.coalesce(b["p10"], F.col(m)) * factor, mid - wide)) & (mid >= least)
            marks[mark] = ready(m) & (low if side == "low" else F.col(m) > F.greatest(F.coalesce(b["p90"], F.lit(0.0)) * factor, mid + wide))
    j = j.withColumn("reasons", F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in marks.items())), lambda x: x.isNotNull()))
    known, before, bad = F.when(F.col("family") == "polar", ready("fetched")).otherwise(ready("upstream")), F.coalesce("_s", F.lit(0)), F.size("reasons") > 0
    state = F.when(~known, "learning").when(~bad, "normal").when(before >= 1, "anomaly").otherwise("watch")
    return j.withColumn("state", state).withColumn("streak", F.when(known & bad, before + 1).otherwise(0)).drop("_m", "_s")


def findings(events: DataFrame, det: DataFrame, queue: DataFrame, as_of, polar: list[str], mtg: str, slstr: str) -> DataFrame:
    """Unsent events that are not closed, by class and severity, with their sources; events without detections are left out.

    ``events`` has ``event_id, status, required, sent``; ``queue`` has ``event_id, sync_reason, eligible_at``. Fresh
    means acquired within 24 hours; ``slstr`` is the start of a source's name.
    """
    at = F.lit(as_of)
    fresh = F.col("acq") >= at - _hours(24)
    kinds = {"polar": F.col("source").isin(*polar), "mtg": F.col("source") == mtg, "slstr": F.col("source").startswith(slstr)}
    per = det.groupBy("event_id").agg(*(F.bool_or(fresh & c).alias(k) for k, c in kinds.items()), F.max("acq").alias("last"), F.count("*").alias("detections"), F.array_sort(F.collect_set("source")).alias("sources"))
    j = events.where("status <> 'closed' and not sent").join(per, "event_id").join(queue, "event_id", "left")
    late = F.col("required") & (F.col("sync_reason") == "new") & (F.col("eligible_at") < at - _hours(0.75))
    held = ~F.col("required")
    kind = (
        F.when(held & F.col("polar"), "notification_gap").when(late, "delivery_backlog").when(held & F.col("mtg") & F.col("slstr"), "support_only_several").when(held & F.col("mtg"), "support_only_geostationary")
        .when(held & F.col("slstr"), "support_only_slstr").when(held & (F.col("last") < at - _hours(24)), "historical_suppressed").when(held, "other_suppressed")
    )
    severity = F.when(F.col("kind") == "notification_gap", "error").when(F.col("kind") == "delivery_backlog", "warning").otherwise("info")
    return j.withColumn("kind", kind).where("kind is not null").withColumn("severity", severity).select("event_id", "kind", "severity", "sources", "detections")


def admin_summary(events: DataFrame, as_of) -> DataFrame:
    """One row: events first seen and touched within 24 hours, and those whose notice is still due."""
    new = lambda c: F.count_if(F.col(c) >= F.lit(as_of) - _hours(24))
    return events.agg(F.count("*").alias("events"), new("first_seen").alias("new_24h"), new("last_seen").alias("touched_24h"), F.count_if(F.col("required") & ~F.col("sent")).alias("pending"))


def cache_health(events: DataFrame, caches: dict[str, DataFrame]) -> DataFrame:
    """For each enrichment cache (``event_id, status``): events ready, failed and without an entry, as one row a cache."""
    out = None
    for name, cache in sorted(caches.items()):
        j = events.select("event_id").join(cache.select("event_id", "status"), "event_id", "left")
        row = j.agg(F.lit(name).alias("cache"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status").isNull()).alias("missing")).select("cache", "ready", "failed", "missing")
        out = row if out is None else out.unionByName(row)
    return out


def report_coverage(parts: DataFrame) -> DataFrame:
    """Of each report's sources (``event_id, source, applicable, active``): how many apply, how many of those answered, the share."""
    g = parts.groupBy("event_id").agg(F.count_if("applicable").alias("applicable"), F.count_if(F.col("applicable") & F.col("active")).alias("active"))
    return g.withColumn("percent", F.round(100 * F.col("active") / F.nullif("applicable", F.lit(0))).cast("int"))


def monitor_summary(rows: DataFrame, state: str, worst: list[str]) -> DataFrame:
    """Rows by state, in the order of severity given (unlisted states last)."""
    rank = F.array_position(F.array(*map(F.lit, worst)), F.col(state))
    n = rows.groupBy(state).agg(F.count("*").alias("n"))
    return n.withColumn("severity", F.when(rank == 0, len(worst) + 1).otherwise(rank).cast("int")).orderBy("severity", state)
