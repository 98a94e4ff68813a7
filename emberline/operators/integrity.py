"""Audits: source coverage, robust baselines, anomalies, reconciliation and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros, seconds
from .events import _hours
from .quantiles import exact_quantiles


def source_coverage(det: DataFrame, sources: DataFrame, runs: DataFrame, as_of, poll_min: int = 15) -> DataFrame:
    """One row a source, also for silent ones: counts at 1, 6 and 24 hours, newest times, worker age and status.

    ``runs`` has ``source, run_at, fetched, last_error``; the newest counts. A worker is stale after the greater of 20
    minutes and three polls.
    """
    at = F.lit(as_of)
    within = lambda h: F.count_if(F.col("received_at") > at - _hours(h)).alias(f"n_{h}h")
    seen = det.groupBy("source").agg(within(1), within(6), within(24), F.max("acq").alias("latest_acq"), F.max("received_at").alias("latest_received"))
    last = runs.groupBy("source").agg(F.max_by(F.struct("run_at", "fetched", "last_error"), F.struct("run_at", "fetched")).alias("r")).select("source", "r.*")
    age = F.floor((seconds(at) - seconds("run_at")) / 60)
    out = sources.join(seen, "source", "left").join(last, "source", "left").withColumn("worker_age_min", age)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_1h", "n_6h", "n_24h")}
    status = F.when(F.col("last_error").isNotNull(), "error").when(F.col("run_at").isNull(), "unknown").when(age > max(20, 3 * poll_min), "stale").when(F.col("fetched") == 0, "empty_fetch").when(F.col("fetched").isNull(), "unknown").otherwise("active")
    activity = F.when(F.col("latest_acq").isNull(), "unknown").when(F.col("n_24h") == 0, "quiet").otherwise("observed")
    return out.withColumns(zero).withColumn("status", status).withColumn("activity", activity)


def coverage_hourly(det: DataFrame, sources: DataFrame, hours: DataFrame) -> DataFrame:
    """Rows a source and hour of receipt, zeros included (``hours`` and ``sources`` are small dimensions)."""
    n = det.groupBy("source", F.date_trunc("hour", "received_at").alias("hour")).agg(F.count("*").alias("n"))
    keys = sources.select("source").crossJoin(hours.select("hour"))  # one row a source, one an hour
    return keys.join(n, ["source", "hour"], "left").fillna(0, ["n"])


def baseline(samples: DataFrame, keys: list[str], ready: int = 6) -> DataFrame:
    """Robust baseline of ``value`` by key: count, median, MAD, p10, p90, whether there are enough samples."""
    first = exact_quantiles(samples, keys, "value", {"median": 0.5, "p10": 0.1, "p90": 0.9}, count="n").select(*keys, "n", "median", "p10", "p90")
    off = samples.join(first.select(*keys, "median"), keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("off"))
    return first.join(exact_quantiles(off, keys, "off", {"mad": 0.5}), keys).withColumn("ready", F.col("n") >= ready)


def lag_baseline(det: DataFrame) -> DataFrame:
    """The baseline of minutes to receipt (0 to 1440 count) by source; ready from 12."""
    lag = (micros("received_at") - micros("acq")) / 6e7
    return baseline(det.select("source", lag.alias("value")).where("value between 0 and 1440"), ["source"], ready=12)


def assess(current: DataFrame, base: DataFrame, prev: DataFrame) -> DataFrame:
    """Current values against baselines; a second abnormal check in a row makes an anomaly.

    ``current`` has ``source, status, feed, worker, lag``; ``base`` has ``source, metric`` (feed, worker, lag) with
    ``median, mad, p10, p90, ready``; ``prev`` has ``source, streak``. Only a ready feed baseline ends the learning.
    """
    part = lambda m: base.where(F.col("metric") == m).select("source", *(F.col(c).alias(f"{m}_{c}") for c in ("median", "mad", "p10", "p90", "ready")))
    j = current
    for m in ("feed", "worker", "lag"):
        j = j.join(part(m), "source", "left")
    j = j.join(prev.select("source", "streak"), "source", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    ready = lambda m: F.coalesce(f"{m}_ready", F.lit(False))
    low = ready("feed") & (z("feed_median") >= 20) & (F.col("feed") < F.least(F.coalesce("feed_p10", "feed") * 0.7, z("feed_median") - 4 * F.greatest(z("feed_mad"), F.lit(5.0))))
    high = lambda m, least: ready(m) & (F.col(m) > F.greatest(z(f"{m}_p90") * 1.5, z(f"{m}_median") + 4 * F.greatest(z(f"{m}_mad"), F.lit(least))))
    marks = {"source_health": F.col("status") != "active", "low_feed": low, "high_worker_lag": high("worker", 2.0), "high_ingestion_delay": high("lag", 5.0)}
    reasons = F.filter(F.array(*(F.when(F.coalesce(v, F.lit(False)), k) for k, v in marks.items())), lambda x: x.isNotNull())
    j = j.withColumn("reasons", reasons).withColumn("ready", ready("feed"))
    streak = F.when(F.col("ready") & (F.size("reasons") > 0), F.coalesce("streak", F.lit(0)) + 1).otherwise(0)
    state = F.when(~F.col("ready"), "learning").when(F.size("reasons") == 0, "normal").when(F.coalesce("streak", F.lit(0)) >= 1, "anomaly").otherwise("watch")
    return j.select("source", state.alias("state"), streak.alias("streak"), "reasons")


def geo_integrity(upstream: DataFrame, store: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region, also empty ones: rows upstream, matched by hash, missing, and the missing by source as a map.

    ``upstream`` has ``detection_hash, source, region_id``; each row counts once.
    """
    j = upstream.join(store.select("detection_hash").distinct().withColumn("hit", F.lit(True)), "detection_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    each = j.groupBy("region_id", "source").agg(F.count("*").alias("n"), F.count_if("hit").alias("matched"))
    per = each.groupBy("region_id").agg(F.sum("n").alias("upstream"), F.sum("matched").alias("matched"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > F.col("matched"), F.struct("source", (F.col("n") - F.col("matched")).alias("missing")))))).alias("missing_by_source"))
    out = regions.select("region_id", "code").join(per, "region_id", "left").fillna(0, ["upstream", "matched"])
    return out.withColumn("missing", F.col("upstream") - F.col("matched"))


def notification_findings(events: DataFrame, det: DataFrame, as_of, completed_at) -> DataFrame:
    """Unsent events by class and severity; events without detections are never reported.

    ``events`` has ``event_id, first_seen, required, sent``; ``completed_at`` is when the bootstrap ended.
    """
    per = det.groupBy("event_id").agg(F.bool_or(F.col("acq") >= F.lit(as_of) - _hours(24)).alias("fresh"))
    j, done = events.where("not sent").join(per, "event_id"), F.lit(completed_at)
    kind = (
        F.when(F.col("fresh") & ~F.col("required") & (F.col("first_seen") >= done), "notification_gap").when(F.col("required") & (F.col("first_seen") < F.lit(as_of) - _hours(0.75)), "delivery_backlog")
        .when(~F.col("required") & (F.col("first_seen") < done), "bootstrap_suppressed").when(~F.col("required"), "other_suppressed")
    )
    severity = F.when(F.col("kind") == "notification_gap", "error").when(F.col("kind") == "delivery_backlog", "warning").otherwise("info")
    return j.withColumn("kind", kind).where("kind is not null").withColumn("severity", severity).select("event_id", "kind", "severity", "first_seen")


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts by class and an overall status."""
    one = findings.agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warning"))
    return one.withColumn("status", F.when(F.col("errors") > 0, "error").when(F.col("warning") > 0, "warning").otherwise("ok"))


def watchdog(states: DataFrame, limits: DataFrame, as_of) -> DataFrame:
    """Monitors over their age limit, never run, or with an error."""
    age = F.floor((seconds(F.lit(as_of)) - seconds("last_run")) / 60)
    j = limits.join(states, "monitor", "left").withColumn("age_min", age)
    reason = F.when(F.col("last_run").isNull(), "never_run").when(F.col("error").isNotNull(), "error").when(F.col("age_min") > F.col("limit_min"), "stale")
    return j.withColumn("reason", reason).where("reason is not null").select("monitor", "age_min", "reason")


def diagnostics(det: DataFrame, events: DataFrame, regions: DataFrame) -> DataFrame:
    """Invariants as pass, warn or fail rows."""
    orphan = det.join(events.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_detections").alias("check"), "n")
    outside = det.where("region_id is null").agg(F.count("*").alias("n")).select(F.lit("outside_regions").alias("check"), "n")
    twice = det.groupBy("detection_hash").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_hashes").alias("check"), "n")
    rings = regions.where(F.exists("rings", lambda r: F.size(r) < 4)).agg(F.count("*").alias("n")).select(F.lit("invalid_rings").alias("check"), "n")
    checks = orphan.unionByName(outside).unionByName(twice).unionByName(rings)
    return checks.withColumn("result", F.when(F.col("n") == 0, "pass").when(F.col("check") == "outside_regions", "warn").otherwise("fail"))
