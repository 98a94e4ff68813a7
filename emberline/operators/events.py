"""Events from their member detections (``event_id`` and detection columns): rollups, lifecycle, trends and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.geo import bearing_deg, haversine_m
from ..functions.times import micros, seconds
from .grid import dwithin_join
from .hull import diameters
from .quantiles import exact_quantiles


def _hours(h: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(h * 3600)))


def event_rollup(det: DataFrame) -> DataFrame:
    """Span, counts, FRP, latest confidence and the sorted names of satellites, instruments and sources of each event."""
    last = lambda c: F.max_by(c, F.struct("acq", "id")).alias(f"latest_{c}")
    names = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return det.groupBy("event_id").agg(
        F.min("acq").alias("first_seen"), F.max("acq").alias("last_seen"), F.count("*").alias("observations"), last("frp"), F.max("frp").alias("max_frp"), last("confidence"), last("lat"), last("lon"),
        names("satellite"), names("instrument"), names("source"),
    )


def rollup_parts(det: DataFrame) -> DataFrame:
    """What :func:`event_rollup` needs of each event's detections, in a form that :func:`merge_parts` can add up."""
    names = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return det.groupBy("event_id").agg(
        F.min("acq").alias("first_seen"), F.max("acq").alias("last_seen"), F.count("*").alias("observations"), F.max("frp").alias("max_frp"), F.max(F.struct("acq", "id", "frp", "confidence", "lat", "lon")).alias("latest"),
        names("satellite"), names("instrument"), names("source"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """One part an event from any number of them, of detections that no two parts share."""
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    return parts.groupBy("event_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("observations").alias("observations"), F.max("max_frp").alias("max_frp"), F.max("latest").alias("latest"),
        names("satellites"), names("instruments"), names("sources"),
    )


def rollup_of_parts(parts: DataFrame) -> DataFrame:
    """The columns of :func:`event_rollup`."""
    last = [F.col(f"latest.{c}").alias(f"latest_{c}") for c in ("frp", "confidence", "lat", "lon")]
    return parts.select("event_id", "first_seen", "last_seen", "observations", last[0], "max_frp", *last[1:], "satellites", "instruments", "sources")


def event_sources(det: DataFrame) -> DataFrame:
    """Distinct satellite (or else source) names of each event, and how many."""
    name = F.coalesce(F.nullif(F.col("satellite"), F.lit("")), F.col("source"))
    return det.groupBy("event_id").agg(F.array_sort(F.collect_set(name)).alias("sources")).withColumn("n_sources", F.size("sources"))


#: Sources that name their platform.
PLATFORMS = {"VIIRS_NOAA20_NRT": "NOAA20_VIIRS", "VIIRS_NOAA21_NRT": "NOAA21_VIIRS", "VIIRS_SNPP_NRT": "SNPP_VIIRS", "EUMETSAT_MTG_MTFRPPIXEL": "MTG_FCI", "LSA_SAF_MSG_FRP_PIXEL": "MSG_SEVIRI"}
SLSTR = {"COPERNICUS_S3_SL_2_FRP_SWIR500M": (500, 2), "COPERNICUS_S3_SL_2_FRP_MWIR1KM": (1000, 3), "COPERNICUS_S3_SL_2_FRP": (1000, 3)}


def _named(c: Column) -> Column:
    return F.nullif(F.upper(c), F.lit(""))


def platform_key(satellite: Column, source: Column, instrument: Column) -> Column:
    """Platform of a detection: by its source, else by instrument and satellite, else whatever name there is."""
    out, sat, ins = None, F.upper(F.coalesce(satellite, F.lit(""))), F.upper(F.coalesce(instrument, F.lit("")))
    for k, v in PLATFORMS.items():
        out = F.when(source == k, v) if out is None else out.when(source == k, v)
    out = out.when(source.isin(*SLSTR), F.concat(F.coalesce(_named(satellite), F.lit("SENTINEL3")), F.lit("_SLSTR"))).when(ins == "MODIS", F.coalesce(_named(satellite), F.lit("MODIS")))
    for part, key in (("20", "NOAA20_VIIRS"), ("21", "NOAA21_VIIRS"), ("NPP", "SNPP_VIIRS")):
        out = out.when((ins == "VIIRS") & sat.contains(part), key)
    return out.otherwise(F.coalesce(_named(satellite), _named(instrument), F.upper(source), F.lit("UNKNOWN")))


def quality_rank(source: Column, instrument: Column) -> Column:
    """Location quality: VIIRS 1, SWIR 2, MWIR, MTG and MODIS 3, MSG 4, others 9."""
    ins = F.upper(F.coalesce(instrument, F.lit("")))
    return F.when(ins == "VIIRS", 1).when(source == "COPERNICUS_S3_SL_2_FRP_SWIR500M", 2).when(source.isin("COPERNICUS_S3_SL_2_FRP_MWIR1KM", "COPERNICUS_S3_SL_2_FRP", "EUMETSAT_MTG_MTFRPPIXEL") | (ins == "MODIS"), 3).when(source == "LSA_SAF_MSG_FRP_PIXEL", 4).otherwise(9)


def multisource(det: DataFrame) -> DataFrame:
    """Distinct platforms of each event: 3 are high, 2 confirmed, 1 single."""
    n = F.col("n_platforms")
    return det.groupBy("event_id").agg(F.count_distinct(platform_key(F.col("satellite"), F.col("source"), F.col("instrument"))).alias("n_platforms")).withColumn("level", F.when(n >= 3, "high").when(n == 2, "confirmed").otherwise("single"))


def best_location(det: DataFrame) -> DataFrame:
    """The place of the detection of best location quality, then the newest, then the least id."""
    order = F.struct(quality_rank(F.col("source"), F.col("instrument")).alias("r"), (-micros("acq")).alias("t"), "id")
    return det.groupBy("event_id").agg(F.min_by(F.struct("lat", "lon", "id"), order).alias("b")).select("event_id", "b.lat", "b.lon", F.col("b.id").alias("best_id"))


def lifecycle(events: DataFrame, as_of, close_h: float = 24, idle_h: float = 3) -> DataFrame:
    """Status at ``as_of``: closed, inactive, active (three observations or two sources), confirmed (two) or new."""
    at = F.lit(as_of)
    status = (
        F.when(F.col("last_seen") < at - _hours(close_h), "closed").when(F.col("last_seen") < at - _hours(idle_h), "inactive")
        .when((F.col("observations") >= 3) | (F.col("n_sources") >= 2), "active").when(F.col("observations") >= 2, "confirmed").otherwise("new")
    )
    return events.withColumn("status", status)


def change_class(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Against the last sent snapshot: with more observations, 1.3 times its FRP is strengthening and 0.7 weakening; else active, confirmed, new."""
    j = cur.join(prev.select("event_id", F.col("latest_frp").alias("prev_frp"), F.col("observations").alias("prev_n")), "event_id", "left")
    grew, minutes = (F.coalesce("prev_n", F.lit(0)) < F.col("observations")) & (F.col("prev_frp") > 0) & (F.col("latest_frp") > 0), (micros("last_seen") - micros("first_seen")) / 6e7
    kind = (
        F.when(grew & (F.col("latest_frp") >= F.col("prev_frp") * 1.3), "strengthening").when(grew & (F.col("latest_frp") <= F.col("prev_frp") * 0.7), "weakening")
        .when((F.col("observations") >= 3) | (minutes >= 60), "active").when((F.col("observations") >= 2) | (F.size("satellites") >= 2), "confirmed").otherwise("new")
    )
    return j.withColumn("change", kind)


def bootstrap_flags(events: DataFrame, completed_at, fresh_h: float) -> DataFrame:
    """Events that began before the bootstrap are suppressed, unless seen within ``fresh_h`` (0..24) hours of it."""
    fresh = F.col("last_seen") >= F.lit(completed_at) - _hours(min(max(fresh_h, 0), 24))
    old = F.col("first_seen") < F.lit(completed_at)
    return events.withColumn("notify", ~old | fresh).withColumn("suppressed", old & ~fresh)


def promote(det: DataFrame, as_of, geostationary: list[str], fresh_h: float = 3, span_s: int = 480) -> DataFrame:
    """Whether an event of the last hours has a polar member, or two geostationary ones that span eight minutes."""
    geo = F.col("source").isin(*geostationary)
    per = det.groupBy("event_id").agg(F.max("acq").alias("last_seen"), F.bool_or(~geo).alias("polar"), F.count_if(geo).alias("n_geo"), F.coalesce(F.max(F.when(geo, seconds("acq"))) - F.min(F.when(geo, seconds("acq"))), F.lit(0)).alias("geo_span_s"))
    return per.withColumn("promoted", (F.col("last_seen") >= F.lit(as_of) - _hours(fresh_h)) & (F.col("polar") | ((F.col("n_geo") >= 2) & (F.col("geo_span_s") >= span_s))))


def sync_queue(events: DataFrame, as_of, limit: int = 100) -> DataFrame:
    """Events to send and why: new, close, update or enrichment; oldest change first, 1 to 500 of them."""
    reason = (
        F.when(F.col("sent_at").isNull(), F.when(F.col("status") != "closed", "new")).when((F.col("status") == "closed") & ~F.col("closed_sent"), "close")
        .when(F.col("last_seen") > F.col("sent_at"), "update").when(F.col("enriched_at") > F.col("sent_at"), "enrichment")
    )
    changed = F.greatest("last_seen", "enriched_at")
    return events.withColumn("reason", reason).where("reason is not null").withColumn("changed_at", changed).orderBy("changed_at", "event_id").limit(min(max(limit, 1), 500))


def newest(det: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest members of each event, ranked ``n`` from 1."""
    return det.withColumn("n", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("acq"), F.desc("id")))).where(F.col("n") <= k)


def frp_trend(det: DataFrame) -> DataFrame:
    """Mean FRP of the latest three against the three before, of the six newest not negative; 30 per cent is a change."""
    six = newest(det.where("frp is not null and frp >= 0"), 6).groupBy("event_id").agg(F.avg(F.when(F.col("n") <= 3, F.col("frp"))).alias("latest"), F.avg(F.when(F.col("n") > 3, F.col("frp"))).alias("before"), F.count("*").alias("samples"))
    pct = F.when(F.col("before") > 0, (F.col("latest") - F.col("before")) / F.col("before") * 100)
    return six.withColumn("change_pct", pct).withColumn("trend", F.when(pct >= 30, "rising").when(pct <= -30, "falling").when(pct.isNotNull(), "stable").otherwise("insufficient"))


def cluster_diameter(det: DataFrame) -> DataFrame:
    """Greatest distance between two members of each event, exactly (:mod:`.hull`); 0 for a single place."""
    far = diameters(det.select("event_id", "lat", "lon").distinct(), "event_id")
    return det.select("event_id").distinct().join(far, "event_id", "left").select("event_id", F.coalesce("diameter_m", F.lit(0.0)).alias("diameter_m"))


def attach_secondary(pixels: DataFrame, events: DataFrame, radius_m: float = 5000, window_h: float = 24) -> DataFrame:
    """Pixels of a second sensor with the nearest existing event: of the same region, within the radius of its last place and the window of its span.

    ``pixels`` has ``id, acq, lat, lon, region_id``, ``events`` ``event_id, region_id, first_seen, last_seen, latest_lat,
    latest_lon``. No event is opened: pixels without one keep a null ``event_id``, as do those without a region. Ties go
    to the least id.
    """
    wait = int(window_h * 3.6e9)
    e = events.select("event_id", F.col("region_id").alias("_region"), "first_seen", "last_seen", "latest_lat", "latest_lon")
    fits = (F.col("region_id") == F.col("_region")) & (micros("last_seen") >= micros("acq") - wait) & (micros("first_seen") <= micros("acq") + wait)
    pairs = dwithin_join(pixels.select("id", "acq", "lat", "lon", "region_id"), e, radius_m, lat_b="latest_lat", lon_b="latest_lon", extra=fits)
    best = pairs.groupBy("id").agg(F.min_by(F.struct("event_id", "distance_m"), F.struct(F.round("distance_m", 3), "event_id")).alias("b")).select("id", "b.*")
    return pixels.join(best, "id", "left")


def cluster_motion(det: DataFrame) -> DataFrame:
    """From the centre of members four to six to that of the latest three: metres and bearing; null with fewer than four."""
    at = lambda c, late: F.avg(F.when((F.col("n") <= 3) == F.lit(late), F.col(c)))
    c = newest(det, 6).groupBy("event_id").agg(at("lat", False).alias("a"), at("lon", False).alias("b"), at("lat", True).alias("c"), at("lon", True).alias("d"))
    return c.select("event_id", haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("moved_m"), bearing_deg(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("bearing"))


def reliability(rollup: DataFrame) -> DataFrame:
    """0 to 100: confidence letter 70, 50, 25 or 40, then observations, satellites, FRP and duration; high 80, medium 55."""
    c, frp, hours = F.lower("latest_confidence"), F.col("max_frp"), (seconds("last_seen") - seconds("first_seen")) / 3600
    score = (
        F.when(c.isin("h", "high"), 70).when(c.isin("n", "nominal"), 50).when(c.isin("l", "low"), 25).otherwise(40) + F.least(F.lit(15), (F.col("observations") - 1) * 5) + F.when(F.size("satellites") >= 2, 10).otherwise(0)
        + F.when(frp >= 100, 15).when(frp >= 30, 10).when(frp >= 10, 5).otherwise(0) + F.when(hours >= 3, 10).when(hours >= 1, 5).otherwise(0)
    )
    return rollup.withColumn("reliability", F.least(F.lit(100), score).cast("int")).withColumn("reliability_level", F.when(F.col("reliability") >= 80, "high").when(F.col("reliability") >= 55, "medium").otherwise("low"))


def priority(events: DataFrame) -> DataFrame:
    """Triage score 0 to 100 with its reasons; levels from 30, 55 and 75.

    Reads ``n_platforms, max_frp, first_seen, last_seen, observations, trend, diameter_m, population_5km, flags,
    evidence_classes`` (arrays of names); nulls add nothing.
    """
    # fixed values: names of factors and their points
    n, frp, obs, pop = F.coalesce("n_platforms", F.lit(0)), F.coalesce("max_frp", F.lit(0.0)), F.coalesce("observations", F.lit(0)), F.coalesce("population_5km", F.lit(0.0))
    minutes = F.greatest(F.lit(0), (micros("last_seen") - micros("first_seen")) / 6e7)
    has = lambda c, name: F.coalesce(F.array_contains(c, name), F.lit(False))
    trend = F.lower(F.coalesce("trend", F.lit("")))
    parts = {
        "satellite_confirmation": F.when(n >= 3, 25).when(n == 2, 18).when(n == 1, 8).otherwise(0),
        "thermal_intensity": F.when(frp >= 100, 25).when(frp >= 50, 20).when(frp >= 20, 14).when(frp >= 5, 7).when(frp > 0, 3).otherwise(0),
        "persistence": F.when(minutes >= 180, 10).when(minutes >= 60, 7).when(minutes >= 15, 4).otherwise(0) + F.when(obs >= 10, 10).when(obs >= 5, 7).when(obs >= 2, 4).when(obs == 1, 1).otherwise(0),
        "dynamics": F.when(trend.isin("strengthening", "rising", "increase", "increasing"), 8).when(trend.isin("stable", "steady"), 3).otherwise(0) + F.when(F.col("diameter_m") >= 1000, 2).otherwise(0),
        "civilian_context": F.least(F.lit(15), F.when(pop >= 50000, 10).when(pop >= 10000, 8).when(pop >= 1000, 5).when(pop > 0, 2).otherwise(0) + F.when(has("flags", "settlement_near_2km"), 5).otherwise(0)),
        "independent_context": sum((F.when(has("evidence_classes", k), p).otherwise(0) for k, p in (("external_document", 2), ("public_post", 1), ("ground", 1), ("atmosphere", 1))), F.lit(0)),
    }
    reasons = F.filter(F.array(*(F.struct(F.lit(k).alias("factor"), v.alias("points")) for k, v in parts.items())), lambda x: x["points"] > 0)
    level = F.when(F.col("priority") >= 75, "high").when(F.col("priority") >= 55, "elevated").when(F.col("priority") >= 30, "normal").otherwise("low")
    return events.withColumn("priority", F.least(F.lit(100), sum(parts.values(), F.lit(0))).cast("int")).withColumn("reasons", reasons).withColumn("priority_level", level)


def priority_events(events: DataFrame, as_of, hours: float, least: int, limit: int) -> DataFrame:
    """The feed: seen within ``hours``, at least ``least`` points, highest first, newest on ties."""
    return events.where((F.col("last_seen") >= F.lit(as_of) - _hours(hours)) & (F.col("priority") >= least)).orderBy(F.col("priority").desc_nulls_last(), F.desc("last_seen"), "event_id").limit(limit)


def atmosphere_level(aerosol: Column, depth: Column) -> Column:
    """Aerosol index and optical depth as strong, elevated, background or insufficient."""
    return F.when((aerosol > 2) & (F.coalesce(depth, F.lit(0.0)) >= 0.3), "strong").when((aerosol > 1) | (F.coalesce(depth, F.lit(0.0)) >= 0.25), "elevated").when(aerosol.isNotNull() | depth.isNotNull(), "background").otherwise("insufficient")


def latency_health(det: DataFrame, *keys: str) -> DataFrame:
    """Minutes from acquisition to receipt: mean, exact p50 and p95, greatest, how many beyond 90 and 10."""
    m = (micros("received_at") - micros("acq")) / 6e7
    rows = det.where("received_at is not null and acq is not null").select(*keys, F.lit(0).alias("_all"), m.alias("m"))
    by = list(keys) or ["_all"]
    plain = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("m"), 3).alias("mean_min"), F.round(F.max("m"), 3).alias("max_min"), F.count_if(F.col("m") > 90).alias("over_90"), F.count_if(F.col("m") > 10).alias("over_10"),
    )
    both = plain.join(exact_quantiles(rows, by, "m", {"p50_min": 0.5, "p95_min": 0.95}), by)
    return both.select(*keys, "n", "mean_min", F.round("p50_min", 3).alias("p50_min"), F.round("p95_min", 3).alias("p95_min"), "max_min", "over_90", "over_10")


def event_latency(det: DataFrame, sent: DataFrame) -> DataFrame:
    """Each event's delays in minutes: ``event_id, first_seen, first_received_at, sent_at``, the greatest from acquisition to receipt
    (``source_latency_min``, at least 0; 0 if no receipt is known), from first receipt to sending (``delivery_latency_min``) and from the first
    acquisition to sending (``end_to_end_latency_min``); the last two are null for events that were not sent.

    ``sent`` has ``event_id, sent_at``, one row an event. Detections without an event are left out.
    """
    minutes = lambda a, b: (micros(b) - micros(a)) / 6e7
    late = F.greatest(F.lit(0.0), F.coalesce(minutes("acq", "received_at"), F.lit(0.0)))
    by = det.where("event_id is not null").groupBy("event_id").agg(F.min("acq").alias("first_seen"), F.min("received_at").alias("first_received_at"), F.round(F.max(late), 1).alias("source_latency_min"))
    both = by.join(sent.select("event_id", "sent_at"), "event_id", "left")
    return both.select("event_id", "first_seen", "first_received_at", "sent_at", "source_latency_min", F.round(minutes("first_received_at", "sent_at"), 1).alias("delivery_latency_min"), F.round(minutes("first_seen", "sent_at"), 1).alias("end_to_end_latency_min"))


def worst_latencies(det: DataFrame, sent: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` slowest detections (``kind`` source) and sent events (delivery): ``kind, event_id, id, latency_min``; ties by event, then id."""
    source = det.where("acq is not null and received_at is not null").select(F.lit("source").alias("kind"), "event_id", "id", F.greatest(F.lit(0.0), (micros("received_at") - micros("acq")) / 6e7).alias("latency_min"))
    done = event_latency(det, sent).where("sent_at is not null and first_received_at is not null")
    delivery = done.select(F.lit("delivery").alias("kind"), "event_id", F.lit(None).cast("long").alias("id"), F.greatest(F.lit(0.0), (micros("sent_at") - micros("first_received_at")) / 6e7).alias("latency_min"))
    top = lambda df: df.orderBy(F.desc("latency_min"), "event_id", "id").limit(k)
    return top(source).unionByName(top(delivery)).withColumn("latency_min", F.round("latency_min", 1))
