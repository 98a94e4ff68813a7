"""Streams whose state is a table of buckets: clustering in both modes and rollups, against the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import cluster, events
from emberline.streaming import detections as streaming
from emberline.streaming.state import Buckets

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, acq timestamp, received_at timestamp, lat double, lon double, region_id long, radius_m double, source string, satellite string, instrument string, frp double, confidence string"


def arrivals(n, seed, step=17):
    rng, out = random.Random(seed), []
    for i in range(n):
        at = T0 + datetime.timedelta(minutes=step * i)
        lon = rng.choice([30 + rng.randrange(9) / 300, 179.999 + rng.randrange(3) / 300, 30.998 + rng.randrange(4) / 500])
        lon = lon - 360 if lon > 180 else lon
        seen = at - datetime.timedelta(minutes=rng.randint(0, 300))
        out.append((i, None if i % 37 == 0 else seen, at, 50 + rng.randrange(5) / 300 - (0.01 if rng.random() < 0.3 else 0), lon, rng.choice([1, 2, None, None]), 750.0, f"s{i % 3}", None if i % 5 == 0 else "x", "y", 1.0 + i % 13, "h"))
    return out


@pytest.mark.parametrize("mode", ["core", "strict"])
def test_clusters_of_batches_are_those_of_the_whole(spark, tmp_path, mode):
    rows = arrivals(210, 5)
    run = streaming.cluster_batches(str(tmp_path / "out"), str(tmp_path / "state"), region_mode=mode, late_h=48, buckets=16)
    parts = [spark.createDataFrame(rows[i : i + 80], SCHEMA) for i in range(0, 210, 80)]
    for n, part in enumerate(parts):
        run(part, n)
    run(parts[2], 2)  # as after a restart
    run(spark.createDataFrame([], SCHEMA), 3)
    want = {tuple(r) for r in cluster.cluster_events(spark.createDataFrame(rows, SCHEMA), region_mode=mode).select("id", "event_id", "opened").collect()}
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "event_id", "opened").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_state_of_clusters_is_bounded_by_the_window(spark, tmp_path):
    state = str(tmp_path / "state")
    run = streaming.cluster_batches(str(tmp_path / "out"), state, late_h=6, buckets=4)
    sizes = []
    for n in range(3):
        run(spark.createDataFrame([(*r[:1], r[2] + datetime.timedelta(days=5 * n), r[2] + datetime.timedelta(days=5 * n), *r[3:]) for r in arrivals(30, 3)], SCHEMA).withColumn("id", F.col("id") + 100 * n), n)
        sizes.append(Buckets(spark, state, streaming.OPEN_EVENTS).current().count())
    assert len(set(sizes)) == 1 and sizes[0] > 0


def test_rollups_read_what_is_active(spark, tmp_path):
    members, rollups = str(tmp_path / "m"), str(tmp_path / "r")
    run, all_, held = streaming.refresh_rollups(members, rollups, buckets=8, idle_h=24), None, []
    for n in range(5):
        day = [(*r[:1], r[2] + datetime.timedelta(days=3 * n), *r[2:]) for r in arrivals(40, 2)]
        part = spark.createDataFrame(day, SCHEMA).withColumn("id", F.col("id") + 100 * n)
        # five events of the day, and one row of an event of the first day
        part = part.withColumn("event_id", F.when(F.col("id") % 40 == 7, "e0-1").otherwise(F.concat(F.lit(f"e{n}-"), (F.col("id") % 5).cast("string"))))
        run(part, n)
        if n == 3:
            run(part, n)
        all_ = part if all_ is None else all_.unionByName(part)
        held.append(Buckets(spark, rollups, spark.read.parquet(f"{rollups}/idle").drop("batch").schema).current().count())
    key = lambda df: sorted(map(str, df.collect()))
    assert key(streaming.current_rollups(spark, rollups)) == key(events.event_rollup(all_).select(*streaming.current_rollups(spark, rollups).columns))
    assert max(held[1:]) <= 12  # of 25 events so far: those of the last batches alone are read again
