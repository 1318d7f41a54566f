"""Keyed state on streams against the batch operators; failing cameras; a loop that survives."""

import random

import pytest
from pyspark.sql import functions as F

from timelens.operators import intervals, tracks
from timelens.streaming import state, watch


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, rows, make, batches):
    """What a stream gives for rows that come in batches, one file each."""
    for i, part in enumerate(batches):
        rows.filter(F.col("n").isin(*part)).drop("n").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.drop("n").schema).parquet(f"{tmp_path}/in").withWatermark("at", "20 seconds")
        query = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None, i
    return spark.read.parquet(f"{tmp_path}/out")


def dealt(n, parts, seed):
    """Numbers in batches, disordered a little."""
    order = sorted(range(n), key=lambda i, r=random.Random(seed): i + r.uniform(0, 8))
    return [order[k * n // parts : (k + 1) * n // parts] for k in range(parts)]


def test_live_tracks(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = []
    for i in range(90):
        video = "ab"[i % 2]
        for k in range(rng.randint(0, 3)):
            rows.append((i, video, float(i) * 0.7 + (9 if i > 60 else 0), rng.choice(["car", "dog"]), rng.choice([0.5, 0.7, 0.9]), k * 0.2 + rng.uniform(0, 0.1), 0.1, 0.3, 0.3))
    df = spark.createDataFrame(rows, "n int, video_id string, timestamp double, object_class string, confidence double, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    # the last row, long after, lets the watermark pass all others
    last = spark.createDataFrame([(90, "z", 9e5, "car", 0.5, 0.0, 0.0, 0.1, 0.1)], df.schema)
    timed = df.union(last).withColumn("at", F.timestamp_micros((F.col("timestamp") * 1e6 + 1.7e15).cast("bigint")))
    got = streamed(spark, tmp_path, timed, state.live_tracks, [*dealt(90, 3, 1), [90]])
    want = tracks.track(df)
    show = lambda t: sorted((r["video_id"], r["track_id"], r["object_class"], r["track_confidence"], round(r["first_seen"], 6), round(r["last_seen"], 6), r["frame_count"]) for r in t.collect())
    assert show(got) == show(want) and want.count() > 20


def test_live_episodes(spark, tmp_path, rocks):
    rng = random.Random(5)
    rows = [(i, f"c{i % 3}", i, *rng.choice([(1e9 + i, None), (None, 1e9 + i), (1e9 + i, 1e9 + i + 3.0)])) for i in range(100)]
    df = spark.createDataFrame(rows, "n int, channel string, seq int, start_epoch double, end_epoch double")
    ends = spark.createDataFrame([(100 + i, f"c{i}", 100 + i, None, 1e9 + 101) for i in range(3)] + [(110, "z", 110, None, 1e9 + 5000)], df.schema)
    timed = df.union(ends).withColumn("at", F.timestamp_seconds(F.lit(1e9) + F.col("n") + F.when(F.col("n") == 110, 5000).otherwise(0)))
    got = streamed(spark, tmp_path, timed, state.live_episodes, [*dealt(100, 3, 2), [100, 101, 102], [110]])
    show = lambda t: sorted((r["channel"], r["start_epoch"], r["end_epoch"], r["open"]) for r in t.filter("channel <> 'z'").collect())
    assert show(got) == show(intervals.pair_markers(df.union(ends).drop("n"))) and got.filter("lost").count() == 0


def test_lost_ends(spark, tmp_path, rocks):
    rows = spark.createDataFrame([(0, "a", 0, 100.0, None), (1, "b", 1, 150.0, None), (2, "b", 2, None, 160.0), (3, "z", 3, 400.0, None)], "n int, channel string, seq int, start_epoch double, end_epoch double")
    timed = rows.withColumn("at", F.timestamp_seconds(F.coalesce("start_epoch", "end_epoch")))
    got = streamed(spark, tmp_path, timed, lambda s: state.live_episodes(s, most=60.0), [[0, 1, 2], [3]])
    assert sorted(map(tuple, got.collect())) == [("a", 100.0, 220.0, False, True), ("b", 150.0, 160.0, False, False)]


def test_a_camera_that_fails_holds_no_other(spark, tmp_path):
    cameras = spark.createDataFrame([(f"cam{i}", str(i), 1000.0) for i in range(6)], "camera_id string, source_ref string, last_processed_epoch double")
    events = spark.createDataFrame([(str(i), 1010.0, 1040.0) for i in range(6)] + [("2", 1200.0, 1210.0), ("2", 1300.0, 1310.0)], "camera_ref string, start_epoch double, end_epoch double")

    def ingest(windows):
        rows = windows.collect()
        if any(r["camera_id"] == "cam4" or (r["camera_id"] == "cam2" and r["window_start"] == 1200.0) for r in rows):
            raise OSError("no route to host")
        return windows.select("uri")

    stream = watch.WatchStream(spark, str(tmp_path), cameras, ingest, lambda: 2000.0, watch.WatchRules(max_windows=60))
    stream.process(events, 0)
    marks = {r["camera_id"]: r["last_processed_epoch"] for r in spark.read.parquet(f"{tmp_path}/cameras/v=0").collect()}
    assert marks == {"cam0": 1880.0, "cam1": 1880.0, "cam2": 1040.0, "cam3": 1880.0, "cam4": 1000.0, "cam5": 1880.0}
    stream.ingest = lambda windows: windows.select("uri")
    stream.process(events.limit(0), 1)
    assert {r["last_processed_epoch"] for r in spark.read.parquet(f"{tmp_path}/cameras/v=1").collect()} == {1880.0}


def test_a_loop_that_survives(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    seen, slept = [], []

    def process(df, batch):
        seen.append(df.count())
        if len(seen) == 1:
            raise OSError("locked")

    def start():
        if len(slept) == 1:
            raise OSError("not there")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        return stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    assert watch.run_watch(start, interval=7.0, stop_after=4, sleep=slept.append) == 2
    assert seen == [3, 3] and slept == [7.0] * 3  # the batch that failed is made good once
