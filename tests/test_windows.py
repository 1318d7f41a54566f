"""Windowed selection, counts and histograms on a hand-worked table."""

import pytest
from pyspark.sql import functions as F

from timelens.functions.timeparse import TimeWindow, bucket_seconds
from timelens.operators import aggregate, tracks
from timelens.plans import planner

W0, W1 = 1786431600, 1786474800


@pytest.fixture(scope="module")
def tables(spark):
    videos = spark.createDataFrame(
        [("E", "ch2", float(W0), 60.0), ("A", "ch1", W0 + 3600.0, 600.0), ("B", "ch2", W1 - 30.0, 60.0), ("C", "ch1", W0 - 3600.0, 60.0), ("D", None, None, 60.0)],
        "video_id string, camera_id string, start_epoch double, duration_seconds double",
    ).withColumns({"ingest_status": F.lit("done"), "profile": F.lit(None).cast("string"), "source_type": F.lit("nvr_recorded")})
    rows = [("e1", "E", "car", 0.0, 3), ("a1", "A", "car", 10.0, 3), ("a2", "A", "car", 100.0, 3), ("a3", "A", "person", 20.0, 3), ("a4", "A", "Car", 30.0, 1), ("b1", "B", "car", 20.0, 3), ("b2", "B", "car", 40.0, 3), ("b3", "B", "car", 30.0, 3), ("c1", "C", "car", 50.0, 3), ("d1", "D", "car", 5.0, 3)]
    found = spark.createDataFrame(rows, "track_id string, video_id string, object_class string, first_seen double, frame_count int").withColumn("last_seen", F.col("first_seen") + 1)
    return found, videos


def ids(df):
    return [r["track_id"] for r in df.orderBy("absolute", "track_id").collect()]


def test_window_bounds():
    assert TimeWindow("2026-08-11T00:00:00", "2026-08-11T12:00:00", "America/Los_Angeles").epoch_bounds() == (W0, W1)
    with pytest.raises(ValueError):
        TimeWindow("2026-03-08T02:30:00", "2026-03-09T00:00:00", "America/Los_Angeles").epoch_bounds()
    TimeWindow("2026-11-01T01:30:00", "2026-11-02T00:00:00", "America/Los_Angeles").epoch_bounds()
    for bad in (("2026-01-01", "2026-01-02", "Nowhere/City"), ("2026-01-02", "2026-01-01", "UTC"), ("2026-01-01T00:00:00+00:00", "2026-01-02", "UTC")):
        with pytest.raises(ValueError):
            TimeWindow(*bad).epoch_bounds()


def test_selection(tables):
    t, v = tables
    assert ids(tracks.select_placed(t, v, ["CAR"], W0, W1).filter("frame_count >= 2")) == ["e1", "a1", "a2", "b1"]
    assert ids(tracks.select_placed(t, v, ["car"], W0, W1, [])) == [] and ids(tracks.select_placed(t, v, [], W0, W1)) == []
    assert "a3" in ids(tracks.select_placed(t, v, None, W0, W1))
    assert ids(tracks.select_placed(t, v, ["car"], W0, W1, ["ch1"]).filter("frame_count >= 2")) == ["a1", "a2"]
    for bad in (True, "0", None):
        with pytest.raises(TypeError):
            tracks.select_placed(t, v, None, bad, W1)


def test_count_and_caveats(tables):
    t, v = tables
    window = TimeWindow("2026-08-11T00:00:00", "2026-08-11T12:00:00", "America/Los_Angeles")
    got = aggregate.count_objects(t, v, "cars", window)
    assert got.total == 4 and {r["camera"]: r["n"] for r in got.per_camera.collect()} == {"ch1": 2, "ch2": 2}
    assert any("left out" in c for c in got.caveats)
    assert {r["camera"]: r["n"] for r in aggregate.count_with_total(got.entities).collect()} == {"ch1": 2, "ch2": 2, None: 4}
    assert len(aggregate.entity_manifest(got.entities).collect()) == 4
    with pytest.raises(ValueError):
        aggregate.resolve_identities(t, "guess")


def test_histogram_and_listing(tables):
    t, v = tables
    found, _ = aggregate.entities_for(t, v, "car", W0, W1)
    bars = {r["bucket"]: r["n"] for r in aggregate.timeline_histogram(found, W0, W1, "1h").collect()}
    assert len(bars) == 12 and {k: n for k, n in bars.items() if n} == {0: 1, 1: 2, 11: 1} and sum(bars.values()) == found.count()
    assert [r["track_id"] for r in aggregate.list_events(found, 2).collect()] == ["e1", "a1"] and aggregate.list_events(found, 0).count() == 0
    with pytest.raises(ValueError):
        aggregate.timeline_histogram(found, W0, W1, "1s")
    assert bucket_seconds("15m") == 900
    for bad in ("h", "0h", "1w", "-1h"):
        with pytest.raises(ValueError):
            bucket_seconds(bad)


def test_dispatch_degrades_to_notes(tables):
    t, v = tables
    args = {"category": "cars", "start": "2026-08-11T00:00:00", "end": "2026-08-11T12:00:00", "tz": "America/Los_Angeles"}
    good = planner.dispatch_aggregation({"op": "count_objects", "args": args}, t, v)
    assert good.note is None and good.frame.filter("camera IS NULL").first()["n"] == 4
    for bad in ({"op": "guess"}, {"op": "count_objects", "args": {"category": "x"}}, {"op": "count_objects", "args": args | {"limit": 3}}, {"op": "list_events", "args": args | {"limit": True}}, {"op": "timeline_histogram", "args": args | {"bucket": "1y"}}, {"op": "count_objects", "args": args | {"tz": "x"}}):
        got = planner.dispatch_aggregation(bad, t, v)
        assert got.frame is None and got.note
    nowhere = planner.dispatch_aggregation({"op": "count_objects", "args": args}, t, v.withColumn("start_epoch", F.lit(None).cast("double")))
    assert nowhere.frame is None and "nothing can be counted" in nowhere.note
