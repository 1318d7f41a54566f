"""Configuration layers, running roles, jobs, pixels, motion spans, the stream's replay."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelens import schemas
from timelens.functions import image
from timelens.operators import catalog, intervals, statechange
from timelens.plans import config, ingest
from timelens.sources import versions


def write(path, document):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(document))


def test_layers(tmp_path):
    write(tmp_path / "roles.json", {"roles": {"captions": {"backend": "stub", "args": {"a": 1, "b": 2}}, "tracks": {"backend": "iou"}}})
    write(tmp_path / "profiles/gpu.json", {"roles": {"captions": {"args": {"b": 3}}}})
    write(tmp_path / "profiles/footage/security.json", {"roles": {"captions": {"enabled": False}}, "min_cosine": 0.1})
    got = config.load_config(str(tmp_path), "security", "gpu")
    assert got.roles["captions"] == {"backend": "stub", "args": {"a": 1, "b": 3}, "enabled": False} and got.disabled() == ["captions"]
    assert got.footage.min_cosine == 0.1 and config.load_config(str(tmp_path)).disabled() == []
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path), "sports")
    for bad in ({"roles": {"tracks": {"enabled": False}}}, {"roles": {"captions": {"enabled": "no"}}}, {"roles": [1]}, {"roles": {"captions": 3}}, {"retention_days": 0}, {"colour": 1}, [1]):
        write(tmp_path / "profiles/footage/bad.json", bad)
        with pytest.raises(ValueError):
            config.load_config(str(tmp_path), "bad")


def test_run_roles_reingest_and_reprocess(spark, tmp_path):
    videos = schemas.conform(spark.createDataFrame([("a", "pending", 2.0, "cam"), ("b", "pending", 2.0, "cam"), ("c", "pending", None, "cam")], "id string, ingest_status string, fps double, camera_id string"), "videos").withColumn("video_id", F.col("id"))
    said = lambda text, skip=(): lambda v: v.filter(~F.col("video_id").isin(*skip, "")).select("video_id", F.lit(0.0).alias("start_time"), F.lit(1.0).alias("end_time"), F.concat(F.lit(text), "video_id").alias("text"))
    broken = lambda v: v.select("video_id", F.raise_error(F.lit("no decoder")).cast("string").alias("text"))
    roles = {"transcript": ("transcripts", said("one ")), "ocr": ("ocr_results", broken), "actions": ("action_events", said("x"))}
    got = ingest.run_roles(videos, roles, str(tmp_path), {"transcript": "f1"}, "r1", disabled=["actions"])
    assert got.written == {"transcript": 3} and list(got.failed) == ["ocr"] and got.skipped == ["actions"]
    assert ingest.missing_roles(list(roles), got) == ["ocr", "actions"]
    done = ingest.finished(videos, videos.filter("video_id <> 'c'"), got, ["transcript"], "r1")
    assert {r["video_id"]: r["ingest_status"] for r in done.collect()} == {"a": "done", "b": "done", "c": "pending"}
    assert ingest.finished(videos, videos, got, ["ocr"], "r1").filter("ingest_status = 'failed' AND ingest_error LIKE 'ocr%'").count() == 3

    read = lambda: {r["video_id"]: r["text"] for r in versions.open_role(spark, f"{tmp_path}/transcripts", "transcripts").collect()}
    after, outcome = ingest.reingest(videos, videos.filter("video_id IN ('a', 'b')"), {"transcript": ("transcripts", said("two ", ["b"]))}, str(tmp_path), {"transcript": "f2"}, "r2")
    assert outcome.failed == {} and read() == {"a": "two a", "c": "one c"}  # b has no rows any more, c is as it was
    assert after.filter("video_id = 'a'").first()["camera_id"] == "cam" and after.filter("ingest_status = 'done'").count() == 2

    provenance = versions.open_role(spark, f"{tmp_path}/role_provenance", "role_provenance")
    assert {(r["video_id"], r["fingerprint"]) for r in provenance.collect()} == {("a", "f2"), ("b", "f2"), ("c", "f1")}
    stale = catalog.stale_roles(videos.withColumn("ingest_status", F.lit("done")), provenance, {"transcript": "f3"})
    plan = catalog.reprocess_plan(stale, provenance, {})
    runs = ingest.reprocess(plan, videos, {"transcript": ("transcripts", said("three "))}, str(tmp_path), {"transcript": "f3"}, "r3")
    assert list(runs) == ["transcript"] and read() == {"a": "three a", "b": "three b", "c": "one c"}  # c has no rate


def test_pixels(spark):
    row = spark.createDataFrame([(list(range(256)), [0] * 9 + [255], [], [5, 1, 2, 2, 9, 8])], "r array<int>, g array<int>, b array<int>, grid array<int>")
    h = row.select(image.rgb_histogram(F.col("r"), F.col("g"), F.col("b"))).first()[0]
    want = np.histogram(np.arange(256), bins=16, range=(0, 255))[0] / 256
    assert np.allclose(h[:16], want) and h[16] == 0.9 and h[31] == 0.1 and h[32:] == [0.0] * 16
    assert row.select(image.histogram_distance(image.rgb_histogram("r", "r", "r") if False else image.rgb_histogram(F.col("r"), F.col("r"), F.col("r")), image.rgb_histogram(F.col("g"), F.col("g"), F.col("g")))).first()[0] == pytest.approx(0.5 * np.abs(want - np.array(h[16:32])).sum())
    assert row.select(image.dhash(F.col("grid"), 2)).first()[0] == 0b1001


def test_color_embeddings(spark):
    rows = spark.createDataFrame([("A red car",), ("Red",), ("something else",), (None,)], "t string")
    got = [r[0] for r in rows.select(image.color_embedding(image.color_key(F.col("t")))).collect()]
    assert np.allclose(got[0], image.key_vector("red", 64)) and got[0] == got[1] and got[3] is None
    assert np.allclose(got[2], image.key_vector("__text__:something else", 64)) and abs(np.linalg.norm(got[2]) - 1) < 1e-6


def test_motion_spans(spark):
    events = spark.createDataFrame([("1", 90.0, 101.0), ("1", 130.0, 131.0), ("1", 1e6, 1e6 + 1), ("2", 110.0, 111.0)], "camera_ref string, start_epoch double, end_epoch double")
    chunks = spark.createDataFrame([("v", "1", 100.0, 60.0), ("w", "3", 100.0, 60.0)], "video_id string, camera_ref string, start_epoch double, duration_seconds double")
    got = sorted(map(tuple, intervals.motion_spans(events, chunks, margin=30.0, pad=2.0).collect()))
    assert got == [("v", 0.0, 33.0), ("w", 0.0, 60.0)]


def test_wide_islands_match_plain_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i % 3), float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 3000, 400).round(1), rng.choice([0.0, 1.0, 5.0, 700.0], 400, p=[0.4, 0.3, 0.28, 0.02]), strict=True))]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    spans = lambda found: sorted(map(tuple, found.groupBy("k", "island").agg(F.min("a"), F.max("b"), F.count("*")).drop("island").collect()))
    want = spans(intervals.islands(df, ["k"], "a", "b", 10.0))
    assert want == spans(intervals.wide_islands(df, ["k"], "a", "b", 10.0, width=50.0)) == spans(intervals.wide_islands(df, ["k"], "a", "b", 10.0))


def test_scan_evidence(spark):
    seen = spark.createDataFrame([("v", "p", float(i), t) for i, t in enumerate(["red", "red", "blue", "none", "red", "red"])], "video_id string, prompt_key string, timestamp double, text string")
    items = statechange.scan_evidence(statechange.analyze_timelines(seen), seen.groupBy("video_id", "prompt_key").agg(F.count("*").alias("frames")), "the dress").collect()
    counted = [r for r in items if r["modality"] == "deep_scan_count"]
    assert len(counted) == 1 and "6 frames" in counted[0]["content"] and "1 distinct states" in counted[0]["content"] and "red: 1" in counted[0]["content"]
    assert [r["content"] for r in items if r["modality"] == "observation"] == ["red"]
