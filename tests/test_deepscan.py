"""Sweeps: both caches, what they ask models for, unreadable frames, which video is swept."""

import json
import os

import pytest

from timelens.operators import deepscan
from timelens.sources import versions

VIDEOS = "video_id string, local_path string, duration_seconds double, profile string, source_type string"


@pytest.fixture
def asked(spark):
    return spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)


def models(asked, captions="c1", states="n1"):
    frames, sweeps = asked

    def captioner():
        def say(rows):
            frames.add(len(rows))
            return [None if r["timestamp"] == 3.0 else ("red gown", "Red Gown!", "blue coat", "n/a")[int(r["timestamp"]) % 4] + " \n" for r in rows]

        return say

    def normaliser():
        def judge(subject, labels, timeline):
            sweeps.add(1)
            assert subject in ("dress", "the dress") and labels == sorted(set(labels)) and timeline[0][0] == 0.0
            return {"red gown": "gown", "Red Gown!": "gown"}

        return judge

    return deepscan.Models(captioner, captions, normaliser, states)


def test_a_second_sweep_asks_no_model(spark, tmp_path, asked):
    videos = spark.createDataFrame([("v", "v.mp4", 8.0, None, "local"), ("w", "w.mp4", 2.0, None, "local")], VIDEOS)
    segments = spark.createDataFrame([], "video_id string, start_time double, end_time double")
    wanted = spark.createDataFrame([("v", "the dress"), ("w", "the dress"), ("v", "dress")], "video_id string, scan_target string")
    scan = lambda m: {r["video_id"]: r for r in deepscan.deep_scan(wanted, videos, segments, str(tmp_path / "observations"), m).filter("modality = 'deep_scan_count'").collect()}
    got = scan(models(asked))
    assert asked[0].value == 12 and asked[1].value == 2  # 9 and 3 frames, once for both wordings
    facts = json.loads(got["v"]["attributes"])
    assert facts["frames_scanned"] == 8 and facts["cached"] is False and facts["normalized"] is True  # one frame couldn't be read
    assert facts["episodes"] == {"gown": 1} and (facts["changes_low"], facts["changes_high"], facts["distinct_states"]) == (0, 4, 1)  # the coat flickers
    assert facts["label_mapping"] == {"red gown": "gown", "Red Gown!": "gown"} and (got["v"]["time_start"], got["v"]["time_end"]) == (0.0, 8.0)
    again = scan(models(asked))
    assert (asked[0].value, asked[1].value) == (12, 2) and json.loads(again["v"]["attributes"])["cached"] is True
    assert {k: v for k, v in json.loads(again["v"]["attributes"]).items() if k != "cached"} == {k: v for k, v in facts.items() if k != "cached"}
    scan(models(asked, states="n2"))  # another reasoner judges what was seen again
    assert (asked[0].value, asked[1].value) == (12, 4)
    scan(models(asked, captions="c2"))  # another captioner looks again
    assert (asked[0].value, asked[1].value) == (24, 6)


def test_a_sweep_that_stops_leaves_nothing(spark, tmp_path):
    def broken():
        def say(rows):
            raise RuntimeError("out of memory")

        return say

    videos = spark.createDataFrame([("v", "v.mp4", 8.0, None, "local")], VIDEOS)
    segments = spark.createDataFrame([("v", 0.0, 4.0)], "video_id string, start_time double, end_time double")
    wanted = spark.createDataFrame([("v", "the dress")], "video_id string, scan_target string")
    with pytest.raises(Exception, match="out of memory"):
        deepscan.deep_scan(wanted, videos, segments, str(tmp_path / "o"), deepscan.Models(broken, "c"))
    assert versions.open_role(spark, str(tmp_path / "o"), "observations").count() == 0 if versions.Versioned(spark, str(tmp_path / "o")).exists() else True


def test_keys(spark):
    rows = spark.createDataFrame([("v", "the girl's dress (color and style)"), ("v", "dress the girl is wearing"), ("v", "hat")], "video_id string, scan_target string")
    assert deepscan.keyed(rows, "c").count() == 2
    key = lambda *a, **k: deepscan.keyed(rows.limit(1), *a, **k).first()["prompt_key"]
    assert len({key("c"), key("d"), key("c", frames=60), key("c", fps=2.0)}) == 4


def test_frame_times(spark):
    videos = spark.createDataFrame([("a", 5.0), ("b", 300.0), ("c", None), ("d", 10.0)], "video_id string, duration_seconds double")
    segments = spark.createDataFrame([("d", 0.0, 4.0), ("x", 0.0, 4.0)], "video_id string, start_time double, end_time double")
    got = {}
    for r in deepscan.frame_times(videos, segments).collect():
        got.setdefault(r["video_id"], []).append(r["timestamp"])
    assert sorted(got["a"]) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and got["c"] == [0.0] and got["d"] == [2.0]
    assert sorted(got["b"]) == [2.5 * i for i in range(121)]  # the wider stride keeps to the budget


def test_scan_requests(spark):
    videos = spark.createDataFrame([("v", "v.mp4", 8.0, None, "local"), ("w", None, 8.0, None, "local"), ("s", "s.mp4", 8.0, None, "nvr_recorded")], VIDEOS)
    items = spark.createDataFrame([(1, "v", 2), (1, "s", 1), (1, "s", 3), (1, "v", 4), (2, "v", 1), (3, "w", 1), (4, None, 1)], "question_id long, video_id string, position long")
    questions = spark.createDataFrame([(1, "dress", None), (2, "", None), (3, "dress", "v"), (4, "dress", "v"), (5, "dress", None)], "question_id long, scan_target string, primary_video_id string")
    got = {r["question_id"]: (r["video_id"], r["skipped"]) for r in deepscan.scan_requests(questions, items, videos, off=("security",)).collect()}
    assert got[1] == (None, "the video's footage profile gates deep scans off")  # equal votes: s was seen first
    assert got[2] == (None, "no scan target derivable from the query") and got[3] == (None, "no target video resolvable")
    assert got[4] == ("v", None) and got[5] == (None, "no target video resolvable")
    only = deepscan.scan_requests(questions.filter("question_id = 5"), items, videos.limit(1)).first()
    assert only["video_id"] == "v"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_states_look_at_each_frame_once(spark, asked, monkeypatch):
    from timelens import queries_scan

    frames, plain = asked[0], queries_scan._captioner

    def counting():
        def made():
            say = plain()

            def each(rows):
                frames.add(len(rows))
                return say(rows)

            return each

        return made()

    monkeypatch.setattr(queries_scan, "_captioner", counting)
    queries_scan.f19_sweep(spark, "/root/testdata/sf0.001").collect()
    once = frames.value
    queries_scan.f20_states(spark, "/root/testdata/sf0.001").collect()
    assert once > 0 and frames.value == 2 * once


def test_shown_runs():
    seen = [{"timestamp": float(t), "text": x, "state": None if x is None else x.lower().strip(".")} for t, x in enumerate(["Red.", "red", None, None, "red", "blue"])]
    assert deepscan._shown_runs(seen) == [(0.0, 1.0, "Red."), (2.0, 2.0, None), (3.0, 3.0, None), (4.0, 4.0, "red"), (5.0, 5.0, "blue")]
    many = [{"timestamp": float(t), "text": str(t % 2), "state": str(t % 2)} for t in range(200)]
    assert len(deepscan._shown_runs(many)) == deepscan.SHOWN_TIMELINE
