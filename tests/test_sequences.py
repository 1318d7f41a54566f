"""Intervals, state changes, the tracker, delivery and watching, on hand-worked and random cases."""

import random

from pyspark.sql import functions as F

from timelens.operators import delivery, folds, intervals, statechange, tracks
from timelens.streaming import watch


def clusters(spark, rows, gap):
    df = spark.createDataFrame([(c, float(a), float(z), "motion") for c, a, z in rows], "camera_ref string, start_epoch double, end_epoch double, kind string")
    return sorted((r["camera_ref"], r["start_epoch"], r["end_epoch"]) for r in intervals.cluster_events(df, gap).collect())


def test_clusters(spark):
    assert clusters(spark, [("1", 0, 10), ("1", 25, 40), ("1", 300, 310), ("2", 20, 30)], 30) == [("1", 0, 40), ("1", 300, 310), ("2", 20, 30)]
    assert clusters(spark, [("1", 0, 10), ("1", 10, 20), ("1", 21, 30)], 0) == [("1", 0, 20), ("1", 21, 30)]
    assert clusters(spark, [("1", 20, 60), ("1", 0, 50)], 5) == [("1", 0, 60)]


def test_clusters_random(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [(str(rng.randint(0, 2)), a := rng.randint(0, 400), a + rng.randint(0, 30)) for _ in range(60)]
        want = []
        for cam in "012":
            own = []
            for _, a, z in sorted(r for r in rows if r[0] == cam):
                if own and a - own[-1][1] <= 7:
                    own[-1][1] = max(own[-1][1], z)
                else:
                    own.append([a, z])
            want += [(cam, a, z) for a, z in own]
        assert clusters(spark, rows, 7) == sorted(want)


def test_speakers(spark):
    lines = spark.createDataFrame([("v", 0, 0.0, 2.0, None), ("v", 1, 2.0, 4.0, None), ("v", 2, 9.0, 9.5, "kept"), ("w", 0, 0.0, 2.0, None)], "video_id string, line_id int, start_time double, end_time double, speaker string")
    turns = spark.createDataFrame([("v", 0.0, 1.8, "A"), ("v", 1.8, 4.0, "B")], "video_id string, start_time double, end_time double, speaker string")
    got = {(r["video_id"], r["line_id"]): r["speaker"] for r in intervals.assign_speakers(lines, turns).collect()}
    assert got == {("v", 0): "A", ("v", 1): "B", ("v", 2): "kept", ("w", 0): None}
    tie = spark.createDataFrame([("w", 0.0, 1.0, "first"), ("w", 1.0, 2.0, "second")], "video_id string, start_time double, end_time double, speaker string")
    assert {r["speaker"] for r in intervals.assign_speakers(lines.filter("video_id = 'w'"), tie).collect()} == {"first"}


def test_wallclock(spark):
    base = 1000.0
    videos = spark.createDataFrame([("a", base, 600.0), ("b", base + 900, 600.0), ("c", None, 600.0), ("d", base + 2000, None)], "video_id string, start_epoch double, duration_seconds double")
    got = [(r["video_id"], r["rel_start"], r["rel_end"]) for r in intervals.wallclock_to_chunks(videos, base + 500, base + 1000).orderBy("start_epoch").collect()]
    assert got == [("a", 500.0, 600.0), ("b", 0.0, 100.0)]
    assert [(r["video_id"], r["rel_end"]) for r in intervals.wallclock_to_chunks(videos, base + 2010, base + 2080).collect()] == [("d", 80.0)]


def test_markers_and_cuts(spark):
    log = spark.createDataFrame([("1", 1, 10.0, None), ("1", 2, None, 20.0), ("1", 3, 30.0, None), ("1", 4, 40.0, None), ("1", 5, None, 50.0), ("1", 6, None, 60.0), ("1", 7, 70.0, None), ("2", 8, 5.0, 6.0)], "channel string, seq int, start_epoch double, end_epoch double")
    got = sorted(map(tuple, intervals.pair_markers(log).collect()))
    assert got == [("1", 10.0, 20.0, False), ("1", 30.0, 30.0, True), ("1", 40.0, 50.0, False), ("1", 60.0, 60.0, False), ("1", 70.0, 70.0, True), ("2", 5.0, 6.0, False)]
    frames = spark.createDataFrame([("v", 0.0, 0.0), ("v", 0.5, 0.9), ("v", 1.0, 0.9), ("v", 1.3, 0.9), ("v", 2.0, 0.9)], "video_id string, timestamp double, distance double")
    assert sorted(r["timestamp"] for r in intervals.scene_cuts(frames).collect()) == [1.0, 2.0]


def analyzed(*labels):
    runs, low, high, distinct = statechange.analyze([(float(i), t) for i, t in enumerate(labels)])
    return len(runs), low, high, distinct


def test_state_changes():
    assert analyzed(*["red scene"] * 2, "green thing", "blue object", "red scene") == (4, 3, 3, 3)
    assert analyzed("pink dress", "blush pink dress", "blue gown")[1:3] == (1, 2)
    assert analyzed("pink dress", "none", "none", "pink dress", "blue dress")[:3] == (2, 1, 1)
    assert analyzed(*["brown speckled bird", "brown striped"] * 2, "brown speckled bird")[:2] == (1, 0)
    assert analyzed("pink dress", "blue gown", "blue gown", "pink dress")[:2] == (3, 2)
    assert analyzed() == (0, 0, 0, 0)


def debounced(merged):
    """The rule as stated: the first flicker goes, again and again."""
    again = True
    while again:
        again = False
        for i in range(1, len(merged) - 1):
            if merged[i][0] == merged[i][1] and merged[i - 1][2] == merged[i + 1][2]:
                merged[i - 1][1] = merged[i + 1][1]
                del merged[i : i + 2]
                again = True
                break
    return merged


def test_flicker_random():
    rng = random.Random(2)
    for _ in range(500):
        labels = [rng.choice("abc") * 3 for _ in range(rng.randint(0, 25))]
        runs = []
        for i, t in enumerate(labels):
            if runs and runs[-1][2] == t:
                runs[-1][1] = float(i)
            else:
                runs.append([float(i), float(i), t])
        assert [list(r) for r in statechange.analyze([(float(i), t) for i, t in enumerate(labels)])[0]] == debounced(runs)


def test_timelines(spark):
    df = spark.createDataFrame([(1, "p", float(i), t) for i, t in enumerate(["a", "a", "none", "b"])] + [(2, "p", 0.0, None)], "video_id int, prompt_key string, timestamp double, text string")
    got = statechange.analyze_timelines(df).collect()
    assert [(r["video_id"], r["changes_high"], len(r["runs"])) for r in got] == [("1", 1, 2)]
    spans = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 30.0)], "video_id int, start_time double, end_time double")
    assert sorted(r["timestamp"] for r in statechange.sample_times(spans, 100).collect()) == [5.0, 12.0, 16.0, 20.0, 24.0, 28.0]
    assert sorted(r["timestamp"] for r in statechange.sample_times(spans, 4).collect()) == [5.0, 12.0, 20.0, 24.0]


def boxes(*rows):
    return [(ts, cls, c, (x, 0.1, 0.2, 0.2)) for ts, cls, c, x in rows]


def test_tracker(spark):
    drift = boxes(*[(float(t), c, 0.9, x + 0.05 * t) for t in range(4) for c, x in (("red", 0.0), ("blue", 0.5))])
    given, found = tracks.associate(drift)
    assert len(found) == 2 and [t.frames for t in found] == [4, 4]
    assert len(tracks.associate(boxes((0.0, "red", 0.9, 0.1), (5.0, "red", 0.9, 0.1)))[1]) == 2
    assert len(tracks.associate(boxes((0.0, "red", 0.9, 0.1), (0.0, "red", 0.9, 0.1)))[1]) == 2
    assert len(tracks.associate(boxes((0.0, "red", 0.9, 0.1), (1.0, "Red", 0.9, 0.1)))[1]) == 2
    df = spark.createDataFrame([(1, ts, cls, c, *b) for ts, cls, c, b in drift], "video_id int, timestamp double, object_class string, confidence double, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    assert sorted((r["object_class"], r["frame_count"]) for r in tracks.track(df).collect()) == [("blue", 4), ("red", 4)]


def test_delivery(spark):
    clips = spark.createDataFrame([(c, 0.0, w, *p) for c, w, p in (("ok", 60.0, (2688, 1520, 20)), ("sub", 60.0, (352, 240, 20)), ("head", 60.0, (2688, 1520, 20)), ("all", 60.0, (2688, 1520, 20)), ("short", 2.5, (2688, 1520, 20)), ("clock", 60.0, (2688, 1520, None)))], "clip_id string, start_epoch double, window_len double, width int, height int, fps int")
    head = spark.createDataFrame([("head", 0.0, 40), ("head", 1.0, 3), ("all", 0.0, 40), ("all", 1.0, 40), ("short", 0.0, 40), ("short", 2.0, 1), ("ok", 0.0, 20)], "clip_id string, t double, distance int")
    clock = spark.createDataFrame([("clock", 0.0, 604800.0), ("clock", 1.0, 1.0), ("clock", 2.0, 2.0)], "clip_id string, t double, observed_epoch double")
    got = {r["clip_id"]: (r["action"], r["trim_before"]) for r in delivery.verify_delivery(clips, head, clock, [(2688, 1520, 20)]).collect()}
    assert got == {"ok": ("accept", 0.0), "sub": ("reject", 0.0), "head": ("trim", 1.0), "all": ("reject", 0.0), "short": ("reject", 0.0), "clock": ("trim", 1.0)}


NOW = 1_700_000_000.0
T0 = NOW - 300


def passed(spark, events, rules=watch.WatchRules(settle=60.0), watermark=T0, done=None, failed=None):
    cameras = spark.createDataFrame([("nvr-ch1", "1", watermark)], "camera_id string, source_ref string, last_processed_epoch double")
    df = spark.createDataFrame([(c, T0 + a, T0 + z, o) for c, a, z, o in events], "camera_ref string, start_epoch double, end_epoch double, open boolean")
    keys = lambda uris: spark.createDataFrame([(u,) for u in uris], "uri string")
    plan = watch.catch_up(cameras, df, NOW, rules, keys(done or []), keys(failed or []))
    rows = plan.windows.orderBy("window_start").collect()
    mark = plan.cameras.first()
    at = mark["last_processed_epoch"]
    return [(r["window_start"] - T0, r["window_end"] - T0) for r in rows], None if at is None else at - T0, mark["truncated"], [r["uri"] for r in rows]


def test_catch_up(spark):
    events = [("1", 10, 40, False), ("1", 100, 130, False), ("1", 290, 310, False), ("9", 50, 60, False)]
    windows, mark, cut, uris = passed(spark, events)
    assert windows == [(10, 40), (100, 130)] and mark == 240 and not cut
    assert passed(spark, events, watermark=T0 + 240)[:3] == ([], 240, False)
    assert passed(spark, events, done=uris)[:2] == ([], 240)
    assert passed(spark, events, failed=uris[1:])[:2] == ([(10, 40), (100, 130)], 40)
    assert passed(spark, [("1", -20, 30, False)])[0] == []


def test_catch_up_budget_and_split(spark):
    three = [("1", 0, 30, False), ("1", 100, 130, False), ("1", 200, 230, False)]
    windows, mark, cut, _ = passed(spark, three, watch.WatchRules(settle=60.0, max_windows=2))
    assert len(windows) == 2 and mark == 130 and cut
    windows, *_ = passed(spark, [("1", -700, -410, False)], watch.WatchRules(settle=60.0), watermark=T0 - 800)
    assert windows == [(-700, -580), (-580, -460), (-460, -410)]


def test_catch_up_defers(spark):
    # an open instant close behind a settled event isn't lost in its cluster
    windows, mark, *_ = passed(spark, [("1", 10, 40, False), ("1", 60, 60, True), ("1", 150, 170, False)])
    assert windows == [(10, 40), (150, 170)] and mark == 60
    windows, mark, *_ = passed(spark, [("1", -900, -900, True)], watermark=T0 - 1000)
    assert windows == [(-900, -780)] and mark == 240
    # without a watermark, an hour is looked back
    assert passed(spark, [("1", 10, 40, False)], watermark=None)[1] == 240


def test_stream(spark, tmp_path):
    from timelens.sources import sidecars

    (tmp_path / "in").mkdir()
    cameras = spark.createDataFrame([("nvr-ch1", "1", T0)], "camera_id string, source_ref string, last_processed_epoch double")
    pulled = []

    def ingest(windows):
        pulled.extend(r["uri"] for r in windows.collect())
        return windows.select("uri")

    stream = watch.WatchStream(spark, str(tmp_path / "state"), cameras, ingest, lambda: NOW, watch.WatchRules(settle=60.0))

    def write(name, start, end):
        (tmp_path / "in" / name).write_text(f'{{"events": [{{"camera_ref": "1", "start_epoch": {start}, "end_epoch": {end}}}]}}')

    for i, (a, z) in enumerate(((10, 40), (100, 130))):
        write(f"{i}.motion.json", T0 + a, T0 + z)
        stream.start(sidecars.motion_stream(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination(120)
    # the second event starts before the watermark that the first pass set
    assert len(pulled) == len(set(pulled)) == 1
    last = spark.read.parquet(str(tmp_path / "state" / "cameras" / "v=1")).first()
    assert last["last_processed_epoch"] == NOW - 60


def test_temporal_joins_agree(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(rng.randint(0, 2), i, float(rng.randint(0, 500))) for i in range(200)], "video_id int, p int, timestamp double")
    spans = spark.createDataFrame([(rng.randint(0, 2), i, a := float(rng.randint(0, 500)), a + rng.randint(0, 90)) for i in range(80)], "video_id int, s int, start_time double, end_time double")
    plain = {(r["p"], r["s"]) for r in intervals.temporal_join(points, spans).collect()}
    dealt = [(r["p"], r["s"]) for r in intervals.bucketed_temporal_join(points, spans, "video_id", 40.0).collect()]
    assert len(dealt) == len(set(dealt)) and set(dealt) == plain
    assert intervals.runs(points.limit(0), ["video_id"], "timestamp", F.col("p")).count() == 0


def test_folds_keep_keys_whole_after_a_join(spark):
    """A join on a fold's keys that turns out to be small is made without dealing its rows by them."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c, None) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        rows = spark.range(0, 4000, 1, 5).select((F.col("id") % 40).cast("string").alias("k"), F.col("id").alias("t"))
        known = spark.range(40).select(F.col("id").cast("string").alias("k"))
        counted = folds.streamed(rows.join(known, "k"), ["k"], ["t"], ["t"], lambda key, seen: iter([(*key, sum(1 for _ in seen))]), "k string, n long")
        assert sorted(map(tuple, counted.collect())) == sorted((str(i), 100) for i in range(40))
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_temporal_join_tries_few_pairs(spark):
    """A key with many rows: pairs tried go with pairs found, whatever the spans' lengths; edges, open and endless spans are met."""
    inf = float("inf")
    rng = random.Random(7)
    spans = [("c", i, a := float(rng.randint(-500, 90_000)), a + rng.choice([0.0, 1.0, 3.5, 64.0, 700.0, 20_000.0])) for i in range(300)]
    spans += [("c", 300, -inf, 10.0), ("c", 301, 89_000.0, inf), ("c", 302, 50.0, 40.0), ("c", 303, None, 9.0), ("d", 304, 1e16, 2e16), ("d", 305, -1e15, 1e15), ("d", 306, -4.0, -4.0)]
    points = [("c", i, rng.choice([float(rng.randint(-500, 90_000)), rng.choice([s[3] for s in spans[:300]])])) for i in range(400)]
    points += [("c", 400, None), ("d", 401, 1.5e16), ("d", 402, 1e15), ("d", 403, -4.0), ("e", 404, 1.0)]
    a = spark.createDataFrame(spans, "video_id string, span int, start_time double, end_time double")
    p = spark.createDataFrame(points, "video_id string, point int, timestamp double")
    want = sorted((k, i, j) for k, i, t in points for o, j, x, y in spans if k == o and None not in (t, x, y) and x <= t <= y)
    joined = intervals.temporal_join(p, a)
    assert joined.columns == ["video_id", "point", "timestamp", "span", "start_time", "end_time"]
    assert sorted((r["video_id"], r["point"], r["span"]) for r in joined.collect()) == want
    # one key's rows by themselves: a join by the key alone tries all 4,000,000 pairs
    many = spark.range(2000).select((F.col("id") % 1).alias("video_id"), (F.col("id") * 50).cast("double").alias("timestamp"))
    short = spark.range(2000).select((F.col("id") % 1).alias("video_id"), (F.col("id") * 50).cast("double").alias("start_time"), (F.col("id") * 50 + F.col("id") % 40).cast("double").alias("end_time"))
    found = intervals.temporal_join(many, short)
    assert any("Join Inner" in x and "_bucket" in x and "_width" in x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert found.count() == 2000


def test_delivered_frames_are_looked_at_once(spark):
    """Hashes of frames are made once, however many steps of the verdict ask for them."""
    looked = spark.sparkContext.accumulator(0)

    def decoded(batches):
        for batch in batches:
            looked.add(batch.num_rows)
            yield batch

    rng = random.Random(3)
    own, other = ([float(rng.randint(0, 255)) for _ in range(56)] for _ in range(2))
    rows = [(clip, i, i / 4, other if i < heads else own) for clip, heads in ((1, 0), (2, 3), (3, 8)) for i in range(12)]
    frames = spark.createDataFrame(rows, "clip_id int, frame_index int, t double, grid array<double>").mapInArrow(decoded, "clip_id int, frame_index int, t double, grid array<double>")
    clips = spark.createDataFrame([(c, 0.0, 3.0, 3.0, "2688x1520", 20.0) for c in (1, 2, 3)], "clip_id int, start_epoch double, window_len double, duration double, resolution string, rate double")
    clock = spark.createDataFrame([(c, 1.0, 1.0) for c in (1, 2, 3)], "clip_id int, t double, observed_epoch double")
    got = {r["clip_id"]: (r["action"], r["trim_before"]) for r in delivery.verified_clips(clips, frames, clock, [(2688, 1520, 20)], size=7).collect()}
    assert looked.value <= 2 * len(rows)
    assert got[1] == ("accept", 0.0) and got[2] == ("trim", 0.75) and got.keys() == {1, 2, 3}
