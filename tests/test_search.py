"""Text functions, lexical and vector search, fusion, planning, catalog, sources."""

import pytest
from pyspark.sql import functions as F

from timelens import schemas
from timelens.functions import geometry, vector
from timelens.functions import text as tx
from timelens.functions import timeparse as tp
from timelens.operators import catalog, fuse, search, vectors
from timelens.plans import planner, roles
from timelens.sources import media, sidecars, uris, vendor_log


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.col("id")]).select(column).first()[0]


def test_text_forms(spark):
    t = F.lit("  The Dogs'  RAN, ran! Glass ")
    assert sorted(one(spark, tx.tokens(t))) == ["dogs'", "glass", "ran", "the"]
    assert one(spark, tx.squeezed(t)) == "the dogs' ran, ran! glass" and one(spark, tx.collapsed(t)) == "thedogsranranglass"
    assert tx.resolve_category("glass cars")[0] == ["glass", "gla", "cars", "car"]
    for label, visible in (("None.", False), ("n/a", False), ("no dress", False), ("OTHER", False), ("not visible", False), ("red dress", True), ("no red dress", True)):
        assert one(spark, tx.is_visible(F.lit(label))) is visible
    assert one(spark, tx.canonical_key(F.lit("the girl's dress/outfit"))) == "dre-girl-outfit" == one(spark, tx.canonical_key(F.lit("Girls dresss outfit")))
    assert one(spark, tx.canonical_key(F.lit("the color"))).startswith("t") and one(spark, tx.canonical_key(F.lit("the color"))) != one(spark, tx.canonical_key(F.lit("the wearing")))
    assert one(spark, tx.snippet(F.lit("one two three"), 9)) == "one two…" and one(spark, tx.snippet(F.lit("one"), 9)) == "one"
    assert one(spark, tx.minutes(F.lit(67.9))) == "1:07"
    assert [one(spark, tx.verdict(F.lit(a))) for a in ("Yes, it is", "no.", "maybe yes", "it is", "NOPE", " None of it", "false", "Yeah", "correct", "true", "sure", "not sure", "no, cannot see it", "nothing", "")] == ["yes", "no", "unsure", "unsure", "no", "no", "no", "yes", "yes", "yes", "yes", "no", "no", "unsure", "unsure"]
    assert tx.first_json_object('x {"a": {"b": 1}} y') == {"a": {"b": 1}} and tx.first_json_object("none") is None and tx.first_json_object("{bad}") is None
    assert tx.fingerprint("r", {"a": 1, "b": 2}) == tx.fingerprint("r", {"b": 2, "a": 1}) != tx.fingerprint("r", {"a": 2})
    assert one(spark, tx.deep_link(F.lit("youtube"), F.lit("k"), F.lit("u"), F.lit(67.5))).endswith("watch?v=k&t=67s")
    said = ("There is not enough evidence", "It is unclear from this", "Unknown.", "cannot be confirmed", "Can't count them", "five cars", None)
    assert [one(spark, tx.insufficient(F.lit(a).cast("string"))) for a in said] == [True] * 5 + [False] * 2
    assert tx.first_json_object('```json\n{"a": 1}\n```') == {"a": 1} and tx.first_json_object('{"a": "```json"}') == {"a": ""}
    assert [one(spark, tx.slug(F.lit(t).cast("string"))) for t in ("A  Red-Car!", "x" * 31 + " y", "???", None)] == ["a-red-car", "x" * 31, "video", "video"]
    assert [one(spark, tx.key16(F.lit(k))) for k in ("sha256:abcdef0123456789ff", "nvr:ch1:100-200", "plain_key", "a:!")] == ["abcdef0123456789", "ch1100-200", "plain_key", "unknown"]
    assert [one(spark, tx.snippet(F.lit(t).cast("string"), 9)) for t in (" one\ntwo  x\t", "abcdefghijkl", "ab  cd  efg", None)] == ["one two…", "abcdefghi…", "ab  cd…", ""]


def test_times(spark):
    assert [one(spark, tp.coerced_seconds(F.lit(x))) for x in ("12", "3.5S", "1:07 ", "01:02:03", "soon", "1:2:3:4", "3 s s", "1d", "")] == [12.0, 3.5, 67.0, 3723.0, None, 223384.0, None, None, None]
    assert one(spark, tp.window_uri(F.lit("1"), F.lit(0.4), F.lit(0.6))) == "nvr://1/1970-01-01T00:00:00+00:00/1970-01-01T00:00:01+00:00"
    assert one(spark, tp.window_uri(F.lit("1"), F.lit(0.4), F.lit(120.4))).endswith("00:02:00+00:00")
    assert one(spark, tp.local_iso(F.lit(0.0), "America/Los_Angeles")) == "1969-12-31T16:00:00"
    assert tp.parse_date("1970-01-02") == 86400 and tp.parse_date("1970-01-01 00:01") == 60


def test_geometry_and_vectors(spark):
    lit = lambda *xs: tuple(F.lit(float(x)) for x in xs)
    assert one(spark, geometry.iou(lit(0, 0, 1, 1), lit(0.5, 0, 1, 1))) == pytest.approx(1 / 3) and one(spark, geometry.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0))) == 0
    assert one(spark, geometry.hamming(F.lit(5), F.lit(6))) == 2
    df = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 1.0]), ("o", [0.0, 0.0, 0.0]), ("s", [1.0])], "id string, embedding array<float>")
    ready = vectors.add_vectors(df, 3)
    assert ready.count() == 4 and vectors.cosine_top_k(ready, [0.1, 0.9, 0.0], 2, "id").first()["id"] == "y"
    for text in ("the quarterly budget report", "", "a a b"):
        got = one(spark, vector.hash_embedding(F.lit(text), 64))
        assert got == pytest.approx(vector.hash_embed(text, 64), abs=1e-6)
    v = ready.withColumn("modality", F.when(F.col("id") == "y", "caption").otherwise("transcript"))
    assert [r["id"] for r in vectors.search_text(v, [0.1, 0.9, 0.0], 1, ["transcript"], "id").collect()] == ["x"]


def test_ocr(spark):
    lines = spark.createDataFrame([("v", 0.5, "COORS LIGHT"), ("v", 1.0, "COORS LIGHT"), ("v", 2.0, "27 Dresses"), ("w", 3.0, "COOrSLIGHT")], "video_id string, timestamp double, text string")
    hit = search.search_ocr(lines.filter("video_id = 'v'"), "coors light billboard").collect()
    assert [(h["sightings"], h["time_start"], h["time_end"]) for h in hit] == [(2, 0.5, 1.0)]
    assert {h["score"] for h in search.search_ocr(lines, "coors light").collect()} == {1.0}
    assert search.search_ocr(lines, "ors").count() == 0
    assert search.search_columns({"a": lambda: lines, "b": lambda: 1 / 0})["b"].startswith("ZeroDivisionError")


def items(spark):
    rows = [("transcript", "v", 1.0, 2.0, "the quarterly budget report", 0.9), ("caption", "v", 3.0, 4.0, "a red ferrari on a road", 0.8), ("visual", "w", 5.0, 5.0, "", 0.99)]
    return spark.createDataFrame(rows, "modality string, video_id string, time_start double, time_end double, content string, score double").withColumn("position", F.lit(0))


def test_fusion(spark):
    pool = fuse.fuse(fuse.word_overlap_rerank(items(spark), "budget"))
    got = fuse.ranked(pool).collect()
    assert [g["modality"] for g in got] == ["transcript", "visual", "caption"] and got[0]["fused_score"] == pytest.approx(1.0) and got[1]["fused_score"] == pytest.approx(0.2)
    gate = spark.createDataFrame([("visual", 0.12, None), ("visual", 0.0, None), ("caption", 0.5, -1.51), ("caption", 0.5, -4.91), ("caption", 0.5, None)], "modality string, score double, rerank_score double")
    assert fuse.gated(gate, -3.0, 0.05).count() == 3 and fuse.gated(gate).count() == 5
    assert fuse.dominant_video(pool).first()["video_id"] == "v"
    assert [r["modality"] for r in fuse.strongest(pool).collect()] == ["transcript", "caption", "visual"]
    assert fuse.keyframes(pool, 2).count() == 2 and fuse.rendered(pool, ["score"], 2).count() == 2
    checked = fuse.verified_within(pool.withColumn("accepted", F.col("modality") != "visual"), 16, 1)
    assert {r["modality"] for r in checked.collect()} == {"transcript", "caption"}


def test_planner(spark):
    p = planner.plan("How many times does the girl's dress change color?")
    assert p.needs_deep_scan and p.needs_object_query and p.needs_vlm_reasoning and p.params["scan_target"] == "the girl's dress"
    assert planner.derive_scan_target("how many times did it change?") is None and planner.derive_scan_target("how many times does the color change?") == "the color"
    assert planner.plan("what does he say about text on the billboard").needs_ocr_search
    kept = planner.QueryPlan.salvage("q", {"needs_ocr_search": True, "search_terms": 3, "needs_smell": True})
    assert kept.needs_ocr_search and kept.search_terms == "" and kept.extra == {"needs_smell": True}
    assert planner.QueryPlan.salvage("who said it", {"params": 1}).needs_transcript_search
    answer = planner.ask("budget", {"caption_search": lambda p: items(spark).drop("position"), "visual": lambda p: 1 / 0})
    assert answer["items"][0].startswith("transcript: ") and any("visual was skipped" in n for n in answer["notes"])
    swept = []
    again = planner.ask("birds", {}, scan=lambda target: swept.append(target) or items(spark).drop("position"))
    assert swept == ["the birds"] and again["items"]
    assert roles.speaker_hints(spark.range(1).select(F.col("id").alias("start_time")), None, None, 3, {"num_speakers": 2, "min_speakers": 1})[0] == {"min_speakers": 1, "max_speakers": 3}
    assert one(spark, roles.nearest_color(F.lit(250), F.lit(10), F.lit(10))) == "red"


def test_catalog(spark):
    t = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "video_id string, n int")
    assert sorted(map(tuple, catalog.replace_keys(t, spark.createDataFrame([("b", 9)], t.schema), ["video_id"]).collect())) == [("a", 1), ("b", 9)]
    assert sorted(map(tuple, catalog.first_writer(t.filter("video_id = 'a'"), t, "video_id", ["n"]).collect())) == [("a", 1), ("b", 1)]
    cams = spark.createDataFrame([("x", None), ("y", 50.0), ("z", 5.0)], "camera_id string, last_processed_epoch double")
    ups = spark.createDataFrame([("x", 3.0), ("y", 10.0), ("z", 7.0)], "camera_id string, epoch double")
    assert {r[0]: r[1] for r in catalog.advance_watermarks(cams, ups).collect()} == {"x": 3.0, "y": 50.0, "z": 7.0}
    patched = catalog.patch(t.filter("n = 1"), spark.createDataFrame([("a", None), ("b", 7)], t.schema), "video_id", ["n"])
    assert {r["video_id"]: r["n"] for r in patched.collect()} == {"a": 1, "b": 7}
    assert {r["video_id"]: r["n"] for r in catalog.patch(t.filter("n = 1"), spark.createDataFrame([("a", None)], t.schema), "video_id", ["n"], False).collect()} == {"a": None, "b": 1}
    videos = spark.createDataFrame([("1", "done"), ("2", "failed"), ("3", "done")], "video_id string, ingest_status string")
    prov = spark.createDataFrame([("1", "captions", "new", 1.0), ("1", "text", "old", 2.0), ("3", "ocr", "x", 1.0)], "video_id string, role string, fingerprint string, fps double")
    stale = catalog.stale_roles(videos, prov, {"captions": "new", "text": "new", "ocr": "new"}, ["ocr"])
    assert sorted((r["video_id"], r["role"]) for r in stale.collect()) == [("1", "text"), ("3", "captions"), ("3", "ocr"), ("3", "text")]
    plan = {r["video_id"]: (r["roles"], r["refused"]) for r in catalog.reprocess_plan(stale, prov, {"captions": ["text"]}).collect()}
    assert plan == {"1": (["text"], True), "3": (["captions", "ocr"], False)}
    v = spark.createDataFrame([("k", "u", "x"), ("i", "k", "y")], "id string, source_key string, source_uri string")
    assert catalog.resolve_ident(v, "k").first()["id"] == "k" and catalog.resolve_ident(v, "y").first()["id"] == "i" and catalog.resolve_ident(v, "none").count() == 0
    assert {n: d.count() for n, d in catalog.cascade_delete({"t": t}, spark.createDataFrame([("b",)], "video_id string")).items()} == {"t": 1}
    assert schemas.conform(t, "segments").columns[:3] == ["id", "video_id", "segment_index"]


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 1)], "video_id string, n int")
    catalog.overwrite_partitions(df, path, "video_id")
    catalog.overwrite_partitions(spark.createDataFrame([("b", 2)], df.schema), path, "video_id")
    assert sorted((r["video_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "clip.mp4.transcript.json").write_text('{"lines": [{"start_time": 0, "end_time": 2, "text": "hi"}, {"start_time": 2, "end_time": 3, "text": "yo", "speaker": "A"}]}')
    got = sidecars.read_sidecars(spark, str(tmp_path / "*.transcript.json"), "transcript").orderBy("position").collect()
    assert [(r["media"], r["text"], r["speaker"]) for r in got] == [("clip.mp4", "hi", None), ("clip.mp4", "yo", "A")]
    files = sidecars.local_files(spark, str(tmp_path / "*.json")).first()
    assert files["source_key"].startswith("sha256:")
    events = spark.createDataFrame([("1", 100.0, 130.0, "motion"), ("2", 100.0, 130.0, "motion")], "camera_ref string, start_epoch double, end_epoch double, kind string")
    assert sidecars.motion_events(events, 120, 150, "1").count() == 1 and sidecars.motion_events(events, 131, 150).count() == 0
    assert uris.backend_of("nvr://1/a/b") == "nvr_recorded" and uris.backend_of("https://youtu.be/x") == "youtube" and uris.backend_of("/a/b") == "local"
    with pytest.raises(ValueError):
        uris.backend_of("https://example.com/x")
    ids = spark.createDataFrame([(u,) for u in ("https://www.youtube.com/watch?v=abcdefghijk", "https://youtu.be/abcdefghijk?t=1", "https://youtube.com/embed/abcdefghijk", "https://youtube.com/watch?v=short", "https://example.com/watch?v=abcdefghijk")], "uri string")
    assert [r[0] for r in ids.select(uris.video_id(F.col("uri"))).collect()] == ["abcdefghijk"] * 3 + [None, None]
    windows = spark.createDataFrame([("nvr://3/2026-01-01T00:00:00/2026-01-01T00:01:00",), ("nvr://3/2026-01-01T00:01:00/2026-01-01T00:00:00",), ("nvr://3/2026-01-01T00:00:00Z/2026-01-01T00:10:00Z",), ("nvr://3/x/y",), ("file",)], "uri string")
    rows = uris.recorder_windows(windows, "America/Los_Angeles").collect()
    assert [r["problem"] for r in rows] == [None, "ends before it starts", "too long", "no time", "not a window"] and rows[0]["start_epoch"] == 1767254400.0 and rows[0]["camera_id"] == "nvr-ch3"
    assert [tuple(p) for p in one(spark, uris.stream_profiles(F.lit("2688x1520@20, 640X480@,, 352x240@14.6")))] == [(2688, 1520, 20), (640, 480, None), (352, 240, 15)]
    assert one(spark, uris.stream_profiles(F.lit("  "))) is None and one(spark, uris.stream_profiles(F.lit(None).cast("string"))) is None
    for slip in ("2688x1520@20,bad", "2688x@20", "640x480@fast", ",", " , "):
        with pytest.raises(Exception, match="stream profile"):
            one(spark, uris.stream_profiles(F.lit(slip)))
    clip = spark.createDataFrame([("v", 30.0, 65)], "video_id string, fps double, frame_count int")
    assert [r["frame_index"] for r in media.sampled_frames(clip).collect()] == [0, 30, 60]
    assert media.first_frames(media.sampled_frames(clip), 2).count() == 2


def test_vendor_log(spark):
    page = "found=4\nitems[0].Time=2026-01-01 00:00:00\nitems[0].Type=Motion Detect\nitems[0].Detail=Event Type:Motion Detect\nChannel:1\nStart Time:2026-01-01 00:00:10\nitems[1].Type=Motion Detect\nitems[1].Detail=Event Type:Motion Detect\nChannel:1\nEnd Time:2026-01-01 00:00:40\nitems[2].Type=Login\nitems[2].Detail=x\ntoken=1\nstray\nitems[3].Type=Motion\nitems[3].Detail.ChannelNo=x\nitems[3].Detail=Channel No.: 2 Start Time: 2026-01-01 00:01:00 End Time: 2026-01-01 00:02:00"
    pages = spark.createDataFrame([("p", page)], "page string, text string")
    values = {(r["item"], r["key"]): r["value"] for r in vendor_log.parse_items(pages).collect()}
    assert values[(0, "Detail")] == "Event Type:Motion Detect\nChannel:1\nStart Time:2026-01-01 00:00:10" and values[(2, "Detail")] == "x"
    base = 1767225600.0
    got = sorted((r["channel"], r["start_epoch"] - base, r["end_epoch"] - base, r["open"]) for r in vendor_log.motion_log(pages).collect())
    assert got == [("1", 10.0, 40.0, False), ("2", 60.0, 120.0, False)]


def test_cli(spark, tmp_path):
    from timelens import cli

    spark.createDataFrame([("l", "v", 0.0, 1.0, "A", "hello there"), ("m", "v", 1.0, 2.0, "B", "bye")], schemas.SCHEMAS["transcripts"]).write.parquet(str(tmp_path / "transcripts"))
    args = cli.build_parser().parse_args(["--workdir", str(tmp_path), "transcript", "hello", "--speaker", "A"])
    assert [r["text"] for r in cli.run(args, spark).collect()] == ["hello there"]


def test_retrieve_by_meaning_or_by_words(spark):
    lines = spark.createDataFrame([("v", 0.0, 1.0, "A", "red car"), ("w", 1.0, 2.0, "B", "blue boat")], "video_id string, start_time double, end_time double, speaker string, text string")
    vecs = spark.createDataFrame([("text", "e1", 2, [1.0, 0.0], "transcript", "v", 0.0, 1.0, "red car"), ("text", "e1", 2, [0.0, 1.0], "caption", "w", 0.0, 1.0, "a boat")], "space string, embedder string, dim int, embedding array<double>, modality string, video_id string, time_start double, time_end double, text string")
    gatherers = {"transcript_search": lambda p: fuse.from_transcripts(search.search_transcripts(lines, p.search_terms)), "caption_search": lambda p: lines.filter("no_such_column")}
    found = planner.QueryPlan("red car", needs_caption_search=False, needs_transcript_search=True, search_terms="red car")
    index = lambda embedder, rows=vecs: planner.TextIndex(rows, "text", embedder, 2, lambda terms: [1.0, 0.1])
    got = planner.retrieve(found, gatherers, text=index("e1"))
    assert [(r["modality"], r["content"]) for r in got.items.collect()] == [("transcript", "red car")] and not got.notes
    for text, said in ((index("e2"), "unusable (2 vectors"), (index("e1", vecs.limit(0)), "is empty")):
        got = planner.retrieve(found, gatherers, text=text)
        assert [r["content"] for r in got.items.collect()] == ["red car"] and any(said in n for n in got.notes)
    plain = planner.assemble(planner.QueryPlan("red car", needs_transcript_search=True, search_terms="blue car"), gatherers)
    assert sorted((r["content"], r["score"], r["position"]) for r in plain.items.collect()) == [("blue boat", 0.5, 0), ("red car", 0.5, 0)]
    assert len(plain.notes) == 1 and plain.notes[0].startswith("caption_search was skipped")


def test_colour_boxes(spark):
    videos = spark.createDataFrame([("v",), ("w",)], "video_id string")
    frames = media.painted_frames(videos, [("red", 0.25, 0.25, 0.25, 0.5, 0.0), ("green", 0.0, 0.75, 0.5, 0.25, 0.25)], 16, 8, 2.0, 1.0)
    got = {(r["video_id"], r["timestamp"], r["object_class"]): (r["bbox_x"], r["bbox_y"], r["bbox_w"], r["bbox_h"], r["confidence"]) for r in media.color_boxes(frames, ["Red", "green", "blue", "car"]).collect()}
    assert len(got) == 8 and got[("v", 0.0, "red")] == (0.25, 0.25, 0.25, 0.5, 0.5 + 16 / 128)
    assert got[("w", 0.0, "green")][:4] == (0.0, 0.75, 0.5, 0.25) and got[("w", 0.5, "green")][:4] == (0.125, 0.75, 0.5, 0.25)
    few = frames.withColumns({c: F.concat(F.array(F.lit(v)), F.array_repeat(F.lit(128), 999)) for c, v in (("r", 220), ("g", 30), ("b", 30))}).withColumn("width", F.lit(40))
    assert media.color_boxes(few, ["red"]).count() == 0 and media.color_boxes(frames, ["car"]).count() == 0  # a pixel in a thousand is too little
    near = frames.limit(1).withColumns({"r": F.array(F.lit(220), F.lit(220)), "g": F.array(F.lit(30 + 59), F.lit(30 + 60)), "b": F.array(F.lit(30), F.lit(30)), "width": F.lit(2)})
    assert media.color_boxes(near, ["red"]).first()["bbox_w"] == 0.5


def test_media_paths(spark):
    videos = spark.createDataFrame([("a", "/d/a.mp4", "sha256:k1"), ("b", "/gone.mp4", "sha256:k-2"), ("c", None, "sha256:k3"), ("d", None, "sha256:k-2-x")], "video_id string, local_path string, source_key string")
    files = spark.createDataFrame([("file:/d/a.mp4",), ("file:///w/videos/k1-title/media.mp4",), ("/w/videos/k-2-title/media.webm",), ("/w/videos/k-2-title/media.mkv",), ("/w/videos/k-2-title/other.mp4",), ("/w/videos/k3/media.mp4",)], "path string")
    got = {r["video_id"]: r["path"] for r in media.media_paths(videos, files).collect()}
    assert got == {"a": "/d/a.mp4", "b": "/w/videos/k-2-title/media.mkv", "c": None, "d": None}
