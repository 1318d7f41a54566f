"""Registered queries: each operator over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelens import bindings as b
from timelens.constants import NO_CAMERA
from timelens.functions import image, timeparse, vector
from timelens.functions import text as tx
from timelens.operators import aggregate, catalog, delivery, fuse, intervals, jobs, presence, search, statechange, textindex, tracks, vectors
from timelens.plans import ingest, planner
from timelens.sources import media, uris
from timelens.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = "the thanea and antion"
WORDS = tx.query_tokens(QUERY)
_SQL_WORDS = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
CATEGORY = "clicks errors"
CLASSES = "('click', 'clicks', 'error', 'errors')"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _score(column: str) -> str:
    return f"len(list_intersect(list_distinct(regexp_extract_all(lower({column}), '[a-z0-9'']+')), {_SQL_WORDS})) / {len(WORDS)}.0::DOUBLE"


_PLACED = f"""{b.TRACKS}, placed AS (SELECT t.*, v.camera_id, v.start_epoch, v.start_epoch + t.first_seen AS absolute FROM tracks t JOIN videos v USING (video_id)
  WHERE v.start_epoch IS NOT NULL AND lower(object_class) IN {CLASSES} AND v.start_epoch + t.first_seen >= {b.T0} AND v.start_epoch + t.first_seen < {b.T1}),
entities AS (SELECT * FROM placed WHERE frame_count >= 2)"""


def _entities(s: SparkSession, d: str) -> DataFrame:
    return aggregate.entities_for(b.tracks(s, d), b.videos(s, d), CATEGORY, b.T0, b.T1)[0]


# Aggregations


@query("a4_windowed_count", f"WITH {_PLACED} SELECT coalesce(camera_id, '{NO_CAMERA}') AS camera, count(*) AS n FROM entities GROUP BY 1")
def a4(s, d):
    return aggregate.count_objects(b.tracks(s, d), b.videos(s, d), CATEGORY, b.WINDOW).per_camera


@query("a4_count_with_total", f"WITH {_PLACED} SELECT camera, count(*) AS n FROM (SELECT coalesce(camera_id, '{NO_CAMERA}') AS camera FROM entities) GROUP BY ROLLUP (camera)")
def a4_total(s, d):
    return aggregate.count_with_total(_entities(s, d))


@query("a5_list_events", f"WITH {_PLACED} SELECT track_id, video_id, absolute, frame_count FROM entities ORDER BY absolute, track_id LIMIT 100")
def a5(s, d):
    return aggregate.list_events(_entities(s, d)).select("track_id", "video_id", "absolute", "frame_count")


@query("a6_histogram", f"WITH {_PLACED}, counted AS (SELECT floor((absolute - {b.T0}) / 3600)::BIGINT AS bucket, count(*) AS n FROM entities GROUP BY 1) SELECT r.range AS bucket, {b.T0}::DOUBLE + r.range * 3600.0::DOUBLE AS bucket_start, coalesce(n, 0) AS n FROM range({int((b.T1 - b.T0) // 3600)}) r LEFT JOIN counted ON counted.bucket = r.range")
def a6(s, d):
    return aggregate.timeline_histogram(_entities(s, d), b.T0, b.T1, "1h")


@query("a7_anchoring", f"WITH {b.TRACKS} SELECT (SELECT count(start_epoch) FROM videos WHERE ingest_status = 'done') AS anchored_videos, (SELECT count(*) FROM tracks WHERE frame_count >= 2 AND lower(object_class) IN {CLASSES} AND video_id IN (SELECT video_id FROM videos WHERE ingest_status = 'done' AND start_epoch IS NULL)) AS unplaced_tracks")
def a7(s, d):
    return tracks.window_anchoring(b.tracks(s, d), b.videos(s, d), tx.resolve_category(CATEGORY)[0], 2)


@query("a1_frame_summary", f"WITH {b.DETECTIONS} SELECT video_id, object_class, count(DISTINCT timestamp) AS frames, min(timestamp) AS first_seen, max(timestamp) AS last_seen, max(confidence) AS confidence FROM detections WHERE lower(object_class) IN {CLASSES} GROUP BY 1, 2")
def a1(s, d):
    return tracks.query_objects(b.detections(s, d), CATEGORY)


@query("a2_distinct_counts", f'WITH {b.TRACKS} SELECT video_id, object_class, count(*) AS "distinct", min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM tracks WHERE frame_count >= 2 AND lower(object_class) IN {CLASSES} GROUP BY 1, 2')
def a2(s, d):
    return tracks.count_objects_of(b.tracks(s, d), CATEGORY)


@query("a8_entities", f"WITH {_PLACED} SELECT track_id, video_id, camera_id, absolute FROM entities")
def a8(s, d):
    return _entities(s, d).select("track_id", "video_id", "camera_id", "absolute")


@query("a10_ocr_groups", f"WITH {b.LINES} SELECT video_id, text, count(*) AS sightings, min(timestamp) AS time_start, max(timestamp) AS time_end FROM lines GROUP BY 1, 2")
def a10(s, d):
    return search.ocr_groups(b.screen_lines(s, d))


@query("a11_classes", "SELECT DISTINCT lower(event_type) AS object_class FROM events")
def a11(s, d):
    return tracks.existing_classes(b.load(s, d, "events").select(F.col("event_type").alias("object_class")))


@query("a12_domains", f"WITH {b.VIDEOS} SELECT DISTINCT coalesce(profile, CASE WHEN source_type = 'nvr_recorded' THEN 'security' ELSE 'generic' END) AS domain FROM videos WHERE ingest_status = 'done'")
def a12(s, d):
    return aggregate.footage_domains(b.videos(s, d))


@query("a13_speakers", "SELECT conv_id AS video_id, count(DISTINCT role) AS speakers FROM conversations GROUP BY 1")
def a13(s, d):
    return b.transcripts(s, d).groupBy("video_id").agg(F.count_distinct("speaker").alias("speakers"))


@query("a16_best_detections", f"WITH {b.DETECTIONS} SELECT video_id, object_class AS track_id, arg_min(timestamp, (-confidence, timestamp)) AS timestamp, max(confidence) AS confidence FROM detections GROUP BY 1, 2")
def a16(s, d):
    return tracks.best_detections(b.detections(s, d).withColumn("track_id", F.col("object_class")))


@query("a20_latency", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(median(value), 6) AS p50, list_sort(list(value))[least(count(value), greatest(1, round(count(value) * 0.95)))::BIGINT] AS p95 FROM events GROUP BY 1")
def a20(s, d):
    stats = aggregate.latency_stats(b.load(s, d, "events").select("event_type", "value"), "value", "event_type")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p50")})


@query("a22_recorded_fps", "SELECT o_custkey AS video_id, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(ascii(o_orderstatus))::DOUBLE END AS fps FROM orders GROUP BY 1")
def a22(s, d):
    return catalog.recorded_fps(b.load(s, d, "orders").select(F.col("o_custkey").alias("video_id"), F.ascii("o_orderstatus").cast("double").alias("fps")))


@query("a23_outcomes", "SELECT o_orderstatus AS outcome, count(*) AS n FROM orders GROUP BY 1")
def a23(s, d):
    return catalog.outcome_totals(b.load(s, d, "orders").select(F.col("o_orderstatus").alias("outcome")))


@query("a24_role_counts", f"WITH {b.TRACKS} SELECT video_id, 'object_detections' AS role, count(*) AS n FROM detections GROUP BY 1 UNION ALL SELECT video_id, 'object_tracks', count(*) FROM tracks GROUP BY 1")
def a24(s, d):
    return catalog.counts_by_video({"object_detections": b.detections(s, d), "object_tracks": b.tracks(s, d)})


# Sequences and intervals


def _clusters(gap: float) -> str:
    return f"""WITH {b.MOTION}, c1 AS (SELECT *, CASE WHEN start_epoch - max(end_epoch) OVER (PARTITION BY camera_ref ORDER BY start_epoch, end_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM motion),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY camera_ref ORDER BY start_epoch, end_epoch ROWS UNBOUNDED PRECEDING) AS island FROM c1)
SELECT camera_ref, min(start_epoch) AS start_epoch, max(end_epoch) AS end_epoch, min(kind) AS kind, count(*) AS n_events FROM c2 GROUP BY camera_ref, island"""


@query("i1_clusters_30s", _clusters(30.0))
def i1(s, d):
    return intervals.cluster_events(b.motion(s, d), 30.0)


@query("i1_clusters_1800s", _clusters(1800.0))
def i1_wide(s, d):
    return intervals.cluster_events(b.motion(s, d), 1800.0)


@query("i2_co_occurrence", f"""WITH {b.EV}, seen AS (SELECT video_id % 6 AS video_id, floor(epoch / 3600) * 3600.0 AS timestamp FROM ev WHERE event_type IN ('click', 'error') GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 2),
c1 AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY video_id ORDER BY timestamp) <= 3600 THEN 0 ELSE 1 END AS fresh FROM seen),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS island FROM c1)
SELECT video_id, min(timestamp) AS time_start, max(timestamp) AS time_end, count(*) AS frames FROM c2 GROUP BY video_id, island""")
def i2(s, d):
    hourly = b.raw_events(s, d).select((F.col("video_id") % 6).alias("video_id"), (F.floor(F.col("epoch") / 3600) * F.lit(3600.0)).alias("timestamp"), F.col("event_type").alias("object_class"))
    return intervals.co_occurrence(hourly, ["Click", "error"], 3600.0)


@query("i3_padded_spans", f"""WITH {b.MOTION}, wide AS (SELECT camera_ref AS video_id, greatest(0.0, start_epoch - 60.0) AS s, least(1e12, end_epoch + 60.0) AS e FROM motion),
c1 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS fresh FROM wide WHERE e > s),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM c1)
SELECT * FROM (SELECT video_id, min(s) AS start_time, max(e) AS end_time FROM c2 GROUP BY video_id, island) WHERE end_time - start_time >= 0.5""")
def i3(s, d):
    spans = b.motion(s, d).select(F.col("camera_ref").alias("video_id"), F.col("start_epoch").alias("start_time"), F.col("end_epoch").alias("end_time"))
    return intervals.padded_spans(spans, 60.0, F.lit(1e12))


@query("i4_first_appearances", f"""WITH {b.LINES}, n AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM lines), l AS (SELECT *, lag(timestamp) OVER (PARTITION BY video_id, norm ORDER BY timestamp) AS last FROM n)
SELECT video_id, timestamp, text FROM l WHERE last IS NULL OR timestamp - last > 2""")
def i4(s, d):
    return intervals.first_appearances(b.screen_lines(s, d), tx.squeezed(F.col("text")), 2.0)


@query("i5_marker_pairs", f"""WITH {b.EV}, log AS (SELECT (video_id % 6)::VARCHAR AS channel, event_id, epoch, CASE event_type WHEN 'click' THEN 'start' WHEN 'error' THEN 'end' END AS kind FROM ev WHERE event_type IN ('click', 'error')),
m AS (SELECT *, lead(kind) OVER w AS nk, lead(epoch) OVER w AS ne, lag(kind) OVER w AS lk FROM log WINDOW w AS (PARTITION BY channel ORDER BY epoch, event_id))
SELECT channel, epoch AS start_epoch, CASE WHEN nk = 'end' THEN ne ELSE epoch END AS end_epoch, coalesce(nk, 'start') = 'start' AS open FROM m WHERE kind = 'start'
UNION ALL SELECT channel, epoch, epoch, false FROM m WHERE kind = 'end' AND coalesce(lk, 'end') = 'end'""")
def i5(s, d):
    e = b.raw_events(s, d).filter("event_type IN ('click', 'error')")
    log = e.select((F.col("video_id") % 6).cast("string").alias("channel"), F.struct("epoch", "event_id").alias("seq"), F.when(F.col("event_type") == "click", F.col("epoch")).alias("start_epoch"), F.when(F.col("event_type") == "error", F.col("epoch")).alias("end_epoch"))
    return intervals.pair_markers(log)


@query("i6_scene_cuts", f"""WITH RECURSIVE {b.DETECTIONS}, cuts AS (SELECT video_id, min(timestamp) AS stamp, 0 AS n FROM detections GROUP BY 1
  UNION ALL SELECT c.video_id, min(d.timestamp), max(c.n) + 1 FROM cuts c JOIN detections d ON d.video_id = c.video_id AND d.confidence > 0.4 AND d.timestamp - c.stamp >= 86400 GROUP BY c.video_id)
SELECT video_id, stamp AS timestamp FROM cuts WHERE n > 0""")
def i6(s, d):
    frames = b.detections(s, d).select("video_id", "timestamp", F.col("confidence").alias("distance"))
    return intervals.scene_cuts(frames, 0.4, 86_400.0)


@query("r1_runs", f"""WITH {b.DETECTIONS}, o AS (SELECT video_id, timestamp, event_id, CASE WHEN object_class = 'view' THEN 'none' ELSE object_class END AS label FROM detections),
c1 AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY video_id ORDER BY timestamp, event_id) THEN 0 ELSE 1 END AS fresh FROM o), c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c1)
SELECT video_id, run::BIGINT AS run, label, min(timestamp) AS time_start, max(timestamp) AS time_end, count(*) AS samples FROM c2 GROUP BY 1, 2, 3""")
def r1(s, d):
    return intervals.runs(b.observations(s, d), ["video_id"], "timestamp", F.col("text"), ["event_id"])


# a stack of runs for each video: a single sample between two runs of one state is taken off when the second one comes
_STATES = f"""WITH RECURSIVE {b.DETECTIONS}, seen AS (SELECT video_id, timestamp, object_class AS state FROM detections WHERE object_class <> 'view'),
c1 AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY video_id ORDER BY timestamp, state) THEN 0 ELSE 1 END AS fresh FROM seen),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY timestamp, state ROWS UNBOUNDED PRECEDING) AS run FROM c1),
runs AS (SELECT video_id, run::BIGINT AS run, state, min(timestamp) AS t0, max(timestamp) AS t1 FROM c2 GROUP BY 1, 2, 3),
fold AS (SELECT video_id, run, [{{'s': state, 'a': t0, 'b': t1}}] AS st FROM runs WHERE run = 1 UNION ALL
  SELECT f.video_id, r.run, CASE WHEN len(st) >= 2 AND st[len(st)].a = st[len(st)].b AND st[len(st) - 1].s = r.state
    THEN list_append(st[1:len(st) - 2], {{'s': r.state, 'a': st[len(st) - 1].a, 'b': r.t1}}) ELSE list_append(st, {{'s': r.state, 'a': r.t0, 'b': r.t1}}) END
  FROM fold f JOIN runs r ON r.video_id = f.video_id AND r.run = f.run + 1),
final AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY run DESC) = 1)"""


@query("r4_state_changes", f"""{_STATES} SELECT video_id::VARCHAR AS video_id, (len(st) - 1)::INTEGER AS changes_low, (run - 1)::INTEGER AS changes_high,
  len(list_distinct(list_transform(st, lambda x: x.s)))::INTEGER AS distinct_states FROM final""")
def r4(s, d):
    return statechange.analyze_timelines(b.observations(s, d)).select("video_id", "changes_low", "changes_high", "distinct_states")


@query("a18_episodes", f"{_STATES}, each AS (SELECT video_id, unnest(st) AS x FROM final) SELECT video_id::VARCHAR AS video_id, 'state' AS prompt_key, x.s AS state, count(*) AS episodes FROM each GROUP BY 1, 2, 3")
def a18(s, d):
    return statechange.episodes(statechange.analyze_timelines(b.observations(s, d)))


@query("r5_sample_times", f"""WITH {b.SEGMENTS}, stamps AS (SELECT video_id, unnest(CASE WHEN end_time - start_time <= 15 THEN [(start_time + end_time) / 2]
  ELSE list_filter(list_transform(range(0, ceil((end_time - start_time) / 4)::BIGINT + 1), lambda i: start_time + 2.0::DOUBLE + i * 4.0::DOUBLE), lambda t: t < end_time) END) AS t FROM segments),
once AS (SELECT DISTINCT video_id, round(t, 2) AS timestamp FROM stamps), p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM once)
SELECT video_id, timestamp FROM p WHERE n <= 20 OR list_contains(list_transform(range(0, 20), lambda k: floor(k * n / 20)::BIGINT), i)""")
def r5(s, d):
    return statechange.sample_times(b.segments(s, d), 20)


@query("w3_episode_windows", f"""WITH {b.MOTION}, w AS (SELECT *, unnest(range(0, ceil((end_epoch - start_epoch) / 120)::BIGINT)) AS part FROM motion WHERE end_epoch > start_epoch)
SELECT camera_ref, start_epoch, end_epoch, part::INTEGER AS part, start_epoch + part * 120 AS window_start, least(end_epoch, start_epoch + part * 120 + 120) AS window_end FROM w""")
def w3(s, d):
    return intervals.split_windows(b.motion(s, d)).drop("kind")


@query("w4_budget", f"WITH {b.MOTION}, r AS (SELECT *, row_number() OVER (PARTITION BY camera_ref ORDER BY start_epoch, end_epoch) AS rn FROM motion) SELECT camera_ref, start_epoch, end_epoch FROM r WHERE rn <= 8")
def w4(s, d):
    return intervals.within_budget(b.motion(s, d), "camera_ref", ["start_epoch", "end_epoch"], 50, 6).drop("kind")


@query("w5_motion_level", f"""WITH {b.DETECTIONS}, l AS (SELECT video_id, abs(confidence - lag(confidence) OVER (PARTITION BY video_id ORDER BY (timestamp, event_id))) AS step FROM detections)
SELECT video_id, 0 AS segment_index, coalesce(max(step), 0.0) AS level, CASE WHEN coalesce(max(step), 0.0) > 0.01 THEN 'motion' ELSE 'static' END AS action_class FROM l GROUP BY 1""")
def w5(s, d):
    samples = b.detections(s, d).select("video_id", F.lit(0).alias("segment_index"), F.struct("timestamp", "event_id").alias("sample"), F.col("confidence").alias("value"))
    return intervals.motion_level(samples)


# Joins


@query("j1_placed_tracks", f"WITH {_PLACED} SELECT track_id, video_id, camera_id, absolute, frame_count FROM placed")
def j1(s, d):
    placed = tracks.select_placed(b.tracks(s, d), b.videos(s, d), tx.resolve_category(CATEGORY)[0], b.T0, b.T1)
    return placed.select("track_id", "video_id", "camera_id", "absolute", "frame_count")


_J3 = f"""WITH {b.EV}, views AS (SELECT video_id % 6 AS camera, event_id AS view_id, epoch AS timestamp FROM ev WHERE event_type = 'view'), acts AS (SELECT video_id % 6 AS camera, event_id, epoch AS start_time, epoch + 60 * value AS end_time FROM ev WHERE event_type = 'purchase')
SELECT view_id, event_id, v.camera AS camera FROM views v JOIN acts a ON v.camera = a.camera AND v.timestamp >= a.start_time AND v.timestamp <= a.end_time"""


def _views(s, d):
    return b.raw_events(s, d).filter("event_type = 'view'").select((F.col("video_id") % 6).alias("camera"), F.col("event_id").alias("view_id"), F.col("epoch").alias("timestamp"))


@query("j3_temporal_join", _J3)
def j3(s, d):
    return intervals.temporal_join(_views(s, d), b.actions(s, d), "camera").select("view_id", "event_id", "camera")


@query("j3_bucketed_join", _J3)
def j3_bucketed(s, d):
    return intervals.bucketed_temporal_join(_views(s, d), b.actions(s, d), "camera", 7200.0).select("view_id", "event_id", "camera")


@query("j5_speakers", f"""WITH {b.TRANSCRIPTS}, {b.TURNS}, met AS (SELECT l.video_id, l.line_id, t.speaker, least(l.end_time, t.end_time) - greatest(l.start_time, t.start_time) AS shared, t.start_time AS t0, t.end_time AS t1 FROM transcripts l JOIN turns t ON l.video_id = t.video_id AND t.start_time < l.end_time AND t.end_time > l.start_time),
best AS (SELECT video_id, line_id, speaker FROM met QUALIFY row_number() OVER (PARTITION BY video_id, line_id ORDER BY shared DESC, t0, t1) = 1)
SELECT l.video_id, l.line_id, coalesce(b.speaker, l.speaker) AS speaker FROM transcripts l LEFT JOIN best b USING (video_id, line_id)""")
def j5(s, d):
    return intervals.assign_speakers(b.transcripts(s, d), b.turns(s, d)).select("video_id", "line_id", "speaker")


@query("j6_wallclock_chunks", f"WITH {b.VIDEOS} SELECT video_id, greatest(start_epoch, {b.T0}) - start_epoch AS rel_start, least(start_epoch + duration_seconds, {b.T1}) - start_epoch AS rel_end, start_epoch FROM videos WHERE start_epoch IS NOT NULL AND start_epoch + duration_seconds >= {b.T0} AND start_epoch <= {b.T1}")
def j6(s, d):
    return intervals.wallclock_to_chunks(b.videos(s, d), b.T0, b.T1)


@query("j8_hits_with_catalog", f"WITH {b.VECTORS} SELECT vec_id, coalesce(v.n_name, 'gone') AS source_uri FROM vecs LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) v ON v.n_nationkey = vecs.video_id")
def j8(s, d):
    live = b.load(s, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("video_id"), F.col("n_name").alias("source_uri"))
    return vectors.with_catalog(b.vectors(s, d).select("vec_id", "video_id", F.lit("gone").alias("source_uri")), live).select("vec_id", "source_uri")


@query("j9_crop_matches", "SELECT a.vec_id AS vec_id, c.vec_id AS detection_id FROM embeddings a JOIN embeddings c ON a.label = c.label AND round(a.vec_id::DOUBLE, 3) = round(c.vec_id::DOUBLE, 3) AND round(a.embedding[1]::DOUBLE, 5) = round(c.embedding[1]::DOUBLE, 5)")
def j9(s, d):
    boxed = b.vectors(s, d).select(F.col("vec_id").alias("id"), "vec_id", "video_id", "timestamp", *[F.element_at("embedding", 1).alias(f"bbox_{c}") for c in "xywh"])
    return tracks.crop_matches(boxed.drop("id"), boxed.drop("vec_id")).select("vec_id", "detection_id")


_CURRENT = {"captions": "1", "text": "0"}


@query("j12_stale_roles", f"""WITH {b.VIDEOS}, p AS (SELECT doc_id AS video_id, 'captions' AS role, max(quality)::VARCHAR AS fingerprint FROM labels GROUP BY 1 UNION ALL SELECT doc_id, 'text', max(toxic)::VARCHAR FROM labels GROUP BY 1),
r(role, "current") AS (VALUES ('captions', '1'), ('text', '0'))
SELECT v.video_id, r.role, p.fingerprint, r."current" FROM videos v, r LEFT JOIN p ON p.video_id = v.video_id AND p.role = r.role WHERE v.ingest_status = 'done' AND p.fingerprint IS DISTINCT FROM r."current" """)
def j12(s, d):
    stamped = b.load(s, d, "labels").groupBy(F.col("doc_id").alias("video_id")).agg(F.max("quality").cast("string").alias("captions"), F.max("toxic").cast("string").alias("text"))
    provenance = stamped.unpivot(["video_id"], ["captions", "text"], "role", "fingerprint")
    return catalog.stale_roles(b.videos(s, d), provenance, _CURRENT)


# Search and vectors


@query("f3_caption_search", f"WITH {b.SEGMENTS}, f AS (SELECT video_id, start_time, segment_index, {_score('caption')} AS score FROM segments WHERE caption IS NOT NULL) SELECT video_id, start_time, score FROM f WHERE score > 0 ORDER BY score DESC, start_time, video_id, segment_index LIMIT 50")
def f3(s, d):
    return search.search_captions(b.segments(s, d), QUERY, 50).select("video_id", "start_time", "score")


@query("f4_transcript_search", f"WITH {b.TRANSCRIPTS}, f AS (SELECT *, {_score('text')} AS score FROM transcripts WHERE speaker = 'assistant') SELECT video_id, line_id, score FROM f WHERE score > 0 ORDER BY score DESC, start_time, video_id, end_time LIMIT 50")
def f4(s, d):
    return search.search_transcripts(b.transcripts(s, d), QUERY, 50, "assistant").select("video_id", "line_id", "score")


@query("f5_ocr_search", f"WITH {b.LINES}, f AS (SELECT *, CASE WHEN contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 'thetheaneaandantion') THEN 1.0 ELSE {_score('text')} END AS score FROM lines) SELECT video_id, text, count(*) AS sightings, min(timestamp) AS time_start, max(timestamp) AS time_end, max(score) AS score FROM f WHERE score > 0 GROUP BY 1, 2 ORDER BY score DESC, time_start, video_id, text LIMIT 50".replace("thetheaneaandantion", "thethaneaandantion"))
def f5(s, d):
    return search.search_ocr(b.screen_lines(s, d), QUERY, 50)


@query("f6_action_search", f"""WITH {b.EV}, a AS (SELECT event_id, video_id, epoch, value AS confidence, CASE WHEN video_id % 2 = 0 THEN 'late ' ELSE '' END || event_type AS cls FROM ev),
f AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(cls, '[a-z0-9'']+')), ['late', 'purchase'])) / 2.0::DOUBLE AS score FROM a)
SELECT event_id, confidence, score FROM f WHERE score > 0 ORDER BY score DESC, confidence DESC, epoch, video_id LIMIT 5000""")
def f6(s, d):
    cls = F.concat(F.when(F.col("video_id") % 2 == 0, "late ").otherwise(""), F.col("event_type"))
    acts = b.raw_events(s, d).select("event_id", "video_id", F.col("epoch").alias("start_time"), F.col("value").alias("confidence"), cls.alias("action_class"))
    return search.search_actions(acts, "late Purchase", 5000).select("event_id", "confidence", "score")


_Q = [((i * 37) % 17 - 8) / 8.0 for i in range(64)]
_COS = "list_dot_product(embedding, [" + ", ".join(f"{x / sum(y * y for y in _Q) ** 0.5!r}::DOUBLE" for x in _Q) + "])"


@query("t1_cosine_top_k", f"WITH {b.VECTORS} SELECT vec_id, video_id, round({_COS} / sqrt(list_dot_product(embedding, embedding)), 6) AS score FROM vecs ORDER BY {_COS} / sqrt(list_dot_product(embedding, embedding)) DESC, vec_id LIMIT 10")
def t1(s, d):
    unit = b.vectors(s, d).withColumn("embedding", F.transform("embedding", lambda x: x / vector.norm(F.col("embedding"))))
    return vectors.cosine_top_k(unit, _Q, 10, "vec_id").select("vec_id", "video_id", F.round("score", 6).alias("score"))


@query("t7_text_search", f"WITH {b.VECTORS} SELECT vec_id, modality, round({_COS}, 6) AS score FROM vecs WHERE modality IN ('caption', 'transcript') ORDER BY {_COS} DESC, vec_id LIMIT 20")
def t7(s, d):
    return vectors.search_text(b.vectors(s, d), _Q, 20, ["caption", "transcript"], "vec_id").select("vec_id", "modality", F.round("score", 6).alias("score"))


@query("t7_over_fetch", f"WITH {b.VECTORS}, top AS (SELECT vec_id, modality, {_COS} AS score FROM vecs ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, modality, round(score, 6) AS score FROM top WHERE modality = 'caption' ORDER BY score DESC, vec_id LIMIT 10")
def t7_over(s, d):
    return vectors.search_text(b.vectors(s, d), _Q, 10, ["caption"], "vec_id", exact=False).select("vec_id", "modality", F.round("score", 6).alias("score"))


@query("sk17_normalise", f"WITH {b.VECTORS} SELECT vec_id, round(list_dot_product(embedding, embedding) / list_dot_product(embedding, embedding), 4) AS length, round(embedding[1] / sqrt(list_dot_product(embedding, embedding)), 4) AS first FROM vecs")
def sk17(s, d):
    ready = vectors.add_vectors(b.vectors(s, d), 64)
    return ready.select("vec_id", F.round(vector.norm(F.col("embedding")), 4).alias("length"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"))


@query("f32_index_state", "SELECT count(*) AS total, count(*) FILTER (label = 1) AS usable FROM embeddings WHERE label < 5")
def f32(s, d):
    v = b.load(s, d, "embeddings").select(F.when(F.col("label") < 5, "text").otherwise("frame").alias("space"), F.col("label").cast("string").alias("embedder"), F.size("embedding").alias("dim"))
    return vectors.index_state(v, "text", "1", 64)


# Fusion

_ITEMS = f"""WITH {b.TRANSCRIPTS}, {b.VECTORS}, items AS (SELECT 'transcript' AS modality, video_id::VARCHAR AS video_id, start_time AS time_start, text AS content, {_score('text')} AS score, 0 AS position FROM transcripts
  UNION ALL SELECT 'visual', video_id::VARCHAR, timestamp, '', {_COS}, 1 FROM vecs)"""
_FUSED = f"""{_ITEMS}, r AS (SELECT *, CASE WHEN modality <> 'visual' THEN {_score('content')} END AS rerank_score FROM items),
n AS (SELECT *, min(score) OVER (PARTITION BY modality) AS lo, max(score) OVER (PARTITION BY modality) AS hi, min(rerank_score) OVER (PARTITION BY rerank_score IS NULL) AS rlo, max(rerank_score) OVER (PARTITION BY rerank_score IS NULL) AS rhi FROM r),
fused AS (SELECT modality, video_id, time_start, content, score, rerank_score, 0.6::DOUBLE * CASE WHEN rerank_score IS NULL THEN 0 WHEN rhi - rlo < 1e-9 THEN 0.5 ELSE (rerank_score - rlo) / (rhi - rlo) END + 0.4::DOUBLE * CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END AS fused_score FROM n)"""


def _pool(s, d):
    lines = b.transcripts(s, d).withColumn("score", tx.overlap_score(F.col("text"), WORDS))
    seen = b.vectors(s, d).withColumn("score", vector.dot(F.col("embedding"), vector.query_vector([x / sum(y * y for y in _Q) ** 0.5 for x in _Q])))
    return fuse.gather([fuse.from_transcripts(lines), fuse.from_visual(seen).withColumn("content", F.lit(""))])


def _fused(s, d):
    return fuse.fuse(fuse.word_overlap_rerank(_pool(s, d), QUERY))


@query("f8_fuse", f"{_FUSED} SELECT modality, video_id, time_start, round(fused_score, 6) AS fused_score FROM fused")
def f8(s, d):
    return _fused(s, d).select("modality", "video_id", "time_start", F.round("fused_score", 6).alias("fused_score"))


@query("f10_retrieve", f"{_FUSED} SELECT modality, video_id, time_start, round(fused_score, 6) AS fused_score FROM fused WHERE CASE WHEN modality = 'visual' THEN score >= 0.1 ELSE rerank_score >= 0.5 END ORDER BY fused.fused_score DESC, score DESC, time_start, video_id, modality, content LIMIT 40")
def f10(s, d):
    return fuse.ranked(fuse.gated(_fused(s, d), 0.5, 0.1)).select("modality", "video_id", "time_start", F.round("fused_score", 6).alias("fused_score"))


@query("fp15_gate", f"{_FUSED} SELECT modality, count(*) AS n FROM fused WHERE CASE WHEN modality = 'visual' THEN score >= 0.05 ELSE rerank_score >= 0.25 END GROUP BY 1")
def fp15(s, d):
    return fuse.modality_counts(fuse.gated(_fused(s, d), 0.25, 0.05))


@query("fp16_gate_by_domain", f"{_FUSED} SELECT modality, count(*) AS n FROM fused WHERE CASE WHEN modality = 'visual' THEN score >= CASE WHEN video_id::BIGINT % 3 = 0 THEN 0.1 ELSE 0.0 END ELSE rerank_score >= CASE WHEN video_id::BIGINT % 3 = 0 THEN 0.5 ELSE 0.25 END END GROUP BY 1")
def fp16(s, d):
    items = _fused(s, d)
    domains = items.select("video_id").distinct().withColumn("domain", F.when(F.col("video_id").cast("bigint") % 3 == 0, "security").otherwise("generic"))
    return fuse.modality_counts(fuse.gated_by_domain(items, domains, {"security": (0.5, 0.1)}, (0.25, 0.0)))


@query("a14_dominant_video", f"{_ITEMS} SELECT video_id, count(*) AS n FROM items GROUP BY 1 ORDER BY n DESC, min(position), video_id LIMIT 1")
def a14(s, d):
    return fuse.dominant_video(_pool(s, d))


@query("a17_strongest", f"{_ITEMS} SELECT modality, video_id, time_start, round(score, 6) AS score FROM items QUALIFY row_number() OVER (PARTITION BY modality ORDER BY score DESC, time_start, video_id, content) = 1")
def a17(s, d):
    return fuse.strongest(_pool(s, d)).select("modality", "video_id", "time_start", F.round("score", 6).alias("score"))


@query("w1_rendered", f"{_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY score DESC, time_start, video_id, content) AS rn FROM items) SELECT modality, video_id, time_start FROM r ORDER BY rn, position LIMIT 60")
def w1(s, d):
    return fuse.rendered(_pool(s, d), [F.desc("score"), "time_start", "video_id", "content"]).select("modality", "video_id", "time_start")


@query("w2_first_texts", f"""WITH {b.TRANSCRIPTS}, n AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM transcripts)
SELECT video_id, line_id FROM n WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY video_id, norm ORDER BY start_time, line_id) = 1""")
def w2(s, d):
    items = b.transcripts(s, d).withColumns({"modality": F.lit("transcript"), "timestamp": F.col("start_time"), "seq": F.col("line_id")})
    return fuse.first_texts(items, tx.squeezed(F.col("text"))).select("video_id", "line_id")


@query("t6_keyframes", f"{_ITEMS}, once AS (SELECT *, CASE modality WHEN 'transcript' THEN 4 ELSE 8 END AS priority, CASE modality WHEN 'transcript' THEN time_start + 2.5 ELSE time_start END AS middle FROM items), k AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY video_id, floor(middle) ORDER BY priority, score DESC, middle) = 1) SELECT video_id, middle, modality FROM k ORDER BY priority, score DESC, middle, video_id LIMIT 4")
def t6(s, d):
    return fuse.keyframes(_pool(s, d)).select("video_id", "middle", "modality")


# Catalog


@query("sk1_replace", "SELECT doc_id AS video_id, CASE WHEN source = 'src0' THEN 1 ELSE 0 END AS version FROM documents")
def sk1(s, d):
    docs = b.load(s, d, "documents")
    return catalog.replace_keys(docs.select(F.col("doc_id").alias("video_id"), F.lit(0).alias("version")), docs.filter("source = 'src0'").select(F.col("doc_id").alias("video_id"), F.lit(1).alias("version")), ["video_id"])


@query("sk9_first_writer", """WITH d AS (SELECT doc_id, sha256(text) AS source_key FROM documents), there AS (SELECT max(doc_id) AS doc_id, source_key FROM d WHERE doc_id % 3 = 0 GROUP BY 2)
SELECT doc_id, source_key FROM there UNION ALL SELECT min(doc_id), source_key FROM d WHERE source_key NOT IN (SELECT source_key FROM there) GROUP BY 2""")
def sk9(s, d):
    rows = b.load(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("source_key"))
    there = rows.filter("doc_id % 3 = 0").groupBy("source_key").agg(F.max("doc_id").alias("doc_id")).select("doc_id", "source_key")
    return catalog.first_writer(there, rows, "source_key", ["doc_id"])


@query("sk11_watermarks", "SELECT c_custkey AS camera_id, greatest(CASE WHEN c_custkey % 2 = 0 THEN 200000.0::DOUBLE END, max(o_totalprice)) AS last_processed_epoch FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def sk11(s, d):
    cameras = b.load(s, d, "customer").select(F.col("c_custkey").alias("camera_id"), F.when(F.col("c_custkey") % 2 == 0, 200000.0).alias("last_processed_epoch"))
    return catalog.advance_watermarks(cameras, b.load(s, d, "orders").select(F.col("o_custkey").alias("camera_id"), F.col("o_totalprice").alias("epoch")))


@query("sk12_patch", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'patched' END, c_mktsegment) AS c_mktsegment FROM customer")
def sk12(s, d):
    c = b.load(s, d, "customer").select("c_custkey", "c_mktsegment")
    return catalog.patch(c, c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "patched").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"])


@query("sk13_latest", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def sk13(s, d):
    return catalog.latest(b.load(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]).drop("o_orderdate")


@query("sk14_requeue", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 < 3 THEN 'queued' WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'failed' END AS state, (o_orderkey % 4 + CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 < 3 THEN 1 ELSE 0 END)::BIGINT AS attempts FROM orders")
def sk14(s, d):
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    jobs = b.load(s, d, "orders").select("o_orderkey", F.lit("ingest").alias("kind"), state.alias("state"), (F.col("o_orderkey") % 4).alias("attempts"))
    return catalog.requeue(jobs).select("o_orderkey", "state", "attempts")


@query("sk15_cascade_delete", "SELECT doc_id AS video_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def sk15(s, d):
    gone = b.load(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("video_id"))
    return catalog.cascade_delete({"labels": b.load(s, d, "labels").select(F.col("doc_id").alias("video_id"), "quality")}, gone)["labels"]


@query("sk12_missing_references", "SELECT o_custkey AS c, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def sk12_missing(s, d):
    return catalog.missing_references(b.load(s, d, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey"), "c", b.load(s, d, "customer").filter("c_nationkey < 20"), "c_custkey")


@query("fp2_get_many", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def fp2(s, d):
    return catalog.get_many(b.load(s, d, "documents").select("doc_id", "source"), b.load(s, d, "labels").filter("toxic = 1"), "doc_id")


@query("fp3_newest", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def fp3(s, d):
    return catalog.newest(b.load(s, d, "orders"), 20, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("fp12_overlap", f"WITH {b.MOTION} SELECT camera_ref, start_epoch, end_epoch FROM motion WHERE end_epoch >= {b.T0} AND start_epoch <= {b.T1}")
def fp12(s, d):
    from timelens.sources.sidecars import motion_events

    return motion_events(b.motion(s, d), b.T0, b.T1).drop("kind")


@query("fp19_visible_labels", f"WITH {b.DETECTIONS} SELECT object_class AS text, count(*) AS n FROM detections WHERE object_class <> 'view' GROUP BY 1")
def fp19(s, d):
    return b.observations(s, d).filter(tx.is_visible(F.col("text"))).groupBy("text").agg(F.count("*").alias("n"))


@query("f26_reprocess_plan", """WITH l AS (SELECT doc_id AS video_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1)
SELECT video_id, CASE WHEN q = 0 THEN 'captions' ELSE 'text' END AS roles, CASE WHEN q = t THEN q::DOUBLE END AS fps, q <> t AS refused FROM l WHERE q <> 1 OR t <> 0""")
def f26(s, d):
    stamped = b.load(s, d, "labels").groupBy(F.col("doc_id").alias("video_id")).agg(F.max("quality").alias("captions"), F.max("toxic").alias("text"))
    rows = stamped.unpivot(["video_id"], ["captions", "text"], "role", "fps").withColumns({"fingerprint": F.col("fps").cast("string"), "fps": F.col("fps").cast("double")})
    videos = stamped.select("video_id", F.lit("done").alias("ingest_status"))
    plan = catalog.reprocess_plan(catalog.stale_roles(videos, rows, _CURRENT), rows, {"captions": ["text"]})
    return plan.withColumn("roles", F.array_join("roles", ","))


# Scalars


@query("s_text_forms", """SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS squeezed, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS collapsed, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS state, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS n_tokens, sha256(text) AS sha FROM documents""")
def s_text(s, d):
    t = F.col("text")
    return b.load(s, d, "documents").select("doc_id", tx.squeezed(t).alias("squeezed"), tx.collapsed(t).alias("collapsed"), tx.state(t).alias("state"), F.size(tx.tokens(t)).cast("bigint").alias("n_tokens"), F.sha2(t, 256).alias("sha"))


@query("s7_canonical_key", f"""WITH w AS (SELECT p_partkey, list_sort(list_distinct(list_transform(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: regexp_replace(x, 's+$', '')))) AS ws FROM part), k AS (SELECT p_partkey, ws, array_to_string(list_filter(ws, lambda x: x NOT IN ('', 'the', 'a', 'an', 'of', 'in', 'on', 'i', 'are', 'it', 'their', 'and', 'or', 'main', 'person', 'current', 'state', 'wearing', 'worn', 'color', 'colour', 'style', 'garment', 'e', 'g', 'eg', 'frame', 'visible')), '-') AS key FROM w)
SELECT p_partkey, CASE WHEN key <> '' THEN key ELSE 't' || substr(sha1(array_to_string(ws, ' ')), 1, 12) END AS key FROM k""")
def s7(s, d):
    return b.load(s, d, "part").select("p_partkey", tx.canonical_key(F.col("p_name")).alias("key"))


@query("s10_local_time", f"WITH {b.EV} SELECT event_id, strftime(to_timestamp(floor(epoch)) AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%dT%H:%M:%S') AS local FROM ev")
def s10(s, d):
    return b.raw_events(s, d).select("event_id", timeparse.local_iso(F.floor("epoch"), "America/Los_Angeles").alias("local"))


@query("s11_minutes", "SELECT event_id, (floor(value)::BIGINT // 60) || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS shown FROM events")
def s11(s, d):
    return b.load(s, d, "events").select("event_id", tx.minutes(F.col("value")).alias("shown"))


@query("s13_coerced_seconds", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 100)::DOUBLE WHEN 1 THEN (o_orderkey % 60) * 60 + 7.0::DOUBLE WHEN 2 THEN 223384.5::DOUBLE WHEN 3 THEN (o_orderkey % 10)::DOUBLE END AS seconds FROM orders")
def s13(s, d):
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, F.concat((k % 100).cast("string"), F.lit("s"))).when(k % 5 == 1, F.concat((k % 60).cast("string"), F.lit(":07"))).when(k % 5 == 2, "1:02:03:04.5").when(k % 5 == 3, F.concat(F.lit(" "), (k % 10).cast("string"), F.lit(" S "))).otherwise("soon")
    return b.load(s, d, "orders").select("o_orderkey", timeparse.coerced_seconds(said).alias("seconds"))


@query("s22_min_max", f"WITH {b.EV} SELECT event_id, round(CASE WHEN max(value) OVER w - min(value) OVER w < 1e-9 THEN 0.5 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS scaled FROM ev WINDOW w AS (PARTITION BY event_type)")
def s22(s, d):
    return vector.min_max(b.raw_events(s, d), "value", "event_type", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("s23_hash_embedding", """WITH h AS (SELECT doc_id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS h FROM documents),
spots AS (SELECT doc_id, (('0x' || substr(h, 9, 8))::BIGINT % 256)::INTEGER AS "at", CASE WHEN ('0x' || substr(h, 17, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM h),
sums AS (SELECT doc_id, "at", sum(sign) AS total FROM spots GROUP BY 1, 2 HAVING sum(sign) <> 0)
SELECT doc_id, "at", round(total / sqrt(sum(total * total) OVER (PARTITION BY doc_id)), 6) AS value FROM sums""")
def s23(s, d):
    return vector.hash_embeddings(b.load(s, d, "documents"), "doc_id", "text").withColumn("value", F.round("value", 6))


@query("s23_hash_embedding_items", """WITH h AS (SELECT item_id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS h FROM benchmark),
spots AS (SELECT item_id, (('0x' || substr(h, 9, 8))::BIGINT % 256)::INTEGER AS "at", CASE WHEN ('0x' || substr(h, 17, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM h),
sums AS (SELECT item_id, "at", sum(sign) AS total FROM spots GROUP BY 1, 2 HAVING sum(sign) <> 0)
SELECT item_id, "at", round(total / sqrt(sum(total * total) OVER (PARTITION BY item_id)), 5) AS value FROM sums""")
def s23_items(s, d):
    rows = b.load(s, d, "benchmark").select("item_id", F.posexplode(vector.hash_embedding(F.col("text"))).alias("at", "value")).filter("value <> 0")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("s28_window_uris", f"WITH {b.MOTION}, w AS (SELECT camera_ref, floor(start_epoch)::BIGINT AS lo, least(greatest(ceil(end_epoch)::BIGINT, floor(start_epoch)::BIGINT + 1), floor(start_epoch)::BIGINT + 120) AS hi FROM motion) SELECT 'nvr://' || camera_ref || '/' || strftime(make_timestamp(lo * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || '/' || strftime(make_timestamp(hi * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS uri FROM w")
def s28(s, d):
    return b.motion(s, d).select(timeparse.window_uri(F.col("camera_ref"), F.col("start_epoch"), F.col("end_epoch")).alias("uri"))


@query("sc6_recorder_windows", f"WITH {b.MOTION}, w AS (SELECT camera_ref, floor(start_epoch)::BIGINT AS lo, least(greatest(ceil(end_epoch)::BIGINT, floor(start_epoch)::BIGINT + 1), floor(start_epoch)::BIGINT + 120) AS hi FROM motion) SELECT 'nvr:ch' || camera_ref || ':' || lo || '-' || hi AS source_key, 'nvr-ch' || camera_ref AS camera_id, lo::DOUBLE AS start_epoch FROM w")
def sc6(s, d):
    return uris.recorder_windows(s28(s, d)).select("source_key", "camera_id", "start_epoch")


@query("sc4_video_ids", "SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE lpad(p_partkey::VARCHAR, 11, 'a') END AS video_id FROM part")
def sc4(s, d):
    k = F.lpad(F.col("p_partkey").cast("string"), 11, "a")
    uri = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), k, F.lit("&x=1"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://youtu.be/"), k, F.lit("?si=x"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), k)).otherwise(F.concat(F.lit("https://example.com/watch?v="), k))
    return b.load(s, d, "part").select("p_partkey", uris.video_id(uri).alias("video_id"))


@query("sc10_sampled_frames", "WITH v AS (SELECT p_partkey AS video_id, (p_size + 1)::DOUBLE AS fps, greatest(1, round((p_size + 1)::DOUBLE))::BIGINT AS step, p_partkey % 100 AS n FROM part), f AS (SELECT video_id, fps, unnest(range(0, n, step)) AS i FROM v WHERE n > 0) SELECT video_id, i::INTEGER AS frame_index, i / fps AS timestamp FROM f")
def sc10(s, d):
    clips = b.load(s, d, "part").select(F.col("p_partkey").alias("video_id"), (F.col("p_size") + 1).cast("double").alias("fps"), (F.col("p_partkey") % 100).alias("frame_count"))
    return media.sampled_frames(clips, 1.0)


@query("sc12_keyframes", f"WITH {b.SEGMENTS} SELECT video_id, j::INTEGER AS j, round(start_time + j / 4.0::DOUBLE * (end_time - start_time), 6) AS timestamp FROM (SELECT *, unnest(range(1, 4)) AS j FROM segments)")
def sc12(s, d):
    return media.keyframes_for_spans(b.segments(s, d), 3).select("video_id", "j", F.round("timestamp", 6).alias("timestamp"))


# Folds, delivery, watching


@query("ud6_tracks")
def ud6(s, d):
    boxed = b.detections(s, d).select("video_id", F.floor(F.col("timestamp") / 3600).cast("double").alias("timestamp"), "object_class", "confidence", (F.col("confidence") / 2).alias("bbox_x"), F.lit(0.2).alias("bbox_y"), F.lit(0.4).alias("bbox_w"), F.lit(0.4).alias("bbox_h"))
    return tracks.track(boxed, gap=24.0).drop("track_id")


@query("v1_delivery", """WITH head AS (SELECT o_orderkey AS clip_id, l_linenumber::DOUBLE AS t, l_quantity::BIGINT AS distance FROM orders JOIN lineitem ON l_orderkey = o_orderkey), last AS (SELECT clip_id, max(t) FILTER (distance > 40) AS last FROM head GROUP BY 1),
a AS (SELECT clip_id, max(last) AS last, min(t) FILTER (t > last) AS trim FROM head JOIN last USING (clip_id) GROUP BY 1)
SELECT o_orderkey AS clip_id, CASE WHEN o_orderstatus = 'P' THEN 'reject' WHEN last IS NOT NULL AND trim IS NULL THEN 'reject' WHEN coalesce(trim, 0) <= 0 THEN 'accept' WHEN 4.0 - trim < 1 THEN 'reject' ELSE 'trim' END AS action,
  CASE WHEN o_orderstatus <> 'P' AND trim IS NOT NULL AND 4.0 - trim >= 1 THEN trim ELSE 0.0 END AS trim_before FROM orders LEFT JOIN a ON clip_id = o_orderkey""")
def v1(s, d):
    clips = b.load(s, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.lit(0.0).alias("start_epoch"), F.lit(4.0).alias("window_len"), F.when(F.col("o_orderstatus") == "P", 352).otherwise(2688).alias("width"), F.when(F.col("o_orderstatus") == "P", 240).otherwise(1520).alias("height"), F.lit(20).alias("fps"))
    head = b.load(s, d, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("double").alias("t"), (F.floor("l_quantity") - 20).alias("distance"))
    clock = head.select("clip_id", "t", F.col("t").alias("observed_epoch"))
    return delivery.verify_delivery(clips, head, clock, [(2688, 1520, 20)])


_WATCH = f"""WITH {b.MOTION}, met AS (SELECT 'cam-' || camera_ref AS camera_id, camera_ref AS source_ref, start_epoch, end_epoch, end_epoch <= start_epoch AS instant,
  end_epoch <= start_epoch AND {b.T1} - 120 - start_epoch > 600 AS lost FROM motion WHERE start_epoch <= {b.T1} - 120 AND start_epoch >= {b.T0}),
flagged AS (SELECT camera_id, source_ref, start_epoch, CASE WHEN lost THEN least(start_epoch + 120, {b.T1} - 120) ELSE end_epoch END AS end_epoch, NOT lost AND (instant OR end_epoch >= {b.T1} - 120) AS deferred FROM met),
held AS (SELECT camera_id, min(start_epoch) AS deferred_start FROM flagged WHERE deferred GROUP BY 1),
c1 AS (SELECT *, CASE WHEN start_epoch - max(end_epoch) OVER (PARTITION BY camera_id ORDER BY start_epoch, end_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 30 THEN 0 ELSE 1 END AS fresh FROM flagged WHERE NOT deferred),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY camera_id ORDER BY start_epoch, end_epoch ROWS UNBOUNDED PRECEDING) AS island FROM c1),
episodes AS (SELECT camera_id, source_ref, island, min(start_epoch) AS start_epoch, max(end_epoch) AS end_epoch FROM c2 GROUP BY 1, 2, 3),
cut AS (SELECT *, unnest(range(0, ceil((end_epoch - start_epoch) / 120)::BIGINT)) AS part FROM episodes WHERE end_epoch > start_epoch),
windows AS (SELECT *, start_epoch + part * 120 AS window_start, least(end_epoch, start_epoch + part * 120 + 120) AS window_end FROM cut),
placed AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY start_epoch, window_start) <= 100 AS reached, floor(window_start)::BIGINT AS lo,
  least(greatest(ceil(window_end)::BIGINT, floor(window_start)::BIGINT + 1), floor(window_start)::BIGINT + 120) AS hi FROM windows),
whole AS (SELECT camera_id, end_epoch, bool_and(reached) AS whole FROM placed GROUP BY camera_id, island, end_epoch),
state AS (SELECT camera_id, max(CASE WHEN whole THEN end_epoch END) AS upto, bool_and(whole) AS every FROM whole GROUP BY 1)"""


@query("st_catch_up", f"""{_WATCH} SELECT camera_id, 'nvr://' || source_ref || '/' || strftime(make_timestamp(lo * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || '/' || strftime(make_timestamp(hi * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS uri,
  window_start, window_end FROM placed WHERE reached""")
def st(s, d):
    cameras = s.range(6).select(F.concat(F.lit("cam-"), "id").alias("camera_id"), F.col("id").cast("string").alias("source_ref"), F.lit(b.T0).alias("last_processed_epoch"))
    plan = watch.catch_up(cameras, b.motion(s, d).withColumn("open", F.lit(False)), b.T1, watch.WatchRules(max_windows=600))
    return plan.windows.select("camera_id", "uri", "window_start", "window_end")


@query("st_watermarks", f"""{_WATCH}, cams AS (SELECT range::VARCHAR AS source_ref, 'cam-' || range AS camera_id FROM range(6))
SELECT camera_id, source_ref, greatest({b.T0}, CASE WHEN coalesce(every, true) THEN least({b.T1} - 120, deferred_start) WHEN upto IS NOT NULL THEN least(upto, deferred_start) END)::DOUBLE AS last_processed_epoch,
  NOT coalesce(every, true) AS truncated, deferred_start FROM cams LEFT JOIN state USING (camera_id) LEFT JOIN held USING (camera_id)""")
def st_marks(s, d):
    cameras = s.range(6).select(F.concat(F.lit("cam-"), "id").alias("camera_id"), F.col("id").cast("string").alias("source_ref"), F.lit(b.T0).alias("last_processed_epoch"))
    return watch.catch_up(cameras, b.motion(s, d).withColumn("open", F.lit(False)), b.T1, watch.WatchRules(max_windows=600)).cameras


@query("f13_dispatch", f"WITH {_PLACED} SELECT camera, count(*) AS n FROM (SELECT coalesce(camera_id, '{NO_CAMERA}') AS camera FROM entities) GROUP BY ROLLUP (camera)")
def f13(s, d):
    request = {"op": "count_objects", "args": {"category": CATEGORY, "start": b.WINDOW.start, "end": b.WINDOW.end, "tz": b.WINDOW.tz}}
    return planner.dispatch_aggregation(request, b.tracks(s, d), b.videos(s, d)).frame


# Jobs, text index, presence, pixels

_JOBS = "jobs AS (SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 2 WHEN 0 THEN 'ingest' ELSE 'ask' END AS kind, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS state, o_custkey::VARCHAR AS payload, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR END AS video_id, NULL::VARCHAR AS error, NULL::VARCHAR AS result, (o_orderkey % 4)::INTEGER AS attempts FROM orders)"


def _jobs(s, d):
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    none, then = F.lit(None).cast("string"), F.lit("2020-01-01 00:00:00").cast("timestamp")
    return b.load(s, d, "orders").select(k.cast("string").alias("id"), F.when(k % 2 == 0, "ingest").otherwise("ask").alias("kind"), state.alias("state"), F.col("o_custkey").cast("string").alias("payload"), F.when(k % 3 == 0, F.col("o_custkey").cast("string")).alias("video_id"), none.alias("error"), none.alias("result"), (k % 4).cast("int").alias("attempts"), then.alias("created_at"), then.alias("updated_at"))


def _now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@query("sk14_record", f"WITH {_JOBS} SELECT id, kind, state, payload FROM jobs WHERE id::BIGINT % 5 <> 0 UNION ALL SELECT o_orderkey::VARCHAR, 'new', 'queued', o_orderstatus FROM orders WHERE o_orderkey % 5 = 0")
def sk14_record(s, d):
    table = _jobs(s, d).filter(F.col("id").cast("bigint") % 5 != 0)
    fresh = b.load(s, d, "orders").filter("o_orderkey % 5 < 2").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("new").alias("kind"), F.col("o_orderstatus").alias("payload"))
    return jobs.record(table, fresh, _now()).select("id", "kind", "state", "payload")


@query("sk14_update", f"WITH {_JOBS} SELECT id, CASE WHEN attempts = 2 THEN 'done' ELSE state END AS state, CASE WHEN attempts = 2 AND kind = 'ask' THEN 'v' ELSE video_id END AS video_id, CASE WHEN attempts = 2 THEN 'ok' ELSE error END AS error, attempts = 2 AS touched FROM jobs")
def sk14_update(s, d):
    table = _jobs(s, d)
    changes = table.filter("attempts = 2").select("id", F.lit("done").alias("state"), F.when(F.col("kind") == "ask", "v").alias("video_id"), F.lit("ok").alias("error"), F.lit(None).cast("string").alias("result"))
    return jobs.update(table, changes, _now()).select("id", "state", "video_id", "error", (F.col("updated_at") > F.col("created_at")).alias("touched"))


@query("sk14_bump_and_requeue", f"WITH {_JOBS} SELECT id, CASE WHEN state = 'running' AND video_id IS NOT NULL THEN 'queued' ELSE state END AS state, attempts + CASE WHEN video_id IS NOT NULL THEN 1 ELSE 0 END AS attempts FROM jobs")
def sk14_bump(s, d):
    table = _jobs(s, d)
    some = table.filter("video_id IS NOT NULL").select("id")
    return jobs.requeue_running(jobs.bump_attempts(table, some, _now()), some, _now()).select("id", "state", "attempts")


@query("sk14_fail_pending", f"WITH {_JOBS} SELECT id, CASE WHEN kind = 'ask' AND state <> 'done' THEN 'failed' ELSE state END AS state, CASE WHEN kind = 'ask' AND state <> 'done' THEN 'restart' END AS error FROM jobs")
def sk14_fail(s, d):
    return jobs.fail_pending(_jobs(s, d), "ask", "restart", _now()).select("id", "state", "error")


@query("s33_payloads", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS customer FROM orders")
def s33(s, d):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.format_string('{"customer": %d}', "o_custkey")).otherwise("{broken")
    return b.load(s, d, "orders").select("o_orderkey", F.try_variant_get(jobs.parsed(raw), "$.customer", "bigint").alias("customer"))


@query("u4_text_rows", f"""WITH {b.SEGMENTS}, {b.TRANSCRIPTS}, {b.EV} SELECT video_id::BIGINT AS video_id, 'caption' AS modality, start_time AS time_start, end_time AS time_end, regexp_replace(caption, '^\\s+|\\s+$', '', 'g') AS text FROM segments WHERE regexp_replace(caption, '^\\s+|\\s+$', '', 'g') <> ''
UNION ALL SELECT video_id, 'transcript', start_time, end_time, regexp_replace(text, '^\\s+|\\s+$', '', 'g') FROM transcripts WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' UNION ALL SELECT video_id, 'action', epoch, epoch + 60 * value, event_type FROM ev""")
def u4(s, d):
    acts = b.raw_events(s, d).select("video_id", F.col("epoch").alias("start_time"), (F.col("epoch") + 60 * F.col("value")).alias("end_time"), F.col("event_type").alias("action_class"))
    return textindex.text_rows({"segments": b.segments(s, d), "transcripts": b.transcripts(s, d), "action_events": acts})


@query("f22_index_rows", f"WITH {b.EV} SELECT video_id, 'action' AS modality, min(epoch) AS time_start, event_type AS text FROM ev GROUP BY video_id, event_type")
def f22(s, d):
    acts = b.raw_events(s, d).select("video_id", F.col("epoch").alias("start_time"), (F.col("epoch") + 60 * F.col("value")).alias("end_time"), F.col("event_type").alias("action_class"))
    return textindex.index_rows({"action_events": acts}).select("video_id", "modality", "time_start", "text")


@query("a21_presence_times", f"""WITH {b.MOTION}, m AS (SELECT camera_ref, (start_epoch + end_epoch) / 2.0 AS timestamp, row_number() OVER (PARTITION BY camera_ref ORDER BY start_epoch, (start_epoch + end_epoch) / 2.0) - 1 AS i, count(*) OVER (PARTITION BY camera_ref) AS n FROM motion)
SELECT camera_ref AS video_id, timestamp FROM m WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda k: floor(k * (n / 10.0::DOUBLE))::BIGINT), i) UNION ALL SELECT 'none', 6.0::DOUBLE * (range + 0.5::DOUBLE) FROM range(10)""")
def a21(s, d):
    spans = b.motion(s, d).select(F.col("camera_ref").alias("video_id"), F.col("start_epoch").alias("start_time"), F.col("end_epoch").alias("end_time"))
    videos = s.range(7).select(F.when(F.col("id") < 6, F.col("id").cast("string")).otherwise("none").alias("video_id"), F.lit(None).cast("double").alias("duration_seconds"))
    return presence.presence_times(videos, spans).withColumn("timestamp", F.round("timestamp", 6))


@query("a21_presence_counts", "SELECT o_custkey AS video_id, count(*) FILTER (o_orderstatus = 'F') AS present FROM orders GROUP BY 1")
def a21_counts(s, d):
    label = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("unsure")
    return presence.presence_counts(b.load(s, d, "orders").select(F.col("o_custkey").alias("video_id"), label.alias("label")))


_PIXELS = "list_transform(embedding::DOUBLE[], lambda x: least(255.0, floor(abs(x) * 600)))"


def _pixels():
    return F.transform("embedding", lambda x: F.least(F.lit(255.0), F.floor(F.abs(x.cast("double")) * 600)))


@query("s26_histogram", f"SELECT vec_id, unnest(range(16))::INTEGER AS bin, round(unnest(list_transform(range(16), lambda i: len(list_filter({_PIXELS}, lambda v: least(floor(v * 16 / 255.0), 15) = i)) / 64.0::DOUBLE)), 6) AS share FROM embeddings")
def s26(s, d):
    return b.load(s, d, "embeddings").select("vec_id", F.posexplode(image.channel_histogram(_pixels())).alias("bin", "share")).withColumn("share", F.round("share", 6))


@query("s26_histogram_distance", """WITH h AS (SELECT vec_id, list_transform(range(16), lambda i: len(list_filter(list_transform(embedding::DOUBLE[], lambda x: least(255.0, floor(abs(x) * 600))), lambda v: least(floor(v * 16 / 255.0), 15) = i)) / 64.0::DOUBLE) AS h FROM embeddings),
n AS (SELECT vec_id, h, lead(h) OVER (ORDER BY vec_id) AS g FROM h) SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: abs(h[i] - g[i]))) * 3 / 6.0, 6) AS distance FROM n WHERE g IS NOT NULL AND vec_id + 1 IN (SELECT vec_id FROM embeddings)""")
def s26_distance(s, d):
    grey = image.rgb_histogram(_pixels(), _pixels(), _pixels())
    frames = b.load(s, d, "embeddings").select("vec_id", grey.alias("h"))
    after = frames.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    return frames.join(after, "vec_id").select("vec_id", F.round(image.histogram_distance(F.col("h"), F.col("g")), 6).alias("distance"))


@query("s27_dhash", "SELECT vec_id, list_sum(list_transform(range(49), lambda i: CASE WHEN embedding[(i // 7) * 8 + i % 7 + 1] > embedding[(i // 7) * 8 + i % 7 + 2] THEN 1::BIGINT << (48 - i)::INTEGER ELSE 0 END))::BIGINT AS hash FROM embeddings")
def s27(s, d):
    return b.load(s, d, "embeddings").select("vec_id", image.dhash(F.col("embedding"), 7).alias("hash"))


@query("s24_color_keys", """WITH w AS (SELECT p_partkey, lower(p_name) AS name, list_filter(string_split(trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')), ' '), lambda x: x IN ('black', 'white', 'red', 'green', 'blue', 'yellow', 'orange', 'purple', 'brown', 'gray')) AS found FROM part)
SELECT p_partkey, coalesce(found[1], '__text__:' || name) AS key FROM w""")
def s24(s, d):
    return b.load(s, d, "part").select("p_partkey", image.color_key(F.col("p_name")).alias("key"))


@query("fp5_ordered_reads", f"WITH {b.MOTION} SELECT camera_ref AS video_id, start_epoch, row_number() OVER (ORDER BY start_epoch, end_epoch) AS n FROM motion WHERE camera_ref = '3'")
def fp5(s, d):
    rows = catalog.ordered_read(b.motion(s, d).withColumnRenamed("camera_ref", "video_id"), "3", ["start_epoch", "end_epoch"])
    return rows.select("video_id", "start_epoch", F.row_number().over(Window.partitionBy("video_id").orderBy("start_epoch", "end_epoch")).cast("bigint").alias("n"))


@query("fp6_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE sha1(o_custkey::VARCHAR || '|' || o_orderkey::VARCHAR) END AS id FROM orders")
def fp6(s, d):
    rows = b.load(s, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("id"))
    return catalog.with_ids(rows, "id", "o_custkey", "o_orderkey").drop("o_custkey")


@query("fp18_pending_videos", "SELECT doc_id, sha256(text) AS source_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1'))")
def fp18(s, d):
    docs = b.load(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("source_key"), F.when(F.col("source") == "src0", "done").when(F.col("source") == "src1", "quarantined").otherwise("failed").alias("ingest_status"))
    return ingest.pending_videos(docs.select("doc_id", "source_key"), docs)


@query("j10_segment_actions", f"""WITH {b.EV}, g AS (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY epoch, event_id) AS i FROM ev WHERE event_type = 'view'), a AS (SELECT video_id, event_id AS action_id, row_number() OVER (PARTITION BY video_id ORDER BY epoch, event_id) AS i FROM ev WHERE event_type = 'click')
SELECT video_id, event_id AS segment_id, action_id FROM g JOIN a USING (video_id, i)""")
def j10(s, d):
    e = b.raw_events(s, d)
    segments = e.filter("event_type = 'view'").select("video_id", F.col("event_id").alias("segment_id"), "epoch", "event_id")
    acts = e.filter("event_type = 'click'").select("video_id", F.col("event_id").alias("action_id"), "epoch", "event_id")
    return intervals.positional_join(segments, acts, ["video_id"], ["epoch", "event_id"]).select("video_id", "segment_id", "action_id")


@query("j14_known_classes", "SELECT DISTINCT lower(event_type) AS object_class FROM events WHERE lower(event_type) IN ('click', 'error', 'zebra')")
def j14(s, d):
    return tracks.known_among(b.detections(s, d), "Zebra click ERROR")


@query("t10_top_spans", f"""WITH {b.EV}, seen AS (SELECT video_id % 6 AS video_id, floor(epoch / 3600) * 3600.0 AS timestamp FROM ev WHERE event_type IN ('click', 'error') GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 2),
c1 AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY video_id ORDER BY timestamp) <= 3600 THEN 0 ELSE 1 END AS fresh FROM seen),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS island FROM c1)
SELECT video_id, min(timestamp) AS time_start, max(timestamp) AS time_end, count(*) AS frames FROM c2 GROUP BY video_id, island ORDER BY frames DESC, time_start, video_id LIMIT 3""")
def t10(s, d):
    return fuse.top_spans(i2(s, d), 3)


@query("t8_scan_states", f"{_STATES}, each AS (SELECT video_id, unnest(st) AS x FROM final), n AS (SELECT video_id, x.s AS state, count(*) AS episodes FROM each GROUP BY 1, 2) SELECT video_id::VARCHAR AS video_id, state, episodes FROM n QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY episodes DESC, state) <= 3")
def t8(s, d):
    return statechange.top_states(statechange.analyze_timelines(b.observations(s, d)), 3).select("video_id", "state", "episodes")


from timelens import queries_scan  # noqa: E402, F401 (registers more queries)
