"""How the operators' role tables are made from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.functions.timeparse import TimeWindow
from timelens.operators.intervals import islands

TRACK_ISLAND = 86_400.0
WINDOW = TimeWindow("2024-01-05T00:00:00", "2024-01-09T00:00:00", "America/Los_Angeles")
T0, T1 = WINDOW.epoch_bounds()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), epoch.alias("epoch"), "event_type", "value")


def _based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).groupBy("video_id").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last")).withColumn("base", F.floor(F.col("first") / 86400) * F.lit(86400.0))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("video_id")
    return _based(spark, sf_dir).select(
        "video_id",
        "base",
        F.when(v % 10 != 0, F.col("base")).alias("start_epoch"),
        (F.col("last") - F.col("base")).alias("duration_seconds"),
        F.when(v % 11 != 0, F.concat(F.lit("cam-"), (v % 6).cast("string"))).alias("camera_id"),
        F.when(v % 37 == 0, "failed").otherwise("done").alias("ingest_status"),
        F.when(v % 3 == 0, "security").alias("profile"),
        F.when(v % 2 == 0, "nvr_recorded").otherwise("local").alias("source_type"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = raw_events(spark, sf_dir).join(_based(spark, sf_dir).select("video_id", "base"), "video_id")
    return joined.select("event_id", "video_id", (F.col("epoch") - F.col("base")).alias("timestamp"), F.col("event_type").alias("object_class"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = detections(spark, sf_dir).withColumn("_end", F.col("timestamp"))
    found = islands(seen, ["video_id", "object_class"], "timestamp", "_end", TRACK_ISLAND)
    grouped = found.groupBy("video_id", "object_class", "island").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("frame_count"), F.max("confidence").alias("track_confidence"))
    return grouped.withColumn("track_id", F.concat_ws("-", F.col("video_id").cast("string"), "object_class", F.col("island").cast("string"))).drop("island")


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).filter("event_type = 'error'")
    return e.select((F.col("video_id") % 6).cast("string").alias("camera_ref"), F.col("epoch").alias("start_epoch"), (F.col("epoch") + F.col("value")).alias("end_epoch"), F.lit("motion").alias("kind"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("object_class") == "view", "none").otherwise(F.col("object_class"))
    return detections(spark, sf_dir).select("video_id", F.lit("state").alias("prompt_key"), "timestamp", "event_id", label.alias("text"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = 5.0 * F.col("turn")
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("line_id"), start.alias("start_time"), (start + 5.0).alias("end_time"), F.col("role").alias("speaker"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = 5.0 * F.col("turn") + 1.8
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), start.alias("start_time"), (start + 5.0).alias("end_time"), F.col("role").alias("speaker"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("n_chars") % 600).cast("double")
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.lit(0).alias("segment_index"), start.alias("start_time"), (start + F.col("n_chars") / 10.0).alias("end_time"), F.col("text").alias("caption"))


def screen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return lines.select("video_id", F.col("position").cast("double").alias("timestamp"), "text").filter("text <> ''")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).filter("event_type = 'purchase'")
    return e.select((F.col("video_id") % 6).alias("camera"), "event_id", F.col("epoch").alias("start_time"), (F.col("epoch") + 60 * F.col("value")).alias("end_time"), F.col("value").alias("confidence"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.transform("embedding", lambda x: x.cast("double"))
    modality = F.when(F.col("vec_id") % 3 == 0, "caption").when(F.col("vec_id") % 3 == 1, "transcript").otherwise("on_screen_text")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("video_id"), F.col("vec_id").cast("double").alias("timestamp"), unit.alias("embedding"), modality.alias("modality"))


EV = "ev AS (SELECT event_id, user_id AS video_id, epoch_us(ts) / 1e6 AS epoch, event_type, value FROM events)"
BASED = f"{EV}, based AS (SELECT video_id, min(epoch) AS first, max(epoch) AS last, floor(min(epoch) / 86400) * 86400.0 AS base FROM ev GROUP BY 1)"
VIDEOS = f"""{BASED}, videos AS (SELECT video_id, base, CASE WHEN video_id % 10 <> 0 THEN base END AS start_epoch, last - base AS duration_seconds,
  CASE WHEN video_id % 11 <> 0 THEN 'cam-' || (video_id % 6) END AS camera_id, CASE WHEN video_id % 37 = 0 THEN 'failed' ELSE 'done' END AS ingest_status,
  CASE WHEN video_id % 3 = 0 THEN 'security' END AS profile, CASE WHEN video_id % 2 = 0 THEN 'nvr_recorded' ELSE 'local' END AS source_type FROM based)"""
DETECTIONS = f"""{VIDEOS}, detections AS (SELECT event_id, video_id, epoch - base AS timestamp, event_type AS object_class, least(value / 500, 1.0) AS confidence FROM ev JOIN based USING (video_id))"""
TRACKS = f"""{DETECTIONS}, t1 AS (SELECT *, CASE WHEN timestamp - max(timestamp) OVER (PARTITION BY video_id, object_class ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {TRACK_ISLAND} THEN 0 ELSE 1 END AS fresh FROM detections),
t2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, object_class ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS island FROM t1),
tracks AS (SELECT video_id, object_class, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS frame_count, max(confidence) AS track_confidence,
  video_id || '-' || object_class || '-' || island::BIGINT AS track_id FROM t2 GROUP BY video_id, object_class, island)"""
MOTION = f"{EV}, motion AS (SELECT (video_id % 6)::VARCHAR AS camera_ref, epoch AS start_epoch, epoch + value AS end_epoch, 'motion' AS kind FROM ev WHERE event_type = 'error')"
TRANSCRIPTS = "transcripts AS (SELECT conv_id AS video_id, turn AS line_id, 5.0::DOUBLE * turn AS start_time, 5.0::DOUBLE * turn + 5.0::DOUBLE AS end_time, role AS speaker, text FROM conversations)"
TURNS = "turns AS (SELECT conv_id AS video_id, 5.0::DOUBLE * turn + 1.8::DOUBLE AS start_time, 5.0::DOUBLE * turn + 1.8::DOUBLE + 5.0::DOUBLE AS end_time, role AS speaker FROM conversations)"
SEGMENTS = "segments AS (SELECT doc_id AS video_id, 0 AS segment_index, (n_chars % 600)::DOUBLE AS start_time, (n_chars % 600)::DOUBLE + n_chars / 10.0::DOUBLE AS end_time, text AS caption FROM documents)"
LINES = "cut AS (SELECT doc_id AS video_id, string_split(text, chr(10)) AS parts FROM documents), lines AS (SELECT video_id, (i - 1)::DOUBLE AS timestamp, parts[i] AS text FROM (SELECT video_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut) WHERE parts[i] <> '')"
VECTORS = "vecs AS (SELECT vec_id, label AS video_id, vec_id::DOUBLE AS timestamp, embedding::DOUBLE[] AS embedding, CASE vec_id % 3 WHEN 0 THEN 'caption' WHEN 1 THEN 'transcript' ELSE 'on_screen_text' END AS modality FROM embeddings)"
