"""One text index over captions, speech, screen text and actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.functions.text import squeezed
from timelens.functions.vector import hash_embedding
from timelens.operators.fuse import first_texts

#: Source of each kind of text: the columns of its start, end and text.
SOURCES = {
    "caption": ("segments", "start_time", "end_time", "caption"),
    "transcript": ("transcripts", "start_time", "end_time", "text"),
    "on_screen_text": ("ocr_results", "timestamp", "timestamp", "text"),
    "action": ("action_events", "start_time", "end_time", "action_class"),
}


def text_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """U4: (video_id, modality, time_start, time_end, text) of all sources that are there; blank texts go, an unknown start is 0."""
    out = None
    for modality, (name, start, end, text) in SOURCES.items():
        if name not in tables:
            continue
        at = F.coalesce(F.col(start).cast("double"), F.lit(0.0))
        part = tables[name].select("video_id", F.lit(modality).alias("modality"), at.alias("time_start"), F.coalesce(F.col(end).cast("double"), at).alias("time_end"), F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("text"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source of texts")
    return out.filter("text <> ''")


def index_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """W2 over U4: the earliest row of each normalised text, by video and modality."""
    rows = text_rows(tables).withColumns({"timestamp": F.col("time_start"), "seq": F.struct("time_end", "text")})
    return first_texts(rows, squeezed(F.col("text"))).drop("timestamp", "seq")


def build_index(tables: dict[str, DataFrame], embed: Callable[[Column], Column] = hash_embedding, embedder: str = "hash") -> DataFrame:
    """index rows with embeddings, as rows of the ``vectors`` table's ``text`` space; written by video, a rebuild replaces a video's partition."""
    rows = index_rows(tables).withColumn("embedding", embed(F.col("text")))
    payload = F.create_map(F.lit("modality"), F.col("modality"), F.lit("time_end"), F.col("time_end").cast("string"), F.lit("text"), F.col("text"))
    return rows.select(F.lit("text").alias("space"), F.lit(embedder).alias("embedder"), F.size("embedding").alias("dim"), "video_id", F.col("time_start").alias("timestamp"), "embedding", payload.alias("payload"))


def missing_videos(videos: DataFrame, index: DataFrame, embedder: str) -> DataFrame:
    """F22's backfill: videos that are done and have no row of the embedder yet."""
    return videos.filter("ingest_status = 'done'").join(index.filter(F.col("embedder") == embedder).select("video_id").distinct(), "video_id", "left_anti")
