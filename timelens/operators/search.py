"""Lexical search over captions, transcripts, screen text and actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.functions.text import collapsed, overlap_score, query_tokens
from timelens.session import checkpoint


def _scored(df: DataFrame, text: Column, query: str) -> DataFrame:
    return df.withColumn("score", overlap_score(text, query_tokens(query))).filter("score > 0")


def top(df: DataFrame, k: int | None, *order: Column | str) -> DataFrame:
    """The first k rows of an order that ends with the frame's own ids, so that ties don't matter."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def search_captions(segments: DataFrame, query: str, k: int | None = 10) -> DataFrame:
    """segments with a caption, by share of the query's words, then start."""
    found = _scored(segments.filter("caption IS NOT NULL"), F.col("caption"), query)
    return top(found, k, F.desc("score"), "start_time", "video_id", "segment_index")


def search_transcripts(lines: DataFrame, query: str, k: int | None = 10, speaker: str | None = None) -> DataFrame:
    """lines by share of the query's words, then start; of one speaker if given."""
    if speaker is not None:
        lines = lines.filter(F.col("speaker") == speaker)
    return top(_scored(lines, F.col("text"), query), k, F.desc("score"), "start_time", "video_id", "end_time")


def ocr_groups(lines: DataFrame) -> DataFrame:
    """A10: each text of a video with its sightings."""
    return lines.groupBy("video_id", "text").agg(F.count("*").alias("sightings"), F.min("timestamp").alias("time_start"), F.max("timestamp").alias("time_end"))


def search_ocr(lines: DataFrame, query: str, k: int | None = 10) -> DataFrame:
    """texts on screen by share of the query's words; 1 where the query's letters, at least four, stand in the text's letters."""
    phrase = "".join(c for c in query.lower() if c.isascii() and c.isalnum())
    score = overlap_score(F.col("text"), query_tokens(query))
    if len(phrase) >= 4:
        score = F.when(collapsed(F.col("text")).contains(phrase), 1.0).otherwise(score)
    # scored before grouping, so that only texts that match are grouped
    found = ocr_groups(lines.filter(score > 0)).withColumn("score", score)
    return top(found, k, F.desc("score"), "time_start", "video_id", "text")


def search_actions(events: DataFrame, query: str, k: int | None = 10) -> DataFrame:
    """by share of the query's words, then confidence, then start."""
    found = _scored(events, F.col("action_class"), query)
    return top(found, k, F.desc("score"), F.desc("confidence"), "start_time", "video_id")


def settled(found: DataFrame) -> DataFrame:
    """A search's few rows, computed and kept until nothing refers to them: what fails in its stages fails here."""
    return checkpoint(found)


def search_columns(sources: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame | str]:
    """several searches side by side; one that fails, as its plan is made or as it runs, leaves its message and the others as they are."""
    out: dict[str, DataFrame | str] = {}
    for name, make in sources.items():
        try:
            out[name] = settled(make())
        except Exception as e:  # noqa: BLE001
            out[name] = f"{type(e).__name__}: {e}"
    return out
