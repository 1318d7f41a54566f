"""Where to look to verify that something is there, and how often it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_DURATION = 60.0


def presence_times(videos: DataFrame, segments: DataFrame, samples: int = 10, window: tuple[float, float] | None = None) -> DataFrame:
    """At most ``samples`` times of each video (video_id, duration_seconds): middles of its segments, else evenly spaced ones.

    With a window, the middles within it, or evenly spaced times of the window where none is in it.
    """
    spaced = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: (i + 0.5) / samples)
    middles = segments.select("video_id", "start_time", ((F.col("start_time") + F.col("end_time")) / 2.0).alias("timestamp"))
    if window is not None:
        middles = middles.filter(F.col("timestamp").between(*map(float, window)))
    by = Window.partitionBy("video_id")
    placed = middles.withColumns({"_i": F.row_number().over(by.orderBy("start_time", "timestamp")) - 1, "_n": F.count("*").over(by)})
    # the kept ones: int(k * n / samples), k under samples
    kept = F.exists(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.floor(k * (F.col("_n") / float(samples))) == F.col("_i"))
    chosen = placed.filter((F.col("_n") <= samples) | kept).select("video_id", "timestamp")
    bare = videos.join(middles.select("video_id").distinct(), "video_id", "left_anti")
    duration = F.coalesce("duration_seconds", F.lit(UNKNOWN_DURATION))
    at = F.transform(spaced, lambda x: duration * x) if window is None else F.transform(spaced, lambda x: F.lit(float(window[0])) + x * (float(window[1]) - float(window[0])))
    return chosen.join(videos.select("video_id"), "video_id", "left_semi").union(bare.select("video_id", F.explode(at).alias("timestamp")))


def presence_counts(answers: DataFrame) -> DataFrame:
    """Times at which a verifier (label ``yes``, ``no`` or ``unsure``) surely saw it, by video; a hedge doesn't count."""
    return answers.groupBy("video_id").agg(F.count_if(F.col("label") == "yes").alias("present"))
