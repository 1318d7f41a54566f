"""How often a label changes over time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelens.constants import LONG_SHOT_STRIDE, MIDPOINT_SHOT, SHOWN_RUNS, SIMILAR_LABELS, TOP_STATES
from timelens.functions.text import NOT_VISIBLE
from timelens.operators.folds import streamed

_NOT_VISIBLE = re.compile(NOT_VISIBLE)


def _state(text: str) -> str:
    return re.sub(r"[^a-z0-9 ]", "", text.lower()).strip()


def _alike(a: str, b: str) -> bool:
    x, y = set(_state(a).split()), set(_state(b).split())
    return bool(x and y) and len(x & y) / len(x | y) >= SIMILAR_LABELS


def analyze(observations: Iterable[tuple[float, str]]) -> tuple[list[tuple[float, float, str]], int, int, int]:
    """Runs of a timeline of (time, label), fewest and most changes, distinct states.

    Labels that say the subject isn't visible don't count. Equal labels run together, which gives the most changes; then runs
    that are alike to the first label of the one before join it, and a run of one sample between two runs of
    one state is flicker, which gives the fewest.
    """
    runs: list[list] = []
    for ts, text in observations:
        if _NOT_VISIBLE.match(text):
            continue
        if runs and _state(text) == _state(runs[-1][2]):
            runs[-1][1] = ts
        else:
            runs.append([ts, ts, text])
    most = max(0, len(runs) - 1)
    merged: list[list] = []
    for run in runs:
        if merged and _alike(run[2], merged[-1][2]):
            merged[-1][1] = run[1]
        else:
            merged.append(list(run))
    at = 1
    while at < len(merged) - 1:
        before, run, after = merged[at - 1 : at + 2]
        if run[0] == run[1] and _state(before[2]) == _state(after[2]):
            before[1] = after[1]
            del merged[at : at + 2]
            at = max(1, at - 1)  # only the grown run's surroundings changed
        else:
            at += 1
    return [tuple(r) for r in merged], max(0, len(merged) - 1), most, len({_state(r[2]) for r in merged})


SUMMARY = "video_id string, prompt_key string, runs array<struct<time_start:double,time_end:double,label:string>>, changes_low int, changes_high int, distinct_states int"


def analyze_timelines(observations: DataFrame) -> DataFrame:
    """R4 for each (video_id, prompt_key): a fold in which each step depends on the last. A timeline is one clip's samples."""
    seen = observations.filter("text IS NOT NULL").select(F.col("video_id").cast("string").alias("video_id"), F.col("prompt_key").cast("string").alias("prompt_key"), "timestamp", "text")

    def summary(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        runs, low, high, distinct = analyze(rows)
        yield *key, [{"time_start": a, "time_end": b, "label": t} for a, b, t in runs], low, high, distinct

    return streamed(seen, ["video_id", "prompt_key"], ["timestamp", "text"], ["timestamp", "text"], summary, SUMMARY)


def episodes(analyzed: DataFrame) -> DataFrame:
    """Runs of each state."""
    label = F.trim(F.regexp_replace(F.lower("run.label"), "[^a-z0-9 ]", ""))
    return analyzed.select("video_id", "prompt_key", F.explode("runs").alias("run")).groupBy("video_id", "prompt_key", label.alias("state")).agg(F.count("*").alias("episodes"))


def top_states(analyzed: DataFrame, most: int = TOP_STATES) -> DataFrame:
    """The states of each timeline with most episodes."""
    by = Window.partitionBy("video_id", "prompt_key").orderBy(F.desc("episodes"), "state")
    return episodes(analyzed).withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= most).drop("_rank")


def scan_evidence(analyzed: DataFrame, frames: DataFrame, target: str) -> DataFrame:
    """A counted item for each timeline (score 1), and its first SHOWN_RUNS runs; frames (video_id, prompt_key, frames) says how many were looked at."""
    said = top_states(analyzed).groupBy("video_id", "prompt_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("episodes")).alias("less"), "state"))).alias("states"))
    joined = analyzed.join(said, ["video_id", "prompt_key"], "left").join(frames, ["video_id", "prompt_key"], "left")
    shown = F.array_join(F.transform(F.coalesce("states", F.array().cast("array<struct<less:bigint,state:string>>")), lambda x: F.concat(x["state"], F.lit(": "), (-x["less"]).cast("string"))), ", ")
    counted = F.format_string("counted over %d frames of '%s': %d distinct states, %d to %d changes, %d episodes (%s)", F.coalesce("frames", F.lit(0)), F.lit(target), "distinct_states", "changes_low", "changes_high", F.size("runs"), shown)
    first, last = F.get("runs", F.lit(0))["time_start"], F.get("runs", F.size("runs") - 1)["time_end"]
    total = joined.select(F.lit("deep_scan_count").alias("modality"), "video_id", F.coalesce(first, F.lit(0.0)).alias("time_start"), F.coalesce(last, F.lit(0.0)).alias("time_end"), counted.alias("content"), F.lit(1.0).alias("score"))
    each = analyzed.select("video_id", F.explode(F.slice("runs", 1, SHOWN_RUNS)).alias("run")).select(F.lit("observation").alias("modality"), "video_id", "run.time_start", "run.time_end", F.col("run.label").alias("content"), F.lit(0.9).alias("score"))
    return total.unionByName(each)


def sample_times(segments: DataFrame, most: int) -> DataFrame:
    """Times to look at: the middle of a short shot, every stride within a long one; at most ``most`` of each video, evenly."""
    start, end = F.col("start_time"), F.col("end_time")
    inner = F.filter(F.transform(F.sequence(F.lit(0), F.ceil((end - start) / LONG_SHOT_STRIDE).cast("int")), lambda i: start + LONG_SHOT_STRIDE / 2 + i * LONG_SHOT_STRIDE), lambda t: t < end)
    stamps = F.when(end - start <= MIDPOINT_SHOT, F.array((start + end) / 2)).otherwise(inner)
    every = segments.select("video_id", F.explode(stamps).alias("timestamp")).select("video_id", F.round("timestamp", 2).alias("timestamp")).distinct()
    seq = Window.partitionBy("video_id").orderBy("timestamp")
    placed = every.withColumns({"_i": F.row_number().over(seq) - 1, "_n": F.count("*").over(Window.partitionBy("video_id"))})
    # kept: the indices floor(i * n / most)
    ahead = F.ceil(F.col("_i") * most / F.col("_n"))
    kept = (F.col("_n") <= most) | ((F.floor(ahead * F.col("_n") / most) == F.col("_i")) & (ahead < most))
    return placed.filter(kept).select("video_id", "timestamp")
