"""sweeps over clips by a captioner, kept in two caches: what was seen, and how labels map to states.

A sweep is known by its key: the target's identity, the template's version, the sampling and the captioner. Keys with any cached row are complete and
aren't looked at again. All requests of a call are one anti-join, one batched captioner pass over the frames that are missing and one
append; labels that no mapping is kept for go through the normaliser, once for each sweep.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.constants import SCAN_FPS, SCAN_FRAMES, SHOWN_RUNS
from timelens.functions import text as tx
from timelens.operators import statechange
from timelens.session import checkpoint
from timelens.sources import versions

#: Versions of the prompts; another one makes another key.
TEMPLATE, NORMALISER = "v5", "norm2"
#: Raw runs that a normaliser is shown, and pairs of a mapping that evidence names.
SHOWN_TIMELINE, SHOWN_PAIRS = 80, 60

#: Loaded once in each Python worker: labels of a batch of frames (video_id, scan_target, timestamp, local_path); None where a frame can't be read.
Captioner = Callable[[], Callable[[list[dict]], list[str | None]]]
#: The same for labels: a subject, its distinct labels and its timeline give label -> state, or nothing.
Normaliser = Callable[[], Callable[[str, list[str], list[tuple]], dict]]

OBSERVATION = "video_id string, prompt_key string, timestamp double, text string"


def prompt_key(target: Column, captioner: str, frames: int = SCAN_FRAMES, fps: float = SCAN_FPS) -> Column:
    """A sweep's key from its target and the captioner's fingerprint."""
    return F.substring(F.sha1(F.concat_ws("|", F.lit(TEMPLATE), tx.canonical_key(target), F.lit(f"{frames}|{fps}|{captioner}"))), 1, 16)


def map_key(key: Column, reasoner: str) -> Column:
    return F.concat_ws(":", key, F.lit(NORMALISER), F.lit(reasoner))


def frame_times(videos: DataFrame, segments: DataFrame, frames: int = SCAN_FRAMES, fps: float = SCAN_FPS) -> DataFrame:
    """The times of statechange.sample_times, and for videos without a segment fixed strides over duration_seconds: 1 / fps, or wider to keep to the budget."""
    sampled = statechange.sample_times(segments.join(videos.select("video_id"), "video_id", "left_semi"), frames)
    bare = videos.join(segments.select("video_id").distinct(), "video_id", "left_anti")
    length = F.coalesce("duration_seconds", F.lit(0.0))
    stride = F.greatest(F.lit(1.0 / fps), F.when(length > 0, length / frames).otherwise(F.lit(1.0)))
    strided = bare.withColumn("stride", stride).select("video_id", "stride", F.explode(F.sequence(F.lit(0), F.floor(length / stride).cast("int"))).alias("i"))
    return sampled.unionByName(strided.select("video_id", F.round(F.col("i") * F.col("stride"), 2).alias("timestamp")))


def captioned(frames: DataFrame, captioner: Captioner) -> DataFrame:
    """Observations of frames (video_id, prompt_key, scan_target, timestamp, local_path), by Arrow batches; frames that can't be read are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or captioner()
            said = [None if t is None else t.strip() for t in model(batch.to_pylist())]
            out = pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("video_id", "prompt_key", "timestamp")} | {"text": pa.array(said, pa.string())})
            yield out.filter(out.column("text").is_valid())

    # rows are few and small, the model's work isn't: as many tasks as there are cores, several times
    dealt = frames.repartition(4 * frames.sparkSession.sparkContext.defaultParallelism, "video_id", "timestamp")
    return dealt.select(F.col("video_id").cast("string").alias("video_id"), "prompt_key", "scan_target", "timestamp", "local_path").mapInArrow(run, OBSERVATION)


def missing(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Requests (video_id, prompt_key) that no row is cached for."""
    return requests.join(cached.select("video_id", "prompt_key").distinct(), ["video_id", "prompt_key"], "left_anti")


def keyed(requests: DataFrame, captioner: str, frames: int = SCAN_FRAMES, fps: float = SCAN_FPS) -> DataFrame:
    """Requests (video_id, scan_target) with their keys, one of each key: of several wordings of one intent the first."""
    made = requests.withColumn("video_id", F.col("video_id").cast("string")).withColumn("prompt_key", prompt_key(F.col("scan_target"), captioner, frames, fps))
    return made.groupBy("video_id", "prompt_key").agg(F.min("scan_target").alias("scan_target"))


def sweep(wanted: DataFrame, cached: DataFrame, times: DataFrame, videos: DataFrame, captioner: Captioner) -> tuple[DataFrame, DataFrame]:
    """Observations for wanted sweeps (video_id, prompt_key, scan_target): those that are cached, and fresh ones of the others, looked at now."""
    paths = videos.select(F.col("video_id").cast("string").alias("video_id"), "local_path")
    at = times.select(F.col("video_id").cast("string").alias("video_id"), "timestamp")
    frames = missing(wanted, cached).join(at, "video_id").join(paths, "video_id", "left")
    held = cached.join(wanted.select("video_id", "prompt_key"), ["video_id", "prompt_key"], "left_semi").select("video_id", "prompt_key", "timestamp", "text")
    return held, captioned(frames, captioner)


def _timelines(observations: DataFrame) -> DataFrame:
    """What a normaliser judges, a row for each sweep: its distinct labels and its observations in order. A sweep has a frame budget, so both are bounded by it."""
    seen = observations.select("video_id", "prompt_key", F.struct("timestamp", "text", tx.state(F.col("text")).alias("state")).alias("x"))
    held = seen.groupBy("video_id", "prompt_key").agg(F.sort_array(F.collect_list("x")).alias("seen"))
    return held.select("video_id", "prompt_key", F.sort_array(F.array_distinct(F.filter("seen.text", lambda t: t.isNotNull()))).alias("labels"), "seen")


def _shown_runs(seen: list[dict]) -> list[tuple]:
    """The first SHOWN_TIMELINE raw runs (start, end, first label) of equal states; what has none is a run by itself."""
    runs: list[list] = []
    last = None
    for x in seen:
        if runs and x["state"] is not None and x["state"] == last:
            runs[-1][1] = x["timestamp"]
        elif len(runs) == SHOWN_TIMELINE:
            break
        else:
            runs.append([x["timestamp"], x["timestamp"], x["text"]])
        last = x["state"]
    return [tuple(r) for r in runs]


def normalised(observations: DataFrame, wanted: DataFrame, normaliser: Normaliser) -> DataFrame:
    """A row (video_id, prompt_key, mapping as JSON) for each sweep that a normaliser maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or normaliser()
            rows = []
            for r in batch.to_pylist():
                found = model(r["scan_target"], r["labels"], _shown_runs(r["seen"]))
                if found:
                    rows.append((r["video_id"], r["prompt_key"], json.dumps(found, sort_keys=True, ensure_ascii=False)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["video_id", "prompt_key", "mapping"])

    shown = _timelines(observations).join(wanted, ["video_id", "prompt_key"])
    return shown.select("video_id", "prompt_key", "scan_target", "labels", "seen").mapInArrow(run, "video_id string, prompt_key string, mapping string")


def with_states(observations: DataFrame, mappings: DataFrame) -> DataFrame:
    """labels replaced by their sweep's mapping (video_id, prompt_key, mapping); others stay."""
    told = mappings.select("video_id", "prompt_key", F.from_json("mapping", "map<string,string>").alias("_mapping"))
    joined = observations.join(told, ["video_id", "prompt_key"], "left")
    return joined.withColumn("text", F.coalesce(F.try_element_at("_mapping", F.col("text")), "text")).drop("_mapping")


def scan_items(observations: DataFrame, wanted: DataFrame, mappings: DataFrame, kept: DataFrame) -> DataFrame:
    """Evidence of sweeps: a counted item each (score 1) with its statistics, and the first SHOWN_RUNS runs (0.9).

    ``observations`` are the labels as they were seen, ``kept`` the keys (video_id, prompt_key) that came from the cache.
    """
    frames = observations.groupBy("video_id", "prompt_key").agg(F.count("*").alias("frames"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    # asked for in several places: models and folds run once
    mappings = checkpoint(mappings)
    analyzed = checkpoint(statechange.analyze_timelines(with_states(observations, mappings)))
    count = F.struct(F.col("changes_low"), F.col("changes_high"), F.col("distinct_states"), F.size("runs").alias("total_episodes"))
    per_state = statechange.episodes(analyzed).groupBy("video_id", "prompt_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("episodes")).alias("less"), "state"))).alias("states"))
    joined = wanted.join(frames, ["video_id", "prompt_key"], "left").join(analyzed.select("video_id", "prompt_key", count.alias("n")), ["video_id", "prompt_key"], "left").join(per_state, ["video_id", "prompt_key"], "left")
    joined = joined.join(kept.select("video_id", "prompt_key").distinct().withColumn("cached", F.lit(True)), ["video_id", "prompt_key"], "left").join(mappings.select("video_id", "prompt_key", "mapping"), ["video_id", "prompt_key"], "left")
    states = F.coalesce("states", F.array().cast("array<struct<less:bigint,state:string>>"))
    shown = F.array_join(F.transform(F.slice(states, 1, 8), lambda x: F.concat(x["state"], F.lit(": "), (-x["less"]).cast("string"))), ", ")
    number = lambda c: F.coalesce(F.col(f"n.{c}"), F.lit(0))
    content = F.format_string("counted over %d frames of '%s': %d distinct states, %d to %d changes, %d episodes (%s)", F.coalesce("frames", F.lit(0)), "scan_target", number("distinct_states"), number("changes_low"), number("changes_high"), number("total_episodes"), shown)
    pairs = F.map_from_entries(F.slice(F.map_entries(F.from_json(F.coalesce("mapping", F.lit("{}")), "map<string,string>")), 1, SHOWN_PAIRS))
    facts = F.to_json(F.struct(number("changes_low").alias("changes_low"), number("changes_high").alias("changes_high"), number("distinct_states").alias("distinct_states"), number("total_episodes").alias("total_episodes"), F.coalesce("frames", F.lit(0)).alias("frames_scanned"), F.map_from_entries(F.transform(states, lambda x: F.struct(x["state"], -x["less"]))).alias("episodes"), F.coalesce("cached", F.lit(False)).alias("cached"), F.col("mapping").isNotNull().alias("normalized"), pairs.alias("label_mapping")))
    total = joined.select(F.lit("deep_scan_count").alias("modality"), "video_id", F.coalesce("first", F.lit(0.0)).alias("time_start"), F.coalesce("last", F.lit(0.0)).alias("time_end"), content.alias("content"), F.lit(1.0).alias("score"), facts.alias("attributes"))
    each = analyzed.select("video_id", F.explode(F.slice("runs", 1, SHOWN_RUNS)).alias("run"))
    return total.unionByName(each.select(F.lit("observation").alias("modality"), "video_id", "run.time_start", "run.time_end", F.col("run.label").alias("content"), F.lit(0.9).alias("score"), F.lit(None).cast("string").alias("attributes")))


@dataclass(frozen=True)
class Models:
    """What looks and what judges, with the fingerprints that their keys hold. Without a normaliser labels stand for themselves."""

    captioner: Captioner
    captioner_id: str
    normaliser: Normaliser | None = None
    normaliser_id: str = ""


def deep_scan(requests: DataFrame, videos: DataFrame, segments: DataFrame, path: str, models: Models, frames: int = SCAN_FRAMES, fps: float = SCAN_FPS) -> DataFrame:
    """evidence for requests (video_id, scan_target), with the observations at ``path`` as both caches.

    Fresh observations and mappings are each computed once, committed, and read from there; a sweep that is stopped leaves nothing. A second call
    with the same models asks neither of them.
    """
    spark = requests.sparkSession
    held = versions.adopt(spark, path, "observations", ("video_id", "prompt_key"))
    wanted = keyed(requests, models.captioner_id, frames, fps).withColumn("map_key", map_key(F.col("prompt_key"), models.normaliser_id))
    before = held.read()
    lacking = missing(wanted, before)
    if not lacking.isEmpty():
        named = videos.withColumn("video_id", F.col("video_id").cast("string"))
        cuts = segments.withColumn("video_id", F.col("video_id").cast("string"))
        some = named.join(lacking.select("video_id").distinct(), "video_id", "left_semi")
        held.replace(sweep(wanted, before, frame_times(some, cuts, frames, fps), named, models.captioner)[1])
    seen = held.read().join(wanted.select("video_id", "prompt_key"), ["video_id", "prompt_key"], "left_semi").select("video_id", "prompt_key", "timestamp", "text")
    if models.normaliser is not None:
        unmapped = wanted.join(held.read().select("video_id", F.col("prompt_key").alias("map_key")), ["video_id", "map_key"], "left_anti")
        if not unmapped.isEmpty():
            fresh = normalised(seen.join(unmapped.select("video_id", "prompt_key"), ["video_id", "prompt_key"], "left_semi"), unmapped.select("video_id", "prompt_key", "scan_target"), models.normaliser)
            rows = fresh.join(wanted.select("video_id", "prompt_key", "map_key"), ["video_id", "prompt_key"])
            held.replace(rows.select("video_id", F.col("map_key").alias("prompt_key"), F.lit(0.0).alias("timestamp"), F.col("mapping").alias("text")))
    kept = held.read().select("video_id", F.col("prompt_key").alias("map_key"), F.col("text").alias("mapping"))
    mappings = wanted.join(kept, ["video_id", "map_key"]).select("video_id", "prompt_key", "mapping") if models.normaliser is not None else _no_mappings(wanted)
    return scan_items(seen, wanted.drop("map_key"), mappings, before)


def _no_mappings(wanted: DataFrame) -> DataFrame:
    return wanted.select("video_id", "prompt_key", F.lit(None).cast("string").alias("mapping")).limit(0)


def scan_requests(questions: DataFrame, items: DataFrame, videos: DataFrame, off: Sequence[str] = ()) -> DataFrame:
    """Which video each question (question_id, scan_target, primary_video_id) sweeps, or why none: question_id, video_id, scan_target, skipped.

    The video that most of its items (question_id, video_id, position) are of, the first seen of equals; else its primary one; else the only one of the
    catalog (video_id, local_path, profile, source_type). Videos whose recorded profile is in ``off`` aren't swept.
    """
    votes = items.filter("video_id IS NOT NULL").groupBy("question_id", "video_id").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    most = votes.groupBy("question_id").agg(F.max_by("video_id", F.struct("n", -F.col("first"))).alias("voted"))
    only = videos.limit(2).agg(F.when(F.count("*") == 1, F.max("video_id")).alias("only"))
    chosen = questions.join(most, "question_id", "left").join(F.broadcast(only)).withColumn("video_id", F.coalesce("voted", "primary_video_id", "only"))
    found = chosen.join(videos.select("video_id", "local_path", F.coalesce("profile", F.when(F.col("source_type") == "nvr_recorded", "security").otherwise("generic")).alias("profile")), "video_id", "left")
    reason = F.when(F.col("local_path").isNull(), "no target video resolvable").when(F.col("profile").isin(*off, ""), "the video's footage profile gates deep scans off").when(F.coalesce("scan_target", F.lit("")) == "", "no scan target derivable from the query")
    return found.select("question_id", F.when(reason.isNull(), F.col("video_id")).alias("video_id"), "scan_target", reason.alias("skipped"))
