"""Intervals and sequences: islands, runs, temporal joins, windows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelens.constants import CLUSTER_GAP, CO_OCCURRENCE_GAP, CUT_DISTANCE, CUT_LEAST_SECONDS, MAX_WINDOW, MIN_SPAN
from timelens.functions.geometry import overlap
from timelens.operators.folds import streamed

#: Seconds of a group's history that are compared in one task.
ISLAND_BUCKET = 86_400.0
#: Time buckets of a span in a temporal join, one more at most; their widths are powers of it. Times from FAR on aren't put into buckets.
SPREAD, FAR = 4, 1e15


def islands(df: DataFrame, by: Sequence[str], start: str, end: str, gap: float, order: Sequence[str] = ()) -> DataFrame:
    """df with ``island``: rows of a group whose start is within gap of the latest end before it are in one island."""
    seq = Window.partitionBy(*by).orderBy(start, end, *order)
    before = F.max(end).over(seq.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) - before > gap), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(seq.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def wide_islands(df: DataFrame, by: Sequence[str], start: str, end: str, gap: float, width: float = ISLAND_BUCKET) -> DataFrame:
    """islands for groups of any length, such as a camera's whole history; ``island`` is the start of its first row.

    Rows are compared within buckets of time; what a bucket needs of those before it (their latest end, and where their last island began)
    is carried over from a row for each bucket. No task sorts a group whole.
    """
    bucket = F.floor(F.col(start) / width).cast("bigint")
    placed = df.withColumn("_bucket", bucket)
    seq = Window.partitionBy(*by, "_bucket").orderBy(start, end)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
        each = rows.groupBy(*by, "_bucket").agg(value.alias("_each")).withColumn(name, F.max("_each").over(earlier)).drop("_each")
        named = each.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_bucket").alias("_in"), name)
        on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_bucket") == F.col("_in")]
        return rows.join(named, reduce(and_, on)).drop("_in", *[f"_of_{c}" for c in by])

    reached = carried(placed, F.max(end), "_carried_end")
    before = F.greatest(F.max(end).over(seq.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried_end"))
    opened = reached.withColumn("_opens", F.when(before.isNull() | (F.col(start) - before > gap), F.col(start))).drop("_carried_end")
    known = carried(opened, F.max("_opens"), "_carried_island")
    own = F.max("_opens").over(seq.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("island", F.coalesce(own, F.col("_carried_island"))).drop("_opens", "_carried_island", "_bucket")


def cluster_events(events: DataFrame, gap: float = CLUSTER_GAP) -> DataFrame:
    """Episodes of events (camera_ref, start_epoch, end_epoch, kind) by camera; an episode has its first event's kind."""
    found = wide_islands(events, ["camera_ref"], "start_epoch", "end_epoch", gap)
    first = F.min_by("kind", F.struct("start_epoch", "end_epoch", "kind"))
    return found.groupBy("camera_ref", "island").agg(F.min("start_epoch").alias("start_epoch"), F.max("end_epoch").alias("end_epoch"), first.alias("kind"), F.count("*").alias("n_events")).drop("island")


def co_occurrence(detections: DataFrame, classes: Sequence[str], max_gap: float = CO_OCCURRENCE_GAP) -> DataFrame:
    """Spans in which all classes are seen at the same time; stamps at most max_gap apart are one span."""
    wanted = sorted({c.lower() for c in classes})
    seen = detections.filter(F.lower("object_class").isin(*wanted)).groupBy("video_id", "timestamp").agg(F.count_distinct(F.lower("object_class")).alias("k"))
    stamps = seen.filter(F.col("k") == len(wanted)).select("video_id", "timestamp", F.col("timestamp").alias("_end"))
    spans = islands(stamps, ["video_id"], "timestamp", "_end", max_gap)
    return spans.groupBy("video_id", "island").agg(F.min("timestamp").alias("time_start"), F.max("timestamp").alias("time_end"), F.count("*").alias("frames")).drop("island")


def padded_spans(spans: DataFrame, pad: float, duration: Column, least: float = MIN_SPAN) -> DataFrame:
    """Spans (video_id, start_time, end_time) padded, cut to the clip, merged where they touch, short ones dropped."""
    wide = spans.select("video_id", F.greatest(F.lit(0.0), F.col("start_time") - pad).alias("start_time"), F.least(duration, F.col("end_time") + pad).alias("end_time")).filter("end_time > start_time")
    merged = wide_islands(wide, ["video_id"], "start_time", "end_time", 0.0).groupBy("video_id", "island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    return merged.drop("island").filter(F.col("end_time") - F.col("start_time") >= least)


def first_appearances(lines: DataFrame, norm: Column, gap: float) -> DataFrame:
    """I4: sightings of a text (video_id, timestamp) that follow the last one of the same normal form by more than gap."""
    lines = lines.withColumn("_norm", norm)
    last = F.lag("timestamp").over(Window.partitionBy("video_id", "_norm").orderBy("timestamp"))
    return lines.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("timestamp") - F.col("_last") > gap)).drop("_last", "_norm")


def pair_markers(log: DataFrame) -> DataFrame:
    """Episodes from a log (channel, seq, start_epoch, end_epoch), where a row has a start, an end, or both.

    A start followed by another start of its channel, or by nothing, is an open instant; an end without a start is an instant.
    """
    seq = Window.partitionBy("channel").orderBy("seq")
    markers = log.filter(F.col("start_epoch").isNull() | F.col("end_epoch").isNull())
    kind = F.when(F.col("start_epoch").isNotNull(), "start").otherwise("end")
    marked = markers.withColumn("kind", kind).withColumns({"next_kind": F.lead(kind).over(seq), "next_end": F.lead("end_epoch").over(seq), "last_kind": F.lag(kind).over(seq)})
    starts = marked.filter("kind = 'start'")
    paired = starts.filter("next_kind = 'end'").select("channel", "start_epoch", F.col("next_end").alias("end_epoch"), F.lit(False).alias("open"))
    opened = starts.filter("next_kind IS NULL OR next_kind = 'start'").select("channel", "start_epoch", F.col("start_epoch").alias("end_epoch"), F.lit(True).alias("open"))
    orphans = marked.filter("kind = 'end' AND end_epoch IS NOT NULL AND (last_kind IS NULL OR last_kind = 'end')").select("channel", F.col("end_epoch").alias("start_epoch"), "end_epoch", F.lit(False).alias("open"))
    whole = log.filter("start_epoch IS NOT NULL AND end_epoch IS NOT NULL").select("channel", "start_epoch", "end_epoch", F.lit(False).alias("open"))
    return whole.union(paired).union(opened).union(orphans)


def scene_cuts(frames: DataFrame, threshold: float = CUT_DISTANCE, least: float = CUT_LEAST_SECONDS) -> DataFrame:
    """Cuts of each video from frames (video_id, timestamp, distance to the frame before): far enough, and long enough since the last cut."""

    def cuts(key: tuple, rows: Iterable[tuple]) -> Iterator[tuple]:
        last = None
        for at, distance in rows:
            last = at if last is None else last
            if distance is not None and distance > threshold and at - last >= least:
                yield *key, at
                last = at

    kind = frames.schema["video_id"].dataType.simpleString()
    return streamed(frames.filter("timestamp IS NOT NULL"), ["video_id"], ["timestamp", "distance"], ["timestamp", "distance"], cuts, f"video_id {kind}, timestamp double")


def runs(df: DataFrame, by: Sequence[str], order: str, label: Column, ties: Sequence[str] = ()) -> DataFrame:
    """Runs of equal labels: by, run, label, time_start, time_end, samples. ``ties`` orders rows of one time."""
    seq = Window.partitionBy(*by).orderBy(order, *ties)
    marked = df.withColumn("label", label)
    fresh = F.when(F.col("label").eqNullSafe(F.lag("label").over(seq)) & (F.row_number().over(seq) > 1), 0).otherwise(1)
    numbered = marked.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run", "label").agg(F.min(order).alias("time_start"), F.max(order).alias("time_end"), F.count("*").alias("samples"))


def positional_join(left: DataFrame, right: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The n-th row of a group on the left with the n-th on the right; what is left over on either side goes."""
    seq = Window.partitionBy(*by).orderBy(*order)
    numbered = lambda df: df.withColumn("_at", F.row_number().over(seq)).drop(*order)
    return numbered(left).join(numbered(right), [*by, "_at"]).drop("_at")


def motion_spans(episodes: DataFrame, chunks: DataFrame, margin: float, pad: float, least: float = MIN_SPAN) -> DataFrame:
    """Motion within chunks (video_id, camera_ref, start_epoch, duration_seconds): events near a chunk are clustered, then set against its start, padded, cut to it and merged.

    Events reach a chunk from ``margin`` seconds around it. A chunk without a span is one whole span.
    """
    named = chunks.select("video_id", F.col("camera_ref").alias("_camera"), F.col("start_epoch").alias("_start"), "duration_seconds")
    near = (F.col("camera_ref") == F.col("_camera")) & (F.col("end_epoch") >= F.col("_start") - margin) & (F.col("start_epoch") <= F.col("_start") + F.col("duration_seconds") + margin)
    met = episodes.join(named, near).select("video_id", "duration_seconds", (F.col("start_epoch") - F.col("_start")).alias("start_time"), (F.col("end_epoch") - F.col("_start")).alias("end_time"))
    grouped = wide_islands(met, ["video_id"], "start_time", "end_time", CLUSTER_GAP).groupBy("video_id", "duration_seconds", "island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("island")
    low, high = F.greatest(F.lit(0.0), F.col("start_time") - pad), F.least(F.col("duration_seconds"), F.col("end_time") + pad)
    wide = grouped.select("video_id", low.alias("start_time"), high.alias("end_time")).filter(F.col("end_time") - F.col("start_time") >= least)
    merged = wide_islands(wide, ["video_id"], "start_time", "end_time", 0.0).groupBy("video_id", "island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("island")
    whole = chunks.join(merged.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(0.0).alias("start_time"), F.col("duration_seconds").alias("end_time"))
    return merged.union(whole)


def _within(points: DataFrame, spans: DataFrame, on: str | list[str]) -> DataFrame:
    return points.join(spans, on).filter(F.col("timestamp").between(F.col("start_time"), F.col("end_time")))


def temporal_join(points: DataFrame, spans: DataFrame, on: str = "video_id") -> DataFrame:
    """Points (timestamp) within spans (start_time, end_time) of the same key, both ends included.

    Both sides also meet on time buckets, whose width goes by the length of the span, so a hot key is dealt over many tasks and pairs tried grow with pairs found,
    however unlike the spans' lengths are: a span lies in SPREAD + 1 buckets at most, a point in one for each width there is. Only spans that are open or beyond
    FAR meet points by their key alone.
    """
    start, end, at = (F.col(c).cast("double") for c in ("start_time", "end_time", "timestamp"))
    near = (F.abs(start) < FAR) & (F.abs(end) < FAR)
    exponent = F.greatest(F.lit(0), F.floor(F.log(F.greatest(end - start, F.lit(1.0))) / math.log(SPREAD)).cast("int"))
    kept = spans.filter("start_time <= end_time").withColumn("_width", F.when(near, F.pow(F.lit(float(SPREAD)), exponent)).otherwise(0.0))
    widths = kept.select("_width").distinct()  # about 25 at most
    cut = lambda c: F.when(F.col("_width") > 0, F.floor(c / F.when(F.col("_width") > 0, F.col("_width")))).otherwise(0)
    wide = kept.withColumn("_bucket", F.explode(F.sequence(cut(start), cut(end))))
    placed = points.filter("timestamp IS NOT NULL").join(F.broadcast(widths), (F.col("_width") == 0) | (F.abs(at) < FAR)).withColumn("_bucket", cut(at))
    return _within(placed, wide, [*([on] if isinstance(on, str) else on), "_width", "_bucket"]).drop("_width", "_bucket")


def bucketed_temporal_join(points: DataFrame, spans: DataFrame, on: str, width: float) -> DataFrame:
    """J3 with buckets of one given width, for spans that are about as long."""
    cut = lambda c: F.floor(c / width).cast("bigint")
    wide = spans.withColumn("_bucket", F.explode(F.sequence(cut(F.col("start_time")), cut(F.col("end_time")))))
    return _within(points.withColumn("_bucket", cut(F.col("timestamp"))), wide, on if isinstance(on, list) else [on, "_bucket"]).drop("_bucket")


def assign_speakers(lines: DataFrame, turns: DataFrame) -> DataFrame:
    """Lines (video_id, line_id, start_time, end_time, speaker) take the speaker of the turn that overlaps them most.

    The first of equal turns (by start, then end) wins; a line without overlap keeps its speaker.
    """
    t = turns.select("video_id", F.col("start_time").alias("t0"), F.col("end_time").alias("t1"), F.col("speaker").alias("turn_speaker"))
    shared = overlap(F.col("start_time"), F.col("end_time"), F.col("t0"), F.col("t1"))
    met = lines.join(t, "video_id").withColumn("_shared", shared).filter("_shared > 0")
    best = met.groupBy("video_id", "line_id").agg(F.min_by("turn_speaker", F.struct((-F.col("_shared")).alias("less"), "t0", "t1")).alias("turn_speaker"))
    return lines.join(best, ["video_id", "line_id"], "left").withColumn("speaker", F.coalesce("turn_speaker", "speaker")).drop("turn_speaker")


def wallclock_to_chunks(videos: DataFrame, t0: float, t1: float) -> DataFrame:
    """What of each placed video falls in [t0, t1], relative to its start; an unknown duration reaches to t1."""
    start, end = F.col("start_epoch"), F.when(F.col("duration_seconds").isNull(), F.lit(float(t1))).otherwise(F.col("start_epoch") + F.col("duration_seconds"))
    placed = videos.filter(start.isNotNull() & (end >= t0) & (start <= t1))
    return placed.select("video_id", (F.greatest(start, F.lit(float(t0))) - start).alias("rel_start"), (F.least(end, F.lit(float(t1))) - start).alias("rel_end"), "start_epoch")


def split_windows(spans: DataFrame, most: int = MAX_WINDOW) -> DataFrame:
    """Spans (start_epoch, end_epoch) cut into windows of at most ``most`` seconds, back to back."""
    n = F.ceil((F.col("end_epoch") - F.col("start_epoch")) / most).cast("int")
    cut = spans.filter("end_epoch > start_epoch").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("start_epoch") + F.col("part") * most
    return cut.withColumns({"window_start": start, "window_end": F.least(F.col("end_epoch"), start + most)})


def within_budget(df: DataFrame, by: str, order: Sequence[str], total: int, groups: int) -> DataFrame:
    """The first rows of each group, an equal share of the total, at least one."""
    share = max(1, total // max(1, groups))
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rank") <= share).drop("_rank")


def motion_level(samples: DataFrame) -> DataFrame:
    """Largest difference between neighbouring samples (video_id, segment_index, sample, value) and whether that is motion."""
    seq = Window.partitionBy("video_id", "segment_index").orderBy("sample")
    step = F.abs(F.col("value") - F.lag("value").over(seq))
    return samples.withColumn("_step", step).groupBy("video_id", "segment_index").agg(F.coalesce(F.max("_step"), F.lit(0.0)).alias("level")).withColumn("action_class", F.when(F.col("level") > 0.01, "motion").otherwise("static"))
