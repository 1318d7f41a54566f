"""V1: whether a delivered clip is what was asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelens.functions.image import dhash
from timelens.session import checkpoint

MAX_DISTANCE, CLOCK_TOLERANCE, LEAST_KEPT = 20, 5.0, 1.0
HEAD_FRAMES = 8


def _head(signals: DataFrame, foreign, name: str) -> DataFrame:
    """By clip: the time of the first good signal after the last foreign one, and whether there is a foreign one."""
    last = F.max(F.when(foreign, F.col("t"))).over(Window.partitionBy("clip_id"))
    return signals.withColumn("_last", last).groupBy("clip_id").agg(F.max("_last").alias(f"{name}_last"), F.min(F.when(F.col("t") > F.col("_last"), F.col("t"))).alias(f"{name}_trim"))


def verify_delivery(clips: DataFrame, head: DataFrame, clock: DataFrame, profiles: Sequence[tuple[int, int, int | None]] | None) -> DataFrame:
    """clips (clip_id, start_epoch, window_len, width, height, fps), head (clip_id, t, distance), clock (clip_id, t, observed_epoch).

    A stream of another profile is refused, whole. Foreign frames at the head, by hash or by clock, are trimmed up to the first good one
    after the last of them; without one, or with less than LEAST_KEPT left, the clip is refused.
    """
    fits = F.lit(True)
    if profiles is not None:
        fits = F.lit(False)
        for w, h, fps in profiles:
            rate = F.lit(True) if fps is None else F.col("fps").isNull() | (F.col("fps") == fps)
            fits = fits | ((F.col("width") == w) & (F.col("height") == h) & rate)
        fits = F.col("width").isNull() | fits
    starts = clips.select("clip_id", "start_epoch")
    skew = F.abs(F.col("observed_epoch") - (F.col("start_epoch") + F.col("t")))
    a = _head(head, F.col("distance") > MAX_DISTANCE, "head")
    b = _head(clock.join(starts, "clip_id"), skew > CLOCK_TOLERANCE, "clock")
    joined = clips.join(a, "clip_id", "left").join(b, "clip_id", "left")
    trim = F.greatest(F.coalesce("head_trim", F.lit(0.0)), F.coalesce("clock_trim", F.lit(0.0)))
    lost = (F.col("head_last").isNotNull() & F.col("head_trim").isNull()) | (F.col("clock_last").isNotNull() & F.col("clock_trim").isNull())
    action = F.when(~fits, "reject").when(lost, "reject").when(trim <= 0, "accept").when(F.col("window_len") - trim < LEAST_KEPT, "reject").otherwise("trim")
    return joined.select("clip_id", action.alias("action"), F.when(action == "trim", trim).otherwise(0.0).alias("trim_before"))


def hashes(frames: DataFrame, size: int = 8) -> DataFrame:
    """clip_id, frame_index, t and the difference hash of each frame (grid: grey values, as image.dhash takes them for ``size``)."""
    return frames.select("clip_id", "frame_index", "t", dhash(F.col("grid"), size).alias("hash"))


def head_signals(clips: DataFrame, frames: DataFrame, size: int = 8) -> DataFrame:
    """UD15: how far each of a clip's first HEAD_FRAMES frames is from its body: clip_id, t, distance (differing bits of difference hashes).

    The body is the frame at the middle of what was decoded (clips: clip_id, duration; else window_len), by which a head of another camera
    stands out without any reference for the channel. frames: clip_id, frame_index, t, grid. Hashes are made before frames meet, so a number a frame
    is shuffled, not pixels.
    """
    return _distances(clips, hashes(frames, size))


def _distances(clips: DataFrame, hashed: DataFrame) -> DataFrame:
    length = F.coalesce("duration", "window_len")
    at = F.least(F.greatest(length / 2, F.lit(0.0)), F.greatest(length - 0.1, F.lit(0.0)))
    placed = hashed.join(clips.select("clip_id", at.alias("_at")), "clip_id")
    body = F.min_by("hash", F.struct(F.abs(F.col("t") - F.col("_at")), "frame_index")).over(Window.partitionBy("clip_id"))
    head = placed.withColumns({"_body": body, "_n": F.row_number().over(Window.partitionBy("clip_id").orderBy("frame_index"))}).filter(F.col("_n") <= HEAD_FRAMES)
    return head.select("clip_id", "t", F.bit_count(F.col("hash").bitwiseXOR(F.col("_body"))).cast("bigint").alias("distance"))


def observed(clips: DataFrame) -> DataFrame:
    """UD15: clips with width, height and fps read from their metadata (resolution ``WxH``, rate); null where it says nothing."""
    part = lambda i: F.nullif(F.regexp_extract("resolution", r"^(\d+)[xX](\d+)$", i), F.lit("")).cast("int")
    return clips.withColumns({"width": part(1), "height": part(2), "fps": F.when(F.col("rate") != 0, F.bround("rate").cast("int"))})


def verified_clips(clips: DataFrame, frames: DataFrame, clock: DataFrame, profiles: Sequence[tuple[int, int, int | None]] | None, size: int = 8) -> DataFrame:
    """UD15, V1: from frames to verdicts: clip_id, action (accept, trim, reject), trim_before, start_epoch (of what is kept).

    A trim is checked again on what it leaves: if that isn't accepted, the clip is refused. Clips, hashes and first verdicts are made once and kept in the
    shared folder: they are asked for in several places, and one plan of all of it sorts in more places than a task has memory for.
    """
    known, hashed = checkpoint(observed(clips)), checkpoint(hashes(frames, size))
    first = checkpoint(verify_delivery(known, _distances(known, hashed), clock, profiles))
    cut = first.filter("action = 'trim'").select("clip_id", F.col("trim_before").alias("_cut"))
    rest = known.join(cut, "clip_id").withColumns({"start_epoch": F.col("start_epoch") + F.col("_cut"), "window_len": F.greatest(F.col("window_len") - F.col("_cut"), F.lit(0.0)), "duration": F.col("duration") - F.col("_cut")}).drop("_cut")
    later = lambda df: df.join(cut, "clip_id").filter(F.col("t") >= F.col("_cut")).withColumn("t", F.col("t") - F.col("_cut")).drop("_cut")
    again = verify_delivery(rest, _distances(rest, later(hashed)), later(clock), profiles).select("clip_id", (F.col("action") == "accept").alias("_clean"))
    judged = first.join(again, "clip_id", "left").join(known.select("clip_id", "start_epoch"), "clip_id")
    action = F.when((F.col("action") == "trim") & ~F.coalesce("_clean", F.lit(False)), "reject").otherwise(F.col("action"))
    trim = F.when(action == "trim", F.col("trim_before")).otherwise(0.0)
    return judged.select("clip_id", action.alias("action"), trim.alias("trim_before"), (F.col("start_epoch") + trim).alias("start_epoch"))
