"""Frames by metadata: which are sampled, sought or kept. Decoding itself is a slot (see roles)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelens.functions.image import MASK_PALETTE, color_mask, mask_extent
from timelens.functions.text import key16


def sampled_frames(videos: DataFrame, fps: float = 1.0) -> DataFrame:
    """SC10: frames that a sampling rate keeps, from (video_id, fps, frame_count): every max(1, round(fps / rate))-th."""
    step = F.greatest(F.lit(1), F.round(F.col("fps") / fps).cast("int"))
    index = F.explode(F.when(F.col("frame_count") > 0, F.sequence(F.lit(0), F.col("frame_count").cast("int") - 1, step)))
    return videos.select("video_id", "fps", index.alias("frame_index")).select("video_id", "frame_index", (F.col("frame_index") / F.col("fps")).alias("timestamp"))


def frame_at(timestamp: Column, fps: Column, frame_count: Column) -> Column:
    """SC11: index of the frame at a time, within the clip."""
    return F.least(F.greatest(F.round(timestamp * fps).cast("bigint"), F.lit(0)), frame_count - 1)


def keyframes_for_spans(spans: DataFrame, per_span: int) -> DataFrame:
    """SC12: evenly spaced times inside each span (start_time, end_time)."""
    at = F.explode(F.sequence(F.lit(1), F.lit(per_span)))
    return spans.withColumn("j", at).withColumn("timestamp", F.col("start_time") + F.col("j") / F.lit(float(per_span + 1)) * (F.col("end_time") - F.col("start_time")))


def first_frames(frames: DataFrame, count: int = 8) -> DataFrame:
    """SC13."""
    order = Window.partitionBy("video_id").orderBy("frame_index")
    return frames.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count).drop("_n")


def media_paths(videos: DataFrame, files: DataFrame) -> DataFrame:
    """FP21: where each video's media lies (video_id, path): its stored local_path if that is among the files (path), else the first ``media.*`` in a folder ``<key>-*`` of its own; null for none.

    files is a listing, such as the path column of a binaryFile read, which reads no contents.
    """
    bare = F.regexp_replace(F.col("path"), "^file:/*", "/")
    listed = files.select(bare.alias("path")).distinct()
    own = listed.filter(F.col("path").rlike(r"/[^/]+/media\.[^/]+$")).withColumn("_folder", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    # a folder begins with the key and a dash; keys may hold dashes, so each part that ends before one is tried
    words = F.split("_folder", "-")
    tried = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), "-"))
    first = own.filter(F.size(words) > 1).select("path", F.explode(tried).alias("_key")).groupBy("_key").agg(F.min("path").alias("_found"))
    known = videos.select("video_id", F.regexp_replace("local_path", "^file:/*", "/").alias("_stored"), key16(F.col("source_key")).alias("_key"))
    stored = known.join(listed.select(F.col("path").alias("_stored"), F.lit(True).alias("_there")), "_stored", "left")
    return stored.join(first, "_key", "left").select("video_id", F.when(F.col("_there"), F.col("_stored")).otherwise(F.col("_found")).alias("path"))


def synthetic_boxes(frames: DataFrame, boxes: list[tuple[str, float, float, float, float, float]]) -> DataFrame:
    """SC27: detections of boxes (class, x, y, w, h, drift in x for each second) on frames (video_id, timestamp)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("object_class"), *[F.lit(float(v)).alias(n) for n, v in zip(("x", "bbox_y", "bbox_w", "bbox_h", "drift"), vs, strict=True)]) for c, *vs in boxes]))
    rows = frames.select("video_id", "timestamp", each.alias("b")).select("video_id", "timestamp", "b.*")
    return rows.withColumn("bbox_x", F.col("x") + F.col("drift") * F.col("timestamp")).withColumn("confidence", F.lit(0.9)).drop("x", "drift")


def color_boxes(frames: DataFrame, classes: Sequence[str]) -> DataFrame:
    """UD5, SC14: detections of named colours on frames (video_id, timestamp, width, and channels r, g, b of 0 to 255 as arrays, row by row).

    A class that names no colour of the palette finds nothing. Each frame is judged within its row, so nothing is shuffled.
    """
    known = [c.lower() for c in classes if c.lower() in MASK_PALETTE]
    if not known:
        none = F.array().cast("array<struct<object_class:string,confidence:double,bbox_x:double,bbox_y:double,bbox_w:double,bbox_h:double>>")
        return frames.select("video_id", "timestamp", F.explode(none).alias("box")).select("video_id", "timestamp", "box.*")

    def box(c: str) -> Column:  # the mask is made once and used for all of its extents
        return F.transform(F.array(color_mask(F.col("r"), F.col("g"), F.col("b"), MASK_PALETTE[c])), lambda mask: mask_extent(mask, F.size("r"), F.col("width"), c))[0]

    found = frames.select("video_id", "timestamp", F.explode(F.filter(F.array(*map(box, known)), lambda x: x.isNotNull())).alias("box"))
    return found.select("video_id", "timestamp", "box.*")


def painted_frames(videos: DataFrame, boxes: Sequence[tuple[str, float, float, float, float, float]], width: int, height: int, fps: float, seconds: float) -> DataFrame:
    """SC27: frames with pixels: a grey ground and boxes (colour, x, y, w, h, drift in x for each second), the later ones on top."""
    times = F.explode(F.sequence(F.lit(0), F.lit(max(int(fps * seconds) - 1, 0))))
    rows = videos.select("video_id", times.alias("i")).select("video_id", (F.col("i") / fps).alias("timestamp"))

    def channel(at: int) -> Column:
        def pixel(i: Column) -> Column:
            x, y, value = (i % width + 0.5) / width, (F.floor(i / width) + 0.5) / height, F.lit(128)
            for name, bx, by, bw, bh, drift in boxes:
                left = F.lit(float(bx)) + F.lit(float(drift)) * F.col("timestamp")
                inside = (x >= left) & (x < left + float(bw)) & (y >= float(by)) & (y < float(by) + float(bh))
                value = F.when(inside, MASK_PALETTE[name][at]).otherwise(value)
            return value

        return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)

    return rows.select("video_id", "timestamp", F.lit(width).alias("width"), channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
