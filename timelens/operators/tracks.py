"""Detections and tracks: placement in time, counts, the tracker."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelens.constants import MIN_FRAMES, TRACK_GAP, TRACK_IOU
from timelens.functions.text import resolve_category
from timelens.operators.folds import streamed


def _number(value: object, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a number, not {type(value).__name__}")
    return float(value)


def _classes(df: DataFrame, classes: Sequence[str] | None) -> DataFrame:
    """None leaves all classes, an empty list none."""
    if classes is None:
        return df
    return df.filter(F.lower("object_class").isin(*[c.lower() for c in classes])) if classes else df.filter(F.lit(False))


def select_placed(tracks: DataFrame, videos: DataFrame, classes: Sequence[str] | None, t0: float, t1: float, cameras: Sequence[str] | None = None) -> DataFrame:
    """J1, FP9: tracks that start within [t0, t1) on the clock; videos without a start aren't placed. None restricts nothing, an empty list leaves nothing."""
    t0, t1 = _number(t0, "t0"), _number(t1, "t1")
    placed = videos.filter(F.col("start_epoch").isNotNull())
    if cameras is not None:
        placed = placed.filter(F.col("camera_id").isin(*cameras)) if cameras else placed.filter(F.lit(False))
    joined = _classes(tracks, classes).join(placed.select("video_id", "camera_id", "start_epoch"), "video_id")
    absolute = F.col("start_epoch") + F.col("first_seen")
    return joined.withColumn("absolute", absolute).filter((F.col("absolute") >= t0) & (F.col("absolute") < t1))


def window_anchoring(tracks: DataFrame, videos: DataFrame, classes: Sequence[str] | None, min_frames: int = 1) -> DataFrame:
    """One row: videos that are done and placed, and matching tracks on videos that aren't placed."""
    done = videos.filter("ingest_status = 'done'")
    anchored = done.agg(F.count("start_epoch").alias("anchored_videos"))
    loose = _classes(tracks, classes).filter(F.col("frame_count") >= min_frames).join(done.filter("start_epoch IS NULL").select("video_id"), "video_id", "left_semi")
    # two single rows
    return anchored.withColumn("_k", F.lit(1)).join(loose.agg(F.count("*").alias("unplaced_tracks")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def summarize(detections: DataFrame, classes: Sequence[str] | None) -> DataFrame:
    """A1: frames in which each class appears, by video: distinct times, not detections; the case of classes is kept."""
    return _classes(detections, classes).groupBy("video_id", "object_class").agg(F.count_distinct("timestamp").alias("frames"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.max("confidence").alias("confidence"))


def distinct_counts(tracks: DataFrame, classes: Sequence[str] | None, min_frames: int = 1) -> DataFrame:
    """A2: tracks of at least min_frames frames, by video and class."""
    return _classes(tracks, classes).filter(F.col("frame_count") >= min_frames).groupBy("video_id", "object_class").agg(F.count("*").alias("distinct"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def query_objects(detections: DataFrame, text: str) -> DataFrame:
    """A3: summarize for the classes that a text names."""
    return summarize(detections, resolve_category(text)[0])


def count_objects_of(tracks: DataFrame, text: str, min_frames: int = MIN_FRAMES) -> DataFrame:
    return distinct_counts(tracks, resolve_category(text)[0], min_frames)


def existing_classes(detections: DataFrame) -> DataFrame:
    """A11."""
    return detections.select(F.lower("object_class").alias("object_class")).distinct()


def known_among(detections: DataFrame, text: str) -> DataFrame:
    """Classes that are detected and that a text names as they are."""
    return existing_classes(detections).filter(F.col("object_class").isin(*dict.fromkeys(text.lower().split())))


def best_detections(detections: DataFrame) -> DataFrame:
    """Each track's detection of most confidence, the first of equal ones."""
    best = F.min_by(F.struct("timestamp", "confidence"), F.struct((-F.col("confidence")).alias("less"), "timestamp"))
    return detections.groupBy("video_id", "track_id").agg(best.alias("best")).select("video_id", "track_id", "best.timestamp", "best.confidence")


def crop_matches(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """Tracks with the detections at the same rounded place: time to 3 digits, box to 5."""
    boxes = ("bbox_x", "bbox_y", "bbox_w", "bbox_h")
    keyed = lambda d: d.withColumns({"_t": F.round("timestamp", 3), **{f"_{b}": F.round(b, 5) for b in boxes}})
    on = ["video_id", "_t", *[f"_{b}" for b in boxes]]
    return keyed(tracks).join(keyed(detections).select(*on, F.col("id").alias("detection_id")), on).drop("_t", *[f"_{b}" for b in boxes])


class _Track:
    __slots__ = ("box", "cls", "confidence", "first", "frames", "last", "number")

    def __init__(self, number: int, cls: str, box: tuple, ts: float, confidence: float):
        self.number, self.cls, self.box, self.first, self.last, self.confidence, self.frames = number, cls, box, ts, ts, confidence, 1


def _iou(a: tuple, b: tuple) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


class Tracker:
    """Greedy association, frame by frame; holds the tracks that can still go on.

    Candidates are tracks that were alive before the frame; surer detections choose first; the last of equally
    overlapping tracks is taken.
    """

    def __init__(self, threshold: float = TRACK_IOU, gap: float = TRACK_GAP):
        self.threshold, self.gap, self.live, self.made = threshold, gap, [], 0

    def ended_before(self, ts: float) -> list[_Track]:
        """Drops and returns the tracks that a frame at ts can't continue."""
        over = [t for t in self.live if ts - t.last > self.gap]
        self.live = [t for t in self.live if ts - t.last <= self.gap]
        return over

    def frame(self, ts: float, rows: list[tuple]) -> list[_Track]:
        """Tracks of the frame's rows (class, confidence, box), which are sorted by falling confidence."""
        free, fresh, out = list(self.live), [], []
        for cls, confidence, box in rows:
            match, best = None, self.threshold
            for t in free:
                if t.cls == cls and (score := _iou(box, t.box)) >= best:
                    match, best = t, score
            if match is None:
                match = _Track(self.made, cls, box, ts, confidence)
                self.made += 1
                fresh.append(match)
            else:
                free.remove(match)
                match.frames += match.last != ts
                match.box, match.last, match.confidence = box, ts, max(match.confidence, confidence)
            out.append(match)
        self.live += fresh
        return out


def associate(detections: list[tuple], threshold: float = TRACK_IOU, gap: float = TRACK_GAP) -> tuple[list[int], list[_Track]]:
    """Association of (timestamp, class, confidence, box) rows: a track's number for each, and the tracks."""
    order = sorted(range(len(detections)), key=lambda i: (detections[i][0], -detections[i][2]))
    tracker, given, found = Tracker(threshold, gap), [0] * len(detections), {}
    for ts, part in itertools.groupby(order, key=lambda i: detections[i][0]):
        frame = list(part)
        tracker.ended_before(ts)
        for i, t in zip(frame, tracker.frame(ts, [detections[i][1:] for i in frame]), strict=True):
            given[i] = t.number
            found[t.number] = t
    return given, [found[n] for n in sorted(found)]


TRACKS = "video_id string, track_id string, object_class string, track_confidence double, first_seen double, last_seen double, frame_count int"


def track(detections: DataFrame, threshold: float = TRACK_IOU, gap: float = TRACK_GAP) -> DataFrame:
    """UD6: tracks of each video, from (video_id, timestamp, object_class, confidence, bbox_x, bbox_y, bbox_w, bbox_h).

    A fold over a video's frames, streamed in order; ids are hashes of video and number, so that runs agree.
    """
    values = ["timestamp", "object_class", "confidence", "bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    rows = detections.withColumns({"video_id": F.col("video_id").cast("string"), "_less": -F.col("confidence")})

    def tracks_of(key: tuple, found: Iterable[tuple]) -> Iterator[tuple]:
        tracker = Tracker(threshold, gap)

        def shown(ended: list[_Track]) -> Iterator[tuple]:
            for t in ended:
                yield *key, f"{key[0]}#{t.number}", t.cls, t.confidence, t.first, t.last, t.frames

        for ts, part in itertools.groupby(found, key=lambda r: r[0]):
            yield from shown(tracker.ended_before(ts))
            tracker.frame(ts, [(r[1], r[2], r[3:]) for r in part])
        yield from shown(tracker.live)

    return streamed(rows, ["video_id"], ["timestamp", "_less", "object_class", "bbox_x", "bbox_y", "bbox_w", "bbox_h"], values, tracks_of, TRACKS).withColumn("track_id", F.sha1("track_id"))
