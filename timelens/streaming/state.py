"""Keyed state: live tracks (ST13) and open episodes (ST5) of streams, with timers for what goes on or ends without a further row.

Rows may come in any order within the stream's watermark: each key holds them until the watermark has passed them, then takes them in order. Results are
those of the batch operators, whatever the batches were. State is in RocksDB; a key holds its rows of the watermark's delay, not its
history.
"""

from __future__ import annotations

import pickle
from abc import abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from timelens.constants import MAX_WINDOW, TRACK_GAP, TRACK_IOU
from timelens.operators.tracks import Tracker

OPEN_MAX_AGE = 600.0
#: Rows wait in buckets of so many milliseconds, each read and written as one value.
WAIT = 1000


class InOrder(StatefulProcessor):
    """Hands a key's rows, as tuples with their time in milliseconds first, to ``take`` in order, and tells ``wake`` how far time has come."""

    columns: tuple[str, ...]
    out: tuple[str, ...]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long", "rows binary")
        self.kept = handle.getValueState("kept", "state binary")

    @abstractmethod
    def fresh(self) -> object: ...

    @abstractmethod
    def take(self, key: tuple, state: object, rows: list[tuple]) -> Iterator[tuple]:
        """Rows of one time."""

    @abstractmethod
    def wake(self, key: tuple, state: object, now: int) -> Iterator[tuple]:
        """What has ended by now without a row."""

    @abstractmethod
    def next_wake(self, state: object) -> int | None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            df = df.assign(_ms=df["at"].astype("datetime64[ms]").astype("int64"))
            for bucket, part in df.groupby(df["_ms"] // WAIT):
                at = (int(bucket),)
                held = pickle.loads(self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else []
                held += [tuple(None if pd.isna(v) else v for v in r) for r in part[["_ms", *self.columns]].itertuples(index=False, name=None)]
                self.waiting.updateValue(at, (pickle.dumps(held),))
                self.handle.registerTimer((int(bucket) + 1) * WAIT)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        state = pickle.loads(self.kept.get()[0]) if self.kept.exists() else self.fresh()
        out, rows = [], []
        for (bucket,) in sorted(k for k in self.waiting.keys() if (k[0] + 1) * WAIT <= now):
            rows += pickle.loads(self.waiting.getValue((bucket,))[0])
            self.waiting.removeKey((bucket,))
        rows.sort(key=lambda r: tuple((v is not None, v) for v in r))
        at = 0
        while at < len(rows):
            end = next((i for i in range(at, len(rows)) if rows[i][0] != rows[at][0]), len(rows))
            out += self.wake(key, state, rows[at][0])
            out += self.take(key, state, rows[at:end])
            at = end
        out += self.wake(key, state, now)
        self.kept.update((pickle.dumps(state),))
        if (later := self.next_wake(state)) is not None:
            self.handle.registerTimer(max(later, now + 1))
        yield pd.DataFrame(out, columns=list(self.out))

    def close(self) -> None:
        pass


class LiveTracks(InOrder):
    columns = ("less", "object_class", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "timestamp")
    out = ("video_id", "track_id", "object_class", "track_confidence", "first_seen", "last_seen", "frame_count")

    def __init__(self, threshold: float, gap: float) -> None:
        self.threshold, self.gap = threshold, gap

    def fresh(self) -> dict:
        return {"tracker": Tracker(self.threshold, self.gap), "offset": None}

    def take(self, key, state, rows):
        ts = rows[0][-1]
        state["offset"] = rows[0][0] - ts * 1000  # where the clip's own time starts
        ended = state["tracker"].ended_before(ts)
        state["tracker"].frame(ts, [(r[2], -r[1], r[3:7]) for r in rows])
        return self.shown(key, ended)

    def wake(self, key, state, now):
        # a frame at this very time may still go on with a track
        return [] if state["offset"] is None else self.shown(key, state["tracker"].ended_before((now - state["offset"]) / 1000))

    def next_wake(self, state):
        last = min((t.last for t in state["tracker"].live), default=None)
        return None if last is None else int(state["offset"] + (last + self.gap) * 1000) + 1

    def shown(self, key, ended):
        return [(key[0], f"{key[0]}#{t.number}", t.cls, t.confidence, t.first, t.last, t.frames) for t in ended]


def live_tracks(detections: DataFrame, threshold: float = TRACK_IOU, gap: float = TRACK_GAP) -> DataFrame:
    """ST13, UD6: tracks.track on a stream with a watermark over ``at``, when a detection was seen: a track is put out once no frame can go on with it.

    at is a clip's start and the detection's timestamp in it.
    """
    rows = detections.select(F.col("video_id").cast("string").alias("video_id"), "at", "timestamp", (-F.col("confidence")).alias("less"), "object_class", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
    schema = "video_id string, track_id string, object_class string, track_confidence double, first_seen double, last_seen double, frame_count int"
    found = rows.groupBy("video_id").transformWithStateInPandas(statefulProcessor=LiveTracks(threshold, gap), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.withColumn("track_id", F.sha1("track_id"))


class OpenEpisodes(InOrder):
    columns = ("seq", "start_epoch", "end_epoch")
    out = ("channel", "start_epoch", "end_epoch", "open", "lost")

    def __init__(self, most: float) -> None:
        self.most = most

    def fresh(self) -> dict:
        return {"start": None, "since": None}

    def take(self, key, state, rows):
        for at, _, start, end in rows:
            if start is not None and end is not None:
                yield key[0], start, end, False, False
            elif start is not None:
                if state["start"] is not None:  # its end was lost
                    yield key[0], state["start"], state["start"], True, False
                state["start"], state["since"] = start, at
            elif end is not None:
                yield key[0], end if state["start"] is None else state["start"], end, False, False
                state["start"] = state["since"] = None

    def wake(self, key, state, now):
        if state["start"] is not None and now > state["since"] + self.most * 1000:
            start, state["start"], state["since"] = state["start"], None, None
            yield key[0], start, start + MAX_WINDOW, False, True

    def next_wake(self, state):
        return None if state["start"] is None else int(state["since"] + self.most * 1000) + 1


def live_episodes(markers: DataFrame, most: float = OPEN_MAX_AGE) -> DataFrame:
    """ST5, I5: intervals.pair_markers on a stream with a watermark over ``at``: channel, start_epoch, end_epoch, open, lost.

    markers: channel, seq, start_epoch, end_epoch and at, when they were logged. An episode that is still open ``most`` seconds after its start has
    lost its end: it is put out as one window of MAX_WINDOW seconds, by a timer, so that nothing waits for it.
    """
    rows = markers.select(F.col("channel").cast("string").alias("channel"), "at", F.col("seq").cast("long").alias("seq"), F.col("start_epoch").cast("double").alias("start_epoch"), F.col("end_epoch").cast("double").alias("end_epoch"))
    schema = "channel string, start_epoch double, end_epoch double, open boolean, lost boolean"
    return rows.groupBy("channel").transformWithStateInPandas(statefulProcessor=OpenEpisodes(most), outputStructType=schema, outputMode="Append", timeMode="EventTime")
