"""Catching up: windows to pull for each camera behind its watermark, as one plan over all cameras, and as a stream."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timelens.constants import CLUSTER_GAP, MAX_WINDOW
from timelens.functions.timeparse import window_uri
from timelens.operators.catalog import advance_watermarks
from timelens.operators.intervals import split_windows, wide_islands
from timelens.session import checkpoint

log = logging.getLogger(__name__)
#: Parts into which cameras are split to find those whose ingest fails.
MOST_BUCKETS = 1 << 20


@dataclass(frozen=True)
class WatchRules:
    lookback: float = 3600.0
    settle: float = 120.0
    max_windows: int = 50
    gap: float = CLUSTER_GAP
    open_max_age: float = 600.0


@dataclass
class CatchUp:
    """windows to ingest, in order; cameras with their next watermark, and whether their budget cut them short."""

    windows: DataFrame
    cameras: DataFrame


def pending_events(cameras: DataFrame, events: DataFrame, now: float, rules: WatchRules) -> DataFrame:
    """ST1-ST5: events from each camera's watermark to the horizon, with ``deferred`` for those that aren't settled.

    Events that start before the watermark were covered by the pass that set it. An open event older than open_max_age has lost its end and
    becomes one window. All this is decided on raw events, before they are clustered.
    """
    horizon = now - rules.settle
    behind = cameras.select("camera_id", "source_ref", F.coalesce("last_processed_epoch", F.lit(now - rules.lookback)).alias("watermark")).filter(F.col("watermark") < horizon)
    near = events.filter(F.col("start_epoch") <= horizon).select("camera_ref", "start_epoch", "end_epoch", F.coalesce("open", F.lit(False)).alias("open"))
    met = behind.join(near, F.col("source_ref") == F.col("camera_ref")).filter(F.col("start_epoch") >= F.col("watermark"))
    instant = F.col("open") | (F.col("end_epoch") <= F.col("start_epoch"))
    lost = instant & (F.lit(horizon) - F.col("start_epoch") > rules.open_max_age)
    flagged = met.withColumns({"_lost": lost, "deferred": ~lost & (instant | (F.col("end_epoch") >= horizon))})
    return flagged.withColumn("end_epoch", F.when(F.col("_lost"), F.least(F.col("start_epoch") + MAX_WINDOW, F.lit(horizon))).otherwise(F.col("end_epoch"))).drop("_lost", "open")


def catch_up(cameras: DataFrame, events: DataFrame, now: float, rules: WatchRules = WatchRules(), ingested: DataFrame | None = None, failed: DataFrame | None = None) -> CatchUp:
    """A pass over all cameras (camera_id, source_ref, last_processed_epoch).

    Settled events are clustered (ST6) and cut into windows (ST7). A window whose key is in ``ingested`` is free (ST10); a camera's
    share of max_windows pays for the others (ST8), and its first window in ``failed`` ends its pass (ST11). The watermark moves over
    whole episodes, never past the first deferred start; if nothing was cut short, to the horizon (ST9).
    """
    spark = cameras.sparkSession
    horizon = now - rules.settle
    keys = spark.createDataFrame([], "uri string")
    share = F.greatest(F.lit(1), F.floor(F.lit(rules.max_windows) / F.greatest(F.lit(1), F.col("n_cameras"))))
    n = cameras.agg(F.count("*").alias("n_cameras"))
    pending = pending_events(cameras, events, now, rules)
    deferred = pending.filter("deferred").groupBy("camera_id").agg(F.min("start_epoch").alias("deferred_start"))
    settled = wide_islands(pending.filter("NOT deferred"), ["camera_id"], "start_epoch", "end_epoch", rules.gap)
    episodes = settled.groupBy("camera_id", "source_ref", "watermark", "island").agg(F.min("start_epoch").alias("start_epoch"), F.max("end_epoch").alias("end_epoch"))
    windows = split_windows(episodes).withColumn("uri", window_uri(F.col("source_ref"), F.col("window_start"), F.col("window_end")))
    windows = windows.join((keys if ingested is None else ingested.select("uri")).distinct().withColumn("free", F.lit(True)), "uri", "left")
    windows = windows.join((keys if failed is None else failed.select("uri")).distinct().withColumn("fails", F.lit(True)), "uri", "left")
    windows = windows.withColumns({"free": F.coalesce("free", F.lit(False)), "fails": F.coalesce("fails", F.lit(False))})
    # the number of cameras is one row that every window needs
    windows = windows.join(F.broadcast(n)).withColumn("share", share)
    seq = Window.partitionBy("camera_id").orderBy("start_epoch", "window_start")
    earlier = seq.rowsBetween(Window.unboundedPreceding, -1)
    paid, broke = F.coalesce(F.sum((~F.col("free") & ~F.col("fails")).cast("int")).over(earlier), F.lit(0)), F.coalesce(F.max("fails").over(earlier), F.lit(False))
    placed = windows.withColumns({"reached": (paid < F.col("share")) & ~broke, "stopped": broke})
    by_episode = placed.groupBy("camera_id", "island", "watermark", "end_epoch").agg(F.every(F.col("reached") & ~F.col("fails")).alias("whole"), F.bool_or(~F.col("reached") & ~F.col("stopped")).alias("cut"))
    done = by_episode.groupBy("camera_id").agg(F.max(F.when(F.col("whole"), F.col("end_epoch"))).alias("_to"), F.every("whole").alias("_all"), F.bool_or("cut").alias("truncated"))
    behind = cameras.select("camera_id", F.coalesce("last_processed_epoch", F.lit(now - rules.lookback)).alias("watermark")).filter(F.col("watermark") < horizon)
    state = behind.join(done, "camera_id", "left").join(deferred, "camera_id", "left")
    target = F.least(F.when(F.coalesce("_all", F.lit(True)), F.lit(horizon)).otherwise(F.col("_to")), F.col("deferred_start"))
    target = F.when(F.coalesce("_all", F.lit(True)) | F.col("_to").isNotNull(), target)
    moves = state.filter(target > F.col("watermark")).select("camera_id", target.alias("epoch"))
    moved = advance_watermarks(cameras, moves).join(state.select("camera_id", F.coalesce("truncated", F.lit(False)).alias("truncated"), "deferred_start"), "camera_id", "left")
    chosen = placed.filter("reached AND NOT free").select("camera_id", "uri", "window_start", "window_end", "fails")
    return CatchUp(chosen, moved.withColumn("truncated", F.coalesce("truncated", F.lit(False))))


class WatchStream:
    """A stream of events that catches up in each micro-batch.

    The state, watermarks and events not yet passed, is a versioned folder of Parquet: a batch that is replayed starts from the version before
    it, with the time that it was first run at, and writes the same one again; ingested windows are known by their URI, so delivery is at
    least once with no double work. A batch adds its own ingested windows only, and versions that no replay needs are removed.
    """

    def __init__(self, spark: SparkSession, state_path: str, cameras: DataFrame, ingest: Callable[[DataFrame], DataFrame], now: Callable[[], float], rules: WatchRules = WatchRules()):
        self.spark, self.path, self.first, self.ingest, self.now, self.rules = spark, state_path, cameras, ingest, now, rules

    def _load(self, name: str, batch: int, empty: DataFrame) -> DataFrame:
        return empty if batch < 0 else self.spark.read.parquet(f"{self.path}/{name}/v={batch}")

    def _clock(self, batch: int) -> float:
        """The time of a batch, the same when it is replayed."""
        path = f"{self.path}/clock/v={batch}"
        try:
            return self.spark.read.schema("now double").parquet(path).first()["now"]
        except (AnalysisException, TypeError):
            now = float(self.now())
            self.spark.createDataFrame([(now,)], "now double").write.mode("overwrite").parquet(path)
            return now

    def _ingested(self, batch: int) -> DataFrame:
        """Windows that earlier batches ingested."""
        if batch <= 0:
            return self.spark.createDataFrame([], "uri string")
        return self.spark.read.schema("uri string, v long").parquet(f"{self.path}/ingested").filter(F.col("v") < batch).select("uri")

    def _drop(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def _ingest(self, windows: DataFrame, buckets: int = 1, bucket: int = 0) -> DataFrame:
        """ST11: the windows (uri) that were ingested. Where ingest raises, its cameras are tried in halves, down to those that fail by themselves;
        such a camera's windows are tried one after the other, up to the first that fails.

        That camera's watermark is held there; the others go on. Windows that were ingested before their half failed are offered again and
        known by their URI to whoever ingests them.
        """
        mine = windows if buckets == 1 else windows.filter(F.pmod(F.xxhash64("camera_id"), F.lit(buckets)) == bucket)
        try:
            return checkpoint(self.ingest(mine).select("uri").distinct())
        except Exception:  # noqa: BLE001
            if mine.select("camera_id").distinct().limit(2).count() > 1 and buckets < MOST_BUCKETS:
                # a hash that is bucket modulo buckets is one of two modulo twice as many
                return self._ingest(windows, 2 * buckets, bucket).union(self._ingest(windows, 2 * buckets, bucket + buckets))
        done = []
        for row in mine.orderBy("window_start").collect():  # one camera's share of max_windows
            one = self.spark.createDataFrame([row], windows.schema)
            try:
                done += self.ingest(one).select("uri").collect()
            except Exception:  # noqa: BLE001
                log.warning("ingest failed for %s; the watermark of camera %s is held and the next pass tries again", row["uri"], row["camera_id"], exc_info=True)
                break
        return self.spark.createDataFrame(done, "uri string")

    def process(self, events: DataFrame, batch: int) -> None:
        before = batch - 1
        cameras = self._load("cameras", before, self.first.select("camera_id", "source_ref", F.col("last_processed_epoch").cast("double").alias("last_processed_epoch")))
        is_open = F.coalesce(F.col("open").cast("boolean"), F.lit(False)) if "open" in events.columns else F.lit(False)
        fresh = events.select("camera_ref", F.col("start_epoch").cast("double"), F.col("end_epoch").cast("double"), is_open.alias("open"))
        kept = self._load("events", before, fresh.limit(0)).unionByName(fresh).distinct()
        known = self._ingested(batch)
        now = self._clock(batch)
        plan = catch_up(cameras, kept, now, self.rules, known)
        done = self._ingest(checkpoint(plan.windows))
        failed = plan.windows.join(done.select("uri"), "uri", "left_anti")
        result = catch_up(cameras, kept, now, self.rules, known, failed)
        save = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}/v={batch}")
        save(result.cameras.select("camera_id", "source_ref", "last_processed_epoch"), "cameras")
        save(done.select("uri").distinct(), "ingested")
        passed = result.cameras.select(F.col("source_ref").alias("camera_ref"), "last_processed_epoch")
        left = kept.join(passed, "camera_ref", "left").filter(F.col("last_processed_epoch").isNull() | (F.col("start_epoch") >= F.col("last_processed_epoch")))
        save(left.select("camera_ref", "start_epoch", "end_epoch", "open"), "events")
        # a replayed batch needs the version before it, and none older
        for name in ("cameras", "events", "clock"):
            self._drop(f"{self.path}/{name}/v={batch - 2}")

    def start(self, stream: DataFrame, location: str, interval: str | None = None):
        """Every interval, or what there is now if none is given."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", location)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def run_watch(start: Callable[[], StreamingQuery], interval: float = 60.0, stop_after: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """ST12: a pass every interval, each a query that takes what there is now and ends; gives how many passes failed.

    ``start`` starts it from its checkpoint, so a pass that fails, in starting or in running, is made good by the next one. ``stop_after`` bounds
    the passes; without it the loop goes on.
    """
    passes = failures = 0
    while True:
        query = None
        try:
            query = start()
            query.awaitTermination()
        except Exception:  # noqa: BLE001
            failures += 1
            log.warning("a pass failed; the next interval tries again", exc_info=True)
            if query is not None and query.isActive:
                query.stop()
        passes += 1
        if stop_after is not None and passes >= stop_after:
            return failures
        sleep(interval)


def session_episodes(stream: DataFrame, gap: str = "30 seconds", late: str = "120 seconds") -> DataFrame:
    """ST6 on a stream of events (camera_ref, start timestamp): sessions of each camera, final once the watermark has passed them."""
    return stream.withWatermark("start", late).groupBy(F.session_window("start", gap), "camera_ref").agg(F.count("*").alias("n_events")).select("camera_ref", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
