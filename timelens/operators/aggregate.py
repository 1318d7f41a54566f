"""Windowed counts, listings and histograms over one shared selection, with what they leave out said beside them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelens.constants import MAX_BUCKETS, MIN_FRAMES, NO_CAMERA
from timelens.functions.text import resolve_category
from timelens.functions.timeparse import TimeWindow, bucket_count, bucket_seconds, local_iso
from timelens.operators.tracks import select_placed, window_anchoring

UPPER_BOUND = "each track counts once; an object that leaves and returns, or passes several cameras, counts again"
START_MEMBERSHIP = "a track belongs to the window in which it starts"
#: Bins in which values are counted before they are ranked.
RANK_BINS = 4096
PARKED = "a still object is one track for as long as it is seen; if its track breaks it counts again"


@dataclass
class CountResult:
    """A count with how it was made. per_camera has a row for each camera."""

    category: str
    classes: list[str]
    window: TimeWindow
    per_camera: DataFrame
    entities: DataFrame
    category_source: str
    identity_mode: str
    caveats: list[str] = field(default_factory=list)

    @property
    def total(self) -> int:
        return self.entities.count()


def resolve_identities(tracks: DataFrame, mode: str = "raw", min_frames: int = MIN_FRAMES) -> tuple[DataFrame, list[str]]:
    """One entity for each track that isn't a flicker. ``instance`` isn't available and falls back, saying so."""
    if mode not in ("raw", "instance"):
        raise ValueError(f"no identity mode {mode!r}")
    kept = tracks.filter(F.col("frame_count") >= min_frames)
    return kept, ["instances can't be told apart across tracks; counted by track"] if mode == "instance" else []


def entities_for(tracks: DataFrame, videos: DataFrame, category: str, t0: float, t1: float, cameras: Sequence[str] | None = None, dedup: str = "raw", min_frames: int = MIN_FRAMES) -> tuple[DataFrame, list[str]]:
    """The selection that counts, listings and histograms share."""
    classes, _ = resolve_category(category)
    return resolve_identities(select_placed(tracks, videos, classes, t0, t1, cameras), dedup, min_frames)


def per_camera_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("camera_id", F.lit(NO_CAMERA)).alias("camera")).agg(F.count("*").alias("n"))


def count_with_total(entities: DataFrame) -> DataFrame:
    """A4's two levels at once: a row for each camera, and one with a null camera for the total."""
    return entities.select(F.coalesce("camera_id", F.lit(NO_CAMERA)).alias("camera")).rollup("camera").agg(F.count("*").alias("n"))


def count_objects(tracks: DataFrame, videos: DataFrame, category: str, window: TimeWindow, cameras: Sequence[str] | None = None, dedup: str = "raw", min_frames: int = MIN_FRAMES) -> CountResult:
    """A4: total and per camera, with caveats."""
    t0, t1 = window.epoch_bounds()
    classes, source = resolve_category(category)
    entities, notes = entities_for(tracks, videos, category, t0, t1, cameras, dedup, min_frames)
    anchoring = window_anchoring(tracks, videos, classes, min_frames).first()
    caveats = [UPPER_BOUND, START_MEMBERSHIP, PARKED, *notes]
    if not anchoring["anchored_videos"]:
        caveats.append("no video has a known start, so no window can be counted; this is not a count of zero")
    if anchoring["unplaced_tracks"]:
        caveats.append(f"{anchoring['unplaced_tracks']} matching {category!r} tracks are on videos without a known start and are left out")
    domains = footage_domains(videos).limit(2).collect()
    if len(domains) > 1:
        caveats.append("videos of several footage domains are counted together")
    return CountResult(category, classes, window, per_camera_counts(entities), entities, source, dedup, caveats)


def list_events(entities: DataFrame, limit: int = 100) -> DataFrame:
    """A5: by absolute start, then id; no rows for a limit under one."""
    return entities.orderBy("absolute", "track_id").limit(limit) if limit > 0 else entities.limit(0)


def timeline_histogram(entities: DataFrame, t0: float, t1: float, bucket: str = "1h") -> DataFrame:
    """Counts in buckets from t0, empty ones as 0."""
    width = bucket_seconds(bucket)
    n = bucket_count(t0, t1, width)
    if n > MAX_BUCKETS:
        raise ValueError(f"{n} buckets are more than {MAX_BUCKETS}")
    counted = entities.groupBy(F.floor((F.col("absolute") - F.lit(float(t0))) / width).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))
    every = entities.sparkSession.range(n).select(F.col("id").alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", (F.lit(float(t0)) + F.col("bucket") * width).alias("bucket_start"), F.coalesce("n", F.lit(0)).alias("n"))


def entity_manifest(entities: DataFrame, tz: str = "UTC") -> DataFrame:
    """a line of evidence for each entity."""
    content = F.format_string("%s on %s at %s, %d frames", "object_class", F.coalesce("camera_id", F.lit(NO_CAMERA)), local_iso(F.col("absolute"), tz), "frame_count")
    return entities.select("track_id", "video_id", "absolute", content.alias("content"))


def footage_domain(profile: str = "profile", source_type: str = "source_type"):
    """the recorded profile, else the default of the source."""
    return F.coalesce(F.col(profile), F.when(F.col(source_type) == "nvr_recorded", "security").otherwise("generic"))


def footage_domains(videos: DataFrame) -> DataFrame:
    """Domains of videos that are done."""
    return videos.filter("ingest_status = 'done'").select(footage_domain().alias("domain")).distinct()


def latency_stats(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, deviation, extremes, median and p95 (the sample at index round(0.95 n) - 1) of each group."""
    stats = samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    n = F.col("n")
    ranks = {"_lower": F.floor((n + 1) / 2), "_upper": F.floor(n / 2) + 1, "p95": F.least(n, F.greatest(F.lit(1), F.round(n * F.lit(0.95)).cast("bigint")))}
    found = ranked_values(samples.filter(F.col(value).isNotNull()), value, by, stats.filter("n > 0").select(*by, "min", "max", *[r.cast("bigint").alias(c) for c, r in ranks.items()]), list(ranks))
    keys = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    joined = stats.join(found.withColumnsRenamed({c: f"_by_{c}" for c in by}), reduce(and_, keys), "left")
    return joined.select(*by, "n", "mean", "std", "min", "max", ((F.col("_lower") + F.col("_upper")) / 2).alias("p50"), "p95")


def ranked_values(samples: DataFrame, value: str, by: Sequence[str], wanted: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """The values at some ranks (columns of wanted: by, min, max, ranks) of each group, from 1.

    Rows are counted in RANK_BINS bins of a group first; only the bins that hold a rank are counted by value. No group is sorted whole.
    """
    keyed = wanted.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("min").alias("_low"), F.col("max").alias("_high"), *[F.col(r).alias(f"_rank_{r}") for r in ranks])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    share = (F.col(value) - F.col("_low")) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    binned = samples.select(*by, value).join(keyed, on).withColumn("_bin", F.least(F.floor(share * RANK_BINS), F.lit(RANK_BINS - 1)).cast("int"))
    group = [f"_by_{c}" for c in by]
    rank_columns = [f"_rank_{r}" for r in ranks]

    def upto(counts: DataFrame, order: str, within: Sequence[str]) -> DataFrame:
        seq = Window.partitionBy(*within).orderBy(order)
        return counts.withColumn("_upto", F.sum("count").over(seq.rowsBetween(Window.unboundedPreceding, 0)))

    bins = upto(binned.groupBy(*group, *rank_columns, "_bin").count(), "_bin", group).withColumn("_before", F.col("_upto") - F.col("count"))
    holds = reduce(or_, [(F.col(r) > F.col("_before")) & (F.col(r) <= F.col("_upto")) for r in rank_columns])
    chosen = bins.filter(holds).select(*[F.col(c).alias(f"_of{c}") for c in group], F.col("_bin").alias("_in"), "_before")
    near = binned.join(chosen, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in group] + [F.col("_bin") == F.col("_in")]))
    counted = upto(near.groupBy(*group, *rank_columns, "_bin", "_before", value).count(), value, [*group, "_bin"])
    placed = counted.withColumns({"_to": F.col("_before") + F.col("_upto"), "_from": F.col("_before") + F.col("_upto") - F.col("count")})
    at = [F.max(F.when((F.col(f"_rank_{r}") > F.col("_from")) & (F.col(f"_rank_{r}") <= F.col("_to")), F.col(value))).alias(r) for r in ranks]
    return placed.groupBy(*group).agg(*at).withColumnsRenamed({f"_by_{c}": c for c in by})
