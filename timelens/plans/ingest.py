"""Running roles over videos: ingest, reingest, reprocessing and removal. Roles are callables from videos to rows; each is one Spark job over all videos."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelens.operators import catalog
from timelens.sources import versions

#: A role's rows (video_id and its table's columns) for videos.
Role = Callable[[DataFrame], DataFrame]
TERMINAL = ("done", "quarantined")
#: Keys of tables that are replaced by more or other than the video.
KEYS = {"videos": ("id",), "role_provenance": ("video_id", "role"), "observations": ("video_id", "prompt_key")}


@dataclass
class Outcome:
    """What was written, and which roles failed with which message."""

    written: dict[str, int] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def pending_videos(requests: DataFrame, videos: DataFrame) -> DataFrame:
    """FP18: requests (source_key) that aren't done or quarantined already."""
    over = videos.filter(F.col("ingest_status").isin(*TERMINAL)).select("source_key")
    return requests.join(over, "source_key", "left_anti")


def stamped(counts: DataFrame, videos: DataFrame, role: str, fingerprint: str, run_id: str) -> DataFrame:
    """Provenance of a role over videos, with the number of rows that each got (video_id, row_count)."""
    each = videos.select("video_id", "fps").join(counts.select("video_id", F.col("row_count").cast("int").alias("row_count")), "video_id", "left")
    return each.select("video_id", F.lit(role).alias("role"), F.lit(role).alias("model"), F.lit(fingerprint).alias("fingerprint"), "fps", F.lit(run_id).alias("run_id"), F.coalesce("row_count", F.lit(0)).alias("row_count"), F.current_timestamp().alias("produced_at"))


def run_roles(videos: DataFrame, roles: Mapping[str, tuple[str, Role]], workdir: str, fingerprints: Mapping[str, str], run_id: str, disabled: Sequence[str] = ()) -> Outcome:
    """each role's rows replace the videos' in its table (role -> (table, callable)), and its provenance is stamped.

    A role's rows are computed once, staged as a version and counted there; the commit makes them visible and lets videos that got none lose
    their old ones. A role that fails leaves its message and what was there, and the others go on: a failure is one of the write, where
    Spark's stages run. A disabled role is skipped.
    """
    out, spark = Outcome(), videos.sparkSession
    for role, (table, make) in roles.items():
        if role in disabled:
            out.skipped.append(role)
            continue
        try:
            counts = versions.adopt(spark, f"{workdir}/{table}", table, KEYS.get(table, ("video_id",))).replace(make(videos), videos)
            stamps = stamped(counts, videos, role, fingerprints.get(role, ""), run_id)
            versions.adopt(spark, f"{workdir}/role_provenance", "role_provenance", KEYS["role_provenance"]).replace(stamps)
            out.written[role] = counts.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
        except Exception as e:  # noqa: BLE001
            out.failed[role] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return out


def remove(workdir: str, gone: DataFrame, tables: Sequence[str]) -> dict[str, int]:
    """SK15: videos (video_id) go from each role table, by a commit that drops their keys; gives how many rows each table lost."""
    lost, spark = {}, gone.sparkSession
    for table in tables:
        held = versions.adopt(spark, f"{workdir}/{table}", table, KEYS.get(table, ("video_id",)))
        if not held.exists():
            continue
        column = "id" if table == "videos" else "video_id"
        mine = held.ledger().join(gone.select(F.col("video_id").alias(column)), column, "left_semi")
        lost[table] = mine.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
        held.drop(mine)
    return lost


def finished(videos: DataFrame, done: DataFrame, outcome: Outcome, required: Sequence[str], run_id: str) -> DataFrame:
    """The catalog's next content: the run's videos are done, or failed where a required role failed, with its message."""
    lost = [r for r in required if r in outcome.failed]
    error = "; ".join(f"{r}: {outcome.failed[r]}" for r in lost) or None
    changes = done.select("video_id", F.lit("failed" if lost else "done").alias("ingest_status"), F.lit(error).cast("string").alias("ingest_error"), F.lit(run_id).alias("last_ingest_run_id"))
    return catalog.patch(videos, changes, "video_id", ["ingest_status", "ingest_error", "last_ingest_run_id"], keep_on_null=False)


def missing_roles(roles: Sequence[str], outcome: Outcome) -> list[str]:
    """Roles that hold nothing of a run: those that failed or were skipped."""
    gone = set(outcome.failed) | set(outcome.skipped)
    return [r for r in roles if r in gone]


def reingest(videos: DataFrame, chosen: DataFrame, roles: Mapping[str, tuple[str, Role]], workdir: str, fingerprints: Mapping[str, str], run_id: str, required: Sequence[str] = ()) -> tuple[DataFrame, Outcome]:
    """the chosen videos' rows are made anew; profile, camera and start stay as the catalog has them."""
    keep = videos.join(chosen.select("video_id"), "video_id", "left_semi")
    outcome = run_roles(keep, roles, workdir, fingerprints, run_id)
    return finished(videos, keep, outcome, required or list(roles), run_id), outcome


def reprocess(plan: DataFrame, videos: DataFrame, roles: Mapping[str, tuple[str, Role]], workdir: str, fingerprints: Mapping[str, str], run_id: str) -> dict[str, Outcome]:
    """run what a plan (video_id, roles, fps, refused) asks for, a job for each role over all videos that need it.

    Videos whose recorded rate isn't known are refused and left as they are.
    """
    wanted = plan.filter(~F.col("refused")).select("video_id", "roles", F.col("fps").alias("_fps"))
    out = {}
    for role in roles:
        mine = wanted.filter(F.array_contains("roles", role)).select("video_id", "_fps")
        some = videos.drop("fps").join(mine, "video_id").withColumnRenamed("_fps", "fps")
        if some.isEmpty():
            continue
        out[role] = run_roles(some, {role: roles[role]}, workdir, fingerprints, run_id)
    return out
