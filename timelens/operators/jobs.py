"""Durable jobs as a table: each function gives the table's next content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.operators.catalog import first_writer

OPEN = ("queued", "running")


def record(jobs: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """SK14: new jobs (id, kind, payload) are queued; an id that is there already stays as it is."""
    rows = fresh.select("id", "kind", "payload").withColumns({"state": F.lit("queued"), "attempts": F.lit(0), "created_at": now, "updated_at": now})
    return first_writer(jobs, rows, "id", ["kind", "payload"])


def update(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """SK14: state, error and result of changes (id, state, video_id, error, result) stand as given, also as null; a null video_id leaves the one there."""
    given = changes.select("id", *[F.col(c).alias(f"_{c}") for c in ("state", "video_id", "error", "result")], F.lit(True).alias("_hit"))
    joined = jobs.join(given, "id", "left")
    hit = F.col("_hit")
    new = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("state", "error", "result")}
    return joined.withColumns(new | {"video_id": F.coalesce("_video_id", "video_id"), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def bump_attempts(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """SK14: one more attempt for each of the ids."""
    joined = jobs.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return joined.withColumns({"attempts": F.when(F.col("_hit"), F.col("attempts") + 1).otherwise(F.col("attempts")), "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}).select(*jobs.columns)


def pending(jobs: DataFrame, kind: str) -> DataFrame:
    """SK14: queued and running jobs of a kind, oldest first."""
    return jobs.filter((F.col("kind") == kind) & F.col("state").isin(*OPEN)).orderBy("created_at", "id")


def requeue_running(jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """SK14: of the ids, only jobs that still run go back to the queue."""
    joined = jobs.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    back = F.col("_hit") & (F.col("state") == "running")
    return joined.withColumns({"updated_at": F.when(back, now).otherwise(F.col("updated_at")), "state": F.when(back, "queued").otherwise(F.col("state"))}).select(*jobs.columns)


def fail_pending(jobs: DataFrame, kind: str, error: str, now: Column) -> DataFrame:
    """SK14: all open jobs of a kind fail with an error."""
    hit = (F.col("kind") == kind) & F.col("state").isin(*OPEN)
    return jobs.withColumns({"error": F.when(hit, error).otherwise(F.col("error")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "state": F.when(hit, "failed").otherwise(F.col("state"))})


def parsed(text: Column) -> Column:
    """A JSON payload as a variant; a corrupt one is null, so that one bad row blocks no other."""
    return F.try_parse_json(text)
