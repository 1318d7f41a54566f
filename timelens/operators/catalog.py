"""Catalog and role tables: replacing, upserting, patching, deleting, staleness. Functions give the table's next content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_keys(table: DataFrame, rows: DataFrame, keys: Sequence[str], cleared: DataFrame | None = None) -> DataFrame:
    """SK1-SK7: all rows of the keys in ``rows`` (and in ``cleared``) replaced."""
    gone = rows.select(*keys).distinct() if cleared is None else rows.select(*keys).union(cleared.select(*keys)).distinct()
    return table.join(gone, list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def overwrite_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """SK1 on files: only the partitions that rows fall in are written anew."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def first_writer(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """SK9, SK10: rows whose key is new are added, the first of each; those there stay."""
    fresh = rows.join(table.select(key), key, "left_anti")
    once = fresh.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_row = 1").drop("_row")
    return table.unionByName(once, allowMissingColumns=True)


def advance_watermarks(cameras: DataFrame, updates: DataFrame) -> DataFrame:
    """SK11: last_processed_epoch of cameras moves to updates (camera_id, epoch), only forward; a null is passed by any."""
    latest = updates.groupBy("camera_id").agg(F.max("epoch").alias("_epoch"))
    return cameras.join(latest, "camera_id", "left").withColumn("last_processed_epoch", F.greatest("last_processed_epoch", "_epoch")).drop("_epoch")


def patch(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], keep_on_null: bool = True) -> DataFrame:
    """SK8, SK12, SK14: columns set from changes by key; a null leaves what was there unless told otherwise."""
    given = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(given, key, "left")
    new = {c: F.coalesce(f"_{c}", c) if keep_on_null else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).drop("_hit", *[f"_{c}" for c in columns])


def missing_references(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """SK12's check: rows that refer to no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """SK13: each key's last row."""
    return rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_row = 1").drop("_row")


def requeue(jobs: DataFrame, most: int = 3) -> DataFrame:
    """SK14, ST14: running ingests go back to the queue with one more attempt, up to ``most``; other running jobs and spent ones fail."""
    running = F.col("state") == "running"
    again = running & (F.col("kind") == "ingest") & (F.col("attempts") < most)
    return jobs.withColumns({"attempts": F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts")), "state": F.when(again, "queued").when(running, "failed").otherwise(F.col("state"))})


def cascade_delete(tables: dict[str, DataFrame], videos: DataFrame) -> dict[str, DataFrame]:
    """SK15, SK16: all tables without the rows of some videos."""
    gone = videos.select("video_id").distinct()
    return {name: t.join(gone, "video_id", "left_anti") for name, t in tables.items()}


def lookup(table: DataFrame, **keys: object) -> DataFrame:
    """FP1."""
    for k, v in keys.items():
        table = table.filter(F.col(k) == F.lit(v))
    return table


def get_many(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """FP2."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def ordered_read(table: DataFrame, video_id: object, order: Sequence[str]) -> DataFrame:
    """FP5: one video's rows in order."""
    return lookup(table, video_id=video_id).orderBy(*order)


def with_ids(table: DataFrame, key: str, *of: str) -> DataFrame:
    """FP6: rows without an id get one made of their own columns, the same on every read."""
    return table.withColumn(key, F.coalesce(F.col(key), F.sha1(F.concat_ws("|", *[F.col(c).cast("string") for c in of]))))


def newest(table: DataFrame, limit: int | None, order: str = "created_at", key: str = "id") -> DataFrame:
    """FP3."""
    ordered = table.orderBy(F.desc(order), key)
    return ordered if limit is None else ordered.limit(limit)


def resolve_ident(videos: DataFrame, ident: str) -> DataFrame:
    """FP4: by id, else by key, else by URI: the first that matches."""
    how = F.when(F.col("id") == ident, 0).when(F.col("source_key") == ident, 1).when(F.col("source_uri") == ident, 2)
    return videos.withColumn("_how", how).filter("_how IS NOT NULL").orderBy("_how", "id").limit(1).drop("_how")


def counts_by_video(tables: dict[str, DataFrame]) -> DataFrame:
    """FP7, A24: rows of each role by video."""
    out = None
    for role, t in sorted(tables.items()):
        part = t.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", F.lit(role).alias("role"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def stale_roles(videos: DataFrame, provenance: DataFrame, current: dict[str, str], disabled: Sequence[str] = ()) -> DataFrame:
    """(video_id, role) whose recorded fingerprint isn't the current one, of videos that are done.

    A disabled role is stale only where it has been stamped. The roles are a fixed few, so each video is exploded over them.
    """
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(f).alias("current"), F.lit(r in disabled).alias("disabled")) for r, f in sorted(current.items())]))
    wanted = videos.filter("ingest_status = 'done'").select("video_id", roles.alias("r")).select("video_id", "r.*")
    joined = wanted.join(provenance.select("video_id", "role", "fingerprint"), ["video_id", "role"], "left")
    changed = F.when(F.col("disabled"), F.col("fingerprint").isNotNull()).otherwise(~F.col("fingerprint").eqNullSafe(F.col("current")))
    return joined.filter(changed).select("video_id", "role", "fingerprint", "current")


def recorded_fps(provenance: DataFrame) -> DataFrame:
    """A video's fps where all roles that have one agree, else null."""
    return provenance.groupBy("video_id").agg(F.when(F.count_distinct("fps") == 1, F.max("fps")).alias("fps"))


def reprocess_plan(stale: DataFrame, provenance: DataFrame, providers: dict[str, Sequence[str]]) -> DataFrame:
    """a row for each video: roles to rebuild and its fps. A role that another stale one rebuilds with itself is satisfied by it.

    Videos whose fps isn't known can't be rebuilt faithfully and are marked refused.
    """
    covered = [(p, r) for p, rs in sorted(providers.items()) for r in rs]
    by_video = stale.groupBy("video_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    satisfied = F.filter(F.array(*[F.when(F.array_contains("roles", p), F.lit(r)) for p, r in covered]) if covered else F.array().cast("array<string>"), lambda x: x.isNotNull())
    plan = by_video.withColumn("roles", F.array_except("roles", satisfied)).join(recorded_fps(provenance), "video_id", "left")
    return plan.withColumn("refused", F.col("fps").isNull())


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """A23."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def migrate_layout(vectors: DataFrame, path: str) -> None:
    """SK20: one monolithic index written by space, embedder, dimension and video."""
    vectors.repartition("space", "embedder", "dim", "video_id").write.mode("overwrite").partitionBy("space", "embedder", "dim", "video_id").parquet(path)
