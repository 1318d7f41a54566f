"""Role tables, as Spark schemas, and a reader that tolerates older files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "videos": "id string, source_type string, source_uri string, source_key string, local_path string, title string, duration_seconds double, fps double, resolution string, has_audio boolean, ingest_status string, ingest_error string, created_at timestamp, fetched_at timestamp, processed_at timestamp, last_ingest_run_id string, profile string, camera_id string, start_epoch double",
    "cameras": "id string, name string, source_ref string, location string, last_processed_epoch double, created_at timestamp",
    "segments": "id string, video_id string, segment_index int, start_time double, end_time double, keyframe_paths array<string>, caption string",
    "object_tracks": "id string, video_id string, object_class string, track_confidence double, first_seen double, last_seen double, frame_count int, appearance_ref string",
    "object_detections": "id bigint, video_id string, timestamp double, track_id string, object_class string, bbox_x double, bbox_y double, bbox_w double, bbox_h double, confidence double",
    "action_events": "id string, video_id string, segment_id string, action_class string, confidence double, start_time double, end_time double",
    "transcripts": "id string, video_id string, start_time double, end_time double, speaker string, text string",
    "ocr_results": "id string, video_id string, timestamp double, text string, bbox_x double, bbox_y double, bbox_w double, bbox_h double",
    "observations": "id string, video_id string, prompt_key string, timestamp double, text string",
    "jobs": "id string, kind string, state string, payload string, video_id string, error string, result string, attempts int, created_at timestamp, updated_at timestamp",
    "role_provenance": "video_id string, role string, model string, fingerprint string, fps double, run_id string, row_count int, produced_at timestamp",
    "vectors": "space string, embedder string, dim int, video_id string, timestamp double, embedding array<float>, payload map<string,string>",
}


class _Schemas(Mapping):
    """Schemas by name, parsed when asked for: parsing needs a session."""

    def __getitem__(self, name: str) -> StructType:
        return StructType.fromDDL(_DDL[name])

    def __iter__(self) -> Iterator[str]:
        return iter(_DDL)

    def __len__(self) -> int:
        return len(_DDL)


SCHEMAS = _Schemas()

INGEST_STATUSES = ("pending", "fetching", "processing", "done", "failed", "quarantined")
SOURCE_TYPES = ("youtube", "local", "nvr_recorded")


def columns(name: str) -> dict[str, str]:
    """A role table's columns and their types."""
    return dict(c.split(" ", 1) for c in _DDL[name].split(", "))


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of a role table: absent ones are null, others cast or dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def read_role(spark: SparkSession, path: str, name: str) -> DataFrame:
    return conform(spark.read.option("mergeSchema", "true").parquet(path), name)


def empty_role(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
