"""Sidecar JSON files beside media, and other files read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMAS = {
    "transcript": ("lines", "struct<start_time:double,end_time:double,text:string,speaker:string>"),
    "diarization": ("turns", "struct<start_time:double,end_time:double,speaker:string>"),
    "ocr": ("lines", "struct<timestamp:double,text:string,bbox_x:double,bbox_y:double,bbox_w:double,bbox_h:double>"),
    "motion": ("events", "struct<camera_ref:string,start_epoch:double,end_epoch:double,kind:string,open:boolean>"),
}


def schema_of(kind: str) -> str:
    name, item = _SCHEMAS[kind]
    return f"{name} array<{item}>"


def read_sidecars(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """SC16-SC19: rows of all sidecars of a kind, with ``media``, the file that they stand beside, and their position."""
    name, _ = _SCHEMAS[kind]
    files = spark.read.schema(schema_of(kind)).option("multiLine", "true").json(path).withColumn("_file", F.input_file_name())
    media = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), rf"\.{kind}\.json$", "")
    return files.select(media.alias("media"), F.posexplode(name).alias("position", "_row")).select("media", "position", "_row.*")


def motion_events(rows: DataFrame, start: float, end: float, camera_ref: str | None = None) -> DataFrame:
    """SC19's filter: events that overlap [start, end], ends included, of one camera if given, in order."""
    found = rows.filter((F.col("end_epoch") >= start) & (F.col("start_epoch") <= end))
    if camera_ref is not None:
        found = found.filter(F.col("camera_ref") == camera_ref)
    return found.orderBy("start_epoch", "camera_ref")


def motion_stream(spark: SparkSession, path: str) -> DataFrame:
    """SC19 as a stream of files that appear in a folder."""
    files = spark.readStream.schema(schema_of("motion")).option("multiLine", "true").json(path)
    return files.select(F.explode("events").alias("_row")).select("_row.*")


def local_files(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """SC2, SC3: files by path, size and time; with content, a key of its sha256."""
    files = spark.read.format("binaryFile").load(path)
    if not with_content:
        return files.select("path", "length", "modificationTime")
    return files.select("path", "length", "modificationTime", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_key"))


def golden_cases(spark: SparkSession, block: dict) -> DataFrame:
    """SC26: a golden block's queries as rows, from a parsed document."""
    rows = [(str(q["id"]), q["query"], q.get("modality"), q.get("expect", "match"), q.get("count_min"), q.get("count_max")) for q in block.get("queries", [])]
    return spark.createDataFrame(rows, "id string, query string, modality string, expect string, count_min int, count_max int")
