"""Tables in versions: pinned readers, writes stopped halfway, torn versions, roles that run once, removal."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from timelens import cli, schemas
from timelens.plans import ingest
from timelens.sources import versions


def said(spark, *rows):
    return spark.createDataFrame(list(rows), "video_id string, text string")


def texts(df):
    return sorted((r["video_id"], r["text"]) for r in df.collect())


def test_replace_and_pinned_readers(spark, tmp_path):
    held = versions.Versioned(spark, str(tmp_path / "t"), "transcripts")
    counts = held.replace(said(spark, ("a", "1"), ("a", "2"), ("b", "1"), ("x", "not asked for")), said(spark, ("a", ""), ("b", ""), ("c", "")))
    assert {(r["video_id"], r["row_count"]) for r in counts.collect()} == {("a", 2), ("b", 1), ("c", 0)}
    before = held.read()
    held.replace(said(spark, ("a", "9")), said(spark, ("a", ""), ("b", "")))
    assert texts(held.read()) == [("a", "9")] and texts(before) == texts(held.read(1)) == [("a", "1"), ("a", "2"), ("b", "1")]
    held.drop(said(spark, ("a", "")))
    assert held.read().count() == 0 and {r["video_id"] for r in held.ledger().collect()} == {"b", "c"}


def test_a_write_that_stops_halfway_is_invisible(spark, tmp_path, monkeypatch):
    held = versions.Versioned(spark, str(tmp_path / "t"), "transcripts")
    held.replace(said(spark, ("a", "old")))
    with pytest.raises(Exception, match="no decoder"):
        held.replace(said(spark, ("a", "new")).withColumn("text", F.raise_error(F.lit("no decoder")).cast("string")))
    held.stage(said(spark, ("a", "staged")))
    monkeypatch.setattr(versions.CommitLog, "add", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        held.replace(said(spark, ("a", "almost")))
    assert texts(held.read(checked=True)) == [("a", "old")] and held.commits.numbers() == [1]


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    held = versions.Versioned(spark, str(tmp_path / "t"), "transcripts")
    held.replace(said(spark, ("a", "1")))
    plain, raced = versions.CommitLog.add, []

    def add(log, number, document):
        if not raced:
            raced.append(number)
            versions.Versioned(spark, str(tmp_path / "t"), "transcripts").replace(said(spark, ("b", "2")))
        return plain(log, number, document)

    monkeypatch.setattr(versions.CommitLog, "add", add)
    held.replace(said(spark, ("c", "3")))
    assert texts(held.read()) == [("a", "1"), ("b", "2"), ("c", "3")] and held.commits.numbers() == [1, 2, 3]


def test_torn_versions_read_as_empty(spark, tmp_path, caplog):
    held = versions.Versioned(spark, str(tmp_path / "t"), "transcripts")
    held.replace(said(spark, ("a", "1")))
    held.replace(said(spark, *[("b", str(i)) for i in range(20)]).repartition(4))
    parts = {d: sorted(glob.glob(f"{d}/part-*"), key=os.path.getsize) for d in glob.glob(f"{tmp_path}/t/rows/version=*")}
    os.remove(max(parts.values(), key=len)[-1])
    with caplog.at_level("WARNING"):
        assert texts(held.read(checked=True)) == [("a", "1")]
    assert "1 keys" in caplog.text


def test_compact_and_vacuum(spark, tmp_path):
    held = versions.Versioned(spark, str(tmp_path / "t"), "transcripts")
    for i in range(3):
        held.replace(said(spark, (str(i), "x")))
    want = texts(held.read())
    held.compact()
    assert texts(held.read()) == want and len(held.commits.latest()[1]["versions"]) == 1
    assert held.vacuum(keep=1) == 6 and texts(held.read()) == want and held.commits.numbers() == [4]


def test_plain_files_are_adopted(spark, tmp_path):
    path = str(tmp_path / "transcripts")
    said(spark, ("a", "1"), ("b", "2")).write.partitionBy("video_id").parquet(path)
    assert texts(versions.open_role(spark, path, "transcripts")) == [("a", "1"), ("b", "2")]
    held = versions.adopt(spark, path, "transcripts")
    assert texts(held.read()) == [("a", "1"), ("b", "2")] and sorted(os.listdir(path)) == ["commits", "ledger", "rows"]


def test_a_role_runs_once(spark, tmp_path):
    videos = schemas.conform(spark.createDataFrame([("a", 2.0), ("b", 2.0)], "id string, fps double"), "videos").withColumn("video_id", F.col("id"))
    calls = spark.sparkContext.accumulator(0)

    def model(batches):
        for df in batches:
            calls.add(len(df))
            yield df.assign(text="said")

    role = {"transcript": ("transcripts", lambda v: v.select("video_id").mapInPandas(model, "video_id string, text string"))}
    assert ingest.run_roles(videos, role, str(tmp_path), {}, "r1").written == {"transcript": 2}
    assert calls.value == 2
    assert ingest.run_roles(videos, role, str(tmp_path), {}, "r2").written == {"transcript": 2}
    assert calls.value == 4


def test_remove_verb(spark, tmp_path):
    schemas.conform(spark.createDataFrame([("a", "key-a"), ("b", "key-b")], "id string, source_key string"), "videos").write.parquet(f"{tmp_path}/videos")
    schemas.conform(said(spark, ("a", "1"), ("a", "2"), ("b", "3")), "transcripts").write.parquet(f"{tmp_path}/transcripts")
    run = lambda *a: cli.run(cli.build_parser().parse_args(["--workdir", str(tmp_path), *a]), spark)
    assert run("remove", "key-a") == {"removed": 1, "rows": {"videos": 1, "transcripts": 2}}
    assert texts(versions.open_role(spark, f"{tmp_path}/transcripts", "transcripts")) == [("b", "3")]
    assert [r["id"] for r in versions.open_role(spark, f"{tmp_path}/videos", "videos").collect()] == ["b"]
    assert run("remove", "key-a") == {"removed": 0}
