"""Catalogs of all versions reach the same tables; steps run once, in order, and again without effect."""

import pytest

from timelens import schemas
from timelens.sources import migrations, versions

ROWS = {
    "videos": ("id string, title string, fps double, last_ingest_run_id string, profile string, camera_id string, start_epoch double", [("a", "A", 2.0, "r", "p", "c", 5.0), ("b", "B", None, None, None, None, None)]),
    "object_tracks": ("id string, video_id string, object_class string, appearance_ref string", [("t", "a", "car", "x")]),
    "cameras": ("id string, name string, last_processed_epoch double", [("c", "gate", 7.0)]),
    "jobs": ("id string, kind string", [("j", "ingest")]),
    "role_provenance": ("video_id string, role string, fingerprint string", [("a", "ocr", "f")]),
}
#: The version that each table and column came with.
SINCE = {"role_provenance": 2, "cameras": 4, "jobs": 7, "last_ingest_run_id": 1, "profile": 3, "camera_id": 4, "start_epoch": 5, "appearance_ref": 6, "last_processed_epoch": 8}


def old_catalog(spark, path, at):
    """What code of a version wrote: no table or column that came later, plain files."""
    for table, (kind, rows) in ROWS.items():
        if SINCE.get(table, 0) <= at:
            df = spark.createDataFrame(rows, kind)
            df.drop(*[c for c in df.columns if SINCE.get(c, 0) > at]).write.parquet(f"{path}/{table}")
    ledger = versions.CommitLog(spark, f"{path}/_schema")
    for n in range(1, at + 1):
        ledger.add(n, {"step": "old"})


def known(at, column, value):
    return value if SINCE.get(column, 0) <= at else None


@pytest.mark.parametrize("at", [0, 3, 5, 8])
def test_old_catalogs_reach_the_same_schema(spark, tmp_path, at):
    path = str(tmp_path)
    old_catalog(spark, path, at)
    assert migrations.migrate(spark, path) == at and migrations.version(spark, path) == 8
    for table, (kind, rows) in ROWS.items():
        got = migrations.read(spark, path, table)
        columns = [c.split()[0] for c in kind.split(", ")]
        if SINCE.get(table, 0) <= at:
            assert set(columns) <= set(got.columns)
            want = [tuple(known(at, c, v) for c, v in zip(columns, r, strict=True)) for r in rows]
        else:
            assert set(got.columns) == set(schemas.columns(table))
            want = []
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))
    commits = {t: versions.Versioned(spark, f"{path}/{t}").commits.numbers() for t in migrations.BASE}
    assert migrations.migrate(spark, path) == 8
    assert commits == {t: versions.Versioned(spark, f"{path}/{t}").commits.numbers() for t in migrations.BASE}


def test_a_new_catalog(spark, tmp_path):
    migrations.migrate(spark, str(tmp_path))
    for table in schemas.SCHEMAS:
        if table != "vectors":
            assert set(migrations.read(spark, str(tmp_path), table).columns) == set(schemas.columns(table))


def test_a_step_that_fails_is_run_again(spark, tmp_path, monkeypatch):
    old_catalog(spark, str(tmp_path), 2)
    ran = []

    def fails(*_):
        ran.append(1)
        if len(ran) == 1:
            raise OSError("disk full")

    steps = list(migrations.STEPS)
    steps[3] = migrations.Step("fails", "cameras", {"name": "string"}, fails)
    monkeypatch.setattr(migrations, "STEPS", tuple(steps))
    with pytest.raises(OSError, match="disk full"):
        migrations.migrate(spark, str(tmp_path))
    assert migrations.version(spark, str(tmp_path)) == 3
    assert migrations.migrate(spark, str(tmp_path)) == 3 and migrations.version(spark, str(tmp_path)) == 8 and len(ran) == 2


def test_two_processes_and_later_code(spark, tmp_path, monkeypatch, caplog):
    plain, inside = versions.CommitLog.add, []

    def add(ledger, number, document):
        if ledger.path.endswith("_schema") and not inside:
            inside.append(1)
            migrations.migrate(spark, str(tmp_path))
        return plain(ledger, number, document)

    monkeypatch.setattr(versions.CommitLog, "add", add)
    assert migrations.migrate(spark, str(tmp_path)) == 0 and migrations.version(spark, str(tmp_path)) == 8
    assert versions.CommitLog(spark, f"{tmp_path}/_schema").numbers() == list(range(1, 9))
    plain(versions.CommitLog(spark, f"{tmp_path}/_schema"), 9, {"step": "later"})
    with caplog.at_level("WARNING"):
        assert migrations.migrate(spark, str(tmp_path)) == 9
    assert "written by later code" in caplog.text


def test_added_columns_and_later_writes(spark, tmp_path):
    held = versions.Versioned(spark, str(tmp_path / "t"))
    held.replace(spark.createDataFrame([("a", 1)], "video_id string, x int"))
    assert held.add_columns({"x": "int", "y": "double"}) and not held.add_columns({"y": "double"})
    held.replace(spark.createDataFrame([("b", 2, 0.5)], "video_id string, x int, y double"))
    held.compact()
    assert sorted((r["video_id"], r["x"], r["y"]) for r in held.read().collect()) == [("a", 1, None), ("b", 2, 0.5)]
