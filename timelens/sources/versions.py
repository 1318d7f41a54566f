"""SK18, SK19: role tables in versions. A write is staged beside what is there and becomes visible by one small file, written last.

Below a table's path: ``rows/version=*`` hold what each write brought, ``ledger/*`` says for each key which version its rows are
of and how many they are, and ``commits/*.json`` name a ledger each, numbered from 1. A commit's file appears whole or not at all, and of two writers one gets the
number; the other takes the next one. Readers are pinned to the commit that they open.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens import schemas

log = logging.getLogger(__name__)


class CommitLog:
    """Numbered small documents in a folder of any store that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at().getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        files = self._files()
        if not files.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._at())]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, number: int) -> dict:
        stream = self._files().open(self._at(f"{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The last number and its document; 0 and nothing before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def add(self, number: int, document: dict) -> bool:
        """Write a document under a number; False if the number is taken."""
        files, part = self._files(), self._at(f"_{uuid.uuid4().hex}")
        stream = files.create(part, True)
        try:
            stream.write(bytearray(json.dumps(document).encode()))
        finally:
            stream.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(part.getFileSystem(self._conf).getUri(), self._conf).rename(part, self._at(f"{number:012d}.json"), plain)
        except Exception as e:  # the JVM's own exception reaches Python wrapped
            files.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True


class Versioned:
    """A role table whose rows are replaced by key."""

    def __init__(self, spark: SparkSession, path: str, table: str | None = None, keys: Sequence[str] = ("video_id",)) -> None:
        self.spark, self.path, self.table, self.keys = spark, path, table, list(keys)
        self.commits = CommitLog(spark, f"{path}/commits")

    def exists(self) -> bool:
        return bool(self.commits.numbers())

    def ledger(self, commit: int | None = None) -> DataFrame:
        """The keys of a commit (the last one) with version and row_count."""
        document = self.commits.latest()[1] if commit is None else self.commits.read(commit)
        return self.spark.read.parquet(f"{self.path}/ledger/{document['ledger']}")

    def _rows(self, versions: Sequence[str]) -> DataFrame:
        read = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/rows")
        return read.parquet(*[f"{self.path}/rows/version={v}" for v in versions])

    def read(self, commit: int | None = None, checked: bool = False) -> DataFrame:
        """A commit's rows (the last one's). Later commits don't change what the frame gives.

        Checked: keys whose rows aren't as many as the ledger says, a torn or damaged version, read as empty, and their number is logged.
        """
        document = self.commits.latest()[1] if commit is None else self.commits.read(commit)
        if not document.get("versions"):
            if self.table is None and not document.get("columns"):
                raise FileNotFoundError(f"{self.path} has no rows")
            return self._shaped(self.spark.createDataFrame([], "_ int").drop("_"), document)
        keys = document["keys"]
        ledger = self.spark.read.parquet(f"{self.path}/ledger/{document['ledger']}").filter("row_count > 0")
        rows = self._rows(document["versions"])
        if checked:
            held = rows.groupBy(*keys, "version").agg(F.count("*").alias("_held"))
            compared = ledger.join(held, [*keys, "version"], "left").withColumn("_whole", F.col("_held").eqNullSafe(F.col("row_count")))
            if torn := compared.filter(~F.col("_whole")).count():
                log.warning("%s: %d keys have other rows than were committed and read as empty", self.path, torn)
            ledger = compared.filter("_whole")
        return self._shaped(rows.join(ledger.select(*keys, "version"), [*keys, "version"], "left_semi").drop("version"), document)

    def _shaped(self, rows: DataFrame, document: dict) -> DataFrame:
        """Rows as the table's schema has them, or with the columns that were added since they were written."""
        if self.table is not None:
            return schemas.conform(rows, self.table)
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in document.get("columns", {}).items() if c not in rows.columns})

    def add_columns(self, columns: dict[str, str]) -> bool:
        """Nullable columns that rows without them read as null: a commit alone, no file is written again. False if all are there.

        A table that isn't there yet is made, empty.
        """
        while True:
            number, document = self.commits.latest()
            have = set(document.get("columns", {}))
            if document.get("versions"):
                have |= set(self._rows(document["versions"]).columns)
            new = {c: k for c, k in columns.items() if c not in have}
            if not new and document:
                return False
            if not document:
                name = uuid.uuid4().hex
                self.spark.createDataFrame([], ", ".join([f"{k} {columns.get(k, 'string')}" for k in self.keys] + ["version string", "row_count bigint"])).write.parquet(f"{self.path}/ledger/{name}")
                document = {"ledger": name, "versions": [], "keys": self.keys}
            if self.commits.add(number + 1, document | {"columns": document.get("columns", {}) | new}):
                return True

    def stage(self, rows: DataFrame) -> str:
        """Write rows as a version that no commit names yet."""
        version = f"v{uuid.uuid4().hex}"  # a letter first, so that Spark reads it as text
        rows.write.parquet(f"{self.path}/rows/version={version}")
        return version

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        """All rows of ``keys`` (those of ``rows``) replaced by ``rows``, which are computed once. Gives the keys' row counts.

        Keys without a new row are kept with a count of 0. Nothing is visible until the commit, and what was committed before stays readable.
        """
        version = self.stage(rows if self.table is None else schemas.conform(rows, self.table))
        held = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/version={version}").groupBy(*self.keys).agg(F.count("*").alias("row_count"))
        every = held if keys is None else keys.select(*[F.col(k).cast(held.schema[k].dataType) for k in self.keys]).distinct().join(held, self.keys, "left")
        fresh = every.select(*self.keys, F.lit(version).alias("version"), F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"))
        return self._commit(fresh, version)

    def drop(self, keys: DataFrame) -> None:
        """Keys and their rows go, by a commit alone."""
        if self.exists():
            self._commit(self.ledger().limit(0), None, keys)

    def compact(self) -> None:
        """All rows written again as one version."""
        number, document = self.commits.latest()
        if len(document.get("versions", [])) < 2:
            return
        version = self.stage(self.read(number))
        ledger = self.spark.read.parquet(f"{self.path}/ledger/{document['ledger']}")
        name = uuid.uuid4().hex
        ledger.withColumn("version", F.lit(version)).write.parquet(f"{self.path}/ledger/{name}")
        if not self.commits.add(number + 1, document | {"ledger": name, "versions": [version]}):
            raise RuntimeError(f"{self.path} was written while it was compacted")

    def vacuum(self, keep: int = 2) -> int:
        """Remove versions and ledgers that none of the last ``keep`` commits names, and the commits before them. Gives how many folders went.

        Readers of those commits, and writers that have staged without a commit, must be done.
        """
        numbers = self.commits.numbers()
        kept = [self.commits.read(n) for n in numbers[-keep:]]
        names = {"rows": {f"version={v}" for d in kept for v in d["versions"]}, "ledger": {d["ledger"] for d in kept}}
        files, gone = self.commits._files(), 0
        for folder, wanted in names.items():
            for status in files.listStatus(self.commits._hadoop.Path(f"{self.path}/{folder}")):
                if status.getPath().getName() not in wanted:
                    gone += bool(files.delete(status.getPath(), True))
        for n in numbers[:-keep]:
            files.delete(self.commits._at(f"{n:012d}.json"), False)
        return gone

    def _commit(self, fresh: DataFrame, version: str | None, dropped: DataFrame | None = None) -> DataFrame:
        while True:
            number, document = self.commits.latest()
            ledger, named = fresh, [version] if version else []
            if document:
                old = self.spark.read.parquet(f"{self.path}/ledger/{document['ledger']}")
                ledger = old.join((fresh if dropped is None else dropped).select(*self.keys).distinct(), self.keys, "left_anti").unionByName(fresh)
            name = uuid.uuid4().hex
            ledger.write.parquet(f"{self.path}/ledger/{name}")
            written = self.spark.read.parquet(f"{self.path}/ledger/{name}")
            # as many as there were commits since the last compaction
            live = {r[0] for r in written.filter("row_count > 0").select("version").distinct().collect()}
            if self.commits.add(number + 1, document | {"ledger": name, "versions": sorted(live | set(named)), "keys": self.keys}):
                return written if version is None else written.filter(F.col("version") == version).drop("version")


def open_role(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A role table's rows, whether it is kept in versions or as plain files."""
    held = Versioned(spark, path, table)
    return held.read() if held.exists() else schemas.read_role(spark, path, table)


def adopt(spark: SparkSession, path: str, table: str, keys: Sequence[str] = ("video_id",)) -> Versioned:
    """A role table in versions at this path; plain files that lie there are its first version and are removed after the commit."""
    held = Versioned(spark, path, table, keys)
    if held.exists():
        return held
    files, at = held.commits._files(), held.commits._hadoop.Path(path)
    if not files.exists(at):
        return held
    for started in ("rows", "ledger"):  # by a first write that never committed
        files.delete(held.commits._hadoop.Path(f"{path}/{started}"), True)
    plain = [s.getPath() for s in files.listStatus(at)]
    if any(not p.getName().startswith(("_", ".")) for p in plain):
        held.replace(spark.read.option("mergeSchema", "true").parquet(path))
        for p in plain:
            files.delete(p, True)
    return held
