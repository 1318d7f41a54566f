"""SK21: a catalog's schema versions. Steps run in order, each is recorded when it is done, and a step that runs twice changes nothing."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from timelens import schemas
from timelens.sources.versions import CommitLog, Versioned, adopt

log = logging.getLogger(__name__)

#: Keys of tables that aren't replaced by video.
KEYS = {"videos": ("id",), "cameras": ("id",), "jobs": ("id",), "role_provenance": ("video_id", "role"), "observations": ("video_id", "prompt_key")}
#: Tables of a catalog before its first version.
BASE = ("videos", "segments", "object_tracks", "object_detections", "action_events", "transcripts", "ocr_results", "observations")


def opened(spark: SparkSession, workdir: str, table: str) -> Versioned:
    """A table in versions with the columns that its files and steps gave it; plain files are taken over."""
    held = adopt(spark, f"{workdir}/{table}", table, KEYS.get(table, ("video_id",)))
    held.table = None
    return held


@dataclass(frozen=True)
class Step:
    """What a version adds: columns of a table; one that isn't there is made. ``more`` may fill them."""

    name: str
    table: str
    columns: dict[str, str]
    more: Callable[[SparkSession, str], None] | None = None

    def apply(self, spark: SparkSession, workdir: str) -> None:
        opened(spark, workdir, self.table).add_columns(self.columns)
        if self.more is not None:
            self.more(spark, workdir)


def _whole(table: str, *later: str) -> dict[str, str]:
    return {n: k for n, k in schemas.columns(table).items() if n not in later}


def _camera_of_videos(spark: SparkSession, workdir: str) -> None:
    opened(spark, workdir, "videos").add_columns({"camera_id": "string"})


#: STEPS[i] takes a catalog from version i to i + 1.
STEPS = (
    Step("the run that last ingested a video", "videos", {"last_ingest_run_id": "string"}),
    Step("provenance of roles", "role_provenance", _whole("role_provenance")),
    Step("the profile a video was ingested under", "videos", {"profile": "string"}),
    Step("cameras, and a video's camera", "cameras", _whole("cameras", "last_processed_epoch"), _camera_of_videos),
    Step("when a video starts", "videos", {"start_epoch": "double"}),
    Step("what a track looks like", "object_tracks", {"appearance_ref": "string"}),
    Step("jobs", "jobs", _whole("jobs")),
    Step("up to where a camera was watched", "cameras", {"last_processed_epoch": "double"}),
)
#: Columns that came with a step, by table.
LATER = {t: tuple(c for s in STEPS if s.table == t for c in s.columns) for t in BASE} | {"videos": ("last_ingest_run_id", "profile", "camera_id", "start_epoch")}


def version(spark: SparkSession, workdir: str) -> int:
    return CommitLog(spark, f"{workdir}/_schema").latest()[0]


def migrate(spark: SparkSession, workdir: str) -> int:
    """Bring a catalog to the last version, one recorded step after another; gives the version it had.

    A new catalog gets its base tables first. Of two processes that migrate at once each step is recorded by one; the other goes on after
    it. A catalog of a later version than this code knows is left as it is.
    """
    ledger = CommitLog(spark, f"{workdir}/_schema")
    found = at = ledger.latest()[0]
    if at > len(STEPS):
        log.warning("%s is at version %d, written by later code; %d is known here", workdir, at, len(STEPS))
        return found
    if at < len(STEPS):
        for table in BASE:
            opened(spark, workdir, table).add_columns(_whole(table, *LATER[table]))
    while at < len(STEPS):
        step = STEPS[at]
        step.apply(spark, workdir)
        ledger.add(at + 1, {"step": step.name, "table": step.table})  # False: another process has recorded it
        at = max(at + 1, ledger.latest()[0])
    return found


def read(spark: SparkSession, workdir: str, table: str) -> DataFrame:
    """A table of a migrated catalog, with the columns it has by now."""
    return opened(spark, workdir, table).read()
