"""Source URIs: dispatch, video ids, recorder windows, stream profiles."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.constants import MAX_WINDOW

YOUTUBE_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be")

_VIDEO = r"([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])"
_WINDOW = r"^nvr://([^/]+)/([^/]+)/([^/]+)$"


def backend_of(uri: str) -> str:
    """SC1: which backend reads a URI."""
    if uri.startswith("nvr://"):
        return "nvr_recorded"
    if urlparse(uri).scheme in ("http", "https"):
        if (urlparse(uri).hostname or "").lower() in YOUTUBE_HOSTS:
            return "youtube"
        raise ValueError(f"no source reads {uri!r}")
    if not uri:
        raise ValueError("an empty URI")
    return "local"


def backend(uri: Column) -> Column:
    """SC1 for a column; null where no source reads the URI."""
    host = F.lower(F.regexp_extract(uri, r"^https?://([^/:?#]+)", 1))
    return F.when(uri.startswith("nvr://"), "nvr_recorded").when(host.isin(*YOUTUBE_HOSTS), "youtube").when((uri != "") & ~uri.rlike("^[a-z]+://"), "local")


def video_id(uri: Column) -> Column:
    """SC4: the 11 characters that name a video in a watch, short, embed or v link; null if there are none."""
    host = F.lower(F.regexp_extract(uri, r"^https?://([^/:?#]+)", 1))
    short = F.regexp_extract(uri, r"^https?://[^/]+/" + _VIDEO, 1)
    path = F.regexp_extract(uri, r"^https?://[^/]+/(?:shorts|embed|v|live)/" + _VIDEO, 1)
    watch = F.regexp_extract(uri, r"[?&]v=" + _VIDEO, 1)
    found = F.when(host.isin("youtu.be", "www.youtu.be"), short).otherwise(F.when(path != "", path).otherwise(watch))
    return F.when(host.isin(*YOUTUBE_HOSTS) & (found != ""), found)


def recorder_windows(uris: DataFrame, tz: str = "UTC") -> DataFrame:
    """SC6, SC7: uri split into channel, start_epoch, end_epoch, source_key and camera; ``problem`` says why a row isn't usable.

    Times without an offset are in tz. A window must end after it starts and have at most MAX_WINDOW seconds.
    """
    part = lambda i: F.regexp_extract("uri", _WINDOW, i)

    def epoch(text: Column) -> Column:
        own = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
        return F.unix_micros(F.when(own, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), tz))) / 1e6

    cut = uris.withColumns({"channel": part(1), "start_epoch": epoch(part(2)), "end_epoch": epoch(part(3))})
    problem = (
        F.when(~F.coalesce(F.col("uri").rlike(_WINDOW), F.lit(False)), "not a window")
        .when(F.col("start_epoch").isNull() | F.col("end_epoch").isNull(), "no time")
        .when(F.col("end_epoch") <= F.col("start_epoch"), "ends before it starts")
        .when(F.col("end_epoch") - F.col("start_epoch") > MAX_WINDOW, "too long")
    )
    key = F.format_string("nvr:ch%s:%d-%d", "channel", F.floor("start_epoch"), F.floor("end_epoch"))
    return cut.withColumn("problem", problem).withColumns({"source_key": F.when(F.col("problem").isNull(), key), "camera_id": F.when(F.col("problem").isNull(), F.concat(F.lit("nvr-ch"), F.col("channel")))})


def stream_profiles(spec: Column) -> Column:
    """SC9: ``WxH[@fps],...`` as an array of (w, h, fps). Null or blank is null: no check is asked for.

    Anything that doesn't parse, or a text without an entry, is an error: a slip must not switch the check off.
    """
    form = r"^\s*(\d+)\s*[xX]\s*(\d+)\s*(?:@\s*(\d+(?:\.\d*)?|\.\d+)?\s*)?$"
    parts = F.filter(F.split(spec, ","), lambda p: F.trim(p) != "")

    def profile(p: Column) -> Column:
        rate = F.bround(F.nullif(F.regexp_extract(p, form, 3), F.lit("")).cast("double")).cast("int")
        read = F.struct(F.regexp_extract(p, form, 1).cast("int").alias("w"), F.regexp_extract(p, form, 2).cast("int").alias("h"), rate.alias("fps"))
        bad = F.raise_error(F.concat(F.lit("bad stream profile '"), p, F.lit("': WxH[@fps] is expected, as in 2688x1520@20")))
        return F.when(p.rlike(form), read).otherwise(bad.cast("struct<w:int,h:int,fps:int>"))

    none = F.raise_error(F.concat(F.lit("no stream profile in '"), spec, F.lit("'"))).cast("array<struct<w:int,h:int,fps:int>>")
    return F.when(F.trim(spec) == "", None).when(F.size(parts) > 0, F.array_distinct(F.transform(parts, profile))).when(spec.isNotNull(), none)
