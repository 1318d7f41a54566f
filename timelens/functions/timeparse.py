"""Times: buckets, wall clocks, coercion, window URIs."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from timelens.constants import MAX_WINDOW

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def bucket_seconds(bucket: str) -> int:
    """Seconds of ``<int><s|m|h|d>``, in either case and with blanks between."""
    m = re.fullmatch(r"(\d+)\s*([smhd])", bucket.strip().lower())
    if not m or int(m[1]) <= 0:
        raise ValueError(f"bucket {bucket!r} is not <int><s|m|h|d>")
    return int(m[1]) * _UNITS[m[2]]


@dataclass(frozen=True)
class TimeWindow:
    """A half-open wall-clock window; the zone must be named."""

    start: str
    end: str
    tz: str

    def epoch_bounds(self) -> tuple[float, float]:
        """Epoch seconds of start and end. Local times that a clock change skips are refused; repeated ones are the first."""
        try:
            zone = ZoneInfo(self.tz)
        except (ZoneInfoNotFoundError, ValueError, OSError) as e:
            raise ValueError(f"{self.tz!r} is no time zone") from e
        bounds = []
        for text in (self.start, self.end):
            naive = datetime.fromisoformat(text)
            if naive.tzinfo is not None:
                raise ValueError(f"{text!r} has an offset; give the wall clock and the zone")
            local = naive.replace(tzinfo=zone)
            if local.astimezone(UTC).astimezone(zone).replace(tzinfo=None, fold=0) != naive.replace(fold=0):
                raise ValueError(f"{text!r} does not exist in {self.tz}")
            bounds.append(local.timestamp())
        if bounds[1] <= bounds[0]:
            raise ValueError("the window ends before it starts")
        return bounds[0], bounds[1]


def local_iso(epoch: Column, tz: str) -> Column:
    """Epoch seconds as a local time, for a session in UTC."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros((epoch * 1_000_000).cast("bigint")), tz), "yyyy-MM-dd'T'HH:mm:ss")


def coerced_seconds(value: Column) -> Column:
    """Seconds from ``12``, ``3.5S``, ``1:07`` or ``01:02:03``, each part 60 of the next; null for anything else."""
    text = F.regexp_replace(F.regexp_replace(F.lower(value), r"^\s+|\s+$", ""), r"\s*s*$", "")
    number = lambda p: F.when(p.rlike(r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?\s*$"), F.trim(p).try_cast("double"))
    return F.aggregate(F.transform(F.split(text, ":"), number), F.lit(0.0), lambda acc, p: acc * 60 + p)


def window_uri(source_ref: Column, start: Column, end: Column) -> Column:
    """``nvr://ref/start/end`` in whole seconds: start rounded down, end up, at least one second, at most MAX_WINDOW."""
    low = F.floor(start)
    high = F.least(F.greatest(F.ceil(end), low + 1), low + MAX_WINDOW)
    iso = lambda x: F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.concat(F.lit("nvr://"), source_ref, F.lit("/"), iso(low), F.lit("/"), iso(high))


def parse_date(text: str, tz: str = "UTC") -> float:
    """Epoch of ``YYYY-MM-DD``, with ``HH:MM`` or with ``HH:MM:SS``."""
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            return datetime.strptime(text.replace("T", " "), form).replace(tzinfo=ZoneInfo(tz)).timestamp()
        except ValueError:
            continue
    raise ValueError(f"{text!r} is no date")


def bucket_count(start: float, end: float, width: int) -> int:
    return max(0, math.ceil((end - start) / width))
