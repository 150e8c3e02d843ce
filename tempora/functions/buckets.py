"""Calendar-aware time buckets as column expressions.

Fixed spans (ns us ms s m h) are anchored on the origin or on the zone's standard midnight;
days, weeks, months and years (d w mo y) follow the local calendar of the zone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1)
#: Microseconds of the fixed units; names are fixed values of the width syntax.
_FIXED = {"us": 1, "ms": 10**3, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6}
_NAMES = {
    "ns": "ns", "nanosecond": "ns", "us": "us", "microsecond": "us", "ms": "ms", "millisecond": "ms", "s": "s", "sec": "s", "second": "s",
    "m": "m", "min": "m", "minute": "m", "h": "h", "hr": "h", "hour": "h", "d": "d", "day": "d", "w": "w", "week": "w", "mo": "mo", "mon": "mo", "month": "mo", "y": "y", "yr": "y", "year": "y",
}


@dataclass(frozen=True)
class Width:
    """A parsed width: microseconds, days or months; exactly one is not 0."""

    micros: int = 0
    days: int = 0
    months: int = 0


def parse_width(text: str) -> Width:
    found = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    if not found:
        raise ValueError(f"not a bucket width: {text!r}")
    n, unit = int(found[1]), found[2]
    if unit == "M":
        raise ValueError("M is neither minutes nor months here; write m or mo")
    unit = unit.lower()
    unit = _NAMES.get(unit) or _NAMES.get(unit.removesuffix("s"))
    if not unit:
        raise ValueError(f"unknown unit in {text!r}")
    if n == 0:
        raise ValueError("a bucket width must be positive")
    if unit == "ns":
        if n % 1000:
            raise ValueError("widths below a microsecond need nanosecond timestamps")
        return Width(micros=n // 1000)
    if unit in _FIXED:
        return Width(micros=n * _FIXED[unit])
    return Width(days=n * (7 if unit == "w" else 1)) if unit in "dw" else Width(months=n * (12 if unit == "y" else 1))


def zone(name: str) -> str:
    """The canonical name of an IANA zone given in any case."""
    by_name = {z.lower(): z for z in available_timezones()}
    if name.lower() not in by_name:
        raise ValueError(f"unknown time zone {name!r}")
    return by_name[name.lower()]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("long")).cast("timestamp_ntz")


def _standard_offset(name: str) -> int:
    moment = datetime(2024, 1, 1, tzinfo=ZoneInfo(name))
    offset = moment.utcoffset() - (moment.dst() or timedelta())
    return int(offset.total_seconds()) * 10**6


def time_bucket(width: str, ts: Column, tz: str | None = None, origin: datetime | None = None) -> Column:
    """The start of the bucket that holds a UTC ``ts`` (TIMESTAMP_NTZ), as UTC."""
    span = parse_width(width)
    tz = zone(tz) if tz else None
    if span.micros:
        anchor = int((origin - _EPOCH) / timedelta(microseconds=1)) if origin else -(_standard_offset(tz) if tz else 0)
        at = micros(ts)
        return from_micros(at - F.pmod(at - F.lit(anchor), F.lit(span.micros)))
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz")) if tz else ts.cast("timestamp_ntz")
    day = 86400 * 10**6
    if span.days:
        shift = int((origin - _EPOCH) / timedelta(microseconds=1)) if origin else 4 * day  # the Monday after the epoch
        at = micros(local)
        start = from_micros(at - F.pmod(at - F.lit(shift), F.lit(span.days * day)))
    else:
        if origin and origin.day > 28:
            raise ValueError("an origin after the 28th does not exist in every month")
        into = int((origin - datetime(origin.year, origin.month, 1)) / timedelta(microseconds=1)) if origin else 0
        first = (origin.year - 1970) * 12 + origin.month - 1 if origin else 0
        moved = from_micros(micros(local) - F.lit(into))
        month = (F.year(moved) - 1970) * 12 + F.month(moved) - 1
        month = month - F.pmod(month - F.lit(first), F.lit(span.months))
        start = F.make_date(F.floor(month / 12).cast("int") + 1970, F.pmod(month, F.lit(12)).cast("int") + 1, F.lit(1)).cast("timestamp_ntz")
        start = from_micros(micros(start) + F.lit(into))
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), start) if tz else start
