"""Dates, durations and time zones. Timestamps are UTC (or zoneless, read as UTC); durations are microseconds as bigint."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
PARTS = ("year", "quarter", "month", "week", "day", "dayofweek", "hour", "minute", "second")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the session's time zone is UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch(ts: Column) -> Column:
    """Whole seconds since the epoch, rounded down also before it."""
    return F.floor(micros(ts) / F.lit(1_000_000)).cast("bigint")


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value.cast("bigint")).cast("timestamp_ntz")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds.cast("double") * 1_000_000).cast("bigint")).cast("timestamp_ntz")


def offset_seconds(offset: Column | str) -> Column:
    """Seconds of an offset like +08:00; null for anything else."""
    c = F.lit(offset) if isinstance(offset, str) else offset
    ok = F.rlike(c, F.lit(r"^[+-][0-9]{2}:[0-9]{2}$"))
    size = F.substring(c, 2, 2).try_cast("int") * 3600 + F.substring(c, 5, 2).try_cast("int") * 60
    return F.when(ok, F.when(F.substring(c, 1, 1) == "-", -size).otherwise(size)).cast("bigint")


def local(ts: Column, zone: Column | str | None) -> Column:
    """Wall-clock time of a UTC timestamp. zone: an offset, an IANA name or a column of either."""
    if zone is None:
        return ts.cast("timestamp_ntz")
    if isinstance(zone, str) and zone[:1] in "+-":
        return from_micros(micros(ts) + offset_seconds(zone) * 1_000_000)
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def to_utc(ts: Column, zone: Column | str | None) -> Column:
    if zone is None:
        return ts.cast("timestamp_ntz")
    return F.to_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def parse(text: Column, fmt: str, zone: Column | str | None = None, strict: bool = False) -> Column:
    """Timestamp of a text; null (or an error if strict) where it doesn't match."""
    ts = F.to_timestamp(text, fmt) if strict else F.try_to_timestamp(text, F.lit(fmt))
    return to_utc(ts, zone)


def extract(ts: Column, part: str, zone: Column | str | None = None) -> Column:
    """A part of the local time; Monday is day 0 of the week, weeks are ISO weeks, seconds are whole."""
    t = local(ts, zone)
    get = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "dayofweek": F.weekday, "hour": F.hour, "minute": F.minute, "second": F.second}
    return get[part](t)


def difference(a: Column, b: Column, unit: str = "second") -> Column:
    return (micros(a) - micros(b)) / F.lit(float(MICROS[unit]))


def duration(value: Column, unit: str) -> Column:
    return value.cast("bigint") * MICROS[unit]


def duration_in(value: Column, unit: str) -> Column:
    return value / F.lit(float(MICROS[unit]))


def add(ts: Column, delta: Any) -> Column:
    """delta: microseconds, as a number or a column."""
    return from_micros(micros(ts) + (delta if isinstance(delta, Column) else F.lit(int(delta))))


def zip_zone(ts: Column, zone: Column) -> Column:
    """Timestamp and zone together, so both survive an aggregation."""
    return F.when(ts.isNotNull(), F.struct(ts.alias("timestamp"), zone.alias("timezone")))


def unzip_local(pair: Column) -> Column:
    return local(pair["timestamp"], pair["timezone"])


def months(ts: Column) -> Column:
    """Months since January 1970."""
    return ((F.year(ts) - 1970) * 12 + F.month(ts) - 1).cast("bigint")


def calendar_index(ts: Column, unit: str) -> Column:
    """The number of the calendar unit that holds a (local) timestamp; weeks start on Monday."""
    seconds = {"MINUTE": 60, "HOUR": 3600, "DAY": 86400}
    if unit in seconds:
        return F.floor(epoch(ts) / seconds[unit]).cast("bigint")
    if unit == "WEEK":
        return F.floor((F.floor(epoch(ts) / 86400) + 3) / 7).cast("bigint")
    return F.floor(months(ts) / {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]).cast("bigint")


def truncate(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit.lower(), ts.cast("timestamp")).cast("timestamp_ntz")


def add_months(ts: Column, n: Any) -> Column:
    """n months later (earlier, if negative) at the same time of day; the last day of shorter months."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return ts.cast("timestamp_ntz") + F.make_ym_interval(F.lit(0), n)


def formatted(ts: Column, fmt: str) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), fmt)
