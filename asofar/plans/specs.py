"""What a feature is made of: frozen descriptions of aggregations and lookups. Equal descriptions are computed once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame

from .jobs import CalendarWindow, CronSchedule, Schedule


@dataclass(frozen=True)
class Source:
    """A view's rows. Two sources are the same if their tokens are."""

    token: str
    df: DataFrame = field(compare=False, repr=False, hash=False)


@dataclass(frozen=True)
class Leaf:
    source: Source
    keys: tuple[str, ...]
    serving: tuple[str, ...]

    @property
    def column(self) -> str:
        said = ";".join(f"{f.name}={getattr(self, f.name)!r}" for f in fields(self))
        return "__agg_" + hashlib.sha1(f"{type(self).__name__}:{said}".encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Aggregation(Leaf):
    value: str | None
    method: str
    category: str | None
    vector: bool = False


@dataclass(frozen=True)
class WindowAggregation(Aggregation):
    """Over rows of [job - blind spot - offset - window, job - blind spot - offset); window None: since ever (latest only)."""

    window: int | None = None
    offset: int = 0
    schedule: Schedule = Schedule("1h")
    ts: str = ""
    tie: tuple[str, ...] = ()


@dataclass(frozen=True)
class CalendarAggregation(Aggregation):
    """Over whole calendar units before the last cron tick."""

    window: CalendarWindow = CalendarWindow("DAY")
    offset: int = 0
    schedule: CronSchedule = CronSchedule("0 0 * * *")
    ts: str = ""
    tie: tuple[str, ...] = ()
    zone: str | None = None


@dataclass(frozen=True)
class ItemAggregation(Aggregation):
    """Over all rows of a key, whatever the time."""


@dataclass(frozen=True)
class AsAtAggregation(Aggregation):
    """Over rows valid at the point in time plus shift."""

    shift: int = 0
    start: str = ""
    end: str = ""


@dataclass(frozen=True)
class ForwardAggregation(Aggregation):
    """Over rows of (pit + offset, pit + offset + window]."""

    window: int = 0
    offset: int = 0
    ts: str = ""
    tie: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lookup(Leaf):
    """A column of the row of a key. kind: static; history (as of the point in time plus shift); event (once it has happened); snapshot."""

    value: str
    kind: str = "static"
    shift: int = 0
    ts: str | None = None
    end: str | None = None
    unit: str | None = None
    lag_units: int = 0
    tie: tuple[str, ...] = ()


AnyLeaf = Any
