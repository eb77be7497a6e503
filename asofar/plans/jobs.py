"""Feature job schedules: periodic (period, offset, blind spot) and by crontab, and the window arithmetic that follows from them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from functools import lru_cache
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal

MAX_TILES = 53_424
#: A table of at most so many days, some 270 years, may be broadcast.
DAYS = 100_000
_UNITS = {"s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(text: str | int | None) -> int:
    """Seconds of a duration such as 90s, 5m, 1h, 7d, 2w or 1h30m; zero for none."""
    if text is None:
        return 0
    if isinstance(text, int):
        return text
    parts = re.findall(r"(\d+)\s*(min|[smhdw])", text.strip())
    if not parts or "".join(f"{a}{b}" for a, b in parts) != re.sub(r"\s+", "", text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(a) * _UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Schedule:
    """A job runs every period, offset after the period's start, and sees data older than the blind spot."""

    period: str
    offset: str = "0s"
    blind_spot: str = "0s"

    def __post_init__(self) -> None:
        if not 0 <= self.o < self.p:
            raise ValueError("the offset must be shorter than the period")
        if self.b < 0:
            raise ValueError("the blind spot can't be negative")

    @property
    def p(self) -> int:
        return seconds(self.period)

    @property
    def o(self) -> int:
        return seconds(self.offset)

    @property
    def b(self) -> int:
        return seconds(self.blind_spot)

    def validate(self, window: int | None, offset: int = 0) -> None:
        for name, size in (("window", window), ("window offset", offset)):
            if size and size % self.p:
                raise ValueError(f"the {name} must be a multiple of the period")
        if window is not None and (window < self.p or window // self.p > MAX_TILES):
            raise ValueError("the window must hold between one and 53424 tiles")

    def tile_index(self, ts: Column) -> Column:
        """Number of the tile that a row falls in."""
        return F.floor((temporal.epoch(ts) - (self.o - self.b)) / self.p).cast("bigint")

    def last_tile(self, pit: Column) -> Column:
        """Number of the first tile that the latest job at a point in time doesn't see."""
        return F.floor((temporal.epoch(pit) - self.o) / self.p).cast("bigint")

    def tile_end_micros(self, index: Column) -> Column:
        """Where a tile begins, in microseconds; also where the one before ends."""
        return (index * self.p + (self.o - self.b)) * 1_000_000


@dataclass(frozen=True)
class CalendarWindow:
    """size calendar units (MINUTE, HOUR, DAY, WEEK, MONTH, QUARTER, YEAR)."""

    unit: str
    size: int = 1


@dataclass(frozen=True)
class CronSchedule:
    """A job runs at a crontab's ticks (five fields, in a time zone)."""

    crontab: str
    timezone: str = "UTC"
    blind_spot: str = "0s"

    @property
    def b(self) -> int:
        return seconds(self.blind_spot)

    def __post_init__(self) -> None:
        self._minutes()
        # the days of a leap-year cycle with a century's gap in it; a crontab without a tick there has none at all
        if not any(self._on(date(1896, 1, 1) + timedelta(days=k)) for k in range(3288)):
            raise ValueError(f"the crontab never fires: {self.crontab!r}")

    def _fields(self) -> list[set[int]]:
        return _parsed(self.crontab)

    def _minutes(self) -> list[tuple[int, int]]:
        minute, hour, *_ = self._fields()
        return [(h, m) for h in sorted(hour) for m in sorted(minute)]

    def _on(self, at: date) -> bool:
        """Whether there are ticks on a local day. Day and weekday: both must fit if one is a star, else either."""
        _, _, day, month, weekday = self._fields()
        stars = [self.crontab.split()[k] == "*" for k in (2, 4)]
        by_day, by_weekday = at.day in day, at.isoweekday() % 7 in {d % 7 for d in weekday}
        return at.month in month and ((by_day and by_weekday) if any(stars) else (by_day or by_weekday))

    def longest_gap(self) -> int:
        """Seconds that no tick may come for, at most: the days between two days with ticks, of a leap-year cycle and a century's gap."""
        if self.crontab.split()[2:] == ["*", "*", "*"]:
            return 2 * 86400
        days = [k for k in range(2 * 3288) if self._on(date(1896, 1, 1) + timedelta(days=k))]
        return (max([b - a for a, b in zip(days[:-1], days[1:], strict=True)], default=3288) + 1) * 86400

    def ticks(self, start: datetime, end: datetime) -> list[datetime]:
        """UTC ticks in [start, end); start and end are zoneless UTC."""
        zone, out = ZoneInfo(self.timezone), set()
        at = start.replace(tzinfo=timezone.utc).astimezone(zone).date()
        last = end.replace(tzinfo=timezone.utc).astimezone(zone).date()
        minutes = self._minutes()
        while at <= last:
            if self._on(at):
                for h, m in minutes:
                    t = datetime(at.year, at.month, at.day, h, m, tzinfo=zone).astimezone(timezone.utc).replace(tzinfo=None)
                    if start <= t < end:
                        out.add(t)
            at += timedelta(days=1)
        return sorted(out)

    def last_before(self, at: datetime) -> datetime:
        """The last tick before a zoneless UTC time."""
        span, upto = 2, at
        while True:
            found = self.ticks(upto - timedelta(days=span), upto)
            if found:
                return found[-1]
            upto, span = upto - timedelta(days=span), 4 * span

    def job_times(self, points: DataFrame, pit: str, name: str = "__job") -> DataFrame:
        """points with the last tick strictly before each point in time.

        A row for each day that the points span carries the last tick before it and the number of its pattern of ticks (seconds of the
        day). Patterns are few, as only changes of the clock make new ones, so an every-minute crontab over decades stays small:
        below DAYS days both tables are broadcast.
        """
        spark: SparkSession = points.sparkSession
        p = F.col(pit).cast("timestamp_ntz")
        low, high = points.agg(F.min(p).cast("string"), F.max(p).cast("string")).first()
        if low is None:
            return points.withColumn(name, F.lit(None).cast("timestamp_ntz"))
        first, end = (datetime.combine(datetime.fromisoformat(x).date(), time()) for x in (low, high))
        patterns: dict[tuple[int, ...], int] = {(): 0}
        rows: list[tuple[Any, ...]] = []
        at, before = first, self.last_before(first)
        while at <= end:
            own = self.ticks(at, at + timedelta(days=1))
            said = tuple(int((t - at).total_seconds()) for t in own)
            rows.append((at.date(), patterns.setdefault(said, len(patterns)), before))
            before = own[-1] if own else before
            at += timedelta(days=1)
        days = spark.createDataFrame(rows, "__day date, __pattern int, __before timestamp_ntz")
        kinds = spark.createDataFrame([(k, list(said)) for said, k in patterns.items()], "__pattern int, __ticks array<int>")
        small = F.broadcast if len(rows) <= DAYS else (lambda df: df)
        joined = points.join(small(days), p.cast("date") == F.col("__day"), "left").join(F.broadcast(kinds), "__pattern", "left")
        since = temporal.micros(p) - temporal.micros(F.col("__day"))
        inside = F.array_max(F.filter("__ticks", lambda t: t.cast("bigint") * 1_000_000 < since))
        own = temporal.from_micros(temporal.micros(F.col("__day")) + inside.cast("bigint") * 1_000_000)
        return joined.withColumn(name, F.coalesce(own, "__before")).drop("__day", "__pattern", "__ticks", "__before")


@lru_cache(maxsize=1000)
def _parsed(crontab: str) -> list[set[int]]:
    return [_field(f, *r) for f, r in zip(crontab.split(), ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True)]


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        body, _, step = part.partition("/")
        if body == "*":
            a, b = low, high
        elif "-" in body:
            a, b = map(int, body.split("-"))
        else:
            a = int(body)
            b = high if step else a
        out |= set(range(a, b + 1, int(step or 1)))
    if not out or min(out) < low or max(out) > high:
        raise ValueError(f"not a crontab field: {text!r}")
    return out
