"""Request tables: observation tables with checks and statistics, batch requests, and the entities that a feature has data for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import profile
from ..plans.features import Feature
from ..plans.planner import PIT
from ..plans.specs import AsAtAggregation, CalendarAggregation, ForwardAggregation, ItemAggregation, Lookup, WindowAggregation

ROW_INDEX = "__row_index"


@dataclass(frozen=True)
class ObservationTable:
    """Checked requests and one row of statistics: first, last, rows, least_gap (seconds between an entity's points), entities of each key."""

    df: DataFrame
    keys: tuple[str, ...]
    stats: DataFrame


def observation_table(
    df: DataFrame,
    keys: list[str],
    pit: str = PIT,
    since: Any = None,
    until: Any = None,
    columns: list[str] | None = None,
    target: str | None = None,
    rates: dict[object, float] | None = None,
    row_key: list[str] | None = None,
    sample_rows: int | None = None,
    seed: int = 1234,
) -> ObservationTable:
    """Requests of since <= point in time < until, without rows that lack it or a key.

    rates: down-sampling by the target's values, with the weight of each row; sample_rows: a random sample of what is left. row_key: what
    identifies a row for down-sampling; by default keys and point in time.
    """
    missing = {pit, *keys, *(columns or []), *([target] if target else [])} - set(df.columns)
    if missing:
        raise ValueError(f"the table lacks {sorted(missing)}")
    kind = dict(df.dtypes)[pit]
    if not kind.startswith("timestamp"):
        raise TypeError(f"{pit} must be a timestamp, not {kind}")
    shown = list(dict.fromkeys([pit, *keys, *(columns or [c for c in df.columns if c not in (pit, *keys)]), *([target] if target else [])]))
    rows = df.select(*[F.col(f"`{c}`") for c in shown]).withColumnRenamed(pit, PIT).dropna(subset=[PIT, *keys])
    at = F.col(PIT)
    if since is not None:
        rows = rows.filter(at >= F.lit(since).cast(kind))
    if until is not None:
        rows = rows.filter(at < F.lit(until).cast(kind))
    if rates:
        if not target:
            raise ValueError("down-sampling needs a target")
        rows = profile.down_sample(rows, target, rates, key=row_key or [*keys, PIT], seed=seed)
    if sample_rows is not None:
        rows = profile.sample(rows, sample_rows, seed)
    return ObservationTable(rows, tuple(keys), _stats(rows, keys))


def _stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    gap = profile.observation_stats(rows.withColumn("__entity", F.struct(*keys)), PIT, "__entity").select("first", "last", "rows", "least_gap")
    counts = rows.agg(*[F.count_distinct(k).alias(f"n_{k}") for k in keys])
    # one row each
    return gap.join(F.broadcast(counts))


def batch_request_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct entities to compute features for at one time; a batch request has no points in time of its own."""
    if PIT in keys:
        raise ValueError("a batch request takes no point in time")
    return df.select(*[F.col(f"`{k}`") for k in keys]).dropna().distinct()


def entity_universe(features: list[Feature], since: Any, until: Any) -> DataFrame:
    """The distinct entities that the features have data for in since <= time < until: who has to be computed anew.

    Features must have the same keys. Rows without a time count always; a history's row counts if it begins then, or holds then if it has an end.
    """
    leaves = list(dict.fromkeys(x for f in features for x in f.leaves))
    serving = {x.serving for x in leaves}
    if len(serving) != 1:
        raise ValueError("the features must have the same keys")
    (names,) = serving
    parts = []
    for x in leaves:
        rows = x.source.df
        kinds = dict(rows.dtypes)
        lit = lambda t, c: F.lit(t).cast(kinds[c])  # noqa: B023, E731
        if isinstance(x, (WindowAggregation, CalendarAggregation, ForwardAggregation)):
            rows = rows.filter((F.col(f"`{x.ts}`") >= lit(since, x.ts)) & (F.col(f"`{x.ts}`") < lit(until, x.ts)))
        elif isinstance(x, AsAtAggregation):
            rows = rows.filter((F.col(f"`{x.start}`") < lit(until, x.start)) & (F.col(f"`{x.end}`").isNull() | (F.col(f"`{x.end}`") > lit(since, x.end))))
        elif isinstance(x, Lookup) and x.ts:
            rows = rows.filter((F.col(f"`{x.ts}`") >= lit(since, x.ts)) & (F.col(f"`{x.ts}`") < lit(until, x.ts)))
        elif not isinstance(x, (ItemAggregation, Lookup)):
            raise TypeError(f"no universe for {type(x).__name__}")
        parts.append(rows.select(*[F.col(f"`{k}`").alias(s) for k, s in zip(x.keys, x.serving, strict=True)]))
    return reduce(DataFrame.unionByName, parts).dropna(subset=list(names)).distinct()


@dataclass(frozen=True)
class ForecastPoint:
    """How a FORECAST_POINT column is read: the time that a prediction is about, in UTC or in a time zone (a name, or a column of names)."""

    granularity: str = "DAY"
    fmt: str | None = None
    is_utc: bool = True
    timezone: str | None = None
    timezone_column: str | None = None
    column: str = "FORECAST_POINT"

    def __post_init__(self) -> None:
        if self.granularity not in ("MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"):
            raise ValueError(f"no such granularity: {self.granularity}")
        if self.timezone and self.timezone_column:
            raise ValueError("a time zone or a column of them, not both")
        if not self.is_utc and not (self.timezone or self.timezone_column):
            raise ValueError("local times need a time zone")

    @property
    def _zone(self) -> Any:
        return F.col(f"`{self.timezone_column}`") if self.timezone_column else self.timezone

    def _read(self) -> Any:
        c = F.col(f"`{self.column}`")
        return temporal.parse(c, self.fmt) if self.fmt else c.cast("timestamp_ntz")

    def local(self) -> Feature:
        """The forecast point as local time: its parts are those of the calendar there."""
        c = self._read()
        return Feature(temporal.local(c, self._zone) if self.is_utc and self._zone is not None else c, (), "forecast_local", "timestamp_ntz")

    def utc(self) -> Feature:
        c = self._read()
        return Feature(c if self.is_utc else temporal.to_utc(c, self._zone), (), "forecast_utc", "timestamp_ntz")

    def until(self, unit: str = "day") -> Feature:
        """How long the forecast point is after the point in time."""
        return Feature(temporal.difference(self.utc().col, F.col(PIT), unit), (), "forecast_until", "double")

    def index(self) -> Feature:
        """The number of the local calendar unit: equal for forecast points that the granularity doesn't tell apart."""
        return Feature(temporal.calendar_index(self.local().col, self.granularity), (), "forecast_index", "bigint")
