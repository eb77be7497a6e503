"""Tables by role. Each gives a view of its role, cleaned unless raw is asked for."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning, joins, profile
from ..plans.views import ChangeView, DimensionView, EventView, ItemView, SCDView, SnapshotsView, TimeSeriesView, with_end


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def literal(spark: SparkSession, rows: list[tuple[Any, ...]], schema: str) -> DataFrame:
    """A frame of given rows."""
    return spark.createDataFrame(rows, schema)


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Structs' leaves as columns."""

    def leaves(schema: T.StructType, path: list[str]) -> list[list[str]]:
        return [x for f in schema.fields for x in (leaves(f.dataType, [*path, f.name]) if isinstance(f.dataType, T.StructType) else [[*path, f.name]])]

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in leaves(df.schema, [])])


def partition_filter(df: DataFrame, column: str, low: Any, high: Any, buffer_days: int = 0, fmt: str | None = None) -> DataFrame:
    """Rows of partitions between two dates, widened by a buffer; with a format the column holds texts that order like dates."""
    a, b = (F.date_add(F.lit(x).cast("date"), s * buffer_days) for x, s in ((low, -1), (high, 1)))
    if fmt:
        a, b = F.date_format(a, fmt), F.date_format(b, fmt)
    return df.filter(F.col(column).between(a, b))


def entity_filter(df: DataFrame, entities: DataFrame, keys: list[str], ts: str | None = None) -> DataFrame:
    """Rows of the entities' keys, and with ts in each entity's range [start, end)."""
    if ts is None:
        return df.join(entities.select(*keys).distinct(), keys, "left_semi")
    spans = entities.groupBy(*keys).agg(F.min("start").alias("__start"), F.max("end").alias("__end"))
    return df.join(spans, keys).filter((F.col(ts) >= F.col("__start")) & (F.col(ts) < F.col("__end"))).drop("__start", "__end")


class Table:
    def __init__(self, df: DataFrame, cleaning_operations: dict[str, list[Any]] | None = None) -> None:
        self.raw = df
        self.operations = dict(cleaning_operations or {})

    def developed(self, df: DataFrame) -> Table:
        """The same table over other rows, those of a development dataset; they need the same columns and types."""
        lacks = [f"{c} {t}" for c, t in self.raw.dtypes if (c, t) not in df.dtypes]
        if lacks:
            raise ValueError(f"the development rows lack {', '.join(lacks)}")
        out = copy.copy(self)
        out.raw, out.operations = df.select(*[F.col(f"`{c}`") for c in self.raw.columns]), dict(self.operations)
        return out

    def update_cleaning(self, column: str, operations: list[Any]) -> None:
        self.operations[column] = operations

    def rows(self, raw: bool = False) -> DataFrame:
        return self.raw if raw else cleaning.clean(self.raw, self.operations)

    def preview(self, limit: int = 10, after_cleaning: bool = False) -> Any:
        return self.rows(not after_cleaning).limit(limit).toPandas()

    def shape(self) -> tuple[int, int]:
        return self.raw.count(), len(self.raw.columns)

    def sample(self, size: int = 10, seed: int = 1234, after_cleaning: bool = False) -> DataFrame:
        return profile.sample(self.rows(not after_cleaning), size, seed)

    def describe(self, after_cleaning: bool = False) -> DataFrame:
        return profile.describe(self.rows(not after_cleaning))

    def deduplicated(self, key: str) -> DataFrame:
        return joins.deduplicated(self.rows(), [key])


class EventTable(Table):
    """Immutable events with an id and a time."""

    def __init__(self, df: DataFrame, event_id: str, ts: str, **more: Any) -> None:
        super().__init__(df, more.pop("cleaning", None))
        self.event_id, self.ts, self.more = event_id, ts, more

    def get_view(self, raw: bool = False) -> EventView:
        return EventView(self.rows(raw), self.event_id, self.ts, **self.more)


class ItemTable(Table):
    """Items of events; an item's time is its event's."""

    def __init__(self, df: DataFrame, item_id: str, event_id: str, events: EventTable, cleaning: dict[str, list[Any]] | None = None) -> None:
        super().__init__(df, cleaning)
        self.item_id, self.event_id, self.events = item_id, event_id, events

    def get_view(self, raw: bool = False, event_suffix: str = "") -> ItemView:
        event = self.events.get_view(raw)
        ts = f"{event.ts}{event_suffix}"
        df = joins.equi_join(self.rows(raw), event.df, [self.event_id], [event.key], {event.ts: ts}, "left")
        return ItemView(df, self.item_id, ts, tie=[self.event_id, self.item_id], event_id=self.event_id, event_view=event)


class DimensionTable(Table):
    def __init__(self, df: DataFrame, key: str, cleaning: dict[str, list[Any]] | None = None) -> None:
        super().__init__(df, cleaning)
        self.key = key

    def get_view(self, raw: bool = False) -> DimensionView:
        return DimensionView(self.rows(raw), self.key)


class SCDTable(Table):
    """History of a natural key: each row holds from its time on, to its end if it has one or to the next row's time."""

    def __init__(self, df: DataFrame, key: str, ts: str, end: str | None = None, flag: str | None = None, cleaning: dict[str, list[Any]] | None = None) -> None:
        super().__init__(df, cleaning)
        self.key, self.ts, self.end, self.flag = key, ts, end, flag

    def get_view(self, raw: bool = False) -> SCDView:
        more = {k: v for k, v in (("end", self.end), ("flag", self.flag)) if v}
        return SCDView(self.rows(raw), self.key, self.ts, **more)

    def current(self) -> DataFrame:
        """The row of each key that holds now: by flag, or without a later one."""
        df = self.rows()
        if self.flag:
            return df.filter(F.col(self.flag))
        return with_end(df, self.key, self.ts, "__to").filter("__to is null").drop("__to")

    def get_change_view(self, column: str) -> ChangeView:
        """Changes of a column: the key, new and past values, and since when each has held."""
        k, t, c = (F.col(f"`{x}`") for x in (self.key, self.ts, column))
        line = Window.partitionBy(k).orderBy(t)
        rows = self.rows().withColumn("__past", F.lag(c).over(line)).withColumn("__first", F.row_number().over(line))
        changed = rows.filter((F.col("__first") == 1) | ~c.eqNullSafe(F.col("__past")))
        df = changed.select(k, t.alias(f"new_{self.ts}"), c.alias(f"new_{column}"), F.lag(t).over(line).alias(f"past_{self.ts}"), F.lag(c).over(line).alias(f"past_{column}"))
        return ChangeView(df, self.key, f"new_{self.ts}", tie=[])

    def validate(self) -> DataFrame:
        return profile.invalid_history(self.raw, self.key, self.ts, self.flag)


class TimeSeriesTable(Table):
    """A value for each series at a fixed interval of (local) time."""

    def __init__(self, df: DataFrame, series_id: str, ts: str, unit: str = "DAY", zone: str | None = None, cleaning: dict[str, list[Any]] | None = None) -> None:
        super().__init__(df, cleaning)
        self.series_id, self.ts, self.unit, self.zone = series_id, ts, unit, zone

    def get_view(self, raw: bool = False) -> TimeSeriesView:
        return TimeSeriesView(self.rows(raw), self.series_id, self.ts, tie=[], unit=self.unit, zone=self.zone)


class SnapshotsTable(Table):
    """All entities at each snapshot time. lag_units: how many units a snapshot is late."""

    def __init__(self, df: DataFrame, key: str, ts: str, unit: str = "DAY", lag_units: int = 1, cleaning: dict[str, list[Any]] | None = None) -> None:
        super().__init__(df, cleaning)
        self.key, self.ts, self.unit, self.lag_units = key, ts, unit, lag_units

    def get_view(self, raw: bool = False) -> SnapshotsView:
        return SnapshotsView(self.rows(raw), self.key, self.ts, tie=[], unit=self.unit, lag_units=self.lag_units)


def lookup_parents(request: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """request with the keys of parent entities, each step (table, child key, parent key) joined in turn."""
    for table, child, parent in steps:
        request = joins.equi_join(request, table, [child], [child], {parent: parent}, "left")
    return request
