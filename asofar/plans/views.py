"""Views: column-oriented lazy frames over tables of a known role, and what can be declared from them."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import joins, profile
from ..operators.aggregates import VECTOR_METHODS, filled
from .expressions import Expression
from .features import Feature, FeatureGroup, Target
from .jobs import CalendarWindow, CronSchedule, Schedule, seconds
from .specs import AsAtAggregation, CalendarAggregation, ForwardAggregation, ItemAggregation, Lookup, Source, WindowAggregation

_tokens = itertools.count()


class ViewColumn(Expression):
    """A column of a view; columns combine only with those of the same rows."""

    def __init__(self, view: View, col: Column, name: str | None = None) -> None:
        self.view, self.col, self.name = view, col, name

    def _kind(self) -> str:
        return self.view.df.select(self.col.alias("c")).dtypes[0][1]

    def _wrap(self, col: Column, *others: Any) -> ViewColumn:
        for o in others:
            if isinstance(o, ViewColumn) and o.view.rows != self.view.rows:
                raise ValueError("columns of different rows can't be combined")
            if isinstance(o, Feature):
                raise TypeError("a view's column can't be combined with a feature")
        return ViewColumn(self.view, col)

    def __getitem__(self, mask: ViewColumn) -> ViewColumn:
        return ViewColumn(self.view[mask], self.col, self.name)

    def __setitem__(self, mask: ViewColumn, value: Any) -> None:
        """Changes the masked rows; a named column changes in its view."""
        new = self.where(mask, value)
        self.col = new.col
        if self.name:
            self.view[self.name] = new

    def lag(self, entity_columns: str | list[str], offset: int = 1) -> ViewColumn:
        """The value offset rows before, of the same entities, in the order of the view's time."""
        keys = [entity_columns] if isinstance(entity_columns, str) else entity_columns
        if "__lag" in str(getattr(self, "lineage", "")):
            raise ValueError("a lagged column can't be lagged again")
        v = self.view
        order = [F.col(f"`{c}`") for c in (v.ts, *v.tie) if c]
        out = ViewColumn(v, F.lag(self.col, offset).over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)))
        out.lineage = "__lag"
        return out

    def frame(self) -> DataFrame:
        return self.view.df.select(self.col.alias(self.name or "value"))

    def preview(self, limit: int = 10) -> Any:
        return self.frame().limit(limit).toPandas()

    def describe(self) -> DataFrame:
        return profile.describe(self.frame())

    def sample(self, size: int = 10, seed: int = 1234) -> DataFrame:
        return profile.sample(self.frame(), size, seed)

    def value_counts(self, limit: int = 500) -> DataFrame:
        return profile.value_counts(self.frame(), self.name or "value", limit)

    def as_feature(self, feature_name: str, offset: str | None = None, fill_value: Any = None) -> Feature:
        view = self.view if self.name else self.view.assigned("__value", self)
        return view.as_features([self.name or "__value"], [feature_name], offset, fill_value)[feature_name]

    def as_target(self, target_name: str, offset: str | None = None, fill_value: Any = None) -> Target:
        view = self.view if self.name else self.view.assigned("__value", self)
        leaf = view._lookup(self.name or "__value", seconds(offset))
        return Target(filled(F.col(leaf.column), "", fill_value, None, False), (leaf,), target_name, view._type(self.name or "__value"))


class View:
    """Rows of a table. ts: the column of their time; key: that of their identity; tie: columns that order rows of equal time."""

    kind = "dimension"

    def __init__(self, df: DataFrame, key: str | None = None, ts: str | None = None, tie: list[str] | None = None, **more: Any) -> None:
        self.df, self.key, self.ts, self.tie, self.more = df, key, ts, list(tie if tie is not None else [key] if key and ts and self.kind in ("event", "item") else []), more
        self.rows = next(_tokens)
        self.token = f"v{next(_tokens)}"

    def _like(self, df: DataFrame, same_rows: bool = False) -> View:
        out = object.__new__(type(self))
        out.__dict__ = {**self.__dict__, "df": df, "token": f"v{next(_tokens)}"}
        if not same_rows:
            out.rows = next(_tokens)
        return out

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def _type(self, name: str) -> str:
        return dict(self.df.dtypes)[name]

    def __getitem__(self, item: Any) -> Any:
        if isinstance(item, str):
            if item not in self.columns:
                raise KeyError(item)
            return ViewColumn(self, F.col(f"`{item}`"), item)
        if isinstance(item, ViewColumn):
            if item.view.rows != self.rows:
                raise ValueError("the mask has other rows than the view")
            return self._like(self.df.filter(item.col))
        held = [c for c in (self.key, self.ts, *self.tie, *self.more.values()) if isinstance(c, str) and c in self.columns and c not in item]
        return self._like(self.df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*held, *item])]), same_rows=True)

    def __setitem__(self, name: Any, value: Any) -> None:
        if isinstance(name, tuple):
            mask, name = name
            value = self[name].where(mask, value)
        if isinstance(value, ViewColumn) and value.view.rows != self.rows:
            raise ValueError("the column has other rows than the view")
        if name in (self.key, self.ts):
            raise ValueError("key and time columns can't be replaced")
        self.df = self.df.withColumn(name, value.col if isinstance(value, ViewColumn) else F.lit(value))
        self.token = f"v{next(_tokens)}"

    def assigned(self, name: str, value: Any) -> View:
        out = self._like(self.df, same_rows=True)
        out[name] = value
        return out

    def join(self, other: View, on: str | None = None, how: str = "left", rsuffix: str = "", rprefix: str = "") -> View:
        """Columns of the other view's row of equal key; of a history the row as of this view's time. Rows are never repeated."""
        if how not in ("left", "inner"):
            raise ValueError("how is left or inner")
        on = on or other.key
        if on is None or on not in self.columns:
            raise ValueError("say which column to join on")
        skip = {other.key, *(c for c in (other.more.get("end"), other.more.get("flag")) if c)}
        names = {c: f"{rprefix}{c}{rsuffix}" for c in other.columns if c not in skip}
        clash = set(names.values()) & set(self.columns)
        if clash:
            raise ValueError(f"both views have {sorted(clash)}; give rsuffix or rprefix")
        if other.kind == "history":
            end = other.more.get("end")
            df = joins.asof_join(self.df, other.df, [on], [other.key], F.col(f"`{self.ts}`"), F.col(f"`{other.ts}`"), names, end_ts=F.col(f"`{end}`") if end else None, tie=other.tie or None, how=how)
        elif other.kind == "snapshot" and self.ts:
            unit = other.more["unit"]
            left = self.df.withColumn("__unit", temporal.calendar_index(F.col(f"`{self.ts}`"), unit) - other.more.get("lag_units", 0))
            right = other.df.withColumn("__unit", temporal.calendar_index(F.col(f"`{other.ts}`"), unit))
            df = joins.equi_join(left, right, [on, "__unit"], [other.key, "__unit"], names, how).drop("__unit")
        else:
            df = joins.equi_join(self.df, other.df, [on], [other.key], names, how)
        return self._like(df.select(*[c for c in self.columns], *names.values()), same_rows=how == "left")

    def groupby(self, by_keys: str | list[str], category: str | None = None, serving_names: list[str] | None = None) -> GroupBy:
        return GroupBy(self, [by_keys] if isinstance(by_keys, str) else list(by_keys), category, serving_names)

    def _lookup(self, column: str, shift: int, serving: str | None = None) -> Lookup:
        kind = {"history": "history", "event": "event", "item": "event", "snapshot": "snapshot"}.get(self.kind, "static")
        if kind == "static" and shift:
            raise ValueError("rows without a time take no offset")
        return Lookup(Source(self.token, self.df), (self.key,), (serving or self.more.get("serving") or self.key,), column, kind, shift, self.ts if kind != "static" else None, self.more.get("end"), self.more.get("unit"), self.more.get("lag_units", 0), tuple(self.tie) if kind == "history" else ())

    def as_features(self, column_names: list[str], feature_names: list[str], offset: str | None = None, fill_value: Any = None) -> FeatureGroup:
        out = []
        for c, n in zip(column_names, feature_names, strict=True):
            leaf = self._lookup(c, -seconds(offset))
            out.append(Feature(filled(F.col(leaf.column), "", fill_value, None, False), (leaf,), n, self._type(c)))
        return FeatureGroup(out)

    def between(self, start: Any, end: Any) -> View:
        """Rows of start <= time < end; the comparison reaches the scan."""
        c = F.col(f"`{self.ts}`")
        return self._like(self.df.filter((c >= F.lit(start).cast(self._type(self.ts))) & (c < F.lit(end).cast(self._type(self.ts)))))

    def preview(self, limit: int = 10) -> Any:
        return self.df.limit(limit).toPandas()

    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    def sample(self, size: int = 10, seed: int = 1234, from_timestamp: Any = None, to_timestamp: Any = None) -> DataFrame:
        view = self if from_timestamp is None and to_timestamp is None else self.between(from_timestamp or "0001-01-01", to_timestamp or "9999-12-31")
        return profile.sample(view.df, size, seed)

    def describe(self) -> DataFrame:
        return profile.describe(self.df)

    def create_observation_table(self, columns: dict[str, str], sample_rows: int | None = None, seed: int = 1234) -> DataFrame:
        """Requests from a view's rows. columns: the request's names by the view's own; one of them is the point in time."""
        df = self.df.select(*[F.col(f"`{a}`").alias(b) for a, b in columns.items()]).dropna()
        return df if sample_rows is None else profile.sample(df, sample_rows, seed)

    create_batch_request_table = create_observation_table

    def create_static_source_table(self, path: str, sample_rows: int | None = None) -> DataFrame:
        df = self.df if sample_rows is None else profile.sample(self.df, sample_rows, 1234)
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)


class EventView(View):
    kind = "event"

    def add_feature(self, new_column_name: str, feature: Feature, entity_column: str | None = None) -> None:
        """A column from a feature that needs no point in time: an aggregate of items joined on the event's key."""
        (leaf,) = feature.leaves
        if not isinstance(leaf, ItemAggregation):
            raise ValueError("only aggregates of items can be added")
        from .planner import Planner

        own = entity_column or self.key
        request = self.df.withColumn("__event", F.col(f"`{own}`")).withColumnRenamed(leaf.serving[0], "__hidden") if leaf.serving[0] != own and leaf.serving[0] in self.columns else self.df
        request = request if leaf.serving[0] in request.columns else request.withColumn(leaf.serving[0], F.col(f"`{own}`"))
        wide = Planner(request, prune=False).attach([leaf]).withColumn(new_column_name, feature.col)
        if "__hidden" in wide.columns:
            wide = wide.drop(leaf.serving[0]).withColumnRenamed("__hidden", leaf.serving[0])
        self.df = wide.select(*[F.col(f"`{c}`") for c in self.columns if c != new_column_name], new_column_name)
        self.token = f"v{next(_tokens)}"


class ItemView(View):
    kind = "item"

    def join_event_table_attributes(self, columns: list[str], event_suffix: str = "") -> ItemView:
        event: EventView = self.more["event_view"]
        names = {c: f"{c}{event_suffix}" for c in columns}
        return self._like(joins.equi_join(self.df, event.df, [self.more["event_id"]], [event.key], names, "left"), same_rows=True)


class DimensionView(View):
    kind = "dimension"


class SCDView(View):
    kind = "history"


class ChangeView(View):
    kind = "change"


class TimeSeriesView(View):
    kind = "series"


class SnapshotsView(View):
    kind = "snapshot"


_WINDOWED = ("event", "item", "change", "series", "snapshot")


class GroupBy:
    def __init__(self, view: View, keys: list[str], category: str | None, serving: list[str] | None) -> None:
        self.view, self.keys, self.category = view, tuple(keys), category
        self.serving = tuple(serving or keys)
        for c in (*keys, *([category] if category else [])):
            if c not in view.columns:
                raise KeyError(c)

    def _base(self, value: str | None, method: str, forbidden: tuple[str, ...] = ()) -> dict[str, Any]:
        if method in forbidden:
            raise ValueError(f"{method} isn't supported here")
        if value is None and method != "count":
            raise ValueError("a value column is needed")
        if value is not None and value not in self.view.columns:
            raise KeyError(value)
        vec = value is not None and self.view._type(value).startswith("array") and method in VECTOR_METHODS
        return {"source": Source(self.view.token, self.view.df), "keys": self.keys, "serving": self.serving, "value": value, "method": method, "category": self.category, "vector": vec}

    def _feature(self, leaf: Any, name: str, fill: Any, skip: bool | None, make: type = Feature) -> Any:
        kind = "map" if leaf.category else "bigint" if leaf.method in ("count", "na_count", "count_distinct") else ""
        return make(filled(F.col(leaf.column), leaf.method, fill, skip, leaf.category is not None), (leaf,), name, kind)

    def _only(self, kinds: tuple[str, ...]) -> None:
        if self.view.kind not in kinds:
            raise ValueError(f"not supported by a {self.view.kind} view")

    def aggregate_over(self, value_column: str | None, method: str, windows: list[Any], feature_names: list[str], feature_job_setting: Schedule | CronSchedule, timestamp_column: str | None = None, fill_value: Any = None, skip_fill_na: bool | None = None, offset: str | CalendarWindow | None = None) -> FeatureGroup:
        """A feature for each window before the last job; window None is all time, for latest only."""
        self._only(_WINDOWED)
        v, ts = self.view, timestamp_column or self.view.ts
        out = []
        for w, name in zip(windows, feature_names, strict=True):
            base = self._base(value_column, method)
            if isinstance(w, CalendarWindow):
                shift = 0
                if isinstance(offset, CalendarWindow):
                    if offset.unit != w.unit:
                        raise ValueError("window and offset must have the same unit")
                    shift = offset.size
                leaf = CalendarAggregation(**base, window=w, offset=shift, schedule=feature_job_setting, ts=ts, tie=tuple(v.tie), zone=v.more.get("zone"))
            else:
                if w is None and (method != "latest" or self.category):
                    raise ValueError("only latest, without a category, has no window")
                size = None if w is None else seconds(w)
                feature_job_setting.validate(size, seconds(offset))
                leaf = WindowAggregation(**base, window=size, offset=seconds(offset), schedule=feature_job_setting, ts=ts, tie=tuple(v.tie))
            out.append(self._feature(leaf, name, fill_value, skip_fill_na))
        return FeatureGroup(out)

    def aggregate(self, value_column: str | None, method: str, feature_name: str, fill_value: Any = None, skip_fill_na: bool | None = None) -> Feature:
        self._only(("item",))
        return self._feature(ItemAggregation(**self._base(value_column, method, ("latest",))), feature_name, fill_value, skip_fill_na)

    def _asat(self, value: str | None, method: str, shift: int) -> AsAtAggregation:
        v = self.view
        self._only(("history", "snapshot", "series"))
        end = v.more.get("end")
        df = v.df
        if not end:
            end, df = "__valid_to", with_end(v.df, v.key, v.ts, "__valid_to")
        base = self._base(value, method, ("latest",)) | {"source": Source(v.token, df)}
        return AsAtAggregation(**base, shift=shift, start=v.ts, end=end)

    def aggregate_asat(self, value_column: str | None, method: str, feature_name: str, offset: str | None = None, backward: bool = True, fill_value: Any = None, skip_fill_na: bool | None = None) -> Feature:
        """Over rows valid at the point in time less (backward) or plus an offset."""
        return self._feature(self._asat(value_column, method, -seconds(offset) if backward else seconds(offset)), feature_name, fill_value, skip_fill_na)

    def forward_aggregate(self, value_column: str | None, method: str, window: str, target_name: str, fill_value: Any = None, skip_fill_na: bool | None = None, offset: str | None = None) -> Target:
        """Over rows of (pit + offset, pit + offset + window]."""
        self._only(("event", "item", "change"))
        leaf = ForwardAggregation(**self._base(value_column, method, ("latest",)), window=seconds(window), offset=seconds(offset), ts=self.view.ts, tie=tuple(self.view.tie))
        return self._feature(leaf, target_name, fill_value, skip_fill_na, Target)

    def forward_aggregate_asat(self, value_column: str | None, method: str, target_name: str, offset: str | None = None, fill_value: Any = None, skip_fill_na: bool | None = None) -> Target:
        return self._feature(self._asat(value_column, method, seconds(offset)), target_name, fill_value, skip_fill_na, Target)


def with_end(df: DataFrame, key: str, ts: str, name: str) -> DataFrame:
    """A history with the time at which each row's next one begins."""
    later = Window.partitionBy(F.col(f"`{key}`")).orderBy(F.col(f"`{ts}`"))
    return df.withColumn(name, F.lead(F.col(f"`{ts}`")).over(later))
