"""Features, targets and lists of them, computed for a table of requests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import Expression
from .planner import PIT, Planner
from .specs import AnyLeaf


class Feature(Expression):
    """An expression over aggregations, lookups and request columns; it has no rows until a request gives it some."""

    def __init__(self, col: Column, leaves: tuple[AnyLeaf, ...] = (), name: str | None = None, kind: str = "") -> None:
        self.col, self.leaves, self.name, self._type = col, leaves, name, kind

    def _kind(self) -> str:
        return self._type

    def _wrap(self, col: Column, *others: Any) -> Feature:
        leaves = dict.fromkeys(self.leaves)
        for o in others:
            if isinstance(o, Feature):
                leaves |= dict.fromkeys(o.leaves)
            elif isinstance(o, Expression):
                raise TypeError("a feature can't be combined with a view's column")
        return type(self)(col, tuple(leaves))

    def alias(self, name: str) -> Feature:
        return type(self)(self.col, self.leaves, name, self._type)

    def compute(self, request: DataFrame) -> DataFrame:
        return FeatureList([self]).compute_historical_features(request)

    def null_filling_value(self, request: DataFrame) -> Any:
        """What the feature is for an entity without data: its expression on nulls."""
        blank = request.limit(0).select(*[F.col(c) for c in request.columns])
        row = FeatureList([self]).compute_historical_features(blank)
        kinds = {c: t for c, t in row.dtypes}
        typed = self.col
        spark = request.sparkSession
        types = dict(Planner(blank, prune=False).attach(list(self.leaves)).dtypes)
        frame = spark.range(1).select(*[F.lit(None).cast(types[x.column]).alias(x.column) for x in self.leaves], *[F.lit(None).cast(t).alias(c) for c, t in request.dtypes])
        return frame.select(typed.cast(kinds[self.name or "feature"]).alias("v")).first()[0]


class Target(Feature):
    def compute_targets(self, request: DataFrame) -> DataFrame:
        return self.compute(request)


def request_column(name: str, kind: str = "") -> Feature:
    """A column of the request table in a feature's expression."""
    return Feature(F.col(f"`{name}`"), (), name, kind)


def point_in_time() -> Feature:
    return request_column(PIT, "timestamp_ntz")


def forecast_point() -> Feature:
    """The request's FORECAST_POINT: the time that a prediction is about."""
    return request_column("FORECAST_POINT", "timestamp_ntz")


class FeatureGroup:
    def __init__(self, features: list[Feature]) -> None:
        self.features = {f.name: f for f in features}

    def __getitem__(self, item: str | list[str]) -> Any:
        return self.features[item] if isinstance(item, str) else FeatureGroup([self.features[i] for i in item])

    def __iter__(self) -> Any:
        return iter(self.features.values())


class FeatureList:
    """Features that are computed together, in one plan."""

    def __init__(self, items: list[Feature | FeatureGroup]) -> None:
        self.features: list[Feature] = [f for i in items for f in ([i] if isinstance(i, Feature) else i)]
        names = [f.name for f in self.features]
        if len(set(names)) < len(names):
            raise ValueError("features must have different names")

    def compute_historical_features(self, request: DataFrame, serving_names: dict[str, str] | None = None, prune: bool = True) -> DataFrame:
        """request with a column for each feature. serving_names: the request's names of key columns, by the features' own."""
        shown = request.columns
        named = request
        for own, theirs in (serving_names or {}).items():
            named = named.withColumnRenamed(theirs, own)
        leaves = list(dict.fromkeys(x for f in self.features for x in f.leaves))
        wide = Planner(named, prune=prune).attach(leaves)
        back = {own: theirs for own, theirs in (serving_names or {}).items()}
        kept = [F.col(f"`{c}`").alias(back.get(c, c)) for c in named.columns if back.get(c, c) in shown]
        return wide.select(*kept, *[f.col.alias(f.name or "feature") for f in self.features])

    def compute_online_features(self, entities: DataFrame, at: Any = None) -> DataFrame:
        """Features of entities as of now, or of another time; the request has no point in time of its own."""
        when = F.lit(at).cast("timestamp_ntz") if at is not None else F.current_timestamp().cast("timestamp_ntz")
        return self.compute_historical_features(entities.withColumn(PIT, when)).drop(PIT)

    def compute_in_batches(self, request: DataFrame, path: str, size: int = 20) -> DataFrame:
        """As compute_historical_features, with a plan for each few features: results are written under path and joined on the request's row numbers.

        The request is written with its numbers first, so they are the same for every batch, also after executors are lost.
        """
        number = "__row_index"
        spark = request.sparkSession
        request.withColumn(number, F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/request")
        numbered = out = spark.read.parquet(f"{path}/request")
        for k, some in enumerate(self.batches(size)):
            got = some.compute_historical_features(numbered).select(number, *[f.name or "feature" for f in some.features])
            got.write.mode("overwrite").parquet(f"{path}/batch-{k}")
            out = out.join(spark.read.parquet(f"{path}/batch-{k}"), number, "left")
        return out.drop(number)

    def ingest(self, entities: DataFrame, at: Any) -> dict[tuple[str, ...], DataFrame]:
        """What can be computed ahead, by keys: the aggregations and lookups of the features for entities as of a time, without expressions over them."""
        groups: dict[tuple[str, ...], list[AnyLeaf]] = {}
        for x in dict.fromkeys(x for f in self.features for x in f.leaves):
            groups.setdefault(x.serving, []).append(x)
        when = F.lit(at).cast("timestamp_ntz")
        out = {}
        for serving, leaves in groups.items():
            asked = entities.select(*serving).dropna().distinct().withColumn(PIT, when)
            out[serving] = Planner(asked).attach(leaves).select(*serving, *[x.column for x in leaves])
        return out

    def serve(self, stored: dict[tuple[str, ...], DataFrame], request: DataFrame) -> DataFrame:
        """On demand: the features' expressions over what ingest() stored and the columns of the request, which may hold a point in time."""
        out = request
        for serving, table in stored.items():
            out = out.join(table, list(serving), "left")
        return out.select(*[F.col(f"`{c}`") for c in request.columns], *[f.col.alias(f.name or "feature") for f in self.features])

    def batches(self, size: int = 20) -> list[FeatureList]:
        return [FeatureList(self.features[i : i + size]) for i in range(0, len(self.features), size)]
