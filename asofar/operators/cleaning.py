"""Data cleaning: imputations and casts that are part of a view."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, temporal


@dataclass(frozen=True)
class MissingValue:
    imputed: Any

    def apply(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(self.imputed))

    def matches(self, value: Any) -> bool:
        return value is None


@dataclass(frozen=True)
class DisguisedValue:
    """Values of a list stand for missing ones; nulls stay."""

    values: tuple[Any, ...]
    imputed: Any

    def apply(self, c: Column) -> Column:
        return F.when(numeric.is_in(c, self.values), F.lit(self.imputed)).otherwise(c)

    def matches(self, value: Any) -> bool:
        return value in self.values


@dataclass(frozen=True)
class UnexpectedValue:
    """Anything but the values of a list is replaced, nulls too."""

    expected: tuple[Any, ...]
    imputed: Any

    def apply(self, c: Column) -> Column:
        return F.when(~numeric.is_in(c, self.expected), F.lit(self.imputed)).otherwise(c)

    def matches(self, value: Any) -> bool:
        return value not in self.expected


@dataclass(frozen=True)
class ValueBeyond:
    """kind: one of < <= > >=; values beyond the end point are replaced."""

    kind: str
    end: Any
    imputed: Any

    def _beyond(self, x: Any) -> Any:
        return {"<": lambda: x < self.end, "<=": lambda: x <= self.end, ">": lambda: x > self.end, ">=": lambda: x >= self.end}[self.kind]()

    def apply(self, c: Column) -> Column:
        return F.when(self._beyond(c), F.lit(self.imputed)).otherwise(c)

    def matches(self, value: Any) -> bool:
        return value is not None and bool(self._beyond(value))


@dataclass(frozen=True)
class StringValue:
    """Texts that aren't numbers are replaced."""

    imputed: Any

    def apply(self, c: Column) -> Column:
        return F.when(numeric.is_string(c.cast("string")), F.lit(self.imputed).cast("string")).otherwise(c.cast("string"))

    def matches(self, value: Any) -> bool:
        return isinstance(value, str)


@dataclass(frozen=True)
class CastToNumeric:
    def apply(self, c: Column) -> Column:
        return c.try_cast("double")

    def matches(self, value: Any) -> bool:
        return False


@dataclass(frozen=True)
class ParseTimestamp:
    """Texts of a format, in a time zone, become UTC timestamps; the last operation of a column."""

    fmt: str
    zone: str | None = None

    def apply(self, c: Column) -> Column:
        return temporal.parse(c.cast("string"), self.fmt, self.zone)

    def matches(self, value: Any) -> bool:
        return False


def clean(df: DataFrame, operations: dict[str, list[Any]]) -> DataFrame:
    """Each column's operations in order; imputations keep the column's type."""
    kinds = dict(df.dtypes)
    out = {}
    for name, ops in operations.items():
        c = F.col(f"`{name}`")
        for i, op in enumerate(ops):
            for later in ops[i + 1 :]:
                if hasattr(op, "imputed") and later.matches(op.imputed):
                    raise ValueError(f"{name}: {later} would replace what {op} imputes")
            if isinstance(op, ParseTimestamp) and i < len(ops) - 1:
                raise ValueError(f"{name}: parsing comes last")
            c = op.apply(c)
            if not isinstance(op, (CastToNumeric, ParseTimestamp)) and not any(isinstance(o, CastToNumeric) for o in ops[:i]):
                c = c.try_cast(kinds[name]) if kinds[name] != "string" else c.cast("string")
        out[name] = c
    return df.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
