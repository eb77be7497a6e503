"""Operators and accessors that view columns, features and request columns share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import countdict, numeric, temporal, text, vector


class Expression:
    """A lazy column. Subclasses say what may be combined and how a result is wrapped."""

    col: Column

    def _wrap(self, col: Column, *others: Any) -> Any:
        raise NotImplementedError

    def _kind(self) -> str:
        """Spark's name of the type, where it is known."""
        return ""

    @staticmethod
    def _other(value: Any) -> Column:
        if isinstance(value, Expression):
            return value.col
        if isinstance(value, dt.timedelta):
            return F.lit(int(value / dt.timedelta(microseconds=1)))
        return F.lit(value)

    def _two(self, other: Any, make: Any) -> Any:
        return self._wrap(make(self.col, self._other(other)), other)

    def __add__(self, other: Any) -> Any:
        kinds = {self._kind(), other._kind() if isinstance(other, Expression) else "string" if isinstance(other, str) else ""}
        if "string" in kinds:
            return self._two(other, text.concat)
        if self._kind().startswith("timestamp"):
            return self._two(other, temporal.add)
        return self._two(other, lambda a, b: a + b)

    def __radd__(self, other: Any) -> Any:
        if self._kind() == "string":
            return self._two(other, lambda a, b: text.concat(b, a))
        return self._two(other, lambda a, b: b + a)

    def __sub__(self, other: Any) -> Any:
        if self._kind().startswith("timestamp"):
            if isinstance(other, Expression) and other._kind().startswith("timestamp"):
                gap = self._two(other, lambda a, b: temporal.micros(a) - temporal.micros(b))
                if hasattr(gap, "_type"):
                    gap._type = "bigint"
                return gap
            return self._two(other, lambda a, b: temporal.add(a, -b))
        return self._two(other, lambda a, b: a - b)

    def __rsub__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: b - a)

    def __mul__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: a * b)

    __rmul__ = __mul__

    def __truediv__(self, other: Any) -> Any:
        return self._two(other, numeric.divide)

    def __rtruediv__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: numeric.divide(b, a))

    def __mod__(self, other: Any) -> Any:
        return self._two(other, numeric.modulo)

    def __rmod__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: numeric.modulo(b, a))

    def __pow__(self, other: Any) -> Any:
        return self._two(other, numeric.power)

    pow = __pow__

    def __and__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: a & b)

    def __or__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: a | b)

    def __invert__(self) -> Any:
        return self._wrap(~self.col)

    def __neg__(self) -> Any:
        return self._wrap(-self.col)

    def __eq__(self, other: Any) -> Any:  # type: ignore[override]
        return self._two(other, lambda a, b: a == b)

    def __ne__(self, other: Any) -> Any:  # type: ignore[override]
        return self._two(other, lambda a, b: a != b)

    def __lt__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: a < b)

    def __le__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: a <= b)

    def __gt__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: a > b)

    def __ge__(self, other: Any) -> Any:
        return self._two(other, lambda a, b: a >= b)

    __hash__ = None  # type: ignore[assignment]

    def isnull(self) -> Any:
        return self._wrap(self.col.isNull())

    def notnull(self) -> Any:
        return self._wrap(self.col.isNotNull())

    def isin(self, options: Sequence[Any] | Expression) -> Any:
        """options: values, an array column, or a dictionary's keys."""
        if isinstance(options, Expression):
            c = options.col
            return self._wrap(numeric.is_in(self.col, F.map_keys(c) if options._kind().startswith("map") else c), options)
        return self._wrap(numeric.is_in(self.col, options))

    def fillna(self, value: Any) -> Any:
        return self._wrap(F.coalesce(self.col, F.lit(value)))

    def where(self, mask: Expression, value: Any) -> Any:
        """value where the mask is true, the column elsewhere."""
        return self._wrap(numeric.conditional(self.col, mask.col, self._other(value)), mask, value)

    def astype(self, kind: type | str) -> Any:
        name = kind if isinstance(kind, str) else kind.__name__
        return self._wrap(numeric.cast(self.col, name, self._kind()))

    def try_astype(self, kind: str) -> Any:
        return self._wrap(numeric.try_cast(self.col, kind))

    def __getattr__(self, name: str) -> Any:
        f = numeric.UNARY.get(name)
        if f is None:
            raise AttributeError(name)
        return lambda: self._wrap(f(self.col))

    @property
    def str(self) -> Strings:
        return Strings(self)

    @property
    def dt(self) -> Dates:
        return Dates(self)

    @property
    def cd(self) -> Dictionaries:
        return Dictionaries(self)

    @property
    def vec(self) -> Vectors:
        return Vectors(self)


class _Accessor:
    def __init__(self, of: Expression) -> None:
        self._of = of

    def _give(self, col: Column, *others: Any) -> Any:
        return self._of._wrap(col, *others)


class Strings(_Accessor):
    def len(self) -> Any:
        return self._give(F.length(self._of.col))

    def lower(self) -> Any:
        return self._give(F.lower(self._of.col))

    def upper(self) -> Any:
        return self._give(F.upper(self._of.col))

    def strip(self, chars: str | None = None) -> Any:
        return self._give(text.trim(self._of.col, chars))

    def lstrip(self, chars: str | None = None) -> Any:
        return self._give(text.trim(self._of.col, chars, "left"))

    def rstrip(self, chars: str | None = None) -> Any:
        return self._give(text.trim(self._of.col, chars, "right"))

    def replace(self, pat: str, repl: str) -> Any:
        return self._give(text.replace(self._of.col, pat, repl))

    def pad(self, width: int, side: str = "left", fillchar: str = " ") -> Any:
        return self._give(text.pad(self._of.col, width, side, fillchar))

    def contains(self, pat: str, case: bool = True) -> Any:
        return self._give(text.contains(self._of.col, pat, case))

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> Any:
        if step not in (None, 1):
            raise ValueError("a slice has step 1")
        return self._give(text.cut(self._of.col, start, stop))

    def __getitem__(self, item: slice) -> Any:
        return self.slice(item.start, item.stop, item.step)


class Dates(_Accessor):
    """Parts of timestamps in local time (tz_offset) and of durations."""

    def __init__(self, of: Expression, zone: Any = None) -> None:
        super().__init__(of)
        self._zone = zone

    def tz_offset(self, zone: Any) -> Dates:
        return Dates(self._of, zone)

    def __getattr__(self, name: str) -> Any:
        part = {"day_of_week": "dayofweek"}.get(name, name)
        zone = self._zone.col if isinstance(self._zone, Expression) else self._zone
        if part in temporal.PARTS and not self._of._kind().startswith(("bigint", "int")):
            return self._give(temporal.extract(self._of.col, part, zone), self._zone)
        if part in temporal.MICROS:
            return self._give(temporal.duration_in(self._of.col, part))
        raise AttributeError(name)


class Dictionaries(_Accessor):
    def entropy(self) -> Any:
        return self._give(countdict.entropy(self._of.col))

    def most_frequent(self) -> Any:
        return self._give(countdict.most_frequent(self._of.col))

    def key_with_highest_value(self) -> Any:
        return self._give(countdict.key_with_highest_value(self._of.col))

    def key_with_lowest_value(self) -> Any:
        return self._give(countdict.key_with_lowest_value(self._of.col))

    def unique_count(self, include_missing: bool = True) -> Any:
        return self._give(countdict.unique_count(self._of.col, include_missing))

    def normalize(self) -> Any:
        return self._give(countdict.normalize(self._of.col))

    def divide(self, other: Any) -> Any:
        return self._give(countdict.divide(self._of.col, Expression._other(other)), other)

    def get_value(self, key: Any) -> Any:
        return self._give(countdict.get_value(self._of.col, Expression._other(key)), key)

    def get_rank(self, key: Any, descending: bool = False) -> Any:
        return self._give(countdict.get_rank(self._of.col, Expression._other(key), descending), key)

    def get_relative_frequency(self, key: Any) -> Any:
        return self._give(countdict.get_relative_frequency(self._of.col, Expression._other(key)), key)

    def cosine_similarity(self, other: Expression) -> Any:
        return self._give(countdict.cosine_similarity(self._of.col, other.col), other)

    def keys(self) -> Any:
        return self._give(countdict.keys(self._of.col))


class Vectors(_Accessor):
    def cosine_similarity(self, other: Expression) -> Any:
        return self._give(vector.cosine_similarity(self._of.col, other.col), other)
