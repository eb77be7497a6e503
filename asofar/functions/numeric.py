"""Arithmetic, comparison, casts and geometry with the engine's null rules: no operation raises on bad data."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def as_column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def divide(a: Column, b: Any) -> Column:
    """a / b; null for a zero divisor."""
    return a.cast("double") / F.nullif(as_column(b).cast("double"), F.lit(0.0))


def modulo(a: Column, b: Any) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    b = as_column(b)
    return a % F.nullif(b, F.lit(0).cast("int"))


def power(a: Column, b: Any) -> Column:
    return F.pow(a, as_column(b))


def log(a: Column) -> Column:
    return F.ln(a)


UNARY = {f.__name__: f for f in (F.abs, F.sqrt, F.exp, F.cos, F.sin, F.tan, F.acos, F.asin, F.atan)} | {
    "log": log,
    "floor": lambda a: F.floor(a).cast("bigint"),
    "ceil": lambda a: F.ceil(a).cast("bigint"),
}


def cast(a: Column, kind: str, source: str = "") -> Column:
    """kind: int, float or str. Fractions are floored on their way to int; booleans become 0 and 1."""
    if source == "boolean" and kind != "str":
        a = a.cast("int")
    if kind == "int":
        return F.floor(a).cast("bigint") if source in ("double", "float") or source.startswith("decimal") else a.cast("bigint")
    return a.cast({"float": "double", "str": "string"}[kind])


def try_cast(a: Column, kind: str) -> Column:
    return a.try_cast({"int": "bigint", "float": "double", "str": "string"}[kind])


def is_in(a: Column, options: Sequence[Any] | Column) -> Column:
    """Membership; a null is never a member, and the answer is never null."""
    hit = F.array_contains(options, a) if isinstance(options, Column) else a.isin(list(options))
    return F.coalesce(hit, F.lit(False))


def is_string(a: Column) -> Column:
    """Whether a text can't be read as a number."""
    return a.isNotNull() & a.try_cast("double").isNull()


def conditional(a: Column, mask: Column, value: Any) -> Column:
    return F.when(mask, as_column(value)).otherwise(a)


def atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (p2 - p1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))
