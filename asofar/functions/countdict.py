"""Functions of count dictionaries (maps from category to number), by higher-order functions on map entries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def _clean(d: Column) -> Column:
    """Without null and NaN values."""
    return F.map_filter(d.cast("map<string,double>"), lambda k, v: v.isNotNull() & ~F.isnan(v))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def without_missing(d: Column, include_missing: bool = True) -> Column:
    return d if include_missing else F.map_filter(d, lambda k, v: k != MISSING)


def _let(value: Column, body: Any) -> Column:
    """Evaluates a value once for a body that uses it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def entropy(d: Column) -> Column:
    """Of the absolute values' shares, with natural logarithms; zeros don't count."""
    values = F.transform(F.map_values(F.map_filter(_clean(d), lambda k, v: v != 0)), F.abs)

    def body(v: Column) -> Column:
        total = _sum(v)
        return -_sum(F.transform(v, lambda x: x / total * F.ln(x / total)))

    return F.when(d.isNotNull(), _let(values, body) + F.lit(0.0))


def _extreme(d: Column, sign: int) -> Column:
    """Entry with the highest (sign 1) or lowest value; the smallest key of equal ones."""
    entries = F.transform(F.map_entries(_clean(d)), lambda e: F.struct((-sign * e["value"]).alias("order"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_min(entries)


def key_with_highest_value(d: Column) -> Column:
    return _extreme(d, 1)["key"]


def highest_value(d: Column) -> Column:
    return _extreme(d, 1)["value"]


def key_with_lowest_value(d: Column) -> Column:
    return _extreme(d, -1)["key"]


most_frequent = key_with_highest_value


def unique_count(d: Column, include_missing: bool = True) -> Column:
    """Number of keys; zero for no dictionary."""
    return F.when(d.isNull(), F.lit(0)).otherwise(F.size(without_missing(d, include_missing))).cast("bigint")


def normalize(d: Column) -> Column:
    """Shares of the sum; empty if the sum is zero."""

    def body(c: Column) -> Column:
        total = _sum(F.map_values(c))
        return F.when(total == 0, F.map_filter(c, lambda k, v: F.lit(False))).otherwise(F.transform_values(c, lambda k, v: v / total))

    return F.when(d.isNotNull(), _let(_clean(d), body))


def divide(d: Column, divisor: Any) -> Column:
    """Each value over a divisor; null if that is null, zero or NaN."""
    b = (divisor if isinstance(divisor, Column) else F.lit(divisor)).cast("double")
    return F.when(b.isNotNull() & ~F.isnan(b) & (b != 0), F.transform_values(_clean(d), lambda k, v: v / b))


def get_value(d: Column, key: Any) -> Column:
    return F.try_element_at(d, (key if isinstance(key, Column) else F.lit(key)).cast("string"))


def get_rank(d: Column, key: Any, descending: bool = False) -> Column:
    """1 plus the number of values that come before the key's; ties share a rank, a key that isn't there has none."""
    v = get_value(_clean(d), key)
    before = F.filter(F.map_values(_clean(d)), (lambda x: x > v) if descending else (lambda x: x < v))
    return F.when(v.isNotNull(), (1 + F.size(before)).cast("double"))


def get_relative_frequency(d: Column, key: Any) -> Column:
    """The key's share of the sum; zero for a key that isn't there."""
    k = (key if isinstance(key, Column) else F.lit(key)).cast("string")
    total = _sum(F.map_values(_clean(d)))
    return F.when(d.isNotNull() & k.isNotNull(), F.coalesce(get_value(_clean(d), k) / F.nullif(total, F.lit(0.0)), F.lit(0.0)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero for an empty dictionary or a zero norm, null for none."""
    x, y = _clean(a), _clean(b)
    dot = _sum(F.transform(F.map_entries(x), lambda e: e["value"] * F.coalesce(F.try_element_at(y, e["key"]), F.lit(0.0))))
    norm = lambda m: F.sqrt(_sum(F.transform(F.map_values(m), lambda v: v * v)))
    size = norm(x) * norm(y)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(size == 0, F.lit(0.0)).otherwise(dot / F.nullif(size, F.lit(0.0))))


def keys(d: Column) -> Column:
    return F.map_keys(d)


def to_text(d: Column) -> Column:
    """A stable text of a dictionary: entries in key order, values rounded to six places."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"].cast("double")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(d)), entry), ";")


def from_rows(category: Column, value: Column) -> Column:
    """Aggregate: a dictionary of one row for each category; a null category is MISSING, null values are left out."""
    entry = F.struct(F.coalesce(category.cast("string"), F.lit(MISSING)).alias("k"), value.cast("double").alias("v"))
    return F.map_from_entries(F.filter(F.collect_list(entry), lambda e: e["v"].isNotNull()))
