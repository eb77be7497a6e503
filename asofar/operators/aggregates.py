"""Aggregate functions in three forms: tile columns, their merge, and direct."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from ..functions import numeric

METHODS = ("sum", "avg", "min", "max", "count", "na_count", "std", "latest", "count_distinct")
VECTOR_METHODS = ("sum", "max", "avg")
#: Those that a difference of running sums gives.
INVERTIBLE = ("sum", "avg", "count", "na_count")


@dataclass(frozen=True)
class Aggregate:
    method: str

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"no such aggregate: {self.method}")

    def tile(self, value: Column, order: Column) -> dict[str, Column]:
        """Partial aggregates of a tile, by suffix. order: a struct that orders rows in time, without ties."""
        v = value
        return {
            "sum": lambda: {"s": F.sum(v)},
            "avg": lambda: {"s": F.sum(v.cast("double")), "n": F.count(v)},
            "min": lambda: {"v": F.min(v)},
            "max": lambda: {"v": F.max(v)},
            "count": lambda: {"n": F.count(F.lit(1))},
            "na_count": lambda: {"n": F.count_if(v.isNull())},
            "std": lambda: {"q": F.sum(v.cast("double") * v), "s": F.sum(v.cast("double")), "n": F.count(v)},
            "latest": lambda: {"v": F.max_by(v, order), "t": F.max(order)},
        }[self.method]()

    def merge(self, part: dict[str, Column], frame: WindowSpec | None = None) -> Column:
        """The aggregate over tiles from their partial columns: of a group, or of a frame."""
        p = part
        of = (lambda c: c) if frame is None else (lambda c: c.over(frame))
        total = lambda s: of(F.sum(p[s]))
        return {
            "sum": lambda: total("s"),
            "avg": lambda: F.try_divide(total("s"), total("n")),
            "min": lambda: of(F.min(p["v"])),
            "max": lambda: of(F.max(p["v"])),
            "count": lambda: total("n"),
            "na_count": lambda: total("n"),
            "std": lambda: population_std(total("q"), total("s"), total("n")),
            "latest": lambda: of(F.max_by(p["v"], p["t"])),
        }[self.method]()

    def direct(self, value: Column, order: Column | None = None) -> Column:
        """The aggregate over rows. The deviation is that of a sample here."""
        v = value
        return {
            "sum": lambda: F.sum(v),
            "avg": lambda: F.avg(v),
            "min": lambda: F.min(v),
            "max": lambda: F.max(v),
            "count": lambda: F.count(F.lit(1)),
            "na_count": lambda: F.count_if(v.isNull()),
            "std": lambda: F.stddev_samp(v),
            "latest": lambda: F.max_by(v, order),
            "count_distinct": lambda: distinct_values(v),
        }[self.method]()

    def parts(self, value: Column, exact: bool = False) -> dict[str, Column]:
        """Partial aggregates of direct(), by suffix; exact: the value is a decimal. Distinct values have none: rows are counted."""
        v = value
        return {
            "sum": lambda: {"s": F.sum(v)},
            "avg": lambda: {"s": F.sum(v if exact else v.cast("double")), "n": F.count(v)},
            "min": lambda: {"v": F.min(v)},
            "max": lambda: {"v": F.max(v)},
            "count": lambda: {"n": F.count(F.lit(1))},
            "na_count": lambda: {"n": F.count_if(v.isNull())},
            "std": lambda: {"p": F.struct(F.count(v).alias("n"), F.avg(v.cast("double")).alias("m"), (F.var_pop(v.cast("double")) * F.count(v)).alias("q"))},
            "count_distinct": lambda: {"n": F.count(F.lit(1))},
        }[self.method]()

    def whole(self, part: dict[str, Column]) -> Column:
        """direct() of a group from its partial columns."""
        p = part
        if self.method == "std":
            return sample_std(F.array_sort(F.collect_list(p["p"])))
        return F.sum(p["n"]) if self.method == "count_distinct" else self.merge(p)


def sample_std(moments: Column) -> Column:
    """Of several samples' (number n, mean m, sum of squares about it q), merged one by one; null for less than two values."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def add(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["m"] - a["m"]
        return F.struct(n.alias("n"), (a["m"] + d * b["n"] / n).alias("m"), (a["q"] + b["q"] + d * d * a["n"] * b["n"] / n).alias("q"))

    return F.aggregate(F.filter(moments, lambda e: e["n"] > 0), start, add, lambda e: F.when(e["n"] > 1, F.sqrt(e["q"] / (e["n"] - 1))))


def distinct_values(v: Column) -> Column:
    """Distinct values; null counts as one."""
    return F.count_distinct(v) + F.max(v.isNull().cast("bigint"))


def population_std(squares: Column, total: Column, n: Column) -> Column:
    """sqrt(E[x^2] - E[x]^2), never of a negative number; null for no values. greatest() would skip the null."""
    mean = F.try_divide(total, n)
    variance = F.try_divide(squares, n) - mean * mean
    return F.sqrt(F.when(variance < 0, F.lit(0.0)).otherwise(variance))


def filled(value: Column, method: str, fill: object, skip: bool | None, has_category: bool) -> Column:
    """fill for no rows. Without a fill value nothing is filled, unless skip is False: counts are zero then."""
    if fill is not None and has_category:
        raise ValueError("a dictionary takes no fill value")
    skip = fill is None if skip is None else skip
    if skip or has_category:
        return value
    if fill is None and method in ("count", "na_count"):
        fill = 0
    return value if fill is None else F.coalesce(value, numeric.as_column(fill))
