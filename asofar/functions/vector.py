"""Vectors: similarity and element-wise aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero if a vector is empty, NaN for a zero norm, an error for unequal lengths, null for a missing vector."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    size = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double"))
        .when(size == 0, F.lit(float("nan")))
        .otherwise(dot / F.nullif(size, F.lit(0.0)))
    )


def elementwise(df: DataFrame, keys: list[str], vector: str, method: str, name: str) -> DataFrame:
    """keys and name: element-wise sum, max or avg of the vectors of each group; null vectors are skipped, unequal lengths raise.

    Elements are aggregated by position with partial aggregation, so no group's vectors meet in one place.
    """
    func = {"sum": F.sum, "max": F.max, "avg": F.avg}[method]
    rows = df.filter(F.col(vector).isNotNull()).select(*keys, F.size(vector).alias("__n"), F.posexplode(vector).alias("__i", "__x"))
    parts = rows.groupBy(*keys, "__i").agg(func(F.col("__x").cast("double")).alias("__v"), F.min("__n").alias("__least"), F.max("__n").alias("__most"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__e"), F.min("__least").alias("__least"), F.max("__most").alias("__most"))
    out = F.transform("__e", lambda e: e["__v"])
    return whole.select(*keys, F.when(F.col("__least") == F.col("__most"), out).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("array<double>")).alias(name))
