"""Rows valid at points in time, without a list of pairs of rows and times.

The times asked of a key are numbered in order, so a row is valid at a range of numbers. Ranges are cut into aligned blocks of powers of two, two
of a size at most, and a number lies in one block of each size: n rows and m times make n log m and m log m entries to aggregate and to join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a period: a key's times are numbered by period first, so no task sorts all of them.
_PERIOD = 3_600_000_000
#: Wider blocks than 2**_TOP are told as several of that width, so no block is joined with more times.
_TOP = 16


def numbered(asked: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """asked (keys, __t; distinct) with __n, a time's number, and __of, how many its key has; rows (keys, __a, __b and more) with [__low, __high).

    A row is valid from __a until before __b, or ever after if that is null; its numbers are those of the times within. Rows that no time sees go.
    """
    told = rows.select(*keys, F.explode(F.array("__a", "__b")).alias("__t"), F.lit(0).alias("__one")).filter("__t is not null")
    stamps = asked.select(*keys, "__t", F.lit(1).alias("__one")).unionByName(told).groupBy(*keys, "__t").agg(F.max("__one").alias("__one"))
    stamps = stamps.withColumn("__period", F.floor(F.col("__t") / F.lit(_PERIOD)))
    line = Window.partitionBy(*keys)
    before = line.orderBy("__period").rowsBetween(Window.unboundedPreceding, -1)
    periods = stamps.groupBy(*keys, "__period").agg(F.sum("__one").alias("__some"))
    periods = periods.select(*keys, "__period", F.coalesce(F.sum("__some").over(before), F.lit(0)).alias("__first"), F.sum("__some").over(line).alias("__of"))
    within = Window.partitionBy(*keys, "__period").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    stamps = stamps.withColumn("__n", F.coalesce(F.sum("__one").over(within), F.lit(0))).join(periods.filter("__of > 0"), [*keys, "__period"])
    stamps = stamps.select(*keys, "__t", "__one", (F.col("__first") + F.col("__n")).alias("__n"), "__of")
    # rows without an end match nothing: they are dealt by their other columns
    spread = F.when(F.col("__b").isNull(), F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind])).otherwise(F.lit(0))
    starts = stamps.select(*keys, F.col("__t").alias("__a"), F.col("__n").alias("__low"), "__of")
    ends = stamps.select(*keys, F.col("__t").alias("__b"), F.lit(0).cast("bigint").alias("__spread"), F.col("__n").alias("__high"))
    seen = rows.withColumn("__spread", spread).join(starts, [*keys, "__a"]).join(ends, [*keys, "__b", "__spread"], "left")
    seen = seen.withColumn("__high", F.coalesce("__high", "__of")).filter("__low < __high").drop("__a", "__b", "__spread", "__of")
    return stamps.filter("__one = 1").select(*keys, "__t", "__n", "__of"), seen


def blocks(rows: DataFrame) -> DataFrame:
    """rows with [__low, __high) once for each block (__level, __block) of its cut."""
    out = rows.withColumn("__level", F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("__high") - F.col("__low"))) - 1)))
    out = out.withColumn("__from", F.expr("shiftright(__low + shiftleft(1L, __level) - 1, __level)")).withColumn("__to", F.expr("shiftright(__high, __level)"))
    left, right = F.when(F.col("__from") % 2 != 0, F.col("__from")), F.when(F.col("__to") % 2 != 0, F.col("__to") - 1)
    out = out.filter("__from < __to").withColumn("__block", F.explode(F.array(left, right))).filter("__block is not null")
    return out.drop("__low", "__high", "__from", "__to")


def holders(asked: DataFrame) -> DataFrame:
    """Numbered times once for each block that holds them, up to the widest."""
    out = asked.withColumn("__level", F.explode(F.sequence(F.lit(0), F.least(F.length(F.bin("__of")) - 1, F.lit(_TOP)))))
    return out.withColumn("__block", F.expr("shiftright(__n, __level)")).drop("__n", "__of")


def told(parts: DataFrame) -> DataFrame:
    """Aggregates by block with those of blocks beyond the widest told of each of that width within."""
    by = F.greatest(F.col("__level") - _TOP, F.lit(0))
    out = parts.withColumn("__by", by).withColumn("__level", F.least("__level", F.lit(_TOP)))
    return out.withColumn("__block", F.explode(F.expr("sequence(shiftleft(__block, __by), shiftleft(__block + 1, __by) - 1)"))).drop("__by")


def disjoint(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and [__low, __high): the numbers that some row of a group covers, each once."""
    spans = rows.groupBy(*by, "__low").agg(F.max("__high").alias("__high"))
    before = Window.partitionBy(*by).orderBy("__low").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__low", F.greatest("__low", F.max("__high").over(before)))
    return spans.filter("__low < __high")
