"""Joins that a warehouse has and Spark lacks: deduplicated, as-of and window joins, all as equality exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the least one by the other columns in order, so reruns agree. Rows with a null key go."""
    rest = [c for c in df.columns if c not in keys]
    df = df.dropna(subset=keys)
    if not rest:
        return df.distinct()
    kinds = dict(df.dtypes)
    order = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") if not kinds[c].startswith("map") else F.to_json(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(rest)])
    payload = F.struct(*[F.col(f"`{c}`") for c in rest])
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(payload, order).alias("__best"))
    return best.select(*[F.col(f"`{k}`") for k in keys], *[F.col("__best")[c].alias(c) for c in rest])


def equi_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], columns: dict[str, str], how: str = "left", unique: bool = False) -> DataFrame:
    """left with columns (name in right: name in the result) of the right row of equal key. Left rows are never repeated."""
    need = list(dict.fromkeys([*right_on, *columns]))
    r = right.select(*[F.col(f"`{c}`") for c in need])
    r = r if unique else deduplicated(r, right_on)
    r = r.select(*[F.col(f"`{k}`").alias(f"__r{i}") for i, k in enumerate(right_on)], *[F.col(f"`{a}`").alias(f"__c{i}") for i, a in enumerate(columns)])
    on = None
    for i, k in enumerate(left_on):
        same = left[f"`{k}`"] == F.col(f"__r{i}")
        on = same if on is None else on & same
    out = left.join(r, on, how)
    return out.select(*[left[f"`{c}`"] for c in left.columns if c not in columns.values()], *[F.col(f"__c{i}").alias(b) for i, b in enumerate(columns.values())])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: list[str],
    right_on: list[str],
    left_ts: Column,
    right_ts: Column,
    columns: dict[str, str],
    exact: bool = True,
    end_ts: Column | None = None,
    tie: list[str] | None = None,
    how: str = "left",
    period: int | None = None,
) -> DataFrame:
    """left with columns of the latest right row of equal key at or before (exact) or before (not exact) the left time.

    Both sides are laid on one time line for each key and the last right row is carried forward, payload and all, so one exchange
    does. Of right rows at one time the last by the columns in tie is taken. end_ts: a row counts only before it, or if it is null.
    period: seconds. With it a key's time line is cut into periods that go to different tasks, each led by the last row before; use it
    where few keys have most rows.
    """
    names = list(columns)
    fields = [F.col(f"`{a}`").alias(f"c{i}") for i, a in enumerate(names)]
    end = temporal.micros(end_ts) if end_ts is not None else F.lit(None).cast("bigint")
    r = right.filter(right_ts.isNotNull())
    for k in right_on:
        r = r.filter(F.col(f"`{k}`").isNotNull())
    order = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(tie if tie is not None else names)]) if (tie or names) else F.lit(None)
    r = r.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(right_on)], temporal.micros(right_ts).alias("__t"), end.alias("__end"), order.alias("__o"), F.struct(F.lit(1).alias("hit"), *fields).alias("__p"))
    # one row for each time, so a tie never depends on the plan
    r = r.groupBy(*[f"__k{i}" for i in range(len(right_on))], "__t").agg(F.max_by(F.struct("__p", "__end"), F.struct(F.col("__o"))).alias("__v")) if (tie or names) else r.groupBy(*[f"__k{i}" for i in range(len(right_on))], "__t").agg(F.max(F.struct("__p", "__end")).alias("__v"))
    l = left.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(left_on)], temporal.micros(left_ts).alias("__t"), F.struct(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(left.columns)]).alias("__l"))
    keys = [f"__k{i}" for i in range(len(left_on))]
    both = l.withColumn("__side", F.lit(2 if exact else 0)).unionByName(r.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    if period:
        both = both.withColumn("__period", F.floor(F.col("__t") / (period * 1_000_000)))
        ends = both.filter("__side = 1").groupBy(*keys, "__period").agg(F.max_by("__v", "__t").alias("__lead"))
        marks = both.select(*keys, "__period").distinct().join(ends, [*keys, "__period"], "left")
        before = Window.partitionBy(*keys).orderBy("__period").rowsBetween(Window.unboundedPreceding, -1)
        leads = marks.select(*keys, "__period", F.last("__lead", ignorenulls=True).over(before).alias("__lead"))
        # keys of left rows may be null: they match nothing and need no lead
        both = both.join(leads, [*keys, "__period"], "left")
        line = Window.partitionBy(*keys, "__period").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
        found = F.coalesce(F.last("__v", ignorenulls=True).over(line), F.col("__lead"))
    else:
        line = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
        found = F.last("__v", ignorenulls=True).over(line)
    out = both.withColumn("__found", found).filter("__side <> 1")
    known = F.col("__t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    valid = known & F.col("__found").isNotNull() & (F.col("__found")["__end"].isNull() | (F.col("__t") < F.col("__found")["__end"]))
    if how == "inner":
        out = out.filter(valid)
    got = [F.when(valid, F.col("__found")["__p"][f"c{i}"]).alias(b) for i, b in enumerate(columns.values())]
    return out.select(*[F.col("__l")[f"l{i}"].alias(c) for i, c in enumerate(left.columns) if c not in columns.values()], *got)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, at: Column, width: int, name: str = "__at") -> DataFrame:
    """Rows of left with those of right of equal keys for which low <= at < high; high - low is at most width.

    low, high and at are whole numbers. Each left row goes to the buckets of that width that its range touches, two at most, and the
    join is an equality on keys and bucket. Columns of left and right other than keys must differ.
    """
    b = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    l = left.withColumn("__low", low).withColumn("__high", high).filter("__low < __high")
    l = l.withColumn("__bucket", F.explode(F.array_distinct(F.array(b(F.col("__low")), b(F.col("__high") - 1)))))
    r = right.withColumn(name, at).withColumn("__bucket", b(F.col(name)))
    return l.join(r, [*keys, "__bucket"], "inner").filter((F.col(name) >= F.col("__low")) & (F.col(name) < F.col("__high"))).drop("__low", "__high", "__bucket")


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on columns of equal name; right has one row for each key."""
    return left.join(right, keys, "left")
