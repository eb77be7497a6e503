"""Exploration: samples, splits, statistics and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def sample(df: DataFrame, size: int, seed: int = 1234) -> DataFrame:
    """size random rows: a pre-filter by probability, then the rows of least random number, without a full sort."""
    n = df.count()
    prob = F.rand(seed)
    if n > 1.5 * size > 0:
        return df.withColumn("__p", prob).filter(F.col("__p") <= 1.5 * size / n + 30 / n).orderBy("__p").limit(size).drop("__p")
    return df.withColumn("__p", prob).orderBy("__p").limit(size).drop("__p")


def table_sample(df: DataFrame, percent: float, seed: int = 1234) -> DataFrame:
    return df.sample(False, percent / 100.0, seed)


def down_sample(df: DataFrame, target: str, rates: dict[object, float], default: float = 1.0, key: list[str] | None = None, seed: int = 1234, weight: str = "row_weight") -> DataFrame:
    """Keeps rows of each target value at its rate, reproducibly by key, with the weight 1 / rate."""
    rate = F.lit(default)
    for value, r in rates.items():
        rate = F.when(F.col(target) == value, F.lit(r)).otherwise(rate)
    return df.withColumn("__rate", rate).filter(split_number([F.col(c) for c in key or df.columns], seed) < F.col("__rate")).withColumn(weight, 1 / F.col("__rate")).drop("__rate")


def split_number(key: list[Column], seed: int) -> Column:
    """In [0, 1), by a hash of the key."""
    text = F.concat_ws("_", *[k.cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split(df: DataFrame, key: list[str], shares: dict[str, float], seed: int = 1234, name: str = "fold") -> DataFrame:
    """A fold for each row, by key, that any rerun repeats. shares: two or three names with parts that add up to one."""
    if len(shares) not in (2, 3) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("two or three shares that add up to one")
    u, upto, out = split_number([F.col(k) for k in key], seed), 0.0, None
    for fold, part in shares.items():
        upto += part
        out = F.when(u < upto, F.lit(fold)) if out is None else out.when(u < upto, F.lit(fold))
    return df.withColumn(name, F.coalesce(out, F.lit(list(shares)[-1])))


def value_counts(df: DataFrame, column: str, limit: int = 500) -> DataFrame:
    """key and count of the most frequent values; a top-k, not a sort."""
    return df.groupBy(F.col(f"`{column}`").alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("key")).limit(limit)


def describe(df: DataFrame) -> DataFrame:
    """A row for each column: dtype, unique, missing (%), empty (%), entropy, top, freq, mean, std, min, quartiles, max.

    One pass of aggregates gives what needs no grouping; values are counted in one exchange keyed by column and value.
    """
    kinds = dict(df.dtypes)
    plain = [c for c in df.columns if kinds[c] in (*_NUMBERS, "string", "boolean", "date", "timestamp", "timestamp_ntz")]
    aggs = []
    for i, c in enumerate(plain):
        x, num = F.col(f"`{c}`"), kinds[c] in _NUMBERS
        d = x.cast("double") if num else F.lit(None).cast("double")
        stats = [F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.try_divide(F.count_if(x.isNull()) * 100.0, F.count(F.lit(1))).alias("missing"), F.try_divide(F.count_if((x == "") if kinds[c] == "string" else F.lit(False)) * 100.0, F.count(F.lit(1))).alias("empty"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.min(x).cast("string").alias("min"), F.percentile(d, F.lit(0.25)).alias("p25"), F.percentile(d, F.lit(0.5)).alias("p50"), F.percentile(d, F.lit(0.75)).alias("p75"), F.max(x).cast("string").alias("max")]
        aggs.append(F.struct(*stats).alias(f"s{i}"))
    one = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(plain))])).alias("s")).select("s.*")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in plain])).alias("p")).select("p.*").filter("value is not null")
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("nl"), F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("b"))
    top = top.select("column", "unique", F.greatest(F.lit(0.0), F.ln("t") - F.col("nl") / F.col("t")).alias("entropy"), F.col("b.value").alias("top"), (-F.col("b.n")).alias("freq"))
    return one.join(top, "column", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))


def invalid_history(df: DataFrame, key: str, ts: str, flag: str | None = None) -> DataFrame:
    """Keys of a history with two rows at one time, or with two current ones: key, duplicates, active."""
    times = df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("a") if flag else F.lit(0).alias("a"))
    sums = times.groupBy(key).agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.sum("a").cast("bigint").alias("active"))
    return sums.filter((F.col("duplicates") > 0) | (F.col("active") > 1))


def observation_stats(df: DataFrame, pit: str, entity: str) -> DataFrame:
    """One row: first and last point in time, entities, rows, least seconds between an entity's points."""
    w = Window.partitionBy(entity).orderBy(pit)
    gaps = df.withColumn("__gap", temporal.epoch(F.col(pit)) - F.lag(temporal.epoch(F.col(pit))).over(w))
    return gaps.agg(F.min(pit).alias("first"), F.max(pit).alias("last"), F.count_distinct(entity).alias("entities"), F.count(F.lit(1)).alias("rows"), F.min("__gap").alias("least_gap"))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Approximate numbers of distinct values, one row."""
    return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])


def job_setting_analysis(df: DataFrame, event_ts: str, arrival_ts: str, period: str) -> DataFrame:
    """Blind spots that would see half, 90, 99 and all of the rows, from the delays of arrival; one row, in seconds."""
    from ..plans.jobs import seconds

    delay = temporal.epoch(F.col(arrival_ts)) - temporal.epoch(F.col(event_ts))
    q = [F.percentile(delay, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)]
    step = seconds(period)
    return df.agg(*q, F.max(delay).alias("most"), (F.ceil(F.max(delay) / step) * step).alias("blind_spot"))
