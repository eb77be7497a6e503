"""Incremental tiles: a stream of events keeps a table of partial aggregates up to date.

Each micro-batch (one run with trigger availableNow, or a standing query) aggregates its rows to tiles and adds them to those on disk. Tiles
are kept in generations: a batch writes all tiles, the old ones merged with its own, as the next generation, so a batch that is run again after
a failure starts from the same one and gives the same result. The last two generations stay, older ones are removed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import Schedule


def tiles(rows: DataFrame, keys: list[str], ts: str, value: str, schedule: Schedule) -> DataFrame:
    """keys, tile and partial aggregates: n_rows, n, sum, squares, least, most."""
    v = F.col(f"`{value}`").cast("double")
    idx = schedule.tile_index(F.col(f"`{ts}`")).alias("tile")
    return rows.groupBy(*keys, idx).agg(F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"))


def combine(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles of disjoint rows as tiles of all."""
    both = a.unionByName(b)
    return both.groupBy(*keys, "tile").agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))


def _generation(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    fs, at = _files(spark, f"{path}/generation={number}/_SUCCESS")
    return spark.read.parquet(f"{path}/generation={number}") if fs.exists(at) else None


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _complete(spark: SparkSession, path: str) -> list[int]:
    fs, at = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    numbers = [int(n.removeprefix("generation=")) for n in names if n.startswith("generation=")]
    return sorted(n for n in numbers if fs.exists(_files(spark, f"{path}/generation={n}/_SUCCESS")[1]))


def maintain(stream: DataFrame, path: str, checkpoint: str, keys: list[str], ts: str, value: str, schedule: Schedule, available_now: bool = True) -> StreamingQuery:
    """Starts a query that keeps the tiles under path."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = tiles(batch, keys, ts, value, schedule)
        old = _generation(spark, path, number - 1) if number else None
        if number and old is None:
            raise FileNotFoundError(f"{path}/generation={number - 1} is missing: without it all earlier tiles would be lost")
        (new if old is None else combine(old, new, keys)).write.mode("overwrite").parquet(f"{path}/generation={number}")
        for past in [n for n in _complete(spark, path) if n < number - 1]:
            fs, at = _files(spark, f"{path}/generation={past}")
            fs.delete(at, True)

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of the last complete generation."""
    numbers = _complete(spark, path)
    if not numbers:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/generation={numbers[-1]}")


def windowed(stream: DataFrame, keys: list[str], ts: str, value: str, schedule: Schedule) -> DataFrame:
    """Tiles as a tumbling window of event time with the schedule's phase; the blind spot is the watermark, so late rows within it count."""
    period, phase = schedule.p, (schedule.o - schedule.b) % schedule.p
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", f"{max(schedule.b, 1)} seconds")
    w = F.window("__ts", f"{period} seconds", f"{period} seconds", f"{phase} seconds")
    v = F.col(value).cast("double")
    return rows.groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(v).alias("sum")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("start"), "n_rows", "sum")
