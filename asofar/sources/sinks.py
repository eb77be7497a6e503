"""Writing: tables by partition, upserts of tiles, feature tables that grow by time and by column, request tables."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def save(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys (null-safe) new lacks: an upsert where the format has none."""
    n = new.select(*[F.col(f"`{k}`").alias(f"__n{i}") for i, k in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__n{i}")) for i, k in enumerate(keys)])
    return old.join(n, on, "left_anti").unionByName(new, allowMissingColumns=True)


class OfflineTable:
    """Features by entity and feature time under a path, in versions of which the last complete one counts.

    Appending writes one partition, that of the feature time, and replaces it when it is run again. New columns make a new version, so a
    reader never sees half of it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], feature_ts: str = "feature_timestamp") -> None:
        self.spark, self.path, self.keys, self.feature_ts = spark, path.rstrip("/"), list(keys), feature_ts

    def _files(self, name: str = "") -> tuple[Any, Any]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _complete(self) -> list[int]:
        """Versions with a marker: a version gets it when its first write has ended."""
        fs, at = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removeprefix("complete-")) for n in names if n.startswith("complete-"))

    def read(self) -> DataFrame:
        versions = self._complete()
        if not versions:
            raise FileNotFoundError(self.path)
        df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/version-{versions[-1]}")
        return df.withColumn(self.feature_ts, F.to_timestamp_ntz(F.col("__partition").cast("string"), F.lit("yyyy-MM-dd HH.mm.ss.SSSSSS"))).drop("__partition")

    def append(self, df: DataFrame, at: str) -> None:
        """Features as of a time. A second run with the same time takes the place of the first."""
        version = (self._complete() or [0])[-1]
        # a text without colons, as folders have it; the same time always gives the same one
        part = F.date_format(F.lit(at).cast("timestamp_ntz"), "yyyy-MM-dd HH.mm.ss.SSSSSS")
        self._write(df.withColumn("__partition", part), version)

    def _write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__partition").parquet(f"{self.path}/version-{version}")
        fs, at = self._files(f"complete-{version}")
        fs.create(at, True).close()

    def add_columns(self, df: DataFrame) -> None:
        """New features (or other values of old ones) for keys and feature time; rows that only one side has stay."""
        on = [*self.keys, self.feature_ts]
        old = self.read()
        new = df.select(*on, *[c for c in df.columns if c not in on])
        kept = old.select(*on, *[c for c in old.columns if c not in new.columns])
        both = kept.join(new, on, "full").withColumn("__partition", F.date_format(self.feature_ts, "yyyy-MM-dd HH.mm.ss.SSSSSS")).drop(self.feature_ts)
        self._write(both, self._complete()[-1] + 1)


def write_batch(df: DataFrame, path: str, snapshot: str, mode: str = "append", column: str = "snapshot") -> DataFrame:
    """A batch feature table by snapshot: append adds or replaces the snapshot's rows, overwrite replaces the table."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is append or overwrite")
    how = "dynamic" if mode == "append" else "static"
    df.withColumn(column, F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(column).parquet(path)
    return df.sparkSession.read.parquet(path)


def with_new_features(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with columns of new on equal keys; rows that only one has stay."""
    return old.join(new, keys, "full")


def latest_features(table: DataFrame, keys: list[str], feature_ts: str = "feature_timestamp") -> DataFrame:
    """Each entity's last row: what an online store serves."""
    rest = [c for c in table.columns if c not in keys]
    best = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), feature_ts).alias("r"))
    return best.select(*keys, "r.*")


def register_view(spark: SparkSession, name: str, sql: str) -> DataFrame:
    """A managed view: SQL text under a name."""
    df = spark.sql(sql)
    df.createOrReplaceTempView(name)
    return df


def serving_key(keys: list[str], name: str = "serving_key") -> object:
    """Several keys as one text, for stores with a single key."""
    return F.concat_ws("::", *[F.coalesce(F.col(k).cast("string"), F.lit("__null__")) for k in keys]).alias(name)


def upload(df: DataFrame, name: str, path: str, cached: bool = False) -> DataFrame:
    """Registers a frame under a name, over files that it is written to; cached: kept in memory, as far as there is room."""
    out = save(df, path, mode="overwrite")
    out = out.persist(StorageLevel.MEMORY_AND_DISK) if cached else out
    out.createOrReplaceTempView(name)
    return out


def result_stream(df: DataFrame, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The result in Arrow batches, one partition at a time on the driver."""
    schema = to_arrow_schema(df.schema)
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(recursive=True))
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def metadata(spark: SparkSession, database: str | None = None) -> DataFrame:
    """table, column, kind of all tables and views that the session knows, in a database if one is given."""
    found = [(t.name, f.name, f.dataType.simpleString()) for t in spark.catalog.listTables(database) for f in spark.table(t.name if t.isTemporary or not database else f"{database}.{t.name}").schema.fields]
    return spark.createDataFrame(found, "`table` string, `column` string, kind string")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors both write: under spark.checkpoint.dir, else the warehouse. It goes at exit."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
