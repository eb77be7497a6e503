"""Helpers that the corpus operators share: shared scratch tables, bounded joins, byte-white-space words."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, as a list for trim() and as a Java character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: A dimension table of at most this many rows may be broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 2000

_scratch: list[tuple[int, SparkSession, str]] = []
_number = itertools.count(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes its warehouse's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at exit if not before. It names the application, so what a killed driver leaves can be told."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _scratch.append((next(_number), spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """What release() takes to spare all that has been written so far."""
    return next(_number)


def release(since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete scratch tables written after a mark, but for those that the kept frames read."""
    held = {part for df in keep for f in df.inputFiles() for part in f.split("/")}
    for entry in [x for x in _scratch if x[0] > since]:
        _, spark, path = entry
        if path.rsplit("/", 1)[-1] in held:
            continue
        _scratch.remove(entry)
        jvm = spark.sparkContext._jvm
        if jvm is None:
            continue
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def finished(df: DataFrame, since: int) -> DataFrame:
    """df, after the scratch tables since a mark that it doesn't read have gone."""
    release(since, [df])
    return df


def _at_exit() -> None:
    for _, spark, _ in _scratch[:1]:
        if spark.sparkContext._jsc is None:
            return
    try:
        release()
    except Exception:  # noqa: BLE001 - the JVM may be gone at interpreter exit
        pass


atexit.register(_at_exit)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's rows in an Arrow batch, so that long texts don't make batches of tens of MB on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return what a worker's allocators keep free to the system, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parallelism(spark: SparkSession) -> int:
    """How many pieces a keyed exchange gets: the session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """Words (runs of other than ASCII white space) of a text; null and blank texts have none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS + "+", -1))


def let(df: DataFrame, *columns: Column) -> DataFrame:
    """Evaluate the columns once per row: a one-row generator keeps the optimiser from inlining them again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def join_dimension(facts: DataFrame, dimension: DataFrame, keys: list[str], rows: int, salts: int = 64) -> DataFrame:
    """Null-safe left join of facts with a table that has one row for each key.

    A dimension of at most BROADCAST_ROWS rows (rows is its counted size) is broadcast. A larger one is copied once for
    each salt and joined by a salted shuffle, so no key's facts meet in one task.
    """
    renamed = dimension.select(*[F.col(k).alias(f"__dim_{k}") for k in keys], *[c for c in dimension.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__dim_{k}"))
        on = same if on is None else on & same
    if rows <= BROADCAST_ROWS:
        out = facts.join(F.broadcast(renamed), on, "left")
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in facts.columns if c not in keys] or [F.lit(0)]), F.lit(salts))
        left = facts.withColumn("__salt", salt)
        right = renamed.withColumn("__dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("bigint"))
        out = left.join(right, on & (F.col("__salt") == F.col("__dim_salt")), "left").drop("__salt", "__dim_salt")
    return out.drop(*[f"__dim_{k}" for k in keys])
