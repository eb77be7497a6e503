"""WARC files and their fixity audit by Merkle trees.

Pages are written as WARC records, FILE_RECORDS ids to a file; a file is one binary value of a Parquet container. An audit parses a
replica's files, hashes each record and builds a tree: a leaf is a record with its offsets, an inner node hashes FANOUT children in
order with the offset range that they cover; above the files' roots the trees go on over ranges of file numbers up to one root.
Two replicas are compared from the root down, level by level, and only children of differing nodes are read further.

Edge cases: null URLs and pages are empty; a null id stands in files of its own (by digest) and comes back as null; rows that share an id stand
in the order of URL and page; an empty table has no files and gives an empty result; a file that can't be parsed to its end has
one last leaf for the rest; files that one replica lacks count as damaged; other columns don't take part.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parallelism, scratch_path

FILE_RECORDS = 256
FANOUT = 16
_NODE = "file bigint, level int, node bigint, first bigint, last bigint, hash binary, record_id string"


def record(key: Column, url: Column, body: Column) -> Column:
    """A WARC resource record as a string; the length counts UTF-8 bytes."""
    body = F.coalesce(body, F.lit(""))
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " ")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), clean, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("null")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Writes WARC files under path: columns file, n_records, content."""
    k = F.col(f"`{key}`").cast("bigint")
    alone = -1 - F.pmod(F.xxhash64(F.col(f"`{url}`"), F.col(f"`{body}`")), F.lit(1 << 20))
    rows = df.select(F.coalesce(F.floor(k / FILE_RECORDS), alone).cast("bigint").alias("file"), k.alias("key"), record(k, F.col(f"`{url}`"), F.col(f"`{body}`")).alias("record"))
    ordered = rows.repartition(parallelism(df.sparkSession), "file").sortWithinPartitions("file", "key", "record").select("file", "record")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": pa.array([here], pa.int64()), "n_records": pa.array([len(parts)], pa.int64()), "content": pa.array([b"".join(parts)], pa.binary())})

        for b in batches:
            for f, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if f != here:
                    if parts:
                        yield flush()
                    here, parts = f, []
                parts.append(r.encode("utf-8", "surrogatepass"))
        if parts:
            yield flush()

    ordered.mapInArrow(join, "file bigint, n_records bigint, content binary").write.option("compression", "zstd").parquet(path)


def parse(content: bytes) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, record id, payload's start) of each record; what can't be parsed is one last record without an id."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        fields: dict[bytes, bytes] = {}
        if content.startswith(b"WARC/", at) and head >= 0:
            for line in content[at:head].split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.strip().lower()] = value.strip()
        size = fields.get(b"content-length", b"")
        end = head + 4 + int(size) + 4 if size.isdigit() and len(size) < 19 else -1
        if not at < end <= len(content):
            yield at, len(content), "", at
            return
        yield at, end, fields.get(b"warc-record-id", b"").decode("utf-8", "replace"), head + 4
        at = end


def _above(first: int, last: int, hashes: list[bytes]) -> bytes:
    return hashlib.sha256(struct.pack("<qq", first, last) + b"".join(hashes)).digest()


def file_nodes(content: bytes) -> list[tuple[int, int, int, int, bytes, str]]:
    """(level, node, first byte, last byte + 1, hash, record id) of all nodes of a file's tree; level 0 has the records."""
    row = [(0, i, a, e, hashlib.sha256(content[a:e]).digest(), r) for i, (a, e, r, _) in enumerate(parse(content))]
    out = list(row)
    while len(row) > 1:
        groups = [row[i : i + FANOUT] for i in range(0, len(row), FANOUT)]
        row = [(g[0][0] + 1, i, g[0][2], g[-1][3], _above(g[0][2], g[-1][3], [x[4] for x in g]), "") for i, g in enumerate(groups)]
        out += row
    return out


def trees(files: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes of all files' trees, and the levels over the files: (node, hash) with the files' roots first, one root last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                level, node, first, last, digest, rid = zip(*file_nodes(c.as_py()), strict=True)
                n = len(level)
                yield pa.RecordBatch.from_pydict({"file": pa.array([f] * n, pa.int64()), "level": pa.array(level, pa.int32()), "node": pa.array(node, pa.int64()), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64()), "hash": pa.array(digest, pa.binary()), "record_id": pa.array(rid, pa.string())})

    nodes = materialize(files.select("file", "content").mapInArrow(run, _NODE), "warc-nodes")
    top = nodes.groupBy("file").agg(F.max_by("hash", "level").alias("hash"))
    levels = [materialize(top.select(F.col("file").alias("node"), "hash"), "warc-roots")]
    while levels[-1].limit(2).count() > 1:
        # FANOUT children at most; each goes in with its place
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        text = F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["node"], F.hex(x["hash"]))), ",")
        parent = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("up")).agg(F.unhex(F.sha2(text, 256)).alias("hash"))
        levels.append(materialize(parent.select(F.col("up").alias("node"), "hash"), "warc-level"))
        if len(levels) > 3 and levels[-1].filter("node not in (0, -1)").isEmpty():
            break  # numbers on both sides of zero never share a parent
    return nodes, levels


def _differing(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys of nodes whose hashes differ or that one side lacks."""
    left, right = a.select(*on, F.col("hash").alias("h1")), b.select(*on, F.col("hash").alias("h2"))
    return left.join(right, on, "full").filter(~F.col("h1").eqNullSafe(F.col("h2"))).select(*on)


def audit(files_a: DataFrame, files_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of replica a's trees, and (file, node) of the records that differ between the replicas."""
    nodes_a, up_a = trees(files_a)
    nodes_b, up_b = trees(files_b)
    empty = nodes_a.select("node", "hash").limit(0)
    depth = max(len(up_a), len(up_b))
    suspects = None
    for level in range(depth - 1, -1, -1):
        a, b = (u[level] if level < len(u) else empty for u in (up_a, up_b))
        if suspects is not None:
            a, b = (x.join(suspects, F.floor(x["node"] / FANOUT) == F.col("up"), "left_semi") for x in (a, b))
        suspects = materialize(_differing(a, b, ["node"]).select(F.col("node").alias("up")), "warc-suspects")
        if suspects.isEmpty():
            return nodes_a, nodes_a.select("file", "node").limit(0)
    heights = nodes_a.unionByName(nodes_b).agg(F.max("level")).first()[0]
    files = suspects.select(F.col("up").alias("file"))
    inside = None
    for level in range(heights, -1, -1):
        a, b = (x.filter(F.col("level") == level).join(files, "file", "left_semi") for x in (nodes_a, nodes_b))
        if inside is not None:
            # a file whose tree ends below this level has no parent there and is entered at its root
            at_root = lambda x: x.join(tops, "file").filter(F.col("top") == level).drop("top")
            tops = nodes_a.unionByName(nodes_b).groupBy("file").agg(F.max("level").alias("top"))
            a, b = (x.join(inside, (x["file"] == F.col("f")) & (F.floor(x["node"] / FANOUT) == F.col("up")), "left_semi").unionByName(at_root(x)) for x in (a, b))
        found = materialize(_differing(a, b, ["file", "node"]).distinct(), "warc-differing")
        inside = found.select(F.col("file").alias("f"), F.col("node").alias("up"))
    return nodes_a, found


def replicate(files: DataFrame, path: str, rot: Callable[[bytes], bool] | None = None) -> None:
    """Writes a copy of the files under path. rot: fault injection; a record whose digest it chooses has a bit of its payload turned."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = bytearray(c.as_py())
                if rot:
                    whole = bytes(raw)
                    for a, e, _, body in parse(whole):
                        if rot(hashlib.sha256(whole[a:e]).digest()):
                            raw[min(body, e - 1)] ^= 1
                yield pa.RecordBatch.from_pydict({"file": pa.array([f], pa.int64()), "n_records": pa.array([n], pa.int64()), "content": pa.array([bytes(raw)], pa.binary())})

    files.select("file", "n_records", "content").mapInArrow(copy, "file bigint, n_records bigint, content binary").write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fixity(df: DataFrame, rot: Callable[[bytes], bool] | None, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, file, record_offset, record_length, record_sha256, damaged for each row of df.

    Writes the pages as WARC, copies them to a second replica (with faults where rot chooses) and audits one against the other.
    """
    spark = df.sparkSession
    paths = [scratch_path(spark, f"warc-{side}") for side in "ab"]
    write(df, paths[0], key, url, body)
    replicate(read(spark, paths[0]), paths[1], rot)
    nodes, damaged = audit(read(spark, paths[0]), read(spark, paths[1]))
    leaves = nodes.filter("level = 0")
    out = leaves.join(damaged.withColumn("hit", F.lit(True)), ["file", "node"], "left")
    return out.select(
        F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint").alias("page_id"), "file", F.col("first").alias("record_offset"),
        (F.col("last") - F.col("first")).alias("record_length"), F.lower(F.hex("hash")).alias("record_sha256"), F.coalesce("hit", F.lit(False)).alias("damaged"),
    )
