"""Exact deduplication against an index of distinct digests behind minimal perfect hashes.

Texts are equal when their SHA-256 digests after white-space removal are. The index is a table cut into shards by digest; a shard is a
minimal perfect hash (levels of bit arrays with ranks) whose n slots hold the n full digests and the locators of the winners: id,
code points, row and size of the group. It is written once and read by any later run. A digest that isn't in the index still gets some slot
or none, so a lookup compares all 32 bytes. Newcomers are grouped among themselves first and ask once for each distinct digest: members join
their group, the others are groups of their own. In resolve() only digests, ids and lengths are moved, never texts.

Without an index of earlier runs, a table's own older half (by id) is history and its newer half asks.

Of equal texts the row with the most code points stays, then the one with the smallest id (null ids last), then the first one read.

Skew: the answers for a digest with more than 1 / 2000 of all rows - at most 2000 of them can exist - are broadcast, the rest join by digest.

Edge cases: a null text counts as empty; blank texts equal the empty one; of repeated rows, with equal ids too, one is kept; an empty
table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism, SPACE_CLASS

SHARD_DIGESTS = 100_000
HOT_SHARE = 2000
_GAMMA = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", "")


@dataclass
class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of its bit in the first level where it met no other key."""

    sizes: list[int]
    bits: list[np.ndarray]
    ranks: list[int]
    rest: dict[bytes, int]

    @staticmethod
    def build(keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """keys: distinct digests, shape (n, 32). Returns the hash and each key's slot."""
        self, slots = PerfectHash([], [], [], {}), np.zeros(len(keys), dtype=np.int64)
        words, left, used = keys.view("<u8").reshape(len(keys), 4), np.arange(len(keys)), 0
        for level in range(32):
            if not len(left):
                break
            size = _GAMMA * len(left) + 1
            at = _place(words[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            self.bits.append(alone)
            self.ranks.append(used)
            ok = alone[at]
            slots[left[ok]] = used + np.cumsum(alone)[at[ok]] - 1
            used += int(ok.sum())
            left = left[~ok]
        for k in left:  # no known digest comes here: keys that met others on all levels
            self.rest[keys[k].tobytes()] = used
            slots[k] = used
            used += 1
        return self, slots

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key, -1 where no level has one; the caller compares the slot's digest."""
        slots, words, left = np.full(len(keys), -1, dtype=np.int64), keys.view("<u8").reshape(len(keys), 4), np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            at = _place(words[left], level, size)
            hit = bits[at]
            slots[left[hit]] = rank + np.cumsum(bits)[at[hit]] - 1
            left = left[~hit]
        for k in left if self.rest else ():
            slots[k] = self.rest.get(keys[k].tobytes(), -1)
        return slots


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = words[:, 0] + words[:, 1 + level % 3] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__key, __digest (32 bytes), __chars, __row: all that is moved of a row. Row numbers hold once the result has been written."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{key}`").cast("bigint").alias("__key"), F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256)).alias("__digest"), F.length(t).cast("bigint").alias("__chars"))


def _better(chars: Column, key: Column, row: Column) -> Column:
    """The least of these is the winner."""
    return F.struct((-chars).alias("c"), key.isNull().alias("n"), key.alias("k"), row.alias("r"))


def winners(base: DataFrame) -> DataFrame:
    """A row for each distinct digest, with its winner and number of rows. Combined before the shuffle."""
    best = F.min(_better(F.col("__chars"), F.col("__key"), F.col("__row")))
    out = base.groupBy("__digest").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
    return out.select("__digest", (-F.col("b.c")).alias("win_chars"), F.col("b.k").alias("keep_id"), F.col("b.r").alias("win_row"), "group_size")


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("__digest"), F.lit(n)).cast("int")


_LOCATORS = ("keep_id", "win_chars", "win_row", "group_size")
_INDEX = "shard int, shards int, sizes array<bigint>, bits binary, digests binary, known binary, " + ", ".join(f"{c} binary" for c in _LOCATORS)


def build_index(content: DataFrame) -> DataFrame:
    """The index of winners()'s rows, a row for each shard: the hash's levels, and digests and locators in the order of its slots."""
    n = max(4 * parallelism(content.sparkSession), -(-content.count() // SHARD_DIGESTS))
    content = content if "win_row" in content.columns else content.withColumn("win_row", F.lit(-1).cast("bigint"))

    def build(t: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(t["__digest"].to_pylist()), dtype=np.uint8).reshape(-1, 32)
        mph, slots = PerfectHash.build(keys)
        owner = np.empty(len(keys), dtype=np.int64)
        owner[slots] = np.arange(len(keys))
        of_slot = {c: t[c].take(pa.array(owner)) for c in _LOCATORS}
        row = {"shard": t["__shard"][0].as_py(), "shards": n, "sizes": mph.sizes, "bits": b"".join(np.packbits(x).tobytes() for x in mph.bits), "digests": keys[owner].tobytes(), "known": of_slot["keep_id"].is_valid().to_numpy().tobytes()}
        row |= {c: of_slot[c].fill_null(0).to_numpy().astype("<i8").tobytes() for c in _LOCATORS}
        return pa.Table.from_pylist([row], schema=_INDEX_ARROW)

    sent = content.select(_shard(n).alias("__shard"), "__digest", *[F.col(c).cast("bigint").alias(c) for c in _LOCATORS])
    return materialize(sent.groupBy("__shard").applyInArrow(build, _INDEX), "exact-index")


_INDEX_ARROW = pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("sizes", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("bits", "digests", "known", *_LOCATORS)]])


class Shard:
    """A shard read back: answers digests with slots whose 32 bytes are the same, -1 for others."""

    def __init__(self, row: dict) -> None:
        self.keys = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        n = len(self.keys)
        bits, ranks, at, used = [], [], 0, 0
        for size in row["sizes"]:
            bits.append(np.unpackbits(np.frombuffer(row["bits"], np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            ranks.append(used)
            used += int(bits[-1].sum())
            at += (size + 7) // 8
        self.hash = PerfectHash(list(row["sizes"]), bits, ranks, {self.keys[k].tobytes(): k for k in range(used, n)})
        self.known = np.frombuffer(row["known"], bool)
        self.locators = {c: np.frombuffer(row[c], "<i8") for c in _LOCATORS}

    def slots(self, ask: np.ndarray) -> np.ndarray:
        got = self.hash.lookup(ask)
        same = got >= 0
        same[same] = (self.keys[got[same]] == ask[same]).all(axis=1)
        return np.where(same, got, -1)


_FOUND = "__digest binary, " + ", ".join(f"h_{c} bigint" for c in _LOCATORS)


def _probe(asked: pa.Table, index: pa.Table) -> pa.Table:
    """The members among the asked digests, with the locators of their slots."""
    digests = asked["__digest"].to_pylist()
    if not digests or not index.num_rows:
        return pa.schema([("__digest", pa.binary()), *[(f"h_{c}", pa.int64()) for c in _LOCATORS]]).empty_table()
    shard = Shard(index.to_pylist()[0])
    slots = shard.slots(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32))
    hit = np.flatnonzero(slots >= 0)
    at = slots[hit]
    found = {c: pa.array(x[at], mask=~shard.known[at] if c == "keep_id" else None) for c, x in shard.locators.items()}
    return pa.table({"__digest": pa.array([digests[i] for i in hit.tolist()], pa.binary()), **{f"h_{c}": found[c] for c in _LOCATORS}})


def look_up(asked: DataFrame, index: DataFrame) -> DataFrame:
    """__digest and the index's h_keep_id, h_win_chars, h_win_row, h_group_size for those of the asked (distinct) digests that are members."""
    first = index.select("shards").first()
    if first is None:
        return asked.select("__digest", *[F.lit(None).cast("bigint").alias(f"h_{c}") for c in _LOCATORS]).limit(0)
    left = asked.select("__digest").groupBy(_shard(first[0]).alias("__shard"))
    return left.cogroup(index.groupBy("shard")).applyInArrow(_probe, _FOUND)


def resolve(df: DataFrame, key: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, __chars for each row of df.

    history: an index of earlier runs, or columns like winners(). A historical winner stays, also against a longer newcomer, as it has
    been published already; digests that history lacks are grouped among themselves. group_size counts history's rows and those of df.
    """
    base = materialize(digests(df, key, text), "exact-digests")
    if history is None:
        rows, middle = base.agg(F.count(F.lit(1)), F.percentile_approx("__key", 0.5, 1000)).first()
        older = F.coalesce(F.col("__key") <= F.lit(middle).cast("bigint"), F.lit(False))
        earlier, newer = materialize(winners(base.filter(older)), "exact-earlier"), materialize(winners(base.filter(~older)), "exact-newer")
        index = build_index(earlier)
    else:
        rows, newer = base.count(), materialize(winners(base), "exact-newer")
        index = history if "digests" in history.columns else build_index(history)
    answered = newer.join(materialize(look_up(newer, index), "exact-members"), "__digest", "left").withColumn("known", F.col("h_group_size").isNotNull())
    if history is None:
        own, theirs = (_better(F.col(f"{p}win_chars"), F.col(f"{p}keep_id"), F.col(f"{p}win_row")) for p in ("", "h_"))
        best = F.when(F.col("known"), F.least(own, theirs)).otherwise(own)
        answered = materialize(answered.select("__digest", best.alias("b"), (F.col("group_size") + F.coalesce("h_group_size", F.lit(0))).alias("group_size"), "known"), "exact-answers")
        answered = answered.select("__digest", (-F.col("b.c")).alias("win_chars"), F.col("b.k").alias("keep_id"), F.col("b.r").alias("win_row"), "group_size", "known")
        # groups without a newcomer stay as they are
        rest = earlier.join(answered.filter("known").select("__digest"), "__digest", "left_anti")
        verdict = answered.drop("known").unionByName(rest).withColumn("known", F.lit(False))
    else:
        pick = lambda c: F.when(F.col("known"), F.col(f"h_{c}")).otherwise(F.col(c)).alias(c)
        verdict = answered.select("__digest", pick("win_chars"), pick("keep_id"), "win_row", (F.col("group_size") + F.coalesce("h_group_size", F.lit(0))).alias("group_size"), "known")
    verdict = materialize(verdict, "exact-verdict")
    # at most HOT_SHARE digests have so many rows of df (and history's rows only count where there are any of df)
    hot = materialize(newer.select("__digest", "group_size").unionByName(earlier.select("__digest", "group_size")).filter(F.col("group_size") * HOT_SHARE > rows).select("__digest").distinct() if history is None else newer.filter(F.col("group_size") * HOT_SHARE > rows).select("__digest"), "exact-hot")
    common = verdict.join(F.broadcast(hot), "__digest", "left_semi")
    rare = verdict.join(F.broadcast(hot), "__digest", "left_anti")
    out = base.join(F.broadcast(common), "__digest").unionByName(base.join(F.broadcast(hot), "__digest", "left_anti").join(rare, "__digest"))
    return out.select(F.col("__key").alias("doc_id"), "keep_id", "group_size", (~F.col("known") & (F.col("__row") == F.col("win_row"))).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256"), "__chars")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row of df for each distinct normalised text: most code points, smallest id (null ids last), smallest hash of the raw text."""
    names = {c: f"__col{i}" for i, c in enumerate(df.columns)}
    safe = df.select(*[df[f"`{c}`"].alias(a) for c, a in names.items()])
    keep = resolve(safe, names[key], names[text], history).filter("kept")
    keep = keep.select(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.unhex("text_sha256").alias("__d")).distinct()
    k = F.col(names[key]).cast("bigint")
    rows = safe.withColumns({"__none": k.isNull(), "__id": F.coalesce(k, F.lit(0)), "__hash": F.xxhash64(names[text])})
    # which of the rows that share id and digest stays is decided without their texts
    best = F.min(F.struct((-F.length(F.coalesce(F.col(names[text]), F.lit("")))).alias("c"), F.col("__hash").alias("h")))
    same = rows.withColumn("__d", F.unhex(F.sha2(normalised(F.col(names[text])), 256))).groupBy("__none", "__id", "__d").agg(best.alias("b"))
    chosen = materialize(same.join(keep, ["__none", "__id", "__d"], "left_semi").select("__none", "__id", F.col("b.h").alias("__hash")), "exact-chosen")
    on = ["__none", "__id", "__hash"]
    # the join's partitions serve for rows that share id and text, too
    out = rows.join(chosen, on, "left_semi").dropDuplicates(on)
    return out.select(*[F.col(a).alias(c) for c, a in names.items()])
