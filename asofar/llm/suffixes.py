"""Removal of repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A byte goes when a LENGTH-byte string that covers it also starts in a document with a smaller id. Documents are cut into chunks of whole
documents. Of the GRAM-byte strings in each window of LENGTH bytes the one with the least hash is its anchor, so equal windows have
equal anchors at equal places, and a tenth of all suffixes stand for all windows:

1. chunks are written, compressed, with their anchors;
2. hashes of anchors meet by range, and each chunk learns by bitmaps which of its anchors other documents may have too;
3. each chunk sorts the suffixes at those anchors (GRAM bytes, then what follows and what precedes in reach), one for each distinct
   string with the least id that has it, and sends them as front-coded runs to ranges of the prefix;
4. each range merges its runs with a loser tree. Every entry carries its common prefix with the last winner; a game
   between unequal prefixes is decided by them, one between equal ones compares only the bytes behind. Entries with the same GRAM bytes
   are resolved window by window, and each chunk gets back a mask for each of its entries;
5. chunks apply the masks.

Anchors are only hashed to choose and to sift; equality is decided on bytes.

Edge cases: a null text is empty; texts shorter than LENGTH keep all bytes; rows that share an id never remove each other's bytes;
a null id counts as larger than all others; an empty table gives an empty result; other columns don't take part; a
document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism

LENGTH = 50
GRAM = 32
REACH = LENGTH - GRAM
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Windows that are searched at a time, and the bits of a number that hash it; the others hold its place in the block.
_BLOCK = 1 << 15
_HASH = np.uint64((1 << 64) - (1 << 16))
_ENTRY = GRAM + 2 * REACH + 2
_NO_ID = np.iinfo(np.int64).max
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling."""
    h, m = _TABLE[x], 1
    for odd in _ODD:
        h = h[:-m] * odd + h[m:]
        m *= 2
    return (h ^ (h >> np.uint64(29))) * _ODD[0]


def anchors(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all windows' anchors in the joined documents x; windows lie within a document.

    Hash and place are one number, so the least of a window is found by minima alone, block by block in the processor's cache; places
    of later windows' anchors never come before those of earlier ones.
    """
    windows = len(x) - LENGTH + 1
    if windows < 1:
        return np.empty(0, dtype=np.uint32)
    ends = np.cumsum(lengths)
    inside = np.zeros(len(x) + 1, dtype=bool)
    for a, e in zip((ends - lengths)[lengths >= LENGTH].tolist(), (ends - LENGTH + 1)[lengths >= LENGTH].tolist(), strict=True):
        inside[a:e] = True
    found = []
    for at in range(0, windows, _BLOCK):
        some = inside[at : min(at + _BLOCK, windows)]
        if not some.any():
            continue
        least = _gram_hashes(x[at : at + len(some) + LENGTH - 1])
        least &= _HASH
        least |= np.arange(len(least), dtype=np.uint64)
        for step in (1, 2, 4, 8, REACH + 1 - 16):
            least = np.minimum(least[:-step], least[step:])
        found.append((least[some] & ~_HASH).astype(np.uint32) + np.uint32(at))
    every = np.concatenate(found) if found else np.empty(0, dtype=np.uint32)
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    return every[new]


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """chunk, data, keys, lengths, places, n_anchors, sample: whole documents, their anchors and a few prefixes for the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq = TaskContext.get().partitionId() << 32, 0
        texts: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(texts), dtype=np.uint8)
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            at = anchors(x, lengths)
            some = at[:: max(1, len(at) // 32)][:64]
            prefix = _words(x, some, 8)[0].byteswap() if len(some) else np.empty(0, np.uint64)
            ids = np.array([_NO_ID if k is None else k for k in keys], dtype=np.int64)
            known = np.array([k is not None for k in keys], dtype=np.uint8)
            squeeze = zstandard.ZstdCompressor(level=3).compress
            return pa.RecordBatch.from_pydict(
                {"chunk": pa.array([first + seq], pa.int64()), "data": pa.array([squeeze(x.tobytes())], pa.binary()), "keys": pa.array([squeeze(ids.tobytes() + known.tobytes())], pa.binary()), "lengths": pa.array([squeeze(lengths.tobytes())], pa.binary()),
                 "places": pa.array([squeeze(np.diff(at, prepend=np.uint32(0)).astype("<u4").tobytes())], pa.binary()), "n_anchors": pa.array([len(at)], pa.int64()), "sample": pa.array([(prefix ^ np.uint64(1 << 63)).view(np.int64).tolist()], pa.list_(pa.int64()))}
            )

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and held + len(raw) > CHUNK_BYTES:
                    yield flush()
                    seq, texts, keys, held = seq + 1, [], [], 0
                texts.append(raw)
                keys.append(k)
                held += len(raw)
        if texts:
            yield flush()

    schema = "chunk bigint, data binary, keys binary, lengths binary, places binary, n_anchors bigint, sample array<bigint>"
    return df.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, schema)


class Chunk:
    """An opened chunk: bytes, ids, whether they are known, lengths, document ends, anchors' places and their documents."""

    def __init__(self, data: bytes, keys: bytes, lengths: bytes, places: bytes) -> None:
        open_ = zstandard.ZstdDecompressor().decompress
        self.x = np.frombuffer(open_(data), dtype=np.uint8)
        self.lengths = np.frombuffer(open_(lengths), dtype=np.int64)
        raw = open_(keys)
        n = len(self.lengths)
        self.keys, self.known = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        self.ends = np.cumsum(self.lengths)
        self.at = np.cumsum(np.frombuffer(open_(places), "<u4"), dtype=np.int64)
        self.doc = np.searchsorted(self.ends, self.at, side="right")


def _words(x: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes at each place as 64-bit words, the first words first."""
    every = np.ndarray((len(x) - 7,), "<u8", x, strides=(1,))
    at = np.asarray(at, dtype=np.int64)
    return [every[at + k] for k in range(0, n, 8)]


def _sift(c: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order: bucket, 32-bit rest, whether several ids have it; and each anchor's index among them."""
    if not len(c.at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    h = np.zeros(len(c.at), dtype=np.uint64)
    for k, w in enumerate(_words(c.x, c.at, GRAM)):
        h = (h ^ w) * _ODD[k]
        h ^= h >> np.uint64(31)
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    code = (bucket << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(code)
    ordered = code[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(new)
    which = np.empty(len(code), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    keys, distinct = c.keys[c.doc][order], ordered[begins]
    return distinct >> 32, (distinct & 0xFFFFFFFF).astype(np.uint32), np.minimum.reduceat(keys, begins) < np.maximum.reduceat(keys, begins), which


def _open(t: pa.Table | pa.RecordBatch, i: int = 0) -> Chunk:
    return Chunk(*[t[c][i].as_py() for c in ("data", "keys", "lengths", "places")])


def shared_anchors(stored: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, bits: for a chunk's distinct hashes of a bucket, whether other documents may have them too."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                bucket, rest, several, _ = _sift(_open(b, i), buckets)
                present = np.unique(bucket)
                lo, hi = np.searchsorted(bucket, present), np.searchsorted(bucket, present, side="right")
                body = [rest[a:e].astype("<u4").tobytes() + several[a:e].astype(np.uint8).tobytes() for a, e in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(present.astype(np.int32)), "chunk": pa.array(np.full(len(present), b["chunk"][i].as_py())), "body": pa.array(body, pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        bodies = t["body"].to_pylist()
        sizes = np.array([len(x) // 5 for x in bodies])
        rest = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(bodies, sizes.tolist(), strict=True)])
        several = np.concatenate([np.frombuffer(x, np.uint8, n, 4 * n) for x, n in zip(bodies, sizes.tolist(), strict=True)]).astype(bool)
        order = np.argsort(rest, kind="stable")
        same = rest[order][1:] == rest[order][:-1]
        dup = np.zeros(len(rest), dtype=bool)
        dup[order[1:][same]] = True
        dup[order[:-1][same]] = True
        dup |= several
        cuts = np.cumsum(sizes)
        bits = [np.packbits(dup[e - n : e]).tobytes() for n, e in zip(sizes.tolist(), cuts.tolist(), strict=True)]
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "bits": pa.array(bits, pa.binary())})

    sent = stored.select("chunk", "data", "keys", "lengths", "places").mapInArrow(hashes, "bucket int, chunk bigint, body binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, bucket int, bits binary")


class Entries:
    """A chunk's distinct candidate suffixes in order, the least id of each, and its candidate anchors' entries."""

    def __init__(self, c: Chunk, bits: dict[int, bytes], buckets: int) -> None:
        bucket, _, _, which = _sift(c, buckets)
        dup = np.zeros(len(bucket), dtype=bool)
        for b, raw in bits.items():
            a, e = np.searchsorted(bucket, b), np.searchsorted(bucket, b, side="right")
            dup[a:e] = np.unpackbits(np.frombuffer(raw, np.uint8), count=e - a).astype(bool)
        chosen = dup[which] if len(which) else np.empty(0, bool)
        self.at, self.doc = c.at[chosen], c.doc[chosen]
        start, end = (c.ends - c.lengths)[self.doc], c.ends[self.doc]
        self.left = np.minimum(REACH, self.at - start)
        self.right = np.minimum(REACH, end - self.at - GRAM)
        n = len(self.at)
        rows = np.zeros((n, _ENTRY), dtype=np.uint8)
        if n:
            padded = np.concatenate((np.zeros(REACH, np.uint8), c.x, np.zeros(LENGTH, np.uint8)))
            here = self.at[:, None] + REACH
            rows[:, :GRAM] = padded[here + np.arange(GRAM)]
            reach = np.arange(REACH)
            rows[:, GRAM : GRAM + REACH] = padded[here + GRAM + reach] * (reach < self.right[:, None])
            rows[:, GRAM + REACH : GRAM + 2 * REACH] = padded[here - 1 - reach] * (reach < self.left[:, None])
            rows[:, -2], rows[:, -1] = self.right, self.left
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{_ENTRY}").ravel(), kind="stable") if n else np.empty(0, np.int64)
        ordered = rows[order]
        new = np.ones(n, dtype=bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        self.rows = ordered[new]
        entry = np.empty(n, dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        self.entry = entry
        self.least = np.full(len(self.rows), _NO_ID)
        np.minimum.at(self.least, entry, c.keys[self.doc])

    def ranges(self, splitters: np.ndarray) -> list[tuple[int, int, int]]:
        """(range, first entry, end) of each range of prefixes that has entries."""
        if not len(self.rows):
            return []
        prefix = np.ascontiguousarray(self.rows[:, :8]).view(">u8").ravel().astype(np.uint64)
        part = np.searchsorted(splitters, prefix, side="right")
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
        return [(int(part[a]), int(a), int(e)) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]


def front_code(rows: np.ndarray, least: np.ndarray) -> bytes:
    """Sorted rows as common-prefix lengths and the bytes behind, with an id for each."""
    differs = rows[1:] != rows[:-1]
    common = np.concatenate((np.zeros(1, np.int64), differs.argmax(axis=1))).astype(np.uint8)
    rest = rows[np.arange(rows.shape[1]) >= common[:, None]]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(rows)], "<u8").tobytes() + common.tobytes() + least.astype("<i8").tobytes() + rest.tobytes())


class Run:
    """A front-coded run, read entry by entry."""

    def __init__(self, raw: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        self.n, self.i = n, -1
        self.common = list(raw[8 : 8 + n])
        self.least = np.frombuffer(raw, "<i8", n, 8 + n).tolist()
        self.rest, self.pos = raw, 8 + 9 * n
        self.key = b""

    def step(self) -> int:
        """Goes to the next entry; its common prefix with the one before, -1 at the end."""
        self.i += 1
        if self.i == self.n:
            return -1
        c = self.common[self.i]
        e = self.pos + _ENTRY - c
        self.key = self.key[:c] + self.rest[self.pos : e]
        self.pos = e
        return c


def merge(runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """(common prefix with the entry before, its run) for all entries in order, by a loser tree that keeps common prefixes."""
    size = 1
    while size < len(runs):
        size *= 2
    live: list[Run | None] = [*runs, *[None] * (size - len(runs))]
    known = [0] * size
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps its common prefix with the winner."""
        x, y = live[a], live[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        h, g = known[a], known[b]
        if h != g:  # the one that shares more with the last winner comes first, and the other's prefix stays
            return (a, b) if h > g else (b, a)
        p, q = x.key[h:], y.key[h:]
        d = int.from_bytes(p) ^ int.from_bytes(q)
        if d == 0:
            known[b] = _ENTRY
            return a, b
        c = h + len(p) - (d.bit_length() + 7 >> 3)
        if p < q:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    for r in runs:
        r.step()
    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        nxt = []
        for k in range(level):
            w, loser = play(winners[2 * k], winners[2 * k + 1])
            tree[level + k] = loser
            nxt.append(w)
        winners = nxt
    top = winners[0]
    while (run := live[top]) is not None:
        yield known[top], run
        c = run.step()
        if c < 0:
            live[top] = None
        known[top] = max(c, 0)
        node = (top + size) >> 1
        while node:
            w, loser = play(top, tree[node])
            tree[node], top = loser, w
            node >>= 1


_ALL = (1 << (REACH + 1)) - 1


def _resolve(group: list[tuple[bytes, list[tuple[int, int, int]]]], masks: list[np.ndarray]) -> None:
    """Entries with the same GRAM bytes: bit o of a mask says that the window o bytes before has a smaller id elsewhere."""
    if len(group) == 1:
        members = group[0][1]
        if len(members) > 1:
            least = min(m[2] for m in members)
            for run, i, own in members:
                if own > least:
                    masks[run][i] = _ALL
        return
    after = [(k[GRAM : GRAM + REACH], k[GRAM + REACH : -2], k[-2], k[-1], min(m[2] for m in ms), ms) for k, ms in group]
    for o in range(REACH + 1):
        best: dict[bytes, int] = {}
        n = REACH - o
        fit = [(a[:n] + b[:o], low, ms) for a, b, r, le, low, ms in after if o <= le and n <= r]
        for w, low, _ in fit:
            if low < best.get(w, _NO_ID + 1):
                best[w] = low
        for w, _, ms in fit:
            least = best[w]
            for run, i, own in ms:
                if own > least:
                    masks[run][i] |= 1 << o


def _merge_range(t: pa.Table) -> pa.Table:
    runs = [Run(raw) for raw in t["run"].to_pylist()]
    number = {id(r): k for k, r in enumerate(runs)}
    masks = [np.zeros(r.n, dtype=np.uint32) for r in runs]
    group: list[tuple[bytes, list[tuple[int, int, int]]]] = []
    for common, run in merge(runs):
        member = (number[id(run)], run.i, run.least[run.i])
        if group and common >= _ENTRY:
            group[-1][1].append(member)
            continue
        if group and common < GRAM:
            _resolve(group, masks)
            group = []
        group.append((run.key, [member]))
    if group:
        _resolve(group, masks)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.table({"chunk": t["chunk"], "kind": pa.array([1] * len(runs), pa.int32()), "part": t["part"], "body": pa.array([squeeze(m.astype("<u4").tobytes()) for m in masks], pa.binary())})


def _bits(t: pa.Table) -> dict[int, bytes]:
    return {b: x for k, b, x in zip(t["kind"].to_pylist(), t["part"].to_pylist(), t["body"].to_pylist(), strict=True) if k == 0}


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (spans as start and end bytes) for each row of df."""
    spark = df.sparkSession
    stored = materialize(chunks(df, key, text), "suffix-chunks")
    total = stored.agg(F.sum("n_anchors")).first()[0] or 0
    buckets = max(2 * parallelism(spark), -(-total * 5 // BUCKET_BYTES))
    parts = max(4 * parallelism(spark), -(-total * 8 // BUCKET_BYTES))
    cuts = stored.select(F.explode("sample").alias("p")).agg(F.percentile_approx("p", [i / parts for i in range(1, parts)], 10_000).alias("c")).first()[0]
    splitters = np.unique(np.array(cuts or [], dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63))
    bits = materialize(shared_anchors(stored, buckets), "suffix-bits").select("chunk", F.lit(0).alias("kind"), F.col("bucket").alias("part"), F.col("bits").alias("body"))
    blobs = stored.select("chunk", "data", "keys", "lengths", "places")

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"part": [], "chunk": [], "run": []}
        for i in range(left.num_rows):
            e = Entries(_open(left, i), _bits(right), buckets)
            for part, a, b in e.ranges(splitters):
                out["part"].append(part)
                out["chunk"].append(left["chunk"][i].as_py())
                out["run"].append(front_code(e.rows[a:b], e.least[a:b]))
        return pa.table({"part": pa.array(out["part"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int64()), "run": pa.array(out["run"], pa.binary())})

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        bodies = {p: x for k, p, x in zip(right["kind"].to_pylist(), right["part"].to_pylist(), right["body"].to_pylist(), strict=True) if k == 1}
        tables = [_cut(_open(left, i), Entries(_open(left, i), _bits(right), buckets), bodies, splitters) for i in range(left.num_rows)]
        return pa.concat_tables(tables) if tables else _OUT.empty_table()

    sorted_runs = blobs.groupBy("chunk").cogroup(bits.groupBy("chunk")).applyInArrow(runs, "part int, chunk bigint, run binary")
    masks = sorted_runs.groupBy("part").applyInArrow(_merge_range, "chunk bigint, kind int, part int, body binary")
    answers = bits.unionByName(masks)
    return blobs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<bigint>")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64()))])


def _cut(c: Chunk, e: Entries, bodies: dict[int, bytes], splitters: np.ndarray) -> pa.Table:
    mask = np.zeros(len(e.rows), dtype=np.uint32)
    for part, a, b in e.ranges(splitters):
        mask[a:b] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bodies[part]), "<u4")
    window = np.zeros(len(c.x), dtype=bool)
    if len(e.at):
        later = c.keys[e.doc] > e.least[e.entry]
        own = np.where(later, np.uint32(_ALL), mask[e.entry])
        for o in range(REACH + 1):
            hit = (own >> np.uint32(o) & 1).astype(bool) & (o <= e.left) & (REACH - o <= e.right)
            window[e.at[hit] - o] = True
    seen = np.cumsum(window, dtype=np.int32)
    gone = seen > np.concatenate((np.zeros(min(LENGTH, len(seen)), np.int32), seen[:-LENGTH]))
    starts = c.ends - c.lengths
    # runs end where documents do
    cut = np.zeros(len(c.x) + 1, dtype=bool)
    cut[starts] = cut[-1] = True
    on = np.concatenate((gone, [False]))
    begins = np.flatnonzero(gone & (cut[:-1] | ~np.concatenate(([False], gone[:-1])))) if len(gone) else np.empty(0, np.int64)
    finishes = np.flatnonzero(gone & (cut[1:] | ~on[1:])) + 1
    lo, hi = np.searchsorted(begins, starts), np.searchsorted(begins, c.ends)
    removed = np.concatenate(([0], np.cumsum(gone, dtype=np.int32)))
    out: dict[str, list] = {"spans": [], "sha": []}
    raw = c.x.tobytes()
    for s, t, a, b in zip(starts.tolist(), c.ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if a == b:
            out["spans"].append([])
            out["sha"].append(hashlib.sha256(raw[s:t]).hexdigest())
        else:
            out["spans"].append([int(v) - s for k in range(a, b) for v in (begins[k], finishes[k])])
            out["sha"].append(hashlib.sha256(c.x[s:t][~gone[s:t]].tobytes()).hexdigest())
    return pa.table(
        {"doc_id": pa.array(c.keys, mask=~c.known), "n_bytes": pa.array(c.lengths), "n_removed": pa.array(removed[c.ends] - removed[starts]), "n_spans": pa.array((hi - lo).astype(np.int64)), "kept_sha256": pa.array(out["sha"], pa.string()), "removed": pa.array(out["spans"], pa.list_(pa.int64()))},
        schema=_OUT,
    )
