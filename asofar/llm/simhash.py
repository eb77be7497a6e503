"""SimHash near-duplicates found through deletion-variant signatures.

A fingerprint has 64 bits (or several such words); two link when at most ``distance`` bits differ. The bits are cut into
distance // 2 + 1 segments, so of two linked fingerprints some segment differs by one bit at most. Each segment is indexed once for each of its bits with that
bit wiped out: segments that differ by at most one bit share such a variant. Equal variants meet by an equality exchange
(64 rows for each distinct fingerprint), links are verified on all bits, and each task keeps only a spanning forest of the links
it has found. Components come from an iterated minimum with pointer jumping over the forests' edges.

Copies share a fingerprint and take part once. A bucket is explored breadth-first from members not yet reached, in blocks: a tight
cluster is absorbed by its first members, and no pairs are listed.

Edge cases: null and blank texts have no words and fingerprint zero, which links like any other; texts with fewer words than a
shingle are one shingle; null ids take part but are never a component's id, unless it has no other; repeated rows
get the same component; an empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dimension, materialize, parallelism

WORD = 64
SEED = 42
_BLOCK = 1 << 22
#: Buckets of at most so many members are compared in one go for all buckets of a batch.
_FEW = 64
#: A candidate component is compared in blocks of so many texts and of so many shingles.
_TEXTS, _SHINGLES = 2000, 1 << 20
#: Words of 64 bits that tell map tasks which texts may be candidates.
_MARKS = 1 << 18


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of the ASCII-lowered words, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([h(b" ".join(w), SEED)], dtype=np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(w) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """Bit by bit the strict majority; zero for no hashes. Words after the first come from remixed hashes."""
    out = []
    for k in range(words):
        ones = np.zeros(WORD, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8")
            if k:
                part = (part ^ (part >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                part ^= part >> np.uint64(32)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def _names(words: int) -> list[str]:
    return [f"__f{k}" for k in range(words)]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """__key, __hash (of the text) and the fingerprint's 64-bit words as signed longs, __f0 and on, for each row.

    distinct: each shingle of a text counts once, however often it occurs.
    """
    hashes = (lambda t: np.unique(shingle_hashes(t, shingle))) if distinct else (lambda t: shingle_hashes(t, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(hashes(t), words) for t in b.column(2).to_pylist()], dtype=np.uint64).reshape(b.num_rows, words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(words)]], names=["__key", "__hash", *_names(words)])

    schema = ", ".join(["__key bigint", "__hash bigint", *[f"{n} bigint" for n in _names(words)]])
    return df.select(F.col(f"`{key}`").cast("bigint").alias("__key"), F.xxhash64(f"`{text}`").alias("__hash"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment of a 64-bit word."""
    return [(WORD * i // count, WORD * (i + 1) // count - WORD * i // count) for i in range(count)]


def variants(fps: DataFrame, words: int, count: int) -> DataFrame:
    """__bucket beside __id and the fingerprint: a row for each bit; the bucket is the bit's segment without the bit, and the bit's place."""
    entries = []
    for k, name in enumerate(_names(words)):
        for first, n in segments(count):
            part = F.shiftrightunsigned(F.col(name), first).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
            entries += [part.bitwiseAND(F.lit((1 << n) - 1 - (1 << i)).cast("bigint")) * (WORD * words) + (k * WORD + first + i) for i in range(n)]
    return fps.select(F.explode(F.array(*entries)).alias("__bucket"), "__id", *_names(words))


class Forest:
    """Union-find over fingerprints, the smallest number at the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _explore(ids: np.ndarray, fps: np.ndarray, distance: int, forest: Forest) -> None:
    """Links all members of a bucket that linked ones can reach within it; each is compared to those not yet reached."""
    left = np.arange(len(ids))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            step = max(1, _BLOCK // len(left))
            for at in range(0, len(front), step):
                some = front[at : at + step]
                bits = np.bitwise_count(fps[some, 0][:, None] ^ fps[left, 0][None, :]).astype(np.int32)
                for k in range(1, fps.shape[1]):
                    bits += np.bitwise_count(fps[some, k][:, None] ^ fps[left, k][None, :])
                near = bits <= distance
                first = near.argmax(axis=0)
                new = near[first, np.arange(len(left))] & ~hit
                for a, b in zip(ids[some[first[new]]].tolist(), ids[left[new]].tolist(), strict=True):
                    forest.link(a, b)
                hit |= new
            front, left = left[hit], left[~hit]


def links(fps: DataFrame, distance: int = 4, words: int = 1, count: int | None = None) -> DataFrame:
    """__a > __b: edges between the __id of distinct fingerprints that connect what their links connect; a spanning forest a task.

    count: segments of a word. With the default, distance // 2 + 1 (one word), no link is lost. Fewer, wider segments meet fewer strangers
    at large distances, and lose a link where every segment of all words has two bits or more that differ.
    """
    met = variants(fps, words, count or distance // 2 + 1).repartition(parallelism(fps.sparkSession), "__bucket").sortWithinPartitions("__bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def explore(bucket: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> None:
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
            sizes = ends - starts
            few = (sizes > 1) & (sizes <= _FEW)
            rows = np.flatnonzero(np.repeat(few, sizes))
            for step in range(1, int(sizes[few].max(initial=1))):
                one, two = rows[:-step], rows[step:]
                met = bucket[one] == bucket[two]
                one, two = one[met], two[met]
                near = np.bitwise_count(fp[one] ^ fp[two]).sum(axis=1, dtype=np.int64) <= distance
                for x, y in zip(ids[one[near]].tolist(), ids[two[near]].tolist(), strict=True):
                    forest.link(x, y)
            for s, e in zip(starts[sizes > _FEW].tolist(), ends[sizes > _FEW].tolist(), strict=True):
                _explore(ids[s:e], fp[s:e], distance, forest)

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            # the last bucket may go on in the next batch
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if last:
                explore(now[0][:last], now[1][:last], np.stack([c[:last] for c in now[2:]], axis=1).view(np.uint64))
            held = [c[last:] for c in now]
        if held is not None and len(held[0]):
            explore(held[0], held[1], np.stack(held[2:], axis=1).view(np.uint64))
        pairs = [(k, forest.root(k)) for k in list(forest.up)]
        for at in range(0, len(pairs), 50_000):
            some = np.array(pairs[at : at + 50_000], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["__a", "__b"])

    return met.mapInArrow(run, "__a bigint, __b bigint")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """__node, __root for each node of the edges __a, __b: the smallest node that it is connected to.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends, rewrites the edges to the ends and
    drops loops and repeats. Only nodes without a smaller neighbour remain, half of them at most; each round is a written table.
    """
    both = lambda e: e.select("__a", "__b").union(e.select(F.col("__b").alias("__a"), F.col("__a").alias("__b")))
    edges = materialize(edges.filter("__a <> __b").distinct(), "simhash-edges")
    label = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        parent = both(edges).groupBy(F.col("__a").alias("__node")).agg(F.min("__b").alias("__p")).select("__node", F.least("__node", "__p").alias("__root"))
        # written, so that the joins on __root, which most nodes may share, are of plain exchanges: those a skewed key is split in
        parent = materialize(parent, "simhash-neighbours")
        settled = False
        while not settled:
            for _ in range(2):
                upper = parent.select(F.col("__node").alias("__n2"), F.col("__root").alias("__r2"))
                parent = parent.join(upper, F.col("__root") == F.col("__n2"), "left").select("__node", F.coalesce("__r2", "__root").alias("__root"), (F.col("__r2") != F.col("__root")).alias("__moved"))
            parent = materialize(parent, "simhash-parents")
            settled = parent.filter("__moved").isEmpty()
        upper = parent.select(F.col("__node").alias("__n2"), F.col("__root").alias("__r2"))
        if label is None:
            label = upper.select(F.col("__n2").alias("__node"), F.col("__r2").alias("__root"))
        else:
            label = materialize(label.join(upper, F.col("__root") == F.col("__n2"), "left").select("__node", F.coalesce("__r2", "__root").alias("__root")), "simhash-labels")
        a = edges.join(upper, F.col("__a") == F.col("__n2"), "left").select(F.coalesce("__r2", "__a").alias("__a"), "__b")
        b = a.join(upper, F.col("__b") == F.col("__n2"), "left").select("__a", F.coalesce("__r2", "__b").alias("__b"))
        edges = materialize(b.filter("__a <> __b").distinct(), "simhash-edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label if label is not None else edges.select(F.col("__a").alias("__node"), F.col("__b").alias("__root"))


def _grouped(df: DataFrame, key: str, text: str, shingle: int, distance: int, words: int, count: int | None, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """A row for each row of df (__key, __hash, fingerprint), and one for each distinct fingerprint: __root of its component and __first row."""
    names = _names(words)
    base = materialize(fingerprints(df, key, text, shingle, words, distinct), "simhash-fingerprints")
    first = F.min(F.struct(F.col("__key").isNull().alias("none"), F.coalesce("__key", F.lit(0)).alias("id"), F.col("__hash").alias("hash")))
    fps = base.groupBy(*names).agg(F.min("__key").alias("__least"), first.alias("__first"), F.count(F.lit(1)).alias("__n"))
    fps = materialize(fps.withColumn("__id", F.monotonically_increasing_id()), "simhash-distinct")
    found = components(links(fps.select("__id", *names), distance, words, count))
    return base, fps.join(found.withColumnRenamed("__node", "__id"), "__id", "left").withColumn("__root", F.coalesce("__root", "__id"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, words: int = 1, count: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a word), component_id (smallest id reachable) and component_size for each row of df."""
    names = _names(words)
    base, joined = _grouped(df, key, text, shingle, distance, words, count)
    joined = materialize(joined.select(*names, "__root", "__least", "__n"), "simhash-rooted")
    ids = materialize(joined.groupBy("__root").agg(F.min("__least").alias("component_id"), F.sum("__n").alias("component_size")), "simhash-ids")
    labelled = materialize(joined.select(*names, "__root").join(ids, "__root").select(*names, "component_id", "component_size"), "simhash-components")
    out = base.join(labelled, names)
    return out.select(F.col("__key").alias("doc_id"), F.concat(*[F.lpad(F.lower(F.hex(n)), 16, "0") for n in names]).alias("fingerprint"), "component_id", "component_size")


def similar(sets: list[np.ndarray], numerator: int = 4, denominator: int = 5) -> list[tuple[int, int]]:
    """Links that connect what pairs of sets with a Jaccard similarity of numerator / denominator or more connect.

    A set asks for all its links at once, through the postings of its elements. Sets within the group of the first to ask needn't:
    of any two that end up apart, one at least has asked. Empty sets equal each other.
    """
    lengths = np.array([len(x) for x in sets], dtype=np.int64)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(element, kind="stable")
    owner = np.repeat(np.arange(len(sets)), lengths)[order]
    ends = np.cumsum(np.bincount(element, minlength=1))
    begins, last = np.concatenate(([0], ends[:-1])), np.cumsum(lengths)
    forest, out = Forest(), []
    first = int(np.argsort(lengths, kind="stable")[len(sets) // 2])
    for x in [first, *[i for i in range(len(sets)) if i != first]]:
        if x != first and forest.root(x) == forest.root(first):
            continue
        if not lengths[x]:
            hits = np.flatnonzero(lengths == 0)
        else:
            own = element[last[x] - lengths[x] : last[x]]
            n = ends[own] - begins[own]
            at = np.repeat(begins[own] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            common = np.bincount(owner[at], minlength=len(sets))
            hits = np.flatnonzero((common > 0) & (common * denominator >= numerator * (lengths[x] + lengths - common)))
        for y in hits.tolist():
            if forest.root(x) != forest.root(y):
                forest.link(x, y)
                out.append((x, y))
    return out


def _verified(safe: DataFrame, key: str, text: str, shingle: int, nodes: DataFrame) -> DataFrame:
    """__a > __b: edges between the __id of nodes (of candidate components, __root) that connect what similar shingle sets connect.

    The sets are made again for candidates only. A component of more than a block's texts or shingles is compared block by block
    with itself, each two blocks in one task, so none has to fit into one.
    """
    many = nodes.groupBy("__root").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__root")
    wanted = materialize(nodes.join(many, "__root", "left_semi").select("__id", "__root", "__first.none", "__first.id", "__first.hash"), "simhash-candidates")
    place, bit = F.pmod("hash", F.lit(_MARKS)).alias("__place"), F.expr(f"shiftleft(1L, cast(pmod(hash div {_MARKS}, 64) as int))")
    marks = wanted.groupBy(place).agg(F.bit_or(bit).alias("__marks"))
    k = F.col(key).cast("bigint")
    rows = safe.select(k.isNull().alias("none"), F.coalesce(k, F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("__text"))
    # at most _MARKS rows are broadcast; a text marked by chance is dropped by the join
    rows = rows.withColumn("__place", place).join(F.broadcast(marks), "__place").filter(F.col("__marks").bitwiseAND(bit) != 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], names=["none", "id", "hash", "__set"])

    made = rows.select("none", "id", "hash", "__text").mapInArrow(sets, "none boolean, id bigint, hash bigint, __set binary")
    made = materialize(made.join(wanted, ["none", "id", "hash"]).dropDuplicates(["none", "id", "hash"]).select("__id", "__root", "__set"), "simhash-sets")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / _TEXTS, F.sum(F.length("__set")) / (8 * _SHINGLES))).cast("int")
    large = materialize(made.groupBy("__root").agg(blocks.alias("__blocks")).filter("__blocks > 1"), "simhash-blocks")
    dealt = join_dimension(made, large, ["__root"], large.count()).withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64("__id"), F.col("__blocks")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.select("__id", "__root", F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"), "__set")

    def compare(group: pa.Table) -> pa.Table:
        ids = group["__id"].to_numpy()
        pairs = similar([np.frombuffer(x, dtype="<u8") for x in group["__set"].to_pylist()])
        ends = np.array([(ids[x], ids[y]) for x, y in pairs], dtype=np.int64).reshape(-1, 2)
        return pa.table({"__a": pa.array(ends.max(axis=1, initial=-1)), "__b": pa.array(ends.min(axis=1, initial=np.iinfo(np.int64).max))})

    return dealt.groupBy("__root", "__i", "__j").applyInArrow(compare, "__a bigint, __b bigint")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 38, words: int = 3, count: int | None = 4) -> DataFrame:
    """One row of df for each component of texts whose sets of shingles have a Jaccard similarity of .8 or more, that of the smallest id (null ids last).

    Fingerprints, of distinct shingles, only find candidates: texts within the distance, and what these connect. Links are verified on the shingles.
    The defaults take five words and 192 bits of which four fifths agree. At that distance no cut into segments of one differing bit is
    selective, so four segments of 16 bits a word are searched: of a pair with a Jaccard similarity of .8 some segment differs by one
    bit at most with a probability of .98, and the pair lies within the distance with one of .96; at .85 both are above .99.
    """
    columns = {c: f"__col{i}" for i, c in enumerate(df.columns)}
    safe = df.select(*[df[f"`{c}`"].alias(a) for c, a in columns.items()])
    names = _names(words)
    base, joined = _grouped(safe, columns[key], columns[text], shingle, distance, words, count, distinct=True)
    # equal fingerprints don't make equal texts, so each text is a node
    first = F.min(F.struct(F.col("__key").isNull().alias("none"), F.coalesce("__key", F.lit(0)).alias("id"), F.col("__hash").alias("hash")))
    nodes = base.groupBy(*names, "__hash").agg(first.alias("__first")).join(joined.select(*names, "__root"), names)
    nodes = materialize(nodes.select("__root", "__first", F.monotonically_increasing_id().alias("__id")), "simhash-texts")
    found = components(_verified(safe, columns[key], columns[text], shingle, nodes)).withColumnRenamed("__root", "__label")
    labelled = nodes.join(found.withColumnRenamed("__node", "__id"), "__id", "left").withColumn("__label", F.coalesce("__label", "__id"))
    chosen = materialize(labelled.groupBy("__label").agg(F.min("__first").alias("f")).select("f.none", "f.id", "f.hash"), "simhash-chosen")
    k = F.col(columns[key]).cast("bigint")
    rows = safe.withColumns({"none": k.isNull(), "id": F.coalesce(k, F.lit(0)), "hash": F.xxhash64(columns[text])})
    # the join's partitions serve for rows that share id and text, too
    out = rows.join(chosen, ["none", "id", "hash"], "left_semi").dropDuplicates(["none", "id", "hash"])
    return out.select(*[F.col(a).alias(c) for c, a in columns.items()])
