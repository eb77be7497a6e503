"""Token ids in a binary file format with random access: directly addressable codes.

An id is cut into chunks of CHUNK_BITS from the low end. Level 0 has the first chunk of every id, level k the k-th chunk of the ids
that have one; a bitmap beside each level says which entries go on, with a rank directory of one count for every BLOCK
bits. So the id at any position is found level by level, without decoding what stands before it.

A segment is one binary value of the Parquet container: magic, counts, then for each level the packed chunks, the bitmap and the
directory; whole documents, their ids and token counts in front. Segments hold about SEGMENT_TOKENS tokens and
documents in ascending id order. Bounds are drawn from all ids, so segments of a range follow each other without a sort of the whole.

Edge cases: a null text is empty and has the end id only; null ids come first; rows that share an id stand in the order of their
encoded ids; an empty table writes no segments and gives an empty result; other columns don't take part; a document longer than a
segment has one of its own.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, parallelism, scratch_path

CHUNK_BITS = 8
BLOCK = 512
END_ID = 2
SEGMENT_TOKENS = 1 << 17
CACHE_WORDS = 1 << 18
SLICE_BYTES = 4 << 20
_MAGIC = b"DAC1"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters for which the tokenizer's normaliser and word pattern are spelt out below; words with others are given to it whole.
_PLAIN = re.compile("[\x21-\x7e\u00a1-\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u017f]*")
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9]|[^a-z0-9ªµºß-öø-ɏ]+")


#: Kinds of bytes: ASCII white space, letters (of Latin-1 and Latin Extended-A, too), digits, the apostrophe, other printable ASCII, the rest.
_SPACE, _LETTER, _DIGIT, _QUOTE, _SIGN, _REST = range(6)


def _kinds() -> np.ndarray:
    out = np.full(256, _REST, dtype=np.uint8)
    out[0x21:0x7F] = _SIGN
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1] = _LETTER
    out[ord("'")] = _QUOTE
    return out


_KINDS = _kinds()
#: Whether the word pattern always ends a word between two kinds. What follows a quote may belong to it, what follows a sign runs on with signs.
_ENDS = np.zeros((6, 6), dtype=bool)
_ENDS[_SPACE, 1:] = _ENDS[1:, _SPACE] = True
_ENDS[_LETTER, [_DIGIT, _QUOTE, _SIGN]] = _ENDS[_SIGN, [_LETTER, _DIGIT]] = True
_ENDS[_DIGIT, [_LETTER, _DIGIT, _QUOTE, _SIGN]] = True
_ENDS = _ENDS.reshape(-1)


def _units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at white space and wherever else the word pattern ends a word for certain: distinct units in lower case, the number of
    each unit in turn, and the first unit of each text and the end of the last's.

    Letters in front of other than ASCII keep their case: composing may depend on it. No text may hold a special token.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kinds = _KINDS[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))  # U+00C0 to U+017F
    first, second = raw[lead], raw[lead + 1]
    # the signs of times and division, and a capital whose lower case isn't one letter
    letter = ~(((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC4) & (second == 0xB0)))
    kinds[lead[letter]] = kinds[lead[letter] + 1] = _LETTER
    starts = np.zeros(len(raw) + 1, dtype=bool)
    starts[1:-1] = _ENDS[kinds[:-1] * np.uint8(6) + kinds[1:]]
    starts[offsets] = starts[-1] = True
    starts = np.flatnonzero(starts).astype(np.int32)
    capital = (raw - np.uint8(65)) < 26
    capital[:-1] &= raw[1:] < 0x80
    capital[-1:] = False
    low = raw + (capital.view(np.uint8) << np.uint8(5))
    units = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(low)]).dictionary_encode()
    used = kinds[starts[:-1]] != _SPACE
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(used)))
    return units.dictionary, units.indices.to_numpy()[used], upto[np.searchsorted(starts, offsets)]


class Encoder:
    """Ids of texts by a tokenizer that drops white space and never joins what its word pattern separates.

    The distinct words of a few megabytes of text are looked up, and their ids gathered for all words at once. Words, and the units that
    the pattern cuts them into, are remembered, CACHE_WORDS of each; what doesn't fit is encoded anew. Units are asked for many at a
    time: the last token of a unit has the vocabulary's word end. Words that aren't spelt out here get a special token between them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.units: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.mark, self.mark_id = "<|startoftext|>", self.tokenizer.token_to_id("<|startoftext|>")

    def _ask(self, units: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(units), 2000):
            some = units[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) != len(some):  # not one word each
                out.update(self._ask_marked(some))
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            out.update(zip(some, [raw[a:e] for a, e in zip([0, *ends], ends, strict=False)], strict=True))
        return out

    def _ask_marked(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        odd = [w for w in words if "<|" in w]
        for w in odd:
            out[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = [w for w in words if "<|" not in w] if odd else words
        for at in range(0, len(words), 500):
            some = words[at : at + 500]
            ids = np.array(self.tokenizer.encode(self.mark.join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id) * 4
            raw, starts, ends = ids.tobytes(), [0, *(cuts + 4).tolist()], [*cuts.tolist(), 4 * len(ids)]
            out.update(zip(some, [raw[a:e] for a, e in zip(starts, ends, strict=True)], strict=True))
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[memoryview, np.ndarray]]:
        """For a few texts at a time: little-endian 32-bit ids of all, and the first byte of each text's ids and the end of the last's.

        ASCII white space cuts words, and so do other ends of words that bytes tell, unless a special token may be about; the tokenizer
        drops other white space itself.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)] if len(texts) else []
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            some = texts.slice(a, e - a)
            if some.type != pa.string() or pc.any(pc.match_substring(some, "<|")).as_py():
                parts = pc.ascii_split_whitespace(some)
                coded = parts.flatten().dictionary_encode()
                words, at, bounds = coded.dictionary, coded.indices.to_numpy(), parts.offsets.to_numpy()
            else:
                words, at, bounds = _units(some)
            gc.disable()  # many small lists and no cycles
            try:
                ids = self._ids(words.to_pylist())
            finally:
                gc.enable()
            many = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            first = np.cumsum(many) - many
            pool, n = np.frombuffer(b"".join(ids), "<u4"), many[at]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            place = np.repeat(first[at] - ends[:-1], n)
            place += np.arange(len(place))
            yield memoryview(pool[place].tobytes()), 4 * ends[bounds]

    def _ids(self, words: list[str]) -> list[bytes]:
        out = list(map(self.words.get, words))
        new = [i for i, x in enumerate(out) if x is None]
        if not new:
            return out
        # lower-case ASCII letters are one unit as they stand
        quick = [i for i in new if (w := words[i]).isascii() and w.isalpha() and w.islower()]
        if quick:
            asked = self._ask([words[i] for i in quick])
            for i in quick:
                out[i] = asked[words[i]]
            self._remember(words, out, quick)
            new = [i for i in new if out[i] is None]
        whole, cut, odd = [], [], []  # (number, unit), (number, units), numbers
        units, plain, wanted = self.units, _PLAIN.fullmatch, set()
        for i in new:
            w = words[i]
            if not w.strip(SPACES):
                out[i] = b""
                continue
            if not plain(w) or "<|" in w:
                odd.append(i)
                continue
            low = w.lower()
            if low.isalpha():
                whole.append((i, low))
                if low not in units:
                    wanted.add(low)
                continue
            some = [low[:-1], low[-1]] if low[-1] in ".,;:!?" and low[:-1].isalpha() else _UNITS.findall(low)
            cut.append((i, some))
            wanted.update([u for u in some if u not in units])
        fresh = self._ask(list(wanted))
        room = CACHE_WORDS - len(units)
        if len(fresh) <= room:
            units.update(fresh)
        else:
            units.update(islice(fresh.items(), room))
        known, get = units.get, fresh.get
        for i, u in whole:
            x = get(u)
            out[i] = known(u) if x is None else x
        for i, some in cut:
            out[i] = b"".join([known(u) if (x := get(u)) is None else x for u in some])
        if odd:
            asked = self._ask_marked([words[i] for i in odd])
            for i in odd:
                out[i] = asked[words[i]]
        self._remember(words, out, new)
        return out

    def _remember(self, words: list[str], ids: list[bytes], which: list[int]) -> None:
        for i in which[: max(0, CACHE_WORDS - len(self.words))]:
            self.words[words[i]] = ids[i]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for a worker process, kept from task to task. A core has one worker, so the library needs no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    pa.set_memory_pool(pa.system_memory_pool())
    return Encoder(path)


def pack(ids: np.ndarray) -> bytes:
    """The levels of directly addressable codes of unsigned 32-bit ids."""
    ids = np.asarray(ids, dtype=np.uint32)
    out, left, mask = [struct.pack("<QB", len(ids), CHUNK_BITS)], ids, np.uint32((1 << CHUNK_BITS) - 1)
    while True:
        rest = left >> np.uint32(CHUNK_BITS)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        blocks = -(-len(more) // BLOCK)
        padded = np.zeros(blocks * BLOCK, dtype=np.int64)
        padded[: len(more)] = more
        ranks = np.concatenate(([0], np.cumsum(padded.reshape(blocks, BLOCK).sum(axis=1))))[:-1].astype("<u4") if blocks else np.empty(0, "<u4")
        chunk = (left & mask).astype(np.uint8)
        out.append(struct.pack("<QB", len(left), bool(more.any())) + chunk.tobytes() + bitmap.tobytes() + ranks.tobytes())
        if not more.any():
            return b"".join(out)
        left = rest[more]


class Codes:
    """Reads packed ids: one at a time through the rank directories, or all at once."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.n, self.bits = struct.unpack_from("<QB", data, at)
        at += 9
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        go_on = True
        while go_on:
            n, go_on = struct.unpack_from("<QB", data, at)
            at += 9
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n
            bitmap = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += (n + 7) // 8
            ranks = np.frombuffer(data, "<u4", -(-n // BLOCK), at)
            at += ranks.nbytes
            self.levels.append((chunk, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (k * self.bits)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * BLOCK
            head = np.unpackbits(bitmap[start >> 3 : (i >> 3) + 1], bitorder="little")[: i - start]
            i = int(ranks[i // BLOCK]) + int(head.sum())
        return value

    def all(self) -> np.ndarray:
        value: np.ndarray | None = None
        for chunk, bitmap, _ in reversed(self.levels):
            low = chunk.astype(np.uint32)
            if value is not None:
                more = np.unpackbits(bitmap, bitorder="little", count=len(chunk)).astype(bool)
                low[more] |= value << np.uint32(self.bits)
            value = low
        return value


def pack_segment(keys: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    head = _MAGIC + struct.pack("<Q", len(keys)) + keys.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + counts.astype("<u8").tobytes()
    return head + pack(ids)


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """Document ids, whether each is known (not null), token counts, and the codes of all tokens."""
    if data[:4] != _MAGIC:
        raise ValueError("not a segment of token ids")
    (n,) = struct.unpack_from("<Q", data, 4)
    keys = np.frombuffer(data, "<i8", n, 12)
    known = np.frombuffer(data, np.uint8, n, 12 + 8 * n).astype(bool)
    counts = np.frombuffer(data, "<u8", n, 12 + 9 * n).astype(np.int64)
    return keys, known, counts, Codes(data, 12 + 17 * n)


def write(df: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID) -> None:
    """Encodes all texts and writes the segments under path: columns range, segment, n_docs, n_tokens, data."""
    spark = df.sparkSession
    n = parallelism(spark)
    ids = df.select(F.col(f"`{key}`").cast("bigint").alias("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000).alias("c")).first()[0] if n > 1 else None
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary).encode
        for b in batches:
            at = 0
            for raw, bounds_of in ids_of(b.column(1)):
                keys = b.column(0).slice(at, len(bounds_of) - 1)
                at += len(keys)
                part = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
                ids = np.frombuffer(raw, "<u4")
                if end:
                    ids = np.insert(ids, bounds_of[1:] // 4, np.uint32(end_id))
                    bounds_of = bounds_of + 4 * np.arange(len(bounds_of))
                column = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(bounds_of.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([keys, pa.array(part, pa.int32()), column], names=["k", "range", "ids"])

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(encode, "k bigint, range int, ids binary")
    ordered = rows.repartition(n, "range").sortWithinPartitions("range", F.col("k").asc_nulls_first(), "ids")

    def pack_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seq, tokens = None, 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # keys, counts and ids of whole documents

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays([h[0] for h in held])
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            data = pack_segment(keys.fill_null(0).to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False), counts, ids)
            return pa.RecordBatch.from_pydict({"range": pa.array([here], pa.int32()), "segment": pa.array([seq], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([int(counts.sum())], pa.int64()), "data": pa.array([data], pa.binary())})

        for b in batches:
            ranges = b.column(1).to_numpy()
            column = b.column(2)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
            ids = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: 4 * int(offsets[-1])].view("<u4") if len(column) else None
            at = 0
            while at < b.num_rows:
                r = int(ranges[at])
                if held and (r != here or tokens + int(offsets[at + 1] - offsets[at]) > SEGMENT_TOKENS):
                    yield flush()
                    seq = seq + 1 if r == here else 0
                    held, tokens = [], 0
                elif r != here:
                    seq = 0
                here = r
                # as many documents as the segment has room for, one at least
                last = int(np.searchsorted(ranges, r, side="right"))
                upto = min(last, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT_TOKENS - tokens, side="right")) - 1))
                # copies, so that a few held documents don't keep a batch
                held.append((pa.array(b.column(0).slice(at, upto - at).to_pylist(), pa.int64()), np.diff(offsets[at : upto + 1]).astype(np.int64), ids[offsets[at] : offsets[upto]].copy()))
                tokens += len(held[-1][2])
                at = upto
        if held:
            yield flush()

    ordered.mapInArrow(pack_ranges, "range int, segment int, n_docs bigint, n_tokens bigint, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 for each document."""
    files = spark.read.parquet(path)
    sums = files.select("range", "segment", "n_tokens")
    # ranges: as many rows as shuffle partitions at most
    ranges = sums.groupBy("range").agg(F.sum("n_tokens").alias("words"))
    before = ranges.select("range", F.coalesce(F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("range").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("offset")).join(F.broadcast(before), "range").select("range", "segment", (F.col("range_start") + F.col("offset")).alias("first"))
    rows = files.mapInArrow(_decode, "range int, segment int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(starts, ["range", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r, s, data in zip(b.column("range").to_pylist(), b.column("segment").to_pylist(), b.column("data"), strict=True):
            keys, known, counts, codes = read_segment(data.as_py())
            raw = memoryview(codes.all().astype("<u4").tobytes())
            ends = np.cumsum(counts)
            starts = ends - counts
            crc = np.array([zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r, np.int32)), pa.array(np.full(n, s, np.int32)), pa.array(keys.astype(np.int64), mask=~known), pa.array(starts), pa.array(counts), pa.array(crc)],
                names=["range", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def round_trip(df: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files in the shared folder and reads them back."""
    spark = df.sparkSession
    path = scratch_path(spark, "token-files")
    write(df, path, vocabulary or default_vocabulary(), key, text)
    return read(spark, path)
