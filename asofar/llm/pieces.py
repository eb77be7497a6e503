"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search reads code points one by one. It keeps scores and characters for a window as long as the longest piece, and the tree of
backpointers that survive: a boundary that has left the window goes when no later one points to it, and when all survivors descend from
one boundary, the ids up to it are committed and dropped at once. Each boundary enters and leaves the tree once, so the work is linear. Only a
text whose paths never meet (one character, repeated) keeps its tree to its end. The best path is that of the highest summed score; of
equal ones the one whose last piece is longest.

A vocabulary may say where the search always converges: between two characters that stand side by side in no piece. If no piece has
the word mark behind another character, every word's start is such a boundary; under a plain normaliser with byte pieces any other such pair is
one, too (a letter and a comma, say). Then the distinct words of a few megabytes of text are searched, many words of about one length in step
(the same recurrence, a lane for each word), and their ids gathered for all texts. Longer words than LANE_CHARS, and whole texts under other
vocabularies, stream. Words are remembered (CACHE_WORDS at most); what doesn't fit is searched again.

Viterbi search is the rule of unigram models. A model file of the BPE type defines its ids by merges, which no sum of scores
reproduces; for such a file ``ids`` are the merges' (the library is asked for the same distinct words), and the Viterbi
segmentation over the same pieces and scores stands beside them. Unknown characters fall back to bytes.

Edge cases: a null text is empty and has no ids; white space and the word mark's own character are kept as the model's
normaliser maps them (the mark decodes to a blank); lone surrogates can't occur in Spark strings; repeated rows are encoded one by one; an
empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

MARK = "▁"
CACHE_WORDS = 1 << 17
#: Longer words stream, and aren't remembered.
LANE_CHARS = 64
#: Texts are taken in slices of about so many bytes.
SLICE_BYTES = 1 << 19
#: New words are searched so many at a time, so many characters of them in step.
WORDS_AT_ONCE = 1 << 13
LANES_CHARS = 1 << 14
#: Words are given to the library so many in one text.
JOINED = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model file: scores by piece, byte pieces, and what kind of model it is."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.byte, self.score, self.id = {}, {}, {}
        for i in range(m.vocab_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.id[p] = i
                self.score[p] = m.get_score(i)
        self.spelt = {i: p for p, i in self.id.items()}
        self.longest = max(map(len, self.id), default=1)
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.word_starts = all(MARK not in p.lstrip(MARK) for p in self.id)
        with open(path, "rb") as f:
            raw = f.read()
        self.unigram = _model_type(raw) == 1
        rules = dict(_fields(next((v for n, v in _fields(raw) if n == 3), b"")))
        #: Whether normalising is no more than the prefix and blanks as marks: no map of characters, no blanks taken out.
        self.plain = not rules.get(2) and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
        self.prefix = bool(rules.get(3, 1))
        self.cuts = self._cuts() if self.plain and self.byte else None
        self.tables = self._tables()

    def _cuts(self) -> np.ndarray:
        """For 256 * a byte + the next one: whether a character ends between them and no piece goes on there; blanks for marks.

        Unused pieces count, for merges pass through them.
        """
        m = self.model
        out = np.ones((256, 256), dtype=bool)
        out[:, 0x80:0xC0] = False
        for i in range(m.vocab_size()):
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)):
                p = [c.encode() for c in m.id_to_piece(i).replace(MARK, " ")]
                for a, b in zip(p[:-1], p[1:], strict=True):
                    out[a[-1], b[0]] = False
        return out.reshape(-1)

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each size: sorted hashes of the pieces, their scores and ids, and which 16-bit digests of hashes occur."""
        by_size: list[list[str]] = [[] for _ in range(self.longest + 1)]
        for p in self.id:
            by_size[len(p)].append(p)
        out = []
        for size, some in enumerate(by_size):
            codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").reshape(len(some), size) if size and some else np.empty((0, size), np.uint32)
            h = np.zeros(len(codes), np.uint64)
            for k in range(size):
                h = h * _MIX + codes[:, k]
            order = np.argsort(h)
            ids = np.array([self.id[p] for p in some], dtype=np.int32)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[_digest(h)] = True
            out.append((h[order], np.array([self.score[p] for p in some])[order] if some else np.empty(0), ids[order], seen))
        return out

    def unknown_ids(self, char: str) -> list[int]:
        if not self.byte:
            return [self.model.unk_id()]
        return [self.byte[b] for b in char.encode("utf-8")]


def _digest(h: np.ndarray) -> np.ndarray:
    return (h * _MIX >> np.uint64(48)).astype(np.uint16)


def _varint(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[i] & 127) << shift
        shift += 7
        i += 1
        if raw[i - 1] < 128:
            return value, i


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""
    i = 0
    while i < len(raw):
        tag, i = _varint(raw, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(raw, i)
        elif kind == 2:
            n, i = _varint(raw, i)
            value, i = raw[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


def _model_type(raw: bytes) -> int:
    """1 for unigram, 2 for BPE: field 3 of the trainer's settings, which are field 2 of the model."""
    for number, value in _fields(raw):
        if number == 2:
            return next((v for n, v in _fields(value) if n == 3), 1)
    return 1


class StreamingViterbi:
    """Feed characters, take committed ids. What is open: the window, and the surviving backpointers since the last committed boundary."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.n = self.root = 0
        self.tail = ""  # the last characters, as many as the longest piece has
        self.best = [0.0]  # scores of the last boundaries, likewise
        self.up: dict[int, int] = {}
        self.ids: dict[int, list[int]] = {}
        self.kids = {0: 0}  # of each boundary in the tree: how many point to it,
        self.mixed = {0: 0}  # and their exclusive or: of one child the child itself
        self.widest = 0

    def feed(self, chars: Iterable[str]) -> Iterator[list[int]]:
        p = self.p
        score, longest, unknown = p.score.get, p.longest, p.unknown
        up, kids, mixed = self.up, self.kids, self.mixed
        for ch in chars:
            tail = self.tail = (self.tail + ch)[-longest:]
            n, best = self.n + 1, self.best
            self.n = n
            top, size = best[-1] + score(ch, unknown), 1
            for k in range(2, min(len(tail), len(best)) + 1):
                s = score(tail[-k:])
                if s is not None and best[-k] + s >= top:
                    top, size = best[-k] + s, k
            best.append(top)
            if len(best) > 2 * longest:
                least = best[-longest]
                self.best = [b - least for b in best[-longest:]]
            piece, at = tail[-size:], n - size
            known = p.id.get(piece)
            self.ids[n] = [known] if known is not None else p.unknown_ids(piece)
            up[n], kids[n], mixed[n] = at, 0, 0
            kids[at] += 1
            mixed[at] ^= n
            gone = n - longest  # no later piece starts here
            while gone > self.root and kids.get(gone) == 0:
                parent = up.pop(gone)
                kids[parent] -= 1
                mixed[parent] ^= gone
                del kids[gone], mixed[gone], self.ids[gone]
                gone = parent
            self.widest = max(self.widest, len(up))
            out: list[int] = []
            while self.root <= n - longest and kids[self.root] == 1:
                child = mixed[self.root]
                out += self.ids.pop(child)
                del up[child], kids[self.root], mixed[self.root]
                self.root = child
            if out:
                yield out

    def finish(self) -> list[int]:
        """The ids that are still open."""
        path, at = [], self.n
        while at != self.root:
            path.append(self.ids[at])
            at = self.up[at]
        return [i for ids in reversed(path) for i in ids]


def viterbi(pieces: Pieces, text: str) -> list[int]:
    """Ids of the highest-scored segmentation of a normalised text."""
    search = StreamingViterbi(pieces)
    out = [i for ids in search.feed(text) for i in ids]
    return out + search.finish()


def in_lanes(pieces: Pieces, words: list[str]) -> list[bytes]:
    """The search for words in step, best of about one length; little-endian 32-bit ids.

    Pieces are found by hash only: the caller has to see whether the ids spell the word. A shorter word's lane goes on behind its end,
    which nothing before it depends on.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    size, n = int(sizes.max()), len(words)
    codes = np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le"), "<u4").reshape(n, size).T.astype(np.uint64)
    longest = min(size, pieces.longest)
    found = np.full((longest + 1, size, n), -1, dtype=np.int32)
    score = np.full((longest + 1, size, n), -np.inf)
    h = np.zeros((size, n), np.uint64)
    for k in range(1, longest + 1):
        h = h[: size - k + 1] * _MIX + codes[k - 1 :]
        hashes, scores, ids, seen = pieces.tables[k]
        if not len(hashes):
            continue
        flat = h.reshape(-1)
        maybe = np.flatnonzero(seen[_digest(flat)])
        some = flat[maybe]
        at = np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)
        hit = hashes[at] == some
        at, maybe = at[hit], maybe[hit]
        found[k].reshape(-1)[maybe] = ids[at]
        score[k].reshape(-1)[maybe] = scores[at]
    unknown = found[1] < 0
    found[1][unknown] = -2 - codes[unknown].astype(np.int32)
    score[1][unknown] = pieces.unknown
    best, back = np.zeros((size + 1, n)), np.zeros((size + 1, n), dtype=np.int64)
    for end in range(1, size + 1):
        top, back[end] = best[end - 1] + score[1, end - 1], 1
        for k in range(2, min(longest, end) + 1):
            other = best[end - k] + score[k, end - k]
            better = other >= top
            top[better] = other[better]
            back[end][better] = k
        best[end] = top
    lane, at, steps = np.arange(n), sizes, []
    while at.any():
        k = back[at, lane]
        start = at - k
        steps.append(np.where(at > 0, found[k, np.maximum(start, 0), lane], -1))
        at = np.where(at > 0, start, 0)
    path = np.array(steps[::-1], dtype=np.int32).T
    used = path != -1
    ids, many = path[used], used.sum(axis=1)
    odd = ids < 0
    if odd.any():  # bytes in place of unknown characters
        kinds, which = np.unique(-2 - ids[odd], return_inverse=True)
        byte = [pieces.unknown_ids(chr(c)) for c in kinds.tolist()]
        n_bytes = np.ones(len(ids), dtype=np.int64)
        n_bytes[odd] = np.array([len(x) for x in byte])[which]
        wide = np.repeat(ids, n_bytes)
        wide[np.repeat(odd, n_bytes)] = [i for k in which.tolist() for i in byte[k]]
        many = np.add.reduceat(n_bytes, np.cumsum(many) - many)
        ids = wide
    return _cut(ids, many)


def _cut(ids: np.ndarray, many: np.ndarray) -> list[bytes]:
    """ids, joined, as bytes of many[0], many[1] and so on of them."""
    raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(many)).tolist()
    return [raw[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class Encoder:
    """Encodes texts with a model file; ids by the model's own rule, and the Viterbi segmentation beside them."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        #: Own ids, Viterbi ids (little-endian 32-bit numbers), and whether both spell the word, by word.
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}
        m = self.pieces.model
        self.head = len(m.encode("\n"))
        byte = {i: bytes([b]) for b, i in self.pieces.byte.items()}
        self.spelling = [byte.get(i, b"" if m.is_control(i) else m.id_to_piece(i).replace(MARK, " ").encode()) for i in range(m.vocab_size())]
        self.spelt_bytes = np.array([len(x) for x in self.spelling])
        self.marked = np.array([m.id_to_piece(i).startswith(MARK) for i in range(m.vocab_size())])
        #: The id of a line's end, where it parts words in one text: one byte piece that stands beside nothing in a piece.
        self.line = None
        if self.pieces.cuts is not None:
            sides = self.pieces.cuts.reshape(256, 256)
            apart = sides[:, 10].all() and sides[10, :0x80].all() and sides[10, 0xC0:].all()
            self.line = self.pieces.byte[10] if apart and m.encode("\n")[-1:] == [self.pieces.byte[10]] else None

    def _merged(self, words: list[str]) -> list[bytes]:
        """The merges' ids; a prefix that the model would add to a mark alone is left out behind a character that no piece holds.

        Where words are what no piece crosses, many are given in one text: those with one mark, at their start, side by side, others a
        line each.
        """
        out: list[bytes] = [b""] * len(words)
        left: Iterable[int] = range(len(words))
        if self.line is not None and self.pieces.word_starts:
            alone, lines, left = [], [], []
            for i, w in enumerate(words):
                (alone if len(w) > 1 and w.rfind(MARK) == 0 else left if "\n" in w else lines).append(i)
            for some in (alone[at : at + JOINED] for at in range(0, len(alone), JOINED)):
                self._fill(out, left, some, "".join([words[i] for i in some])[int(self.pieces.prefix) :], True)
            for some in (lines[at : at + JOINED] for at in range(0, len(lines), JOINED)):
                self._fill(out, left, some, "\n" + "\n".join([words[i] for i in some]), False)
        if left:
            for i, ids in zip(left, self._merged_singly([words[i] for i in left]), strict=True):
                out[i] = ids
        return out

    def _fill(self, out: list[bytes], left: list[int], some: list[int], text: str, marked: bool) -> None:
        """Put the ids of some words, given as one text, into out; if it isn't cut into as many, their numbers into left."""
        ids = np.array(self.pieces.model.encode(text, num_threads=1), dtype="<u4")
        starts = np.flatnonzero(self.marked[ids] if marked else ids == self.line) + (not marked)
        if len(starts) != len(some):
            left += some
            return
        ends = np.append(starts[1:] - (not marked), len(ids))
        raw = ids.tobytes()
        for i, a, e in zip(some, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
            out[i] = raw[a:e]

    def _merged_singly(self, words: list[str]) -> list[bytes]:
        m = self.pieces.model
        marks = [i for i, w in enumerate(words) if self.pieces.prefix and not (w.startswith(MARK) and w.strip(MARK))]
        out = m.encode([w[1:] if self.pieces.prefix and w.startswith(MARK) else w for w in words], num_threads=1)
        for i in marks:
            out[i] = m.encode("\n" + words[i])[self.head :]
        many = np.fromiter(map(len, out), np.int64, len(out))
        return _cut(np.fromiter(chain.from_iterable(out), np.int64, int(many.sum())), many)

    def _searched(self, words: list[str]) -> list[bytes]:
        out = [b""] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= LANE_CHARS), key=lambda i: -len(words[i]))
        at = 0
        while at < len(short):
            part = short[at : at + LANES_CHARS // len(words[short[at]])]
            at += len(part)
            for i, ids in zip(part, in_lanes(self.pieces, [words[i] for i in part]), strict=True):
                out[i] = ids
        if len(short) < len(words):
            for i, w in enumerate(words):
                if len(w) > LANE_CHARS:
                    out[i] = self._streamed(w)
        return out

    def _streamed(self, word: str) -> bytes:
        return np.array(viterbi(self.pieces, word), "<u4").tobytes()

    def _spells(self, ids: bytes, raw: bytes) -> bool:
        return b"".join(map(self.spelling.__getitem__, memoryview(ids).cast("I"))) == raw

    def _all_spell(self, ids: list[bytes], raw: list[bytes]) -> bool:
        """Whether each word's ids spell it, seen from all together."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        if b"".join(map(self.spelling.__getitem__, flat.tolist())) != b"".join(raw):
            return False
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.spelt_bytes[flat])))
        last = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        return bool((upto[last] == np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))).all())

    def _encoded(self, words: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """words: distinct, with blanks for marks."""
        out = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        for start in range(0, len(missing), WORDS_AT_ONCE):
            at = missing[start : start + WORDS_AT_ONCE]
            new = [words[i].replace(" ", MARK) for i in at]
            found = self._searched(new)
            own = found if self.pieces.unigram else self._merged(new)
            raw = [words[i].encode("utf-8", "surrogatepass") for i in at]
            if self._all_spell(found, raw) and (own is found or self._all_spell(own, raw)):
                for i, a, v in zip(at, own, found, strict=True):
                    out[i] = (a, a if a == v else v, True)
            else:
                for i, word, r, a, v in zip(at, new, raw, own, found, strict=True):
                    good = self._spells(v, r)
                    if not good and len(word) <= LANE_CHARS:  # a hash may have deceived
                        v = self._streamed(word)
                        good = self._spells(v, r)
                        a = v if self.pieces.unigram else a
                    out[i] = (a, a, good) if a == v else (a, v, good and self._spells(a, r))
            if len(self.known) < CACHE_WORDS:
                short = [i for i, word in zip(at, new, strict=True) if len(word) <= LANE_CHARS]
                self.known.update((words[i], out[i]) for i in short[: CACHE_WORDS - len(self.known)])
        return out

    def _normal(self, texts: pa.Array) -> pa.Array:
        """Normalised texts with blanks for marks."""
        if self.pieces.plain:
            texts = pc.replace_substring(texts, MARK, " ")
            lead = pc.if_else(pc.equal(texts, ""), "", " ")
            return pc.binary_join_element_wise(lead, texts, "") if self.pieces.prefix else texts
        return pa.array([self.pieces.model.normalize(t).replace(MARK, " ") if t else "" for t in texts.to_pylist()], pa.string())

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Own ids and Viterbi ids of a text as little-endian 32-bit numbers."""
        own, other, _ = next(self.encode_all([text]))[0]
        return bytes(own), bytes(other)

    def encode_all(self, texts: list[str | None] | pa.Array) -> Iterator[list[tuple[memoryview, memoryview, bool]]]:
        """For a few texts at a time: own ids and Viterbi ids of each text, and whether both spell its normalised form."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)] if len(texts) else []
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            normal = self._normal(pc.fill_null(texts.slice(a, e - a), ""))
            offsets = np.frombuffer(normal.buffers()[1], np.int32)[normal.offset : normal.offset + len(normal) + 1]
            data = normal.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            first = np.zeros(offsets[-1] + 1, dtype=bool)
            first[offsets] = True
            if self.pieces.cuts is not None:
                first[1:-1] |= self.pieces.cuts[(raw[: max(0, offsets[-1] - 1)].astype(np.uint16) << 8) | raw[1 : offsets[-1]]]
            elif self.pieces.word_starts:
                blank = raw[: offsets[-1]] == 32
                first[1:-1] |= blank[1:] & ~blank[:-1]
            first[: offsets[0]] = False
            first[-1] = True
            starts = np.flatnonzero(first).astype(np.int32)
            words = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), data or pa.py_buffer(b"")]).dictionary_encode()
            got = self._encoded(words.dictionary.to_pylist())
            at, ends = words.indices.to_numpy(), np.searchsorted(starts, offsets)
            own, other = (_gathered([g[k] for g in got], at, ends) for k in (0, 1))
            wrong = np.concatenate(([0], np.cumsum(~np.fromiter((g[2] for g in got), bool, len(got))[at])))[ends]
            yield list(zip(own, other, (wrong[1:] == wrong[:-1]).tolist(), strict=True))

    def decode(self, ids: bytes) -> str:
        """Pieces and bytes put together, the mark as a blank, without the prefix that encoding adds."""
        text = b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def _gathered(ids: list[bytes], at: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The ids of each text: those of its words (numbers at, from ends[i] to ends[i + 1]) put together."""
    many = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    first = np.cumsum(many) - many
    n = many[at]
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    place = np.repeat(first[at] - upto[:-1], n)
    place += np.arange(len(place))
    raw = memoryview(np.frombuffer(b"".join(ids), "<u4")[place].tobytes())
    cuts = (4 * upto[ends]).tolist()
    return [raw[a:e] for a, e in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for a worker process, kept from task to task; big buffers are given back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    return Encoder(path)


def _binary(parts: Sequence[memoryview]) -> pa.Array:
    """A binary column with a copy of the parts: pa.array() never frees the memory behind a memoryview."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])


def _rows(coder: Encoder, keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of encoded() for a few texts at a time."""
    at = 0
    for got in coder.encode_all(texts):
        own, other, same = zip(*got, strict=True)
        if not coder.pieces.plain:  # the normalised form may differ from the text
            plain = [(t or "").replace(MARK, " ") for t in texts.slice(at, len(got)).to_pylist()]
            same = [coder.decode(a) == t and coder.decode(v) == t for a, v, t in zip(own, other, plain, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [keys.slice(at, len(got)), *[pa.array([f(x) for x in ids], pa.int64()) for ids in (own, other) for f in (lambda x: len(x) // 4, zlib.crc32)], pa.array(same, pa.bool_()), _binary(own), _binary(other)],
            names=["doc_id", "n_tokens", "ids_crc32", "n_viterbi", "viterbi_crc32", "round_trip", "ids", "viterbi_ids"],
        )
        at += len(got)
        del got, own, other, same
        give_back()


def encoded(df: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_viterbi, viterbi_crc32, round_trip, ids, viterbi_ids for each row of df.

    round_trip: both lists of ids decode to the text, with the mark's own character read as a blank. The session's Arrow batches are
    lowered to 1000 rows.
    """
    small_batches(df.sparkSession)
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rows(encoder(path), b.column(0), b.column(1))

    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, n_viterbi bigint, viterbi_crc32 bigint, round_trip boolean, ids binary, viterbi_ids binary"
    return df.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


def decoded(df: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text from columns of ids as encoded() makes them; null ids give an empty text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{ids}`").cast("binary").alias("i")).mapInArrow(run, "doc_id bigint, text string")
