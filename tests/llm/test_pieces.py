"""SentencePiece ids against the library and against a plain search; a unigram model is written by hand, none is trained."""

from __future__ import annotations

import gc
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from asofar.llm import pieces


def _number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


def model_file(path, vocabulary, squeeze=False):
    """A unigram model: unknown, bytes, and pieces with random scores. squeeze: blanks are taken out, so words aren't what blanks cut."""
    rng = random.Random(3)
    found = [("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, -1.0 - rng.random() * 9, 1) for p in vocabulary]]
    raw = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, kind)) for p, s, kind in found)
    raw += _field(2, _field(3, 1) + _field(35, 1))
    raw += _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, int(squeeze)) + _field(5, 1))
    path.write_bytes(raw)
    return str(path)


TEXTS = ["", None, " ", "  a  b ", "abcabcabcba" * 9, "a" * 700, "cab ▁bac", "héllo ab", "ab\ncd\x00e", "日本 ab", " ".join(["bacab", "abba", "x"] * 300)]


@pytest.mark.parametrize("across", [False, True], ids=["words", "pieces across words"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_unigram_model_like_the_library(spark, tmp_path, across, squeeze):
    rng = random.Random(1)
    vocabulary = {"▁", *"abcx", *("▁" * rng.randint(0, 1) + "".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(300))}
    vocabulary |= {"a▁b", "b▁", "ab▁ba"} if across else set()
    path = model_file(tmp_path / "m.model", sorted(vocabulary), squeeze)
    coder = pieces.Encoder(path)
    assert coder.pieces.unigram and coder.pieces.word_starts != across and coder.pieces.plain != squeeze
    texts = TEXTS + [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 90))) for _ in range(40)) for _ in range(20)]
    got = [x for some in coder.encode_all(texts) for x in some]
    for t, (own, other, spelt) in zip(texts, got, strict=True):
        ids, theirs = np.frombuffer(own, "<u4").tolist(), coder.pieces.model.encode(t or "")
        if set(t or "") == {"a"}:  # paths of one sum: the library adds single floats, whose rounding decides
            total = lambda some: sum(coder.pieces.score[coder.pieces.spelt[i]] for i in some)
            assert total(ids) == pytest.approx(total(theirs))
        else:
            assert ids == theirs, t
        assert own == other and spelt
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = pieces.encoded(docs, path).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32, r.n_viterbi, r.viterbi_crc32) for r in rows} == {i: (len(a) // 4, zlib.crc32(a), len(v) // 4, zlib.crc32(v)) for i, (a, v, _) in enumerate(got)}
    plain = {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs, path), path).collect()}
    assert all(r.round_trip == (back[r.doc_id] == plain[r.doc_id]) for r in rows)
    assert squeeze or back == plain


def test_words_in_step_like_the_stream():
    """All words of a length in step give what the streaming search gives for each, unknown characters and all."""
    p = pieces.encoder(pieces.default_model()).pieces
    rng = random.Random(2)
    words = ["▁" + "".join(rng.choices("etaoinshré日🙂.-0", k=rng.randint(1, 30))) for _ in range(600)]
    coder = pieces.Encoder(pieces.default_model())
    assert [np.frombuffer(x, "<u4").tolist() for x in coder._searched(words)] == [pieces.viterbi(p, w) for w in words]


def test_full_memory_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{i * j}" for j in range(50)) for i in range(30)]
    want = [x for some in pieces.Encoder(pieces.default_model()).encode_all(texts) for x in some]
    monkeypatch.setattr(pieces, "CACHE_WORDS", 10)
    monkeypatch.setattr(pieces, "SLICE_BYTES", 300)
    coder = pieces.Encoder(pieces.default_model())
    assert [x for _ in range(2) for some in coder.encode_all(texts) for x in some] == 2 * want
    assert len(coder.known) == 10


def test_words_end_where_no_piece_goes_on():
    """A letter and a comma, or a line's end, stand side by side in no piece: what they part is searched and remembered once."""
    coder = pieces.Encoder(pieces.default_model())
    texts = ["tree, tree. tree\ntree", "(tree) tree!\n\n tree", "日tree🙂tree, \n", "\n", ",", " ,\n tree", "<0x0A>\n<s>tree", "\n".join(["tree,"] * 900)]
    got = [x for some in coder.encode_all(texts) for x in some]
    assert [np.frombuffer(own, "<u4").tolist() for own, _, _ in got] == [coder.pieces.model.encode(t) for t in texts]
    assert [np.frombuffer(v, "<u4").tolist() for _, v, _ in got] == [pieces.viterbi(coder.pieces, "▁" + t.replace(" ", "▁")) for t in texts]
    assert all(spelt for _, _, spelt in got)
    assert {w for w in coder.known if "tree" in w} == {" tree", "tree"}


def test_rows_that_are_passed_on_are_freed():
    """A worker's memory doesn't grow with the rows it has encoded."""
    coder = pieces.Encoder(pieces.default_model())
    keys, texts = pa.array(range(200)), pa.array(["some words of a text " * 50] * 200)
    held = []
    tracemalloc.start()
    for _ in range(6):
        assert sum(b.num_rows for b in pieces._rows(coder, keys, texts)) == 200
        gc.collect()
        held.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert held[-1] - held[1] < 200_000  # the ids of one round take more


def test_commits_come_as_soon_as_paths_meet():
    """What is open stays within a few windows on ordinary text, and a boundary that all survivors pass is given at once."""
    p = pieces.encoder(pieces.default_model()).pieces
    search = pieces.StreamingViterbi(p)
    text = p.model.normalize("the streaming search commits ids as it reads and keeps but a window " * 200)
    given = 0
    for n, ch in enumerate(text, 1):
        given += sum(len(p.spelt[i]) for ids in search.feed(ch) for i in ids)
        assert n - given <= 3 * p.longest
    assert given + sum(len(p.spelt[i]) for i in search.finish()) == len(text)
