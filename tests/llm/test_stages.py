"""The pipeline's stages on small tables, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from asofar.llm import exact, mixing, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(k, t, None, "s", 0) for k, t in rows], SCHEMA)


def similarity(a, b):
    a, b = set(simhash.shingle_hashes(a, 5).tolist()), set(simhash.shingle_hashes(b, 5).tolist())
    return len(a & b) / max(1, len(a | b))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, origin = [], {}
    for i in range(150):
        w = rng.choices(vocabulary, k=rng.randint(120, 400))
        rows.append((10 * i, " ".join(w)))
        for j in range(1, 4):
            v = list(w)
            for at in rng.sample(range(len(v)), max(1, len(v) // 120)):
                v[at] = rng.choice(vocabulary)
            rows.append((10 * i + j, " ".join(v)))
            origin[10 * i + j] = 10 * i
    text = dict(rows)
    near = [k for k, o in origin.items() if similarity(text[k], text[o]) >= 0.8]
    kept = {r.doc_id for r in simhash.representatives(table(spark, rows)).collect()}
    assert {10 * i for i in range(150)} <= kept
    assert len(near) > 300
    assert sum(k in kept for k in near) <= 0.02 * len(near)


def edited(words, n, rng):
    """The words with n of them, spread evenly, replaced."""
    out = list(words)
    for i in range(n):
        out[(2 * i + 1) * len(words) // (2 * n)] = f"z{rng.getrandbits(40):x}"
    return out


def kept_by_brute_force(rows):
    """The smallest id of each component of pairs at .8 or more."""
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (k, t) in enumerate(rows):
        for m, u in rows[:i]:
            if similarity(t, u) >= 0.8:
                a, b = sorted((find(k), find(m)))
                root[b] = a
    return {k for k in root if find(k) == k}


def test_pairs_below_the_limit_stay(spark):
    """Near pairs on both sides of .8: none below goes unless links at .8 connect it, and those from .85 on do go."""
    rng = random.Random(5)
    rows, below = [], 0
    for i in range(60):
        w = [f"w{rng.getrandbits(40):x}" for _ in range(400)]
        other = edited(w, 2 + i % 20, rng)
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(other))]
        below += 0.5 <= similarity(rows[-1][1], rows[-2][1]) < 0.8
    assert below > 20
    kept = {r.doc_id for r in simhash.representatives(table(spark, rows)).collect()}
    expected = kept_by_brute_force(rows)
    assert expected <= kept
    assert all(similarity(rows[2 * (k // 10)][1], rows[2 * (k // 10) + 1][1]) < 0.85 for k in kept - expected)


def test_repeated_lines_count_once(spark):
    """A line repeated in two unrelated texts doesn't link them in the fingerprints, and one repeated in one of two copies doesn't part them."""
    rng = random.Random(8)
    line = "one line of eight words that comes back"
    rows = []
    for i in range(20):
        w = [f"w{rng.getrandbits(40):x}" for _ in range(400)]
        plain = " ".join(w) + "\n" + line
        rows += [(10 * i, plain), (10 * i + 1, plain + ("\n" + line) * 20)]
    kept = {r.doc_id for r in simhash.representatives(table(spark, rows)).collect()}
    assert kept == kept_by_brute_force(rows) == {10 * i for i in range(20)}
    found = simhash.fingerprints(table(spark, rows[1::2]), shingle=5, words=3, distinct=True).collect()
    bits = [sum(((r[f"__f{k}"] & (1 << 64) - 1) << (64 * k)) for k in range(3)) for r in found]
    assert min((a ^ b).bit_count() for i, a in enumerate(bits) for b in bits[:i]) > 38


def test_blocks_of_a_large_component(spark, monkeypatch):
    """A component that is compared block by block has the same result."""
    rng = random.Random(6)
    w = [f"w{rng.getrandbits(40):x}" for _ in range(300)]
    rows = [(i, " ".join(edited(w, 1 + i % 9, rng))) for i in range(60)]
    one = {r.doc_id for r in simhash.representatives(table(spark, rows)).collect()}
    monkeypatch.setattr(simhash, "_TEXTS", 7)
    assert {r.doc_id for r in simhash.representatives(table(spark, rows)).collect()} == one


def test_similar_sets_against_all_pairs():
    rng = random.Random(7)
    for _ in range(30):
        origin = [np.array(rng.sample(range(60), 40), dtype=np.uint64) for _ in range(3)]
        sets = [np.unique(np.concatenate((rng.choice(origin)[: rng.randint(30, 40)], np.array([rng.randrange(100)], dtype=np.uint64)))) for _ in range(25)] + [np.empty(0, dtype=np.uint64)] * 2
        want, got = simhash.Forest(), simhash.Forest()
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                n = len(np.intersect1d(a, b))
                if 5 * n >= 4 * (len(a) + len(b) - n):
                    want.link(i, j)
        for i, j in simhash.similar(sets):
            got.link(i, j)
        assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_representatives_of_shared_ids(spark):
    """Rows with one id and differing texts are rows of their own; equal rows are one."""
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "one two three four five six seven eight nine"), (1, "one two three four five six seven eight nine"), (None, None), (None, ""), (2, "alpha beta gamma delta epsilon zeta eta theta")]
    out = simhash.representatives(table(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 1, rows[0][1]), (False, 1, rows[1][1]), (True, 0, "")]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = table(spark, [])
    out = stage(spark, docs, "")
    assert out.count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns


def test_one_row_of_each_exact_group(spark):
    """Of rows that share an id, or have none, and differ in white space only, the longest stays."""
    rows = [(1, "a b c"), (1, "a  b  c"), (1, "ab c"), (2, "a b c"), (None, "d e"), (None, "d  e"), (None, "de"), (3, "f g"), (3, "f\tg"), (4, "h"), (4, "h"), (None, None), (None, "  "), (0, " ")]
    got = exact.deduplicated(table(spark, rows)).collect()
    assert sorted((r.doc_id or -1, "".join((r.text or "").split())) for r in got) == [(-1, ""), (-1, "de"), (1, "abc"), (3, "fg"), (4, "h")]
    assert {"a  b  c", "d  e", "  "} <= {r.text for r in got}


def test_mixed_texts_are_whole(spark):
    """The text on a source's boundary is taken whole or left, whichever is nearer to the target."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.getrandbits(30):x}" for _ in range(rng.randint(3, 90))) + "\n", None, f"s{i % 7}", i) for i in range(140)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r["__key"]: (r["taken"], r["size"]) for r in mixing.plan(docs).collect()}
    assert any(t % n for t, n in taken.values())
    got = mixing.mixed(docs).collect()
    assert {(r.doc_id, r.text, r.source, r.n_chars) for r in got} <= {(r[0], r[1], r[3], r[4]) for r in rows}
    count = Counter(r.doc_id for r in got)
    assert all(abs(count[k] * n - t) <= abs(c * n - t) for k, (t, n) in taken.items() for c in (t // n, t // n + 1))


def test_run(spark):
    """Each document that comes out went in, copies are gone, and ids decode."""
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.filter("not round_trip").count() == 0
    known = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    got = {r.doc_id for r in out.select("doc_id").collect()}
    assert got <= known and len(got) > 50
    assert all(len(r.ids) == 4 * r.n_tokens for r in out.select("ids", "n_tokens").collect())


def brute_force(docs):
    """How often each document comes out of rules, exact and near dedup and mix; docs: (doc_id, text, source) with distinct ids."""

    def split(t):
        return [x.decode() for x in t.encode().split()]

    def failed(t):
        w = split(t)
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = Counter(triples)
        covered = {i + j for i, x in enumerate(triples) if many[x] > 1 for j in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    bad = {k: failed(t) for k, t, _ in docs}
    hosts = {}
    for k, _, h in docs:
        d, f = hosts.get(h, (0, 0))
        hosts[h] = (d + 1, f + bad[k])
    m = sum(f for _, f in hosts.values()) / len(docs)
    var = sum(f * f / d for d, f in hosts.values()) / len(docs) - m * m
    s = 1e6 if var <= 1e-12 else min(1e6, max(1.0, m * (1 - m) / var - 1))
    docs = [x for x in docs if not bad[x[0]] and (hosts[x[2]][1] + m * s) / (hosts[x[2]][0] + s) < 0.9]
    groups = {}
    for x in docs:
        groups.setdefault("".join(split(x[1])), []).append(x)
    docs = [min(g, key=lambda x: (-len(x[1]), x[0])) for g in groups.values()]
    kept = kept_by_brute_force([(k, t) for k, t, _ in docs])
    docs = [x for x in docs if x[0] in kept]
    size = {k: len(split(t)) for k, t, _ in docs}
    sources = sorted({h for _, _, h in docs})
    weight = {h: (5.0, 2.0, 1.0)[i % 3] for i, h in enumerate(sources)}
    words = {h: sum(size[k] for k, _, x in docs if x == h) for h in sources}
    stopped, level = None, 0.0
    while (now := {h for h in sources if 3.0 * words[h] <= level * weight[h]}) != stopped and len(now) < len(sources):
        stopped, level = now, (sum(words.values()) - sum(3.0 * words[h] for h in now)) / sum(weight[h] for h in sources if h not in now)

    def order(x):
        k, t, _ = x
        u = (int(hashlib.md5(f"17:{k}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)
        return -math.log(u) / (0.5 + 0.5 * len(re.sub("[^A-Za-z0-9 ]+", "", t)) / len(t)), k

    out = Counter()
    for h in sources:
        left = math.floor(min(3.0 * words[h], level * weight[h]) + 0.5)
        passes = math.floor(min(3.0 * words[h], level * weight[h]) / words[h])
        left -= passes * words[h]
        for k, _, _ in sorted((x for x in docs if x[2] == h), key=order):
            out[k] += passes + (2 * max(0, min(size[k], left)) >= size[k])
            left -= size[k]
    return docs, +out


def test_run_against_brute_force(spark, tmp_path):
    """Rules, exact and near copies on both sides of .8, repeated lines and the mix: each document comes out as often as by brute force."""
    rng = random.Random(10)
    word = lambda: f"w{rng.getrandbits(30):x}"
    line = "a line that many of these texts share here"
    docs = []

    def add(text, source):
        docs.append((len(docs), text, source))

    for i in range(60):
        source, w = f"s{i % 5}", [word() for _ in range(rng.randint(150, 400))]
        t = " ".join(w) + ("\n" + line) * (len(w) // 25 if i % 3 == 0 else 0)
        add(t, source)
        if i % 4 == 0:
            add("\n".join(w) + ("  \n" + line) * t.count(line), source)
        if i % 2:
            add(" ".join(edited(w, max(1, len(w) // rng.choice([90, 120, 20, 25, 30, 15])), rng)), f"s{(i + 1) % 5}")
        if i % 7 == 0:
            add(t + ("\n" + line) * 9, source)
        if i % 6 == 0:
            add(" ".join(w[: rng.randint(1, 49)]), source)
            add(" ".join(w[:20] * 10), source)
    for i in range(40):
        add(" ".join(word() for _ in range(60 if i == 0 else 20)), "junk")
    near = [similarity(a[1], b[1]) for i, a in enumerate(docs) for b in docs[:i] if a[2] != "junk" != b[2] and len(a[1]) > 900 < len(b[1])]
    assert sum(0.5 <= x < 0.8 for x in near) >= 10
    spark.createDataFrame([(k, t, None, h, len(t)) for k, t, h in docs], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    left, expected = brute_force(docs)
    assert 40 < len(left) < len(docs) and max(expected.values()) > 1
    out = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "round_trip", "n_viterbi").collect()
    assert all(r.round_trip for r in out)
    assert Counter(r.doc_id for r in out) == expected


def test_words_of_a_fingerprint_differ():
    f = simhash.fingerprint(np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 4)
    assert min((a ^ b).bit_count() for i, a in enumerate(f) for b in f[:i]) > 10
