"""Index lookups, secrets behind learnt contexts, labelled URLs and host verdicts, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from asofar.llm import exact, pii, quality, urls

SCHEMA = "doc_id bigint, text string, source string, group_size string"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "s", "clash") for k, t in rows], SCHEMA)


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def groups_of(rows):
    out = defaultdict(list)
    for k, t in rows:
        out[plain(t)].append((-len(t or ""), k is None, k or 0))
    return out


def test_exact_groups_and_one_kept_row(spark):
    """Half of the rows are copies of one text, ids repeat, and some are null: one row of each group stays, the longest of the smallest id."""
    rng = random.Random(1)
    rows = [(i, f"text {rng.randint(0, 30)}" + " " * rng.randint(0, 3)) for i in range(120)] + [(i, "hot  copy"[: 9 - i % 2]) for i in range(60, 180)]
    rows += [(1, "a b c"), (1, "abc"), (2, "abc"), (2, "abc"), (None, "abc"), (None, "n"), (None, " n"), (500, None), (501, " ")]
    groups = groups_of(rows)
    got = exact.resolve(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.kept]
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): min(g) for t, g in groups.items()}
    assert sorted(r.text_sha256 for r in kept) == sorted(by_hash)
    for r in got:
        size, none, k = by_hash[r.text_sha256]
        assert r.keep_id == (None if none else k)
        assert not r.kept or (r["__chars"], r.doc_id) == (-size, r.keep_id)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): len(g) for t, g in groups.items()}
    assert all(r.group_size == sizes[r.text_sha256] for r in got)


@pytest.mark.parametrize("stored", [False, True], ids=["winners", "index"])
def test_history(spark, stored):
    """Members give way to history, also if longer; the others are grouped among themselves."""
    old = [(i, f"old {i % 40}") for i in range(100)]
    new = [(1000 + i, f"old  {i}") for i in range(60)] + [(2000 + i, f"new {i % 7}") for i in range(30)]
    history = exact.winners(exact.digests(frame(spark, old)))
    if stored:
        history = exact.build_index(history)
        assert "digests" in history.columns
    got = {r.doc_id: r for r in exact.resolve(frame(spark, new), history=history).collect()}
    for i in range(60):
        r = got[1000 + i]
        assert (r.keep_id, r.kept) == ((i, False) if i < 40 else (1000 + i, True))
        assert r.group_size == (1 + len(range(i, 100, 40)) if i < 40 else 1)
    assert [got[2000 + i].kept for i in range(30)] == [i < 7 for i in range(30)]
    left = exact.deduplicated(frame(spark, new), history=history).collect()
    assert {r.doc_id for r in left} == {*range(1040, 1060), *range(2000, 2007)}


def test_shards_answer_members_only():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    mph, slots = exact.PerfectHash.build(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (mph.lookup(keys) == slots).all()


def test_secrets_behind_learnt_contexts(spark):
    """Long hexadecimal tokens teach their context; other tokens behind it are found with full precision and recall, tokens elsewhere are not."""
    rng = random.Random(3)
    token = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 4)) + "0123"
    rows = [(i, f'{rng.choice(["so", "then", "and"])} the api_key = "{token(40)}" is set') for i in range(60)]
    rows += [(100 + i, f'here the api_key = "Zq{rng.randint(10**7, 10**8)}xK" is set') for i in range(10)]
    rows += [(200 + i, f"{rng.choice(['order', 'lot', 'part', 'room'])} AB{rng.randint(10**7, 10**8)} is ready") for i in range(30)]
    rows += [(300, f"a lone {token(40)} in a text")]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert {k for k, r in got.items() if r.n_added} == {*range(60), *range(100, 110)}
    for k, t in rows:
        said = [x.split(":") for x in got[k].spans.split(",") if x.startswith("secret")]
        assert [t[int(a) : int(e)] for _, a, e in said] == re.findall(r'api_key = "([^"]+)"', t)
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())


def test_verdicts_of_a_labelled_table(spark):
    """URLs that no rule decides are judged by the labelled table, and rules come first."""
    rng = random.Random(4)
    words = {"block": ["casino", "jackpot", "bonus"], "allow": ["museum", "garden", "library"]}
    make = lambda v: f"https://{rng.choice(words[v])}{rng.randint(0, 999)}.example/{rng.choice(words[v])}/{rng.randint(0, 9999)}"
    labelled = spark.createDataFrame([(make(v), v) for v in words for _ in range(150)], "url string, verdict string")
    asked = [(i, make(v), v) for i, v in enumerate(["block", "allow"] * 100)]
    pages = spark.createDataFrame([(i, u, v) for i, u, v in asked] + [(900, "https://casino.museum.net/es/1", ""), (901, "http://jackpot.com/casino", "")], "page_id bigint, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(pages, labelled=labelled).collect()}
    assert sum(got[i].verdict == v for i, _, v in asked) >= 195
    assert (got[900].rule, got[900].verdict, got[901].rule, got[901].verdict) == ("net/es/", "block", "com/", "allow")
    model = urls.fit(*_split(labelled), np.array([r.verdict == "block" for r in _ordered(labelled)], dtype=float))
    hosts, paths = zip(*[(re.sub("^.*?://", "", u).split("/", 1)[0], "/" + re.sub("^.*?://", "", u).split("/", 1)[1]) for _, u, _ in asked], strict=True)
    margins = model.margins(list(hosts), list(paths))
    assert all(got[i].block_margin == pytest.approx(m) for (i, _, _), m in zip(asked, margins.tolist(), strict=True))


def _ordered(labelled):
    cut = lambda u: (u.split("://")[1].split("/", 1)[0], "/" + u.split("://")[1].split("/", 1)[1])
    return sorted(labelled.distinct().collect(), key=lambda r: (*cut(r.url), r.verdict))


def _split(labelled):
    pairs = [(r.url.split("://")[1].split("/", 1)[0], "/" + r.url.split("://")[1].split("/", 1)[1]) for r in _ordered(labelled)]
    return [h for h, _ in pairs], [p for _, p in pairs]


def test_a_share_of_a_large_labelled_table(spark, monkeypatch):
    monkeypatch.setattr(urls, "TRAIN_ROWS", 100)
    seen = []
    monkeypatch.setattr(urls, "fit", lambda hosts, paths, block: seen.append(len(hosts)) or urls.Model(np.zeros(urls.DIMENSIONS), -1.0))
    labelled = spark.range(4000).selectExpr("concat('http://a', id, '.example/') AS url", "if(id % 2 = 0, 'block', 'allow') AS verdict")
    urls.judge(spark.createDataFrame([(1, "http://x/")], "page_id bigint, url string"), labelled=labelled)
    assert 60 < seen[0] < 140


def test_the_small_labelled_table(spark):
    pages = spark.createDataFrame([(1, "https://casino-bonus.example.org/slots"), (2, "https://library.example.org/catalogue/novels")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages).collect()} == {1: "block", 2: "allow"}


def test_a_bad_host_is_rejected(spark):
    """A host nearly all of whose documents fail takes its others with it; a small host with few failures is drawn to the mean."""
    rng = random.Random(5)
    good = lambda: " ".join(f"w{rng.getrandbits(40):x}" for _ in range(60))
    docs = [("bad", good() if i < 6 else "short text") for i in range(300)] + [(f"h{j}", "short" if i == 0 else good()) for j in range(20) for i in range(20)] + [("tiny", "short")]
    docs += [(None, good())]
    rows = [(i, t, h, "clash") for i, (h, t) in enumerate(docs)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"]).collect()}
    n, f = defaultdict(int), defaultdict(int)
    for i, (h, t) in enumerate(docs):
        n[h] += 1
        f[h] += len(t.split()) < 50
    d = len(docs)
    m = sum(f.values()) / d
    var = sum(f[h] ** 2 / n[h] for h in n) / d - m * m
    s = max(1.0, min(1e6, m * (1 - m) / var - 1))
    for i, (h, t) in enumerate(docs):
        rejected = (f[h] + m * s) / (n[h] + s) >= 0.9
        assert got[i].host_rejected == rejected
        assert got[i].kept == (not rejected and len(t.split()) >= 50)
    assert got[0].host_rejected and not got[0].base_failed and not got[len(docs) - 2].host_rejected
