"""The corpus operators on the small tables and on edge cases, against brute force that is written the plain way."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from asofar.llm import pii, pieces, queries, simhash, suffixes, tokens, urls

from ..comparison import of_duckdb, of_spark

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept int, __text string"
PASSAGE = "the quick brown fox jumps over the lazy dog while seventy seven sleepy cats look on from the wall. "
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "a b c d e f"), (7, PASSAGE * 3), (8, "x" + PASSAGE * 2 + "y"), (8, PASSAGE), (None, PASSAGE), (None, None),
    (9, "Mail a.b@c.de, a@b or x@y.z@w.v; 1.2.3.4.5.6.7.8 and 999.1.1.1, 01.002.3.255; card 4111 1111 1111 1111; 4111-1111-1111-1112; +49 (0)30 123-456-7 +1 2"),
    (10, "größe é日本語 \u00a0\u2003 \x85 \x1c🙂 <|endoftext|> <|startoftext|>x I'll they've ①½"), (11, "▁a ▁▁ b  c"), (12, "w " * 5000), (13, "日本" * 3000), (14, PASSAGE.replace("quick", "slow") * 2), (15, "é" * 60), (16, "é" * 60 + "!"),
    (17, "4" * 30), (18, "$" * 70 + "\n" + "line\nline\n \n\nline"), (-5, "negative " + PASSAGE),
]


def table(spark, found=ODD):
    return spark.createDataFrame([(k, t, None, "s", 0, "z", 1, "clash") for k, t in found], SCHEMA)


@pytest.fixture(scope="module")
def sf_rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def both(spark, sf_rows):
    """(rows, frame) of the small table and of the odd rows."""
    return [(sf_rows, spark.read.parquet(f"{SF}/documents.parquet")), (ODD, table(spark))]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_duckdb(spark, name):
    df = queries.queries()[name](spark, SF)
    columns, expected = of_duckdb(queries.oracle_sql()[name], SF)
    assert sorted(df.columns) == sorted(columns)
    assert of_spark(df) == expected


def key(k):
    return (k is None, k or 0)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def fingerprint(text, size=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(both):
    for rows, df in both:
        fps = [fingerprint(t) for _, t in rows]
        up = list(range(len(rows)))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    up[root(i)] = root(j)
        least = defaultdict(list)
        for i, (k, _) in enumerate(rows):
            least[root(i)].append(k)
        least = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
        want = sorted((key(k), f"{fps[i]:016x}", key(least[root(i)])) for i, (k, _) in enumerate(rows))
        got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted((key(r[0]), r[1], key(r[2])) for r in got) == want


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1001, 1000), (1002, 1001)], "__a long, __b long")
    got = {r[0]: r[1] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_token_files(spark, both):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.default_vocabulary())
    for rows, df in both:
        ids = [(k, [*tk.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in rows]
        raw = lambda x: np.array(x, dtype="<u4").tobytes()
        at, want = 0, []
        for k, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, raw(r[1]))):
            want.append((key(k), at, len(x), zlib.crc32(raw(x))))
            at += len(x)
        got = tokens.round_trip(df).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
        assert sorted((key(r[0]), *r[1:]) for r in got) == sorted(want)


def test_words_of_token_files_end_where_the_pattern_ends_them():
    """Signs, digits and capitals around a word make no new words to ask for, and ids are the tokenizer's for whole texts."""
    coder = tokens.Encoder(tokens.default_vocabulary())
    texts = ["Tree, tree. (TREE) tree12 tree;\nTree's don't 'tree ''s", "É×é÷ÿ İtree «tree» tree—tree", "H\u0331tree J\u030c 日tree本 ŉ ſ", "", None, " \n", "a'1,'s.'ll1'9"]
    for some in (texts, [*texts, "tree<|startoftext|>Tree"]):
        got = [raw[a:e] for raw, ends in coder.encode(some) for a, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
        if some is texts:
            assert {w for w in coder.words if "tree" in w.lower() and w.isascii()} == {"tree", "'tree"}


def test_codes_give_any_token():
    ids = np.random.default_rng(1).integers(0, 2, 5000).astype(np.uint32) * np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32) + np.arange(5000, dtype=np.uint32) % 300
    codes = tokens.Codes(tokens.pack(ids))
    assert (codes.all() == ids).all()
    assert [codes[i] for i in range(0, 5000, 7)] == ids[::7].tolist()
    assert len(tokens.Codes(tokens.pack(np.empty(0, np.uint32)))) == 0


def best_score(p, text):
    best = [0.0]
    for n in range(1, len(text) + 1):
        best.append(max([best[n - 1] + p.score.get(text[n - 1], p.unknown), *[best[a] + p.score[text[a:n]] for a in range(max(0, n - p.longest), n - 1) if text[a:n] in p.score]]))
    return best[-1]


def test_pieces(both):
    coder = pieces.encoder(pieces.default_model())
    for rows, df in both:
        want = sorted((key(k), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ((k, coder.pieces.model.encode(t or "")) for k, t in rows))
        got = pieces.encoded(df).select("doc_id", "n_tokens", "ids_crc32", "round_trip").collect()
        assert sorted((key(r[0]), r[1], r[2]) for r in got) == want
        assert all(r.round_trip for r in got)


def test_streaming_viterbi(sf_rows):
    """The committed ids have the best score; what is open stays small, but where paths never meet."""
    p = pieces.encoder(pieces.default_model()).pieces
    for text in [t[:1500] for _, t in sf_rows[:20] if t] + ["a" * 4000, "日本語" * 200]:
        normal = p.model.normalize(text)
        search = pieces.StreamingViterbi(p)
        ids = [i for some in search.feed(normal) for i in some] + search.finish()
        assert ids == [i for i in ids if 0 <= i < p.model.vocab_size()]
        spelt, byte = {i: s for s, i in p.id.items()}, {i: b for b, i in p.byte.items()}
        score, run = 0.0, b""
        for i in ids:
            if i in byte:
                run += bytes([byte[i]])
                continue
            score += p.unknown * len(run.decode()) + p.score[spelt[i]]
            run = b""
        score += p.unknown * len(run.decode())
        assert score == pytest.approx(best_score(p, normal))
        assert search.widest <= 8 * p.longest or set(text) == {"a"}


def test_one_endless_word():
    """The work is linear where paths never meet."""
    coder = pieces.Encoder(pieces.default_model())
    assert coder.decode(coder.encode("a" * 200_000)[1]) == "a" * 200_000


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    d = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_personal_data(both):
    for rows, df in both:
        want = []
        for k, t in rows:
            found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, t or "") if passes(kind, m[0])]
            said = ",".join(f"{kind}:{a}:{e}" for a, _, kind, e in sorted(found))
            want.append((key(k), *[sum(f[2] == kind for f in found) for kind in KINDS], hashlib.sha256(said.encode()).hexdigest()))
        out = pii.find(df).collect()
        assert sorted((key(r[0]), *r[1:6]) for r in out) == sorted(want)
        for r in out:
            spans = [s for s in r.spans.split(",") if s]
            assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
            assert all(re.fullmatch(r"(email|ip|card|phone):\d+:\d+", s) for s in spans)


def test_personal_data_learns_contexts(spark):
    """Numbers that the base rules reject are found behind words that introduce cards elsewhere, and nowhere else."""

    def card(i):
        d = f"41111111{i:07d}"
        return next(d + str(c) for c in range(10) if passes("card", d + str(c)))

    seen = [(i, f"please charge account card {card(i)} today") for i in range(40)]
    odd = [(100, "please charge account card 4111x11122 today"), (101, "the part number 4111x11122 is out of stock")]
    got = {r.doc_id: r.n_added for r in pii.find(table(spark, seen + odd)).collect()}
    assert got[100] == 1 and got[101] == 0


def brute_repeats(rows, size=50):
    least, raw = {}, [(k, (t or "").encode()) for k, t in rows]
    low = lambda k: float("inf") if k is None else k
    for k, b in raw:
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            least[s] = min(least.get(s, float("inf")), low(k))
    for k, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if least[b[i : i + size]] < low(k):
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        yield key(k), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()


def test_repeated_passages(both):
    for rows, df in both:
        got = [(key(r[0]), *r[1:5]) for r in suffixes.repeated(df).collect()]
        assert sorted(got) == sorted(brute_repeats(rows))


def test_url_rules_and_model(spark):
    rows = duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall()
    rows += [(1000, None), (1001, ""), (1002, "example.net/es/"), (1003, "HTTP://News.Example.COM/en/x?y#z"), (1004, "https://www.example.com/en/"), (1005, "https://a.www.example.com/EN/"), (1006, "x://net/es/?q"), (1007, "http://notnet/es/"), (1008, "http://com?x/y"), (1009, "a://b.net#c"), (1010, "http://exa\nmple.net/fr/a b")]
    df = spark.createDataFrame([(k, u, "h", "clash") for k, u in rows], "page_id bigint, url string, html string, host string")
    fixed = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    for r in urls.judge(df).collect():
        u = dict(rows)[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x in fixed if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == fixed[rule] if rule else r.verdict in ("allow", "block")


def test_url_model_on_held_out_rows():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    pairs = [(f"{'casino' if b else 'garden'}{rng.integers(1000)}.example", f"/{'win' if b else 'read'}/{rng.integers(10**6)}") for b in y]
    hosts, paths = zip(*pairs, strict=True)
    model = urls.fit(list(hosts[:400]), list(paths[:400]), y[:400].astype(float))
    assert ((model.margins(list(hosts[400:]), list(paths[400:])) > 0) == y[400:]).mean() > 0.95


EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_simhash_dedup", "op3_mix_sources", "op5_exact_dedup", "op6_token_files", "op7_sentencepiece", "op8_personal_data", "op9_repeated_passages"])
def test_empty_and_odd_tables(spark, tmp_path, name):
    spark.createDataFrame([], EMPTY).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.queries()[name](spark, str(tmp_path / "empty")).count() == 0
    table(spark).withColumn("source", F.when(F.col("doc_id") > 8, "s")).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    assert queries.queries()[name](spark, str(tmp_path / "odd")).count() == len(ODD)


@pytest.mark.parametrize("name", ["op4_warc_fixity", "op10_url_filter"])
def test_empty_and_odd_pages(spark, tmp_path, name):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "empty" / "pages.parquet"))
    assert queries.queries()[name](spark, str(tmp_path / "empty")).count() == 0
    odd = [(1, None, None), (1, "http://a", "b"), (None, "http://a", "b"), (None, None, None), (2, "u\r\nv", "é" * 9000), (-1, "x", "")]
    spark.createDataFrame([(*r, "clash", 1) for r in odd], "page_id bigint, url string, html string, file string, level int").write.parquet(str(tmp_path / "odd" / "pages.parquet"))
    assert queries.queries()[name](spark, str(tmp_path / "odd")).count() == len(odd)
