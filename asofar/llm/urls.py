"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for what no rule covers.

The model is fitted on a small labelled table of URLs: labelled_urls.csv beside this module (or one of the caller's), an invented one that
says what the filter is to keep out. Of a larger table about TRAIN_ROWS rows are taken, those of the least digests; every URL is
judged. Fitting is full-batch gradient descent from zero over sorted rows, so reruns agree; the weights (2**16 numbers) don't
grow with the input.

Edge cases: a null URL or one without ``://`` has an empty host and path and is judged by the model's intercept and the
n-grams of the empty text; repeated rows are judged alike; without labels of both verdicts the model answers
with the verdict that there is, allow if there is none; an empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
TRAIN_ROWS = 20_000
DIMENSIONS = 1 << 16
NGRAMS = (3, 4, 5)
ROUNDS = 60


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits the host or a parent domain and the path's start; null if none does."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, start = rule.split("/", 1)
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{start}"))
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def features(hosts: list[str], paths: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashed dimensions of each URL's distinct character n-grams of ``^host/path$``-like text."""
    rows, dims = [], []
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        x = np.frombuffer(f"^{h}|{p}$".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        got = []
        for n in NGRAMS:
            if len(x) >= n:
                v = np.full(len(x) - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    v = (v ^ x[k : len(x) - n + 1 + k]) * np.uint64(0x100000001B3)
                got.append((v ^ (v >> np.uint64(32))) % np.uint64(dimensions))
        d = np.unique(np.concatenate(got)) if got else np.empty(0, dtype=np.uint64)
        dims.append(d.astype(np.int64))
        rows.append(np.full(len(d), i, dtype=np.int64))
    return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate(dims) if dims else np.empty(0, np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def margins(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        r, d = features(hosts, paths, len(self.weights))
        n = np.bincount(r, minlength=len(hosts))
        return self.bias + np.bincount(r, self.weights[d], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1))


def fit(hosts: list[str], paths: list[str], block: np.ndarray, rounds: int = ROUNDS, rate: float = 20.0, shrink: float = 1e-4) -> Model:
    """Logistic regression of block (0 or 1), classes weighted evenly."""
    y = np.asarray(block, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(DIMENSIONS), 1.0 if len(y) and y[0] else -1.0)
    r, d = features(hosts, paths)
    n = np.bincount(r, minlength=len(y))
    value = (1 / np.sqrt(np.maximum(n, 1)))[r]
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        margin = b + np.bincount(r, w[d] * value, minlength=len(y))
        error = each * (1 / (1 + np.exp(-margin)) - y)
        w -= rate * (np.bincount(d, error[r] * value, minlength=DIMENSIONS) + shrink * w)
        b -= error.sum()
    return Model(w, b)


def labels(spark: SparkSession) -> DataFrame:
    """url and verdict: the table beside this module."""
    with open(Path(__file__).with_name("labelled_urls.csv"), encoding="utf-8", newline="") as f:
        rows = [(r["url"], r["verdict"]) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "url string, verdict string")


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_margin (null where a rule decides) for each row of df.

    labelled: columns url and verdict (allow or block); without it the table beside this module is taken.
    """
    u = F.col(f"`{url}`")
    ruled = df.select(F.col(f"`{key}`").alias("page_id"), host(u).alias("host"), path(u).alias("path"))
    ruled = ruled.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    by = F.lit(None).cast("string")
    for rule, verdict in rules:
        by = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by)
    labelled = labels(df.sparkSession) if labelled is None else labelled
    train = labelled.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "verdict").filter("verdict in ('allow', 'block')").distinct()
    n = train.count()
    if n > TRAIN_ROWS:  # a share by digest: TRAIN_ROWS rows, give or take a few hundred, whatever the table's size
        train = train.filter(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 40)) < int((1 << 40) * TRAIN_ROWS / n))
    train = sorted(train.collect(), key=lambda r: (r.host, r.path, r.verdict))
    model = fit([r.host for r in train], [r.path for r in train], np.array([r.verdict == "block" for r in train], dtype=float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            open_ = pc.is_null(b.column("rule")).to_numpy(zero_copy_only=False)
            margin = np.zeros(b.num_rows)
            at = np.flatnonzero(open_)
            if len(at):
                margin[at] = model.margins([hosts[i] for i in at], [paths[i] for i in at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(margin, mask=~open_)], names=[*b.schema.names, "block_margin"])

    schema = "page_id bigint, host string, path string, rule string, verdict string, block_margin double"
    scored = ruled.withColumn("page_id", F.col("page_id").cast("bigint")).withColumn("verdict", by).mapInArrow(score, schema)
    verdict = F.coalesce("verdict", F.when(F.col("block_margin") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_margin")
