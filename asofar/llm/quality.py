"""Quality rules with host verdicts, in DataFrame functions only.

Document rules fail on few words or on much repetition. Their failures are summed by host (here the column ``source``);
each host's failure rate is shrunk towards an empirical beta prior, fitted to all hosts by the method of moments, and a
host whose shrunk rate reaches the limit is rejected with all its documents.

Edge cases: a null text has no words and fails; null hosts form one host of their own; repeated rows are judged one by
one; an empty table gives an empty result; other columns of the input, whatever their names, don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, join_dimension, words, SPACES

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when nine of ten of its documents, after shrinkage, fail.
HOST_LIMIT = 0.9
#: Limits of the prior's weight in documents: with hosts that hardly differ it is finite, with few hosts it is positive.
PRIOR_RANGE = (1.0, 1e6)

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds METRICS and base_failed to each row. The per-row work is linear but for one sort of word triples.

    Word triples are compared by 64-bit hashes: within one text of n words two differing triples meet with probability
    below n * n / 2**65.
    """
    kept = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    df = let(df, words(F.col(text)).alias("__w"), F.filter(F.split(t, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("__l"))
    n, w = F.size("__w"), F.col("__w")
    triple = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    # from here on neither words nor lines are carried along
    df = let(
        df,
        n.cast("bigint").alias("__n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("__word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("__n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("__n_dup_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), triple)).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    h = F.col("__h")
    pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i"))))
    df = let(df, pairs.alias("__p"))
    p = F.col("__p")
    same = lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])
    df = let(df, F.transform(F.filter(p, same), lambda x: x["i"]).alias("__at"))
    a = F.col("__at")
    covered = F.size(F.array_distinct(F.concat(a, F.transform(a, lambda x: x + 1), F.transform(a, lambda x: x + 2))))
    df = df.withColumn("__n_repeat_words", F.when(a.isNull(), F.lit(0)).otherwise(covered).cast("bigint"))
    out = df.select(*[df[f"`{c}`"] for c in kept if c not in (*METRICS, "base_failed")], *[F.col(f"__{m}").alias(m) for m in METRICS])
    return out.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(judged: DataFrame, host: str, failed: str = "base_failed") -> DataFrame:
    """host, n_docs, n_failed, host_rate: the posterior mean of each host's failure rate.

    The prior's mean m is the rate over all documents; its weight s solves var = m (1 - m) / (s + 1) for the variance of
    the hosts' rates, weighted by documents, and is held within PRIOR_RANGE.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("d"), F.sum("n_failed").alias("f"), F.sum(F.col("n_docs") * rate * rate).alias("sq"))
    m, var = F.col("f") / F.col("d"), F.col("sq") / F.col("d") - (F.col("f") / F.col("d")) * (F.col("f") / F.col("d"))
    s = F.when(var <= 1e-12, F.lit(PRIOR_RANGE[1])).otherwise(m * (1 - m) / var - 1)
    prior = total.select(m.alias("m"), F.when(s < PRIOR_RANGE[0], PRIOR_RANGE[0]).when(s > PRIOR_RANGE[1], PRIOR_RANGE[1]).otherwise(s).alias("s"))
    # one row against one row for each host
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))).alias("host_rate"))


def judge(df: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The kept columns, METRICS, base_failed, host_rejected and kept, one row for each row of df."""
    keep = df.columns if keep is None else keep
    clash = [*METRICS, "base_failed", "host_rejected", "kept", "__host"]
    keep = [c for c in keep if c not in clash]
    slim = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{host}`"].alias("__host"), *([] if text in keep else [df[f"`{text}`"]]))
    judged = with_metrics(slim, text)
    judged = materialize(judged.select(*[F.col(f"`{c}`") for c in keep], "__host", *METRICS, "base_failed"), "quality")
    rejected = materialize(host_rates(judged, "__host").filter(F.col("host_rate") >= host_limit).select(F.col("host").alias("__host"), F.lit(True).alias("host_rejected")), "quality-hosts")
    out = join_dimension(judged, rejected, ["__host"], rejected.count())
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.select(*[F.col(f"`{c}`") for c in keep], *METRICS, "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host_rejected")


def accepted(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of df that its rules and its host's verdict keep, with the columns of df."""
    flags = {c: f"__col{i}" for i, c in enumerate(df.columns)}
    safe = df.select(*[df[f"`{c}`"].alias(a) for c, a in flags.items()])
    return judge(safe, flags[text], flags[host]).filter("kept").select(*[F.col(a).alias(c) for c, a in flags.items()])
