"""Personal data: base rules, and bootstrapped contextual extraction of further identifiers, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers; their possessive forms match what the plain ones would, in
linear time and constant stack. Spans are code points, from the lengths of the matches and of what stands between them.

The method: spans of the base rules are the seeds, and so are long hexadecimal tokens, as seeds of a kind of its own, secret. The words before an
instance are its lexical patterns (the last word, and the last two). Patterns and instance values form a graph; round by round a pattern's
confidence in a kind is the summed score of its values of that kind over all its distinct values plus one, a value's score is its best
pattern's confidence, and seeds keep score one. Patterns above PATTERN_LIMIT with MIN_SUPPORT distinct values of a kind, after the last round,
mark identifier-like tokens that no base span overlaps: secrets by their context, not by their form alone. All statistics are over all
documents; only distinct (pattern, value) pairs are moved.

Limits: tokens have six word characters, four of them digits, or more; patterns have words of at most 24 letters within 64 characters; ROUNDS
rounds are made, so a pattern that shares no value with one nearer to the seeds than ROUNDS - 1 steps isn't reached.

Edge cases: a null text is empty; texts without personal data give zero counts, the digest of the empty string and empty spans;
repeated rows are searched one by one; an empty table gives an empty result; other columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_dimension, let, materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to, in the order that spans of one start have.
LEARNT = (*KINDS, "secret")
#: Tokens that are seeds of secrets by their form.
SECRET = "^[0-9a-f]{32,}$"
ROUNDS = 3
PATTERN_LIMIT = 0.75
MIN_SUPPORT = 5
_CONTEXT_CHARS = 64

_L = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_L})){_L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++|(?<=\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A whole run of 6 word characters or more with at least four digits.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=(?:[A-Za-z_-]*+[0-9]){4})[A-Za-z0-9_-]{6,}+"
_TRIGGER = {"email": "@", "phone": "+"}
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string,before:string>>"


def spans(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """All matches with their places and the _CONTEXT_CHARS before them. Gaps and matches alternate, so their lengths add up."""
    p = F.lit(pattern)

    def walk(both: Column) -> Column:
        found, gaps = both["m"], both["g"]
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            gap, value = F.get(gaps, i), F.get(found, i)
            begin = acc["at"] + F.length(gap)
            tail = F.substring(gap, F.greatest(F.length(gap) - _CONTEXT_CHARS, F.lit(0)) + 1, F.lit(_CONTEXT_CHARS))
            one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (begin + F.length(value)).alias("end"), value.alias("value"), tail.alias("before"))
            return F.struct((begin + F.length(value)).alias("at"), F.concat(acc["out"], F.array(one)).cast(_SPAN).alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step)["out"]).otherwise(F.array().cast(_SPAN))

    both = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.get(F.transform(F.array(both), walk), 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, -i - 1, F.lit(1))) - 48
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(small(x)) <= 3) & (F.lpad(small(x), 3, "0") <= "255"))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast(_SPAN)
    found = F.filter(spans(text, PATTERNS[kind], kind, KINDS.index(kind)), lambda x: valid(kind, x["value"]))
    has = F.contains(text, F.lit(_TRIGGER[kind])) if kind in _TRIGGER else F.rlike(text, F.lit("[0-9].?[0-9]" if kind == "card" else r"[0-9]\.[0-9]"))
    return F.when(has, found).otherwise(none)


def joined(found: Column) -> Column:
    ordered = F.array_sort(found)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def contexts(before: Column) -> Column:
    """Up to two lexical patterns: the last word with what follows it, and the last two; digits count as one sign."""
    low = F.regexp_replace(F.lower(before), "[0-9]+", "0")
    one = F.regexp_extract(low, r"(\p{L}{1,24}[^\p{L}]{1,8})$", 1)
    two = F.regexp_extract(low, r"(?<!\p{L})(\p{L}{1,24}[^\p{L}]{1,8}\p{L}{1,24}[^\p{L}]{1,8})$", 1)
    return F.array_distinct(F.filter(F.array(one, two), lambda x: x != ""))


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of df."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    base = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("__t"))
    base = let(base, *[base_spans(t, k).alias(f"__{k}") for k in KINDS])
    base = let(base, F.concat(*[F.col(f"__{k}") for k in KINDS]).alias("__base"))
    b = F.col("__base")
    free = lambda x: ~F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    tokens = F.when(F.rlike(t, F.lit("[0-9]")), F.filter(spans(t, CANDIDATE, "", len(KINDS)), free)).otherwise(F.array().cast(_SPAN))
    counts = [F.size(f"__{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    base = base.select("doc_id", F.monotonically_increasing_id().alias("__row"), *counts, b.alias("__base"), tokens.alias("__tokens"))
    base = materialize(base, "pii-base")
    marks = base.select("__row", F.explode(F.concat("__base", "__tokens")).alias("x")).select("__row", "x.start", "x.end", "x.kind", "x.value", contexts(F.col("x.before")).alias("__ctx"))
    edges = marks.select(F.explode("__ctx").alias("pattern"), F.xxhash64("value").alias("value"), F.when(F.col("kind") != "", F.col("kind")).when(F.rlike("value", F.lit(SECRET)), "secret").alias("seed"))
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    best = _bootstrap(edges)
    n = best.count()
    found = marks.filter(F.col("kind") == "").select("__row", "start", "end", F.explode("__ctx").alias("pattern"))
    hits = join_dimension(found, best.select("pattern", F.col("kind").alias("k"), "confidence"), ["pattern"], n).filter(F.col("k").isNotNull())
    hits = hits.groupBy("__row", "start", "end").agg(F.max(F.struct("confidence", "k")).alias("b"))
    rank = F.array_position(F.array(*[F.lit(k) for k in LEARNT]), F.col("b.k")).cast("int") - 1
    one = F.struct(F.col("start"), rank.alias("rank"), F.col("b.k").alias("kind"), F.col("end"), F.lit("").alias("value"), F.lit("").alias("before"))
    # of one text only: as many as it has marked tokens
    added = hits.groupBy("__row").agg(F.collect_list(one).cast(_SPAN).alias("__added"))
    out = base.join(added, "__row", "left").withColumn("__added", F.coalesce("__added", F.array().cast(_SPAN)))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.concat("__base", "__added")).alias("spans"), F.size("__added").cast("bigint").alias("n_added"))


def _bootstrap(edges: DataFrame) -> DataFrame:
    """pattern, kind, confidence of the patterns that pass after the last round. edges: distinct pattern, value, seed (kind or null)."""
    total = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= MIN_SUPPORT), "pii-totals")
    scored = edges.filter(F.col("seed").isNotNull()).select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    best = None
    for turn in range(ROUNDS):
        sums = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("support"))
        ranked = sums.join(total, "pattern").withColumn("confidence", F.col("sum") / (F.col("total") + 1)).filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= PATTERN_LIMIT))
        best = materialize(ranked.groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("pattern", "b.kind", "b.confidence"), "pii-patterns")
        if turn == ROUNDS - 1 or best.isEmpty():
            break
        fresh = join_dimension(edges.filter(F.col("seed").isNull()), best, ["pattern"], best.count()).filter(F.col("kind").isNotNull())
        known = materialize(fresh.groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("value", "b.kind", F.col("b.confidence").alias("score")), "pii-values")
        reached = edges.filter(F.col("seed").isNull()).join(known, "value").select("pattern", "value", "kind", "score")
        seeds = edges.filter(F.col("seed").isNotNull()).select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
        scored = seeds.unionByName(reached)
    return best
