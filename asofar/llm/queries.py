"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, mixing, pieces, pii, quality, simhash, suffixes, tokens, urls, warc
from .common import finished, scratch_mark


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host verdicts on all documents; a document's host is its source."""
    return quality.judge(_documents(spark, sf_dir), keep=["doc_id"])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of 100% of all words takes."""
    return mixing.plan(_documents(spark, sf_dir)).select(F.col("__key").alias("doc_id"), "size", "source_size", "target", "taken")


def _rots(digest: bytes) -> bool:
    """One record in 256, by digest."""
    return digest[0] == 0


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC in two replicas, the second with injected faults, and the records that the audit finds damaged."""
    return warc.fixity(spark.read.parquet(f"{sf_dir}/pages.parquet"), _rots)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents, through the hash index of their distinct digests."""
    return exact.resolve(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints of 4-word shingles differ in at most 4 bits."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as segments of directly addressable codes and read back."""
    return tokens.round_trip(_documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the model's rule and by the streaming Viterbi search, and whether both decode to the text."""
    return pieces.encoded(_documents(spark, sf_dir)).drop("ids", "viterbi_ids")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base rules, and what patterns learnt from all documents add."""
    return pii.find(_documents(spark, sf_dir))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that passages of 50 bytes share with a document of a smaller id."""
    return suffixes.repeated(_documents(spark, sf_dir)).drop("removed")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all URLs of pages, the model trained on the small labelled table."""
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's result."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which leaves only those scratch tables that its result reads."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        mark = scratch_mark()
        return finished(query(spark, sf_dir), mark)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _tidy(f) for f in (op1_quality_rules, op2_simhash_dedup, op3_mix_sources, op4_warc_fixity, op5_exact_dedup, op6_token_files, op7_sentencepiece, op8_personal_data, op9_repeated_passages, op10_url_filter, pipeline)}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = rf"""
WITH base AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, len(w) AS many, unnest(list_zip(w, w[2:], w[3:])) AS g FROM base WHERE len(w) >= 3),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE i <= many - 2),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, (VALUES (0), (1), (2)) AS v(k) WHERE counted.n > 1 GROUP BY doc_id),
metrics AS (
  SELECT b.doc_id, b.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (doc_id)),
judged AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM metrics),
hosts AS (SELECT source, count(*) AS d, sum(base_failed::INT) AS f FROM judged GROUP BY source),
total AS (SELECT sum(f) / sum(d) AS m, sum(d * (f / d) * (f / d)) / sum(d) - (sum(f) / sum(d)) * (sum(f) / sum(d)) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v <= 1e-12 THEN 1e6 ELSE greatest(1.0, least(1e6, m * (1 - m) / v - 1)) END AS s FROM total),
rejected AS MATERIALIZED (SELECT source FROM hosts, prior WHERE (f + m * s) / (d + s) >= 0.9)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM rejected r WHERE r.source IS NOT DISTINCT FROM j.source) AS kept,
       EXISTS (SELECT 1 FROM rejected r WHERE r.source IS NOT DISTINCT FROM j.source) AS host_rejected
FROM judged j
"""

_OP3 = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size, md5(t) AS digest,
         CASE WHEN length(t) > 0 THEN 0.5 + 0.5 * length(regexp_replace(t, '[^A-Za-z0-9 ]+', '', 'g')) / length(t) ELSE 0.5 END AS w,
         (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(t)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM base),
sources AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source)),
fill(step, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) - sum(CASE WHEN 3.0 * source_size <= level * weight THEN 3.0 * source_size ELSE 0 END))
                           / sum(CASE WHEN 3.0 * source_size <= level * weight THEN 0 ELSE weight END) FROM sources)
  FROM fill WHERE step < 40),
goals AS (SELECT source, source_size, least(3.0 * source_size, weight * (SELECT max(level) FROM fill)) AS target FROM sources),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
         CAST(floor(target + 0.5) AS BIGINT) AS goal FROM goals),
ordered AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.passes, p.goal - p.passes * p.source_size AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln(u) / w, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN parts p ON p.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + least(size, greatest(0, budget - before)) AS BIGINT) AS taken FROM ordered
"""

_OP4 = r"""
WITH records AS (
  SELECT page_id, floor(page_id / 256)::BIGINT AS file,
         'WARC/1.0' || n || 'WARC-Type: resource' || n || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') || n
         || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'Content-Type: text/html' || n || 'Content-Length: '
         || strlen(coalesce(html, '')) || n || n || coalesce(html, '') || n || n AS r
  FROM pages, (SELECT chr(13) || chr(10) AS n))
SELECT page_id, file, CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
       CAST(strlen(r) AS BIGINT) AS record_length, sha256(r) AS record_sha256, starts_with(sha256(r), '00') AS damaged
FROM records
"""

_OP5 = r"""
WITH base AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS kept, h AS text_sha256
FROM base
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op3_mix_sources": _OP3, "op4_warc_fixity": _OP4, "op5_exact_dedup": _OP5}
