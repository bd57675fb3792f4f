"""The registered queries of the training-data operators: thin digests of what each operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.llm import secrets
from casegrain.llm.decontamination import find_leaks
from casegrain.llm.fingerprint import fingerprints
from casegrain.llm.frames import bounded_batches, read
from casegrain.llm.html_extraction import extract_main_text
from casegrain.llm.line_dedup import line_dedup
from casegrain.llm.mixing import mix
from casegrain.llm.ngram_join import ngram_join
from casegrain.llm.quality import quality
from casegrain.llm.substring_dedup import substring_dedup
from casegrain.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents")).drop("edited_text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", F.round("leak.score", 6).alias("score"), F.col("leak.question").alias("question_overlap"), F.col("leak.answer").alias("answer_overlap"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join(read(spark, sf_dir, "documents"), shingle=5, percent=75)
    return out.select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secret_scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.as_text(F.col("found"), 3), 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    """Each query, told to bound the Arrow batches of the session that it is given."""
    return {f.__name__: lambda spark, sf_dir, f=f: f(bounded_batches(spark), sf_dir) for f in (op1_fingerprint, op2_substring_dedup, op3_toxicity, op4_decontamination, op5_html_extraction, op6_quality, op7_ngram_join, op8_mixing, op9_secrets, op10_line_dedup)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
     s AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
     f AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM s JOIN f USING (h) WHERE least < doc_id),
     r AS (SELECT doc_id, list(j) AS gone, count(*) AS n FROM g GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN words
              ELSE [x FOR x, k IN words IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


_OP8 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
     k AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
                  -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(t)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
                  / (0.1 + 0.9 * CASE WHEN length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) > 0
                       THEN (length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) - length(regexp_replace(t, '[^!-/:-@\[-`{-~]', '', 'g')))::DOUBLE
                            / length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) ELSE 0.0 END) AS key FROM d),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM k GROUP BY source),
     w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM s),
     r AS (SELECT *, cap / w AS ratio,
                  (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
     g AS (SELECT source, source_size, cap, w, (SELECT level FROM r WHERE ratio > level ORDER BY ratio, i LIMIT 1) AS final FROM r),
     t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM g),
     o AS (SELECT k.doc_id, k.size, t.*, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
     e AS (SELECT *, round(target)::BIGINT AS words, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, words - epochs * source_size - before)))::BIGINT AS taken FROM e
"""

_OP10 = r"""
WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
     n AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM l),
     c AS (SELECT key, min(doc_id) AS first FROM n WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
     k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND doc_id <> first) AS n_removed,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL OR doc_id = first), '') AS kept
           FROM n LEFT JOIN c USING (key) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2, "op8_mixing": _OP8, "op10_line_dedup": _OP10}
