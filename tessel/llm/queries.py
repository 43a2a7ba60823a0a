"""The corpus queries by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, quality_crf, toxicity
from .common import read_table
from .exact_dedup import exact_dedup
from .mixing import training_order
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import judged
from .token_counts import token_counts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position_ppm is the first training time in millionths, -1 for documents that the mix leaves out."""
    ordered = training_order(read_table(spark, sf_dir, "documents"))
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "copies", F.coalesce(F.floor(F.col("position") * 1_000_000).cast("long"), F.lit(-1).cast("long")).alias("position_ppm"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.trained(docs, read_table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read_table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_crf.scored(docs, quality_crf.trained(docs, read_table(spark, sf_dir, "labels")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.trained(docs))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_near_dedup": op6_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(x) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY x)""",
    "op2_mix_sources": """
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':0'), 1, 15))::BIGINT AS h
            FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
        s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k, (3 * total)::DOUBLE AS cap FROM s0),
        s2 AS (SELECT *, (k + 1)::DOUBLE AS w FROM s1),
        s3 AS (SELECT *, sum(total::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0) AS lft,
                      sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS shr
               FROM s2 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s4 AS (SELECT *, max(CASE WHEN cap > lft / shr * w THEN lft / shr END) OVER () AS lvl FROM s3),
        s5 AS (SELECT source, total, w, k, CASE WHEN lvl IS NULL OR cap <= lvl * w THEN cap ELSE lvl * w END AS target FROM s4),
        p AS (SELECT d.*, total, w, k, target, floor(target)::BIGINT AS words,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id::VARCHAR, size
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
              FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
        q AS (SELECT *, CASE WHEN total > 0 THEN words // total ELSE 0 END AS whole FROM p),
        r AS (SELECT *, greatest(0, least(size, words - whole * total - start)) AS part,
                     start / target * w AS cum, CASE k WHEN 0 THEN 1.5 ELSE 2.0 END::DOUBLE AS w0,
                     CASE k WHEN 0 THEN -1.0 WHEN 1 THEN 0.0 ELSE 2.0 END::DOUBLE AS slope FROM q),
        c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + (part > 0)::BIGINT END AS copies FROM r)
        SELECT doc_id, size, total AS source_size, target, (whole * size + part)::BIGINT AS taken, copies::BIGINT AS copies,
               CASE WHEN copies > 0 THEN floor((0.0 + CASE WHEN cum <= 0 THEN 0.0 ELSE
                   2.0 * cum / (w0 + sqrt(greatest(0.0, w0 * w0 + 2.0 * slope * cum))) END) * 1000000)::BIGINT ELSE -1 END AS position_ppm
        FROM c""",
    "op4_quality_rules": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (
            SELECT row_number() OVER () AS r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM d),
        g AS (
            SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k
            FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g),
        n AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY r),
        m AS (
            SELECT doc_id, len(words)::BIGINT AS n_words,
                   length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                   len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                   (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper
            FROM w LEFT JOIN n USING (r)),
        f AS (
            SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
                   + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT + 16 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
                   + 32 * (2 * n_upper > word_chars)::BIGINT)::BIGINT AS failed
            FROM m)
        SELECT *, failed & 3 <> 0 AS base_failed, failed & 39 = 0 AND bit_count(failed & 24) <= 1 AS kept FROM f""",
}
