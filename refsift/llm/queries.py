"""The corpus operators as queries over whole tables, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, langid, licenses, mixing, pii, quality, simhash, substring, tokens
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, and when, by the default curriculum."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each document and the verdict of the learned decision list."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document, and the score of each."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.withColumn("scores", F.array_join(F.transform("scores", lambda x: F.format_number(x, 2)), ","))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded with a public vocabulary and decoded again."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the passages that occur elsewhere."""
    return substring.dedup(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of each document, and whether it stays."""
    return exact.assign(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences and notices in each document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return tokens.round_trip(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and near-duplicate component of each document."""
    return simhash.dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_personal_data": op3_personal_data,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_licenses": op7_licenses,
    "op8_token_files": op8_token_files,
    "op9_language": op9_language,
    "op10_simhash": op10_simhash,
}

ORACLES = {
    "op5_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35
        ), twice AS (
            SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i : i + 34], ' ')) AS n FROM s) WHERE n > 1
        ), gone AS (
            SELECT DISTINCT r, i + k AS p FROM twice, (SELECT unnest(range(0, 35)) AS k)
        ), words AS (
            SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
        ), kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST)
    """,
    "op7_licenses": licenses.oracle(),
}
