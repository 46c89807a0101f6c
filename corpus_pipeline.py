"""The corpus pipeline: stages, each of which reads what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; the caller writes each result and reads it
again for the next, as run() does.

Nulls, in all stages: a null text is an empty one, a null doc_id comes after all
others, a null source is a source of its own. Columns may have any names. An
empty table stays empty. Texts are read whole, however long.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refsift.llm import bpe, exact, mixing, quality, simhash
from refsift.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test, which empty texts fail, and that no rule of the learned decision list rejects; repeated rows alike."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that of smallest doc_id; of repeated rows one."""
    return exact.only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of smallest doc_id; of repeated rows, and of those without a doc_id, one."""
    return simhash.only(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in order of training, each as often as the mix takes it; those that it doesn't take go. Repeated rows share what is taken of them."""
    return mixing.sequence(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, repeated ones too."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe encoding", encode),
]

#: SQL can't express the learned rules, SimHash or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
