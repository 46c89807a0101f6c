"""Exact dedup by skew-safe combining.

Rows are combined three times, each time on the digest and the full normalised
text: within a map task, within a salt (the map task's number modulo SALTS, so
one group's rows meet in at most SALTS places), then across salts. A group
never travels as more than one row per map task, however many copies it has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, join_spread, release, stored, whole

SALTS = 16


def _number(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(20,0)")


def normalised(text: Column) -> Column:
    return F.translate(text, BLANK, "")


def _rank(n: Column, doc_id: Column) -> Column:
    """A fixed-width number that is largest for the row that stays: most code points,
    then smallest doc_id, a null doc_id after all others."""
    late = F.coalesce(_number(2**63) - doc_id.cast("decimal(19,0)"), F.lit(0).cast("decimal(20,0)"))
    return (n.cast("decimal(10,0)") * _number(2**65) + late).cast("decimal(33,0)")


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each distinct normalised text: text_sha256, text_len (code points
    of the normalised text), keep_id, keep_chars and group_size."""
    text = whole("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(text).alias("norm"), F.length(text).alias("n")
    ).select(
        F.sha2("norm", 256).alias("text_sha256"), "norm",
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        _rank(F.col("n"), F.col("doc_id")).alias("top"),
    )
    salted = rows.groupBy("text_sha256", "norm", "salt").agg(F.max("top").alias("top"), F.count("*").alias("c"))
    merged = salted.groupBy("text_sha256", "norm").agg(F.max("top").alias("top"), F.sum("c").alias("c"))
    late = F.pmod(F.col("top"), _number(2**65))
    return merged.select(
        "text_sha256", F.length("norm").alias("text_len"),
        F.when(late > 0, (_number(2**63) - late).cast("long")).alias("keep_id"),
        ((F.col("top") - late) / _number(2**65)).cast("int").alias("keep_chars"),
        F.col("c").cast("long").alias("group_size"),
    )


def assign(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    Texts are equal when identical without ASCII white space; null is an empty
    text and equals every blank one. Of equal texts the row with most code
    points stays, then the smallest doc_id; a null doc_id comes last. Of rows that
    repeat both the doc_id and the length of the one that stays, one is marked
    kept. An empty table gives an empty result; other columns are ignored.

    The way back joins slim rows by digest and length, and deals those of a hot
    group over tasks by doc_id and length.
    """
    text, keys = whole("text"), ["text_sha256", "text_len"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), normalised(text).alias("norm"), F.length(text).alias("n")
    ).select("doc_id", "n", F.sha2("norm", 256).alias("text_sha256"), F.length("norm").alias("text_len"))
    best = stored(winners(docs, salts).withColumn("of", F.col("group_size")), "winners")
    joined = join_spread(rows, best, keys, "of", F.xxhash64("doc_id", "n"))
    # The join's own partitions serve the window, as its keys include theirs.
    nth = F.row_number().over(Window.partitionBy(*keys, "_salt", "doc_id", "n").orderBy("doc_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_chars"))
    return joined.select("doc_id", "keep_id", "group_size", (stays & (nth == 1)).alias("kept"), "text_sha256")


def only(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, one for each distinct normalised text, with all columns.

    The same rules as for assign(): null texts are empty, a null doc_id comes
    last, and an empty table gives an empty result. Columns may have any names.
    The join is on digest, doc_id and length together, so copies spread over the
    partitions. Rows that repeat all three collapse to one, in each task before they travel.
    """
    keys = ["text_sha256", "keep_id", "keep_chars"]
    text = whole("text")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.sha2(normalised(text), 256).alias("text_sha256"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("keep_id"),
        F.length(text).alias("keep_chars"),
    )
    # Slim, and once it is written, the texts that were shuffled for it can go.
    best = stored(winners(docs, salts), "winners")
    release(docs.sparkSession)
    best = best.select(
        "text_sha256", F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("keep_id"), "keep_chars"
    )
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("row.text")).alias("nth")
    return rows.select("*", first).where("nth = 1").join(best, keys, "left_semi").select("row.*")
