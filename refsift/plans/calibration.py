"""Threshold calibration on labelled pairs of titles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.udfs import title_similarity
from .registry import query, sql, with_

THRESHOLDS = list(range(20, 91, 2))
FLOOR = 0.99

# Pairs with a made-up similarity: a third are different works.
PAIRS = ("pairs", """SELECT l.l_orderkey * 10 + l.l_linenumber AS pair_id, CASE WHEN l.l_partkey % 3 = 0 THEN 'different' ELSE 'same' END AS label,
    CASE WHEN l.l_partkey % 17 = 0 THEN NULL WHEN l.l_partkey % 3 = 0 THEN cast(10 + l.l_suppkey % 61 AS double) ELSE cast(58 + l.l_suppkey % 43 AS double) END AS similarity FROM lineitem l""")
_SWEEP = ("sweep", """SELECT t.threshold, sum(CASE WHEN label = 'different' AND similarity < threshold THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label = 'same' AND similarity < threshold THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN label = 'same' AND similarity >= threshold THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN label = 'different' AND similarity >= threshold THEN 1 ELSE 0 END) AS fn
    FROM pairs CROSS JOIN (SELECT unnest(range(20, 91, 2)) AS threshold) t WHERE similarity IS NOT NULL GROUP BY t.threshold""")
_METRICS = """cast(threshold AS int) AS threshold, cast(tp AS bigint) AS true_positive, cast(fp AS bigint) AS false_positive, cast(tn AS bigint) AS true_negative, cast(fn AS bigint) AS false_negative,
    cast(tp AS double) / nullif(tp + fp, 0) AS precision, cast(tp AS double) / nullif(tp + fn, 0) AS recall, cast(2 * tp AS double) / nullif(2 * tp + fp + fn, 0) AS f1, cast(tn AS double) / nullif(tn + fp, 0) AS specificity"""


def sweep(pairs: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """Confusion counts and rates at each threshold; a similarity below it flags a pair as different works.

    Pairs are counted by similarity first, so what is compared with the
    thresholds is as many rows as there are distinct similarities.
    """
    counted = pairs.where("similarity is not null").groupBy("similarity").agg(F.count_if(F.col("label") == "different").alias("d"), F.count_if(F.col("label") == "same").alias("s"))
    rows = counted.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    below = F.col("similarity") < F.col("threshold")
    total = lambda cond, x: F.sum(F.when(cond, F.col(x)).otherwise(0))
    found = rows.groupBy("threshold").agg(total(below, "d").alias("tp"), total(below, "s").alias("fp"), total(~below, "s").alias("tn"), total(~below, "d").alias("fn"))
    rate = lambda part, *rest: c.share(part, sum(map(F.col, rest), F.lit(0)))
    return found.select(
        "threshold", F.col("tp").alias("true_positive"), F.col("fp").alias("false_positive"), F.col("tn").alias("true_negative"), F.col("fn").alias("false_negative"),
        rate("tp", "tp", "fp").alias("precision"), rate("tp", "tp", "fn").alias("recall"), rate(2 * F.col("tp"), "tp", "tp", "fp", "fn").alias("f1"), rate("tn", "tn", "fp").alias("specificity"),
    )


def operating_point(curve: DataFrame, floor: float = FLOOR) -> DataFrame:
    """The threshold of the highest recall, the lowest of equal ones, whose precision reaches the floor; none if no one does."""
    return curve.where(F.col("precision") >= floor).orderBy(F.round("recall", 9).desc(), "threshold").limit(1)


def pairs(spark, sf_dir) -> DataFrame:
    return sql(spark, sf_dir, with_(PAIRS) + "SELECT * FROM pairs")


@query("q22_sweep", with_(PAIRS, _SWEEP) + f"SELECT {_METRICS} FROM sweep")
def q22(spark, sf_dir):
    return sweep(pairs(spark, sf_dir))


@query("q23_operating_point", with_(PAIRS, _SWEEP, ("m", f"SELECT {_METRICS} FROM sweep")) + f"SELECT * FROM m WHERE precision >= {FLOOR} ORDER BY round(recall, 9) DESC, threshold LIMIT 1")
def q23(spark, sf_dir):
    return operating_point(sweep(pairs(spark, sf_dir)))


_EDGE = "SELECT max(CASE WHEN label = 'different' THEN similarity END) AS hi, min(CASE WHEN label = 'same' THEN similarity END) AS lo FROM pairs"


@query("q24_class_overlap", with_(PAIRS, ("e", _EDGE)) + "SELECT label, min(similarity) AS lowest, max(similarity) AS highest, count(*) AS n, cast(sum(CASE WHEN similarity BETWEEN lo AND hi THEN 1 ELSE 0 END) AS bigint) AS contested FROM pairs CROSS JOIN e WHERE similarity IS NOT NULL GROUP BY label")
def q24(spark, sf_dir):
    """Range of each class, and how many pairs lie where both occur."""
    rows = pairs(spark, sf_dir).where("similarity is not null").groupBy("label", "similarity").count()
    edge = rows.agg(F.max(F.when(F.col("label") == "different", F.col("similarity"))).alias("hi"), F.min(F.when(F.col("label") == "same", F.col("similarity"))).alias("lo"))
    joined = rows.join(F.broadcast(edge))  # one row
    contested = F.sum(F.when(F.col("similarity").between(F.col("lo"), F.col("hi")), F.col("count")).otherwise(0))
    return joined.groupBy("label").agg(F.min("similarity").alias("lowest"), F.max("similarity").alias("highest"), F.sum("count").alias("n"), contested.alias("contested"))


def perturbed(titles: DataFrame, seed: int = 1729) -> DataFrame:
    """work_id, title, perturbation and claimed_title: the ways in which citations garble a title.

    Choices come from a hash of the work and the seed. A perturbation that
    doesn't apply to a title gives no row.
    """
    u = lambda k: F.pmod(F.xxhash64("work_id", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    title = F.col("title")
    words = F.split(title, " ")
    n = F.size(words)
    head = F.regexp_extract(title, r"^(.*?)(?:: | - | — )", 1)
    cut = lambda k: F.array_join(F.slice(words, F.lit(1), k.cast("int")), " ")
    short = F.greatest(F.lit(5), F.floor(n * (0.6 + 0.2 * u(1))))
    at = (2 + F.floor(u(2) * (F.length(title) - 5))).cast("int")
    swapped = lambda t: F.concat(t.substr(F.lit(1), at), t.substr(at + 2, F.lit(1)), t.substr(at + 1, F.lit(1)), t.substr(at + 3, F.length(t)))
    bare = lambda t: F.regexp_replace(t, r"(?U)[^\w\s]", "")
    compound = swapped(bare(F.when(n >= 8, cut(short)).otherwise(title)))
    forms = {
        "identity": title, "drop_subtitle": F.when(F.length(F.trim(head)) >= 15, F.trim(head)), "truncate": F.when(n >= 8, cut(short)),
        "typo": F.when(F.length(bare(title)) >= 12, swapped(title)), "case": F.when(u(3) < 0.5, F.upper(title)).otherwise(F.lower(title)),
        "punctuation": F.nullif(bare(title), title), "opening_words": F.when(n >= 9, cut(F.lit(4) + (u(4) < 0.5).cast("int"))),
        "compound": F.when(F.length(compound) >= 12, F.nullif(compound, title)),
    }
    rows = titles.select("work_id", "title", F.explode(F.array(*[F.struct(F.lit(k).alias("perturbation"), v.alias("claimed_title")) for k, v in forms.items()])).alias("x"))
    return rows.select("work_id", "title", "x.*").where("claimed_title is not null")


@query("q56_perturbations")
def q56(spark, sf_dir):
    """Each garbled title of the works, with its similarity to the true one."""
    works = sql(spark, sf_dir, "SELECT p.p_partkey AS work_id, p.p_name || ': ' || p.p_type || ' as seen in the light of ' || p.p_brand AS title FROM part p")
    return perturbed(works).withColumn("similarity", title_similarity("title", "claimed_title"))
