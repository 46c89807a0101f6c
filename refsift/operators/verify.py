"""Lookups in authorities, with the status of each as a column, and the verdicts that follow."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from . import titles

DOI_SYNTAX = r"^10\.\d{4,9}/\S+$"
MIN_TITLE = 15


def two_stage(citations: DataFrame, first: DataFrame, second: DataFrame, use_second: bool = True) -> DataFrame:
    """Add verdict and authority to citations (identifier, claimed_key).

    first and second hold doi, status and title_key of two authorities. The
    second is asked only about what the first has not; an outage of either is
    inconclusive, as is a second that is disabled.
    """
    wellformed = F.col("identifier").rlike(DOI_SYNTAX)
    a = first.select(F.col("doi").alias("identifier"), F.col("status").alias("s1"), F.col("title_key").alias("t1"))
    b = second.select(F.col("doi").alias("identifier"), F.col("status").alias("s2"), F.col("title_key").alias("t2"))
    one = citations.join(a, "identifier", "left").withColumn("s1", F.when(wellformed, F.coalesce("s1", F.lit("miss"))))
    asked = one.where("s1 = 'miss'").join(b, "identifier", "left").withColumn("s2", F.coalesce("s2", F.lit("miss")) if use_second else F.lit("disabled"))
    rest = one.where("s1 is null or s1 <> 'miss'").select("*", F.lit(None).cast("string").alias("s2"), F.lit(None).cast(one.schema["t1"].dataType).alias("t2"))
    rows = asked.select(*rest.columns).unionByName(rest)
    return rows.select("*", verdict_of("identifier", "s1", "s2", F.coalesce(F.when(F.col("s1") == "hit", F.col("t1")), F.col("t2"))).alias("verdict"), authority_of("s1", "s2").alias("authority"))


def verdict_of(identifier, s1, s2, found_key) -> Column:
    """The truth table of two lookups; claimed_key decides between verified and mismatch, null agrees."""
    identifier, s1, s2 = c.col(identifier), c.col(s1), c.col(s2)
    same = F.coalesce(F.col("claimed_key") == found_key, F.lit(True))
    return (
        F.when(identifier.isNull(), "unverifiable").when(~identifier.rlike(DOI_SYNTAX), "malformed").when(s1 == "unreachable", "unreachable")
        .when((s1 == "hit") | (s2 == "hit"), F.when(same, "verified").otherwise("mismatch"))
        .when(s2 == "unreachable", "unreachable").when(s2 == "disabled", "unverifiable").otherwise("not_found")
    )


def authority_of(s1, s2) -> Column:
    s1, s2 = c.col(s1), c.col(s2)
    return (
        F.when(s1.isNull(), "crossref").when(s1 == "unreachable", "-").when(s1 == "hit", "crossref")
        .when(s2 == "hit", "openalex").when(s2 == "disabled", "crossref").otherwise("crossref+openalex")
    )


def versionless(arxiv_id) -> Column:
    return F.regexp_replace(c.col(arxiv_id), r"v\d+$", "")


def url_verdict(status, enabled: bool = True) -> Column:
    if not enabled:
        return F.lit("unverifiable")
    status = c.col(status)
    return F.when(status == "hit", "verified").when(status == "miss", "not_found").otherwise("unreachable")


def candidates(claims: DataFrame, works: DataFrame, common: int | None = None, least: float = c.LEAST_PLAUSIBLE) -> DataFrame:
    """All works for each claim (claim_id, claimed_title) that are similar enough, by the number of title words they share.

    No work of a similarity of at least ``least`` is left out, whatever words it
    shares; below LEAST_PLAUSIBLE none is plausible. ``common`` limited the words
    that bring candidates, and has no effect any more. Titles under MIN_TITLE
    characters aren't searched.
    """
    asked = claims.where(F.length("claimed_title") >= MIN_TITLE).select("claim_id", "claimed_title")
    rank = Window.partitionBy("claim_id").orderBy(F.desc("shared"), "work_id")
    return titles.at_least(asked, works, least).withColumn("rank", F.row_number().over(rank))


def search(claims: DataFrame, works: DataFrame, least: float = c.LEAST_PLAUSIBLE) -> DataFrame:
    """What first_plausible() makes of all candidates of each claim (claim_id, claimed_title, claimed_authors) among works (work_id, title, authors), without listing them.

    Each block of works gives its first plausible and its closest one. Names are compared without case and accents.
    """
    asked = claims.where(F.length("claimed_title") >= MIN_TITLE).select("claim_id", "claimed_title", "claimed_authors")
    met = titles.best(asked, works.select("work_id", "title", "authors"), least)
    first = F.when(F.col("plausible"), F.struct(-F.col("shared"), "work_id"))
    return met.groupBy("claim_id").agg(
        F.min_by("work_id", first).alias("accepted"), F.min_by("work_id", F.struct(-F.col("similarity"), -F.col("shared"), "work_id")).alias("closest"), F.max("similarity").alias("best_similarity")
    )


def first_plausible(scored: DataFrame) -> DataFrame:
    """Of candidates (claim_id, rank, work_id, similarity, overlap) the first plausible one, and the closest, the earlier of equal ones."""
    passing = F.when(c.plausible("similarity", "overlap"), F.col("rank"))
    return scored.groupBy("claim_id").agg(
        F.min_by("work_id", passing).alias("accepted"), F.max_by("work_id", F.struct("similarity", -F.col("rank"))).alias("closest"), F.max("similarity").alias("best_similarity")
    )
