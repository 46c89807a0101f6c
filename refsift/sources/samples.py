"""What studies look at: works, preprints and articles, drawn from record tables.

A draw orders rows by a hash of their key and a seed, so it is the same whatever
the order, the partitions and the number of machines. A key that comes twice counts once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col

#: The most that one draw of works returns (a fixed value of the service).
MOST = 200
MIN_TITLE, CALIBRATION_TITLE = 15, 20
ARXIV_DOI = "10.48550/arxiv."
MIN_ARTICLE = 8000


def order(key, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"))), col(key)]


def top(rows: DataFrame, n: int, *by: Column, per: list[str] = ()) -> DataFrame:
    """The first n rows by an order, for each group of per; a group is cut in each task before it travels."""
    if not per:
        return rows.orderBy(*by).limit(n)
    nth = F.row_number().over(Window.partitionBy(*per).orderBy(*by))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least of those that have it."""
    return rows.groupBy(key).agg(F.min(F.struct(*[x for x in rows.columns if x != key])).alias("row")).select(key, "row.*")


def works(records: DataFrame, n: int, years: tuple[int, int], seed: int = 42) -> DataFrame:
    """A draw of works (doi, title, authors, year) that have a DOI, from these years; MOST at most."""
    found = records.where(F.col("doi").isNotNull() & F.col("year").between(*years))
    return top(once(found, "doi"), min(n, MOST), *order("doi", seed))


def source_works(records: DataFrame, per_year: int, seed: int = 42) -> DataFrame:
    """So many works a year of those (doi, title, year, refs) with a reference that has a DOI and a title of MIN_TITLE characters."""
    usable = F.exists("refs", lambda r: r["doi"].isNotNull() & (F.length(r["title"]) >= MIN_TITLE))
    return top(once(records.where(F.col("doi").isNotNull() & usable), "doi"), per_year, *order("doi", seed), per=["year"])


def calibration_works(records: DataFrame, n: int, windows: list[tuple[int, int]], seed: int = 42) -> DataFrame:
    """Works (doi, title, authors, year) for similarities: n in equal parts from windows of years, with a title of CALIBRATION_TITLE characters and authors."""
    good = once(records.where(F.col("doi").isNotNull() & (F.length("title") >= CALIBRATION_TITLE) & (F.size("authors") > 0)), "doi")
    window = F.coalesce(*[F.when(F.col("year").between(a, b), F.lit(i)) for i, (a, b) in enumerate(windows)])
    rows = good.withColumn("window", window).where("window is not null")
    return top(rows, -(-n // len(windows)), *order("doi", seed), per=["window"]).drop("window")


def preprints_of_index(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A draw of preprints from an index of works (doi, title, year): those whose DOI is arXiv's; arxiv_id is the rest of it."""
    mine = F.startswith(F.lower("doi"), F.lit(ARXIV_DOI))
    rows = records.where(mine).select(F.substring("doi", len(ARXIV_DOI) + 1, 1 << 20).alias("arxiv_id"), *[x for x in records.columns if x != "doi"])
    return top(once(rows, "arxiv_id"), n, *order("arxiv_id", seed))


def newest_preprints(records: DataFrame, per_category: int) -> DataFrame:
    """The newest preprints (arxiv_id, category, published) of each category; one of several counts in the first of them by name."""
    rows = once(records, "arxiv_id")
    return top(rows, per_category, F.desc("published"), F.col("arxiv_id"), per=["category"])


def articles(pages: DataFrame, n: int, seed: int = 42, search: str | None = None) -> DataFrame:
    """A draw of articles (title, text): those that hold search, else those of MIN_ARTICLE bytes; a title counts once."""
    fits = F.contains("text", F.lit(search)) if search else F.octet_length("text") >= MIN_ARTICLE
    return top(once(pages.where(fits & F.col("title").isNotNull()), "title"), n, *order("title", seed))


def wikitext(body) -> Column:
    """The text of a page in an answer of the wiki's service (JSON): the first slot of its first revision, else empty."""
    slots = "struct<query:struct<pages:array<struct<title:string,revisions:array<struct<slots:struct<main:struct<content:string>>>>>>>>"
    page = F.try_element_at(F.from_json(col(body).cast("string"), slots)["query"]["pages"], F.lit(1))
    return F.coalesce(F.try_element_at(page["revisions"], F.lit(1))["slots"]["main"]["content"], F.lit(""))

