"""The engine as one object: documents in, findings out."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as c
from .functions.udfs import normalise_names, title_similarity
from .operators import explain, extract, quotes, verify
from .sources import documents

#: Schemas of the snapshots: dois of both authorities, arXiv records, links, and works to search.
DOI = "doi string, status string, title string, authors array<string>, year int"
ARXIV = "arxiv_id string, status string, title string, authors array<string>, year int"
URL = "url string, status string"
WORK = "work_id long, title string, authors array<string>, year int"

_COLUMNS = ("doc_id", "line", "pos", "raw", "kind", "identifier", "ref_number", "claimed_title", "claimed_authors", "claimed_year", "context")
_FOUND = ("resolved_title", "resolved_authors", "resolved_year")
_DISABLED = "this check is disabled"


def _with_overlap(rows: DataFrame, name: str, claimed: str, resolved: str) -> DataFrame:
    """Add the overlap of two columns of names, compared without case and accents."""
    rows = rows.withColumns({"_claimed": normalise_names(claimed), "_resolved": normalise_names(resolved)})
    return rows.withColumn(name, c.author_overlap("_claimed", "_resolved")).drop("_claimed", "_resolved")


@dataclass
class Verifier:
    """Checks citations by kind against snapshots; one that is None is a disabled check.

    Documents' texts never leave the plan; a bad row becomes a finding, not an error.
    Links and references without an identifier are passed over if check_urls or
    search_unidentified is false; without use_fallback, what the first authority
    lacks stays open. The citations of a check are kept by Spark until release().
    ``common`` has no effect any more: a search compares a title with all works.
    """

    first: DataFrame | None = None
    second: DataFrame | None = None
    arxiv: DataFrame | None = None
    urls: DataFrame | None = None
    works: DataFrame | None = None
    more_works: DataFrame | None = None
    sources: DataFrame | None = None
    common: int = 1000
    check_urls: bool = True
    search_unidentified: bool = True
    use_fallback: bool = True
    _kept: list[DataFrame] = field(default_factory=list, init=False, repr=False, compare=False)

    def release(self) -> None:
        """Give back the memory and disk of the citations of all checks so far; for callers that have read all findings."""
        while self._kept:
            self._kept.pop().unpersist()

    def findings(self, docs: DataFrame) -> DataFrame:
        return self.check(extract.extract(docs))

    def verify_text(self, spark: SparkSession, text: str, document: str = "-") -> DataFrame:
        """Findings of one text."""
        return self.findings(spark.createDataFrame([(document, text)], "doc_id string, text string"))

    def verify_file(self, spark: SparkSession, path: str) -> DataFrame:
        """Findings of the files at path (a glob is fine)."""
        return self.findings(documents.read(spark, path))

    def check(self, citations: DataFrame) -> DataFrame:
        """A finding for each citation: verdict, authority, detail, what was found, title_similarity, author_overlap, evidence_url and checked_at."""
        # Every kind has a plan of its own, and a search two; texts are read once for all of them.
        citations = citations.select(*_COLUMNS).persist()
        self._kept.append(citations)
        kind = lambda k: citations.where(F.col("kind") == k).select(*_COLUMNS)
        out = self._dois(kind("doi")).unionByName(self._arxiv(kind("arxiv"))).unionByName(self._urls(kind("url")))
        return out.unionByName(self._search(kind("bibliographic")))

    def _nothing(self, rows: DataFrame, verdict: Column, authority: str | Column = "-", note: str | None = None) -> DataFrame:
        empty = [F.lit(None).cast(t).alias(n) for n, t in zip(_FOUND, ("string", "array<string>", "int"))]
        authority = F.lit(authority) if isinstance(authority, str) else authority
        return self._assessed(rows.select(*_COLUMNS, *empty, verdict.alias("verdict"), authority.alias("authority"), F.lit(note).cast("string").alias("note")))

    def _assessed(self, rows: DataFrame) -> DataFrame:
        """Compare what was found with the claim; only a hit can become a mismatch. A note takes the place of the detail."""
        rows = rows if "note" in rows.columns else rows.withColumn("note", F.lit(None).cast("string"))
        rows = rows.withColumn("title_similarity", title_similarity("claimed_title", "resolved_title"))
        rows = _with_overlap(rows, "author_overlap", "claimed_authors", "resolved_authors")
        verdict = F.when((F.col("verdict") == "verified") & F.col("resolved_title").isNotNull(), c.assess("title_similarity", "author_overlap")).otherwise(F.col("verdict"))
        rows = rows.withColumn("verdict", verdict).withColumn("detail", F.coalesce("note", explain.detail())).withColumn("evidence_url", explain.evidence_url())
        return rows.drop("note").withColumn("checked_at", F.current_timestamp())

    def _dois(self, rows: DataFrame) -> DataFrame:
        if self.first is None:
            return self._nothing(rows, F.lit("unverifiable"), note=_DISABLED)
        record = lambda a: a.select("doi", "status", F.struct("title", "authors", "year").alias("title_key"))
        claim = rows.withColumn("claimed_key", F.lit(None).cast("struct<title:string,authors:array<string>,year:int>"))
        found = verify.two_stage(claim, record(self.first), record(self.first if self.second is None else self.second), self.second is not None and self.use_fallback)
        hit = F.coalesce(F.when(F.col("s1") == "hit", F.col("t1")), F.when(F.col("s2") == "hit", F.col("t2")))
        return self._assessed(found.select(*_COLUMNS, hit["title"].alias("resolved_title"), hit["authors"].alias("resolved_authors"), hit["year"].alias("resolved_year"), "verdict", "authority"))

    def _arxiv(self, rows: DataFrame) -> DataFrame:
        if self.arxiv is None:
            return self._nothing(rows, F.lit("unverifiable"), note=_DISABLED)
        known = self.arxiv.select("arxiv_id", "status", *[F.col(n.removeprefix("resolved_")).alias(n) for n in _FOUND])
        found = rows.withColumn("arxiv_id", verify.versionless("identifier")).join(known, "arxiv_id", "left")
        verdict = F.when(F.col("status") == "hit", "verified").when(F.col("status") == "unreachable", "unreachable").otherwise("not_found")
        return self._assessed(found.select(*_COLUMNS, *_FOUND, verdict.alias("verdict"), F.lit("arxiv").alias("authority")))

    def _urls(self, rows: DataFrame) -> DataFrame:
        if self.urls is None or not self.check_urls:
            return self._nothing(rows, F.lit("unverifiable"), note=_DISABLED)
        found = rows.join(self.urls.select(F.col("url").alias("identifier"), "status"), "identifier", "left")
        return self._nothing(found, verify.url_verdict("status"), "http")

    def _search(self, rows: DataFrame) -> DataFrame:
        if self.works is None or not self.search_unidentified:
            return self._nothing(rows, F.lit("unverifiable"), note=_DISABLED)
        # What many documents cite in the same words is searched once.
        rows = rows.withColumn("claim_id", F.xxhash64("claimed_title", "claimed_authors"))
        long_enough = F.length("claimed_title") >= verify.MIN_TITLE
        asked, hit = rows.where(long_enough), F.col("work_id").isNotNull()
        found = self._hits(asked, self.works).withColumn("authority", F.lit("crossref"))
        if self.more_works is not None and self.use_fallback:
            rest = asked.join(found.where(hit).select("claim_id").distinct(), "claim_id", "left_anti")
            found = found.where(hit).unionByName(self._hits(rest, self.more_works).withColumn("authority", F.when(hit, "openalex").otherwise("crossref+openalex")))
        closest = F.when(~hit & F.col("closest").isNotNull(), F.format_string("no record matches this description. The closest is '%s' at %s%% similarity, too little for a match", "closest", F.format_string("%.0f", "best_similarity")))
        done = found.select(*_COLUMNS, *_FOUND, F.when(hit, "verified").otherwise("not_found").alias("verdict"), "authority", closest.alias("note"))
        short = rows.where(~F.coalesce(long_enough, F.lit(False)))
        return self._assessed(done).unionByName(self._nothing(short, F.lit("unverifiable"), note="no identifier, and no title that is specific enough to search; look it up by hand"))

    def _hits(self, rows: DataFrame, works: DataFrame) -> DataFrame:
        """rows with the first plausible of their candidates among works, or nulls; closest and best_similarity of all candidates."""
        claims = rows.select("claim_id", "claimed_title", "claimed_authors").dropDuplicates(["claim_id"])
        best = verify.search(claims, works).select("claim_id", F.col("accepted").alias("work_id"), F.col("closest").alias("near"), "best_similarity")
        near = works.select(F.col("work_id").alias("near"), F.col("title").alias("closest"))
        record = works.select("work_id", *[F.col(n.removeprefix("resolved_")).alias(n) for n in _FOUND])
        return rows.join(best.join(near, "near", "left").join(record, "work_id", "left"), "claim_id", "left")

    def quotations(self, docs: DataFrame) -> DataFrame:
        """Quotations with the citation each relies on and its verdict; without sources none can be checked."""
        found = quotes.attribute(quotes.quotes(docs), extract.extract(docs))
        sources = self.sources if self.sources is not None else docs.sparkSession.createDataFrame([], "identifier string, coverage string, source_text string")
        return quotes.judge(found, sources)
