"""Why a finding is what it is, and where to look: detail and evidence_url of findings, as columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as c

#: How a detail names the two titles of a mismatch (a fixed form: audits read it again).
TITLES = "Document claims '%s'; record holds '%s' (%s%% similarity)"
NOT_PROOF = "Indexes are incomplete, so this is no proof that the work never existed."


def _percent(x) -> Column:
    return F.format_string("%.0f", c.col(x))


def _names(x) -> Column:
    return F.array_join(F.slice(c.col(x), 1, 3), ", ")


def compared() -> Column:
    """What comparing a claim with the record found says (claimed_*, resolved_*, title_similarity, author_overlap)."""
    sim, overlap = F.col("title_similarity"), F.col("author_overlap")
    years = F.when(~c.years_agree("claimed_year", "resolved_year"), F.format_string("year %s vs %s in the record", F.col("claimed_year"), F.col("resolved_year")))
    strangers = F.when(overlap == 0, F.concat(F.lit("no claimed author is in the record ("), _names("claimed_authors"), F.lit(" against "), _names("resolved_authors"), F.lit(")")))
    shared = F.when(overlap.isNotNull(), F.concat(_percent(100 * overlap), F.lit("% of the claimed authors are in it")))
    titles = F.format_string(TITLES, F.col("claimed_title"), F.col("resolved_title"), _percent(sim))
    return (
        F.when(sim.isNull(), F.concat_ws("; ", F.lit("resolved, but the document gives no title to compare"), strangers, years))
        .when(sim >= c.STRONG, F.concat(F.lit("the title matches the record ("), _percent(sim), F.lit("% similarity)")))
        .when(F.col("verdict") == "mismatch", F.concat_ws("; ", F.concat(F.lit("identifier resolves to a different work. "), titles), years))
        .when(sim < c.MISMATCH, F.concat(F.lit("the titles differ ("), _percent(sim), F.lit("% similarity) but the authors agree, so it is likely one work under two titles")))
        .otherwise(F.concat_ws("; ", F.concat(F.lit("the title matches in part ("), _percent(sim), F.lit("%)")), shared, years))
    )


def detail() -> Column:
    """The detail of a finding that wasn't given one, by its kind, verdict and authority."""
    kind, verdict, authority = F.col("kind"), F.col("verdict"), F.col("authority")
    second = F.when(authority == "openalex", F.lit("not in Crossref, but OpenAlex has it: ")).otherwise(F.lit(""))
    open_ = F.when(authority == "crossref+openalex", "Crossref has no record, and OpenAlex could not be asked; nothing follows from that").when(
        authority == "crossref", "Crossref has no record, and the second index is disabled, so the check is not complete").otherwise("the check could not be completed")
    return (
        F.when(verdict.isin("verified", "mismatch") & (kind == "url"), "the link answers")
        .when(verdict.isin("verified", "mismatch") & (kind == "bibliographic"), F.concat(second, F.lit("found by its title ("), _percent("title_similarity"), F.lit("% similarity); the document gives no identifier")))
        .when(verdict.isin("verified", "mismatch"), F.concat(second, compared()))
        .when(verdict == "malformed", F.concat(F.lit("not a DOI by its form: "), F.col("identifier")))
        .when((verdict == "not_found") & (kind == "url"), "the link is dead, which does not say that what it held never existed")
        .when((verdict == "not_found") & (kind == "arxiv"), "arXiv has no preprint of this number")
        .when((verdict == "not_found") & (kind == "bibliographic"), F.lit("no record matches this description. " + NOT_PROOF))
        .when(verdict == "not_found", F.lit("no index that was asked has this DOI. " + NOT_PROOF))
        .otherwise(open_)
    )


def evidence_url() -> Column:
    """Where a reader can look the finding up: the record, else the place that was asked; null if nothing was."""
    kind, identifier = F.col("kind"), F.col("identifier")
    search = F.concat(F.lit("https://search.crossref.org/?q="), F.url_encode(F.substring("claimed_title", 1, 120)))
    return (
        F.when(F.col("verdict").isin("unverifiable", "malformed") | (F.col("authority") == "-"), F.lit(None).cast("string"))
        .when(kind == "url", identifier).when(kind == "arxiv", c.evidence_url(F.lit("arxiv"), identifier))
        .when(kind == "doi", c.evidence_url(F.lit("crossref"), identifier)).otherwise(search)
    )

