"""Summaries, studies and the SQL mart over verdicts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import verify
from ..schema import VERDICTS
from .registry import CITES, OBSERVATIONS, WORKS, both, query, sql, with_

_VERDICT = """
    CASE WHEN c.identifier IS NULL THEN 'unverifiable' WHEN NOT {match} THEN 'malformed'
         WHEN w.crossref = 'unreachable' THEN 'unreachable'
         WHEN w.crossref = 'hit' OR w.openalex = 'hit' THEN CASE WHEN c.claimed_key = w.work_id THEN 'verified' ELSE 'mismatch' END
         WHEN w.openalex = 'unreachable' THEN 'unreachable' ELSE 'not_found' END"""
_SYNTAX = "regexp_matches(c.identifier, '^10\\.\\d{4,9}/\\S+$')"
_DUCK_FOUND = ("found", f"SELECT c.*, {_VERDICT.replace('{match}', _SYNTAX)} AS verdict FROM cites c LEFT JOIN works w ON c.identifier = w.doi")
_COUNTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in VERDICTS)


def citations(spark, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, with_(CITES) + "SELECT * FROM cites")


def authority(spark, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, with_(WORKS) + f"SELECT doi, {name} AS status, work_id AS title_key FROM works")


def findings(spark, sf_dir: str) -> DataFrame:
    return verify.two_stage(citations(spark, sf_dir), authority(spark, sf_dir, "crossref"), authority(spark, sf_dir, "openalex"))


def summary(found: DataFrame, *by: str) -> DataFrame:
    """Counts by verdict, checks concluded, and score and coverage with the bounds that incomplete checks leave."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    out = found.groupBy(*by).agg(F.count("*").alias("total"), *[count(v) for v in VERDICTS])
    conclusive = F.col("verified") + F.col("not_found") + F.col("mismatch") + F.col("malformed")
    out = out.withColumn("conclusive", conclusive)
    open_ = F.col("total") - F.col("conclusive")
    return out.select(
        "*", c.share("conclusive", "total").alias("check_coverage"), c.share("verified", "conclusive").alias("integrity_score"),
        c.share("verified", "total").alias("pass_low"), c.share(F.col("verified") + open_, "total").alias("pass_high"),
    )


_SUMMARY = """
    SELECT *, cast(conclusive AS double) / total AS check_coverage, cast(verified AS double) / nullif(conclusive, 0) AS integrity_score,
           cast(verified AS double) / total AS pass_low, cast(verified + total - conclusive AS double) / total AS pass_high
    FROM (SELECT *, verified + not_found + mismatch + malformed AS conclusive FROM (SELECT {by}, count(*) AS total, """ + _COUNTS + """ FROM {of} GROUP BY {by}) x) y"""


@query("q01_report_summary", with_(WORKS, CITES, _DUCK_FOUND) + _SUMMARY.replace("{by}", "doc_id").replace("{of}", "found"))
def q01(spark, sf_dir):
    return summary(findings(spark, sf_dir), "doc_id")


both("q02_verdict_share", with_(OBSERVATIONS) + """
    SELECT category, verdict, count(*) AS checks, count(DISTINCT paper) AS papers,
           cast(count(*) AS double) / sum(count(*)) OVER (PARTITION BY category) AS share_within_category
    FROM observations GROUP BY category, verdict""")
both("q03_paper_verified", with_(OBSERVATIONS) + "SELECT paper, count(*) AS checks, cast(sum(CASE WHEN verdict = 'verified' THEN 1 ELSE 0 END) AS bigint) AS verified FROM observations GROUP BY paper ORDER BY checks DESC, paper")


@query("q04_score_bounds", with_(OBSERVATIONS) + _SUMMARY.replace("{by}", "category").replace("{of}", "observations"))
def q04(spark, sf_dir):
    return summary(sql(spark, sf_dir, with_(OBSERVATIONS) + "SELECT * FROM observations"), "category")


_SINGLE = "CASE WHEN c.identifier IS NULL THEN 'unverifiable' WHEN NOT " + _SYNTAX + " THEN 'malformed' WHEN w.crossref = 'unreachable' THEN 'unreachable' WHEN w.crossref = 'hit' THEN CASE WHEN c.claimed_key = w.work_id THEN 'verified' ELSE 'mismatch' END ELSE 'unverifiable' END"


@query("q05_doi_join_verdict", with_(WORKS, CITES) + f"SELECT {_SINGLE} AS verdict, count(*) AS n FROM cites c LEFT JOIN works w ON c.identifier = w.doi GROUP BY 1")
def q05(spark, sf_dir):
    """One authority alone: what it lacks stays unverifiable while the second is disabled."""
    first = authority(spark, sf_dir, "crossref")
    return verify.two_stage(citations(spark, sf_dir), first, first, use_second=False).groupBy("verdict").agg(F.count("*").alias("n"))


_AUTHORITY = f"CASE WHEN c.identifier IS NULL OR NOT {_SYNTAX} THEN 'crossref' WHEN w.crossref = 'unreachable' THEN '-' WHEN w.crossref = 'hit' THEN 'crossref' WHEN w.openalex = 'hit' THEN 'openalex' ELSE 'crossref+openalex' END"


@query("q06_fallback_two_stage", with_(WORKS, CITES) + f"SELECT {_VERDICT.replace('{match}', _SYNTAX)} AS verdict, {_AUTHORITY} AS authority, count(*) AS n FROM cites c LEFT JOIN works w ON c.identifier = w.doi GROUP BY 1, 2")
def q06(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("verdict", "authority").agg(F.count("*").alias("n"))


_ARXIV = "SELECT cast(1000 + p.p_partkey % 9000 AS string) || '.' || lpad(cast(p.p_partkey % 100000 AS string), 5, '0') AS arxiv_id FROM part p WHERE p.p_partkey % 5 <> 0"
_ASKED = "SELECT l.l_orderkey AS doc_id, l.l_linenumber AS line, cast(1000 + l.l_partkey % 9000 AS string) || '.' || lpad(cast(l.l_partkey % 100000 AS string), 5, '0') || CASE WHEN l.l_linenumber % 2 = 0 THEN 'v' || cast(l.l_linenumber AS string) ELSE '' END AS asked FROM lineitem l"


@query("q07_arxiv_version_strip", f"WITH w AS ({_ARXIV}), a AS ({_ASKED}) SELECT a.doc_id, a.line, a.asked, CASE WHEN w.arxiv_id IS NULL THEN 'not_found' ELSE 'verified' END AS verdict FROM a LEFT JOIN w ON regexp_replace(a.asked, 'v\\d+$', '') = w.arxiv_id")
def q07(spark, sf_dir):
    works, asked = sql(spark, sf_dir, _ARXIV), sql(spark, sf_dir, _ASKED)
    joined = asked.withColumn("arxiv_id", verify.versionless("asked")).join(works.withColumn("known", F.lit(True)), "arxiv_id", "left")
    return joined.select("doc_id", "line", "asked", F.when(F.col("known"), "verified").otherwise("not_found").alias("verdict"))


_STATUS = "CASE WHEN p.page_id % 11 = 0 THEN 'unreachable' WHEN p.page_id % 7 = 0 THEN 'miss' ELSE 'hit' END"


@query("q08_url_status", f"SELECT regexp_extract(p.url, '^https?://([^/]+)', 1) AS host, CASE {_STATUS} WHEN 'hit' THEN 'verified' WHEN 'miss' THEN 'not_found' ELSE 'unreachable' END AS verdict, count(*) AS n FROM pages p GROUP BY 1, 2")
def q08(spark, sf_dir):
    pages = sql(spark, sf_dir, "SELECT p.page_id, p.url FROM pages p")
    # A page's status is that of its own visit: pages of one URL may differ.
    status = sql(spark, sf_dir, f"SELECT DISTINCT p.page_id AS visit, p.url AS visited, {_STATUS} AS status FROM pages p")
    same = F.col("page_id").eqNullSafe(F.col("visit")) & F.col("url").eqNullSafe(F.col("visited"))
    rows = pages.join(status, same, "left").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), verify.url_verdict("status").alias("verdict"))
    return rows.groupBy("host", "verdict").agg(F.count("*").alias("n"))


def _wilson_sql(s: str, n: str, z: float = c.Z) -> tuple[str, str]:
    p, n = f"(cast({s} AS double) / nullif({n}, 0))", f"cast(nullif({n}, 0) AS double)"
    centre, scale = f"({p} + {z * z} / (2 * {n}))", f"(1 + {z * z} / {n})"
    margin = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n}))"
    return f"CASE WHEN {n} IS NOT NULL THEN greatest(0.0, ({centre} - {margin}) / {scale}) END", f"CASE WHEN {n} IS NOT NULL THEN least(1.0, ({centre} + {margin}) / {scale}) END"


_RATES = ("rates", """SELECT category, sum(CASE WHEN verdict IN ('not_found', 'mismatch', 'malformed') THEN 1 ELSE 0 END) AS failed,
    sum(CASE WHEN verdict IN ('unreachable', 'unverifiable') THEN 0 ELSE 1 END) AS conclusive FROM observations GROUP BY category""")
_LOW, _HIGH = _wilson_sql("failed", "conclusive")
_WILSON = f"SELECT category, cast(failed AS bigint) AS failed, cast(conclusive AS bigint) AS conclusive, cast(failed AS double) / nullif(conclusive, 0) AS rate, {_LOW} AS rate_lo, {_HIGH} AS rate_hi FROM rates"


def _rates(spark, sf_dir) -> DataFrame:
    rates = sql(spark, sf_dir, with_(OBSERVATIONS, _RATES) + "SELECT * FROM rates")
    low, high = c.wilson("failed", "conclusive")
    return rates.select("category", "failed", "conclusive", c.share("failed", "conclusive").alias("rate"), low.alias("rate_lo"), high.alias("rate_hi"))


@query("q32_wilson", with_(OBSERVATIONS, _RATES) + _WILSON)
def q32(spark, sf_dir):
    return _rates(spark, sf_dir)


@query("q33_power_guard", with_(OBSERVATIONS, _RATES, ("w", _WILSON)) + "SELECT category, rate, CASE WHEN conclusive < 30 THEN 'too few checks' WHEN rate_lo IS NULL THEN 'no interval' WHEN rate_hi - rate_lo > 0.15 THEN 'interval too wide' END AS usability_reason FROM w")
def q33(spark, sf_dir):
    return _rates(spark, sf_dir).select("category", "rate", c.usability("conclusive", "rate_lo", "rate_hi").alias("usability_reason"))


both("q34_study_blocks", with_(OBSERVATIONS) + """
    SELECT category, paper, cast(grouping(category) AS int) AS all_categories, cast(grouping(paper) AS int) AS all_papers, count(*) AS checks,
           cast(sum(CASE WHEN verdict IN ('not_found', 'mismatch', 'malformed') THEN 1 ELSE 0 END) AS bigint) AS failed,
           cast(sum(CASE WHEN verdict IN ('not_found', 'malformed') THEN 1 ELSE 0 END) AS bigint) AS false_positive,
           cast(sum(CASE WHEN verdict IN ('unreachable', 'unverifiable') THEN 0 ELSE 1 END) AS bigint) AS conclusive
    FROM observations GROUP BY GROUPING SETS ((), (category), (paper))""")
both("q38_stratified_sample", """
    SELECT orderkey, year FROM (
        SELECT o.o_orderkey AS orderkey, cast(year(o.o_orderdate) AS int) AS year,
               row_number() OVER (PARTITION BY year(o.o_orderdate) ORDER BY md5(cast(o.o_orderkey AS string) || ':42')) AS k FROM orders o) x
    WHERE k <= 12""")
both("q39_accumulate_anti", """
    WITH old AS (SELECT DISTINCT l.l_partkey AS paper FROM lineitem l WHERE l.l_shipdate < {day}),
         new AS (SELECT DISTINCT l.l_partkey AS paper FROM lineitem l WHERE l.l_shipdate >= {day})
    SELECT paper, 'carried' AS origin FROM old UNION ALL
    SELECT n.paper, 'new' AS origin FROM new n LEFT JOIN old o ON n.paper = o.paper WHERE o.paper IS NULL""", day="timestamp_ntz '1993-01-01 00:00:00'||timestamp '1993-01-01 00:00:00'")
both("q52_cache_key", "SELECT p.page_id, substring({sha}, 1, 24) AS cache_key FROM pages p", sha="sha2(p.url, 256)||sha256(p.url)")
both("q53_fallback_rescues", with_(WORKS, CITES) + """
    SELECT count(*) AS checks, cast(sum(CASE WHEN w.crossref = 'miss' AND w.openalex = 'hit' AND c.claimed_key = w.work_id THEN 1 ELSE 0 END) AS bigint) AS rescues
    FROM cites c JOIN works w ON c.identifier = w.doi""")
both("q54_coverage_cases", """
    WITH cases AS (SELECT * FROM (VALUES ('outage', 'unreachable'), ('outage', 'unreachable'), ('disabled', 'unverifiable'), ('completed', 'not_found'),
        ('mixed', 'verified'), ('mixed', 'unreachable'), ('mixed', 'unverifiable'), ('empty', NULL)) AS v(name, verdict))
    SELECT name, count(verdict) AS total, cast(sum(CASE WHEN verdict = 'verified' THEN 1 ELSE 0 END) AS bigint) AS verified,
           cast(sum(CASE WHEN verdict IN ('verified', 'not_found', 'mismatch', 'malformed') THEN 1 ELSE 0 END) AS bigint) AS conclusive,
           cast(sum(CASE WHEN verdict = 'verified' THEN 1 ELSE 0 END) AS double) / nullif(sum(CASE WHEN verdict IN ('verified', 'not_found', 'mismatch', 'malformed') THEN 1 ELSE 0 END), 0) AS integrity_score
    FROM cases GROUP BY name""")
