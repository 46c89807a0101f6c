"""Studies over many documents: what is sampled, checked and summed up."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import corpora, extract
from ..schema import is_failure, is_inconclusive
from ..sources import samples
from .evidence import _wilson_sql, findings
from .registry import CITES, WORKS, both, query, sql, with_

PER_PAPER = 12


def block(checks: DataFrame, *by: str, failed=None) -> DataFrame:
    """Checks, failures among the conclusive ones with their interval, and whether the rate may be used; by sets of columns at once.

    failed is what counts as one; studies differ in whether a mismatch does.
    """
    failed = is_failure() if failed is None else failed
    sets = checks.groupingSets([[], *[[b] for b in by]], *by) if by else checks.groupBy()
    out = sets.agg(F.count("*").alias("checks"), F.count_if(failed).alias("failed"), F.count_if(~is_inconclusive()).alias("conclusive"), F.count_if(F.col("verdict") == "verified").alias("verified"))
    low, high = c.wilson("failed", "conclusive")
    out = out.withColumns({"rate": c.share("failed", "conclusive"), "rate_lo": low, "rate_hi": high})
    return out.withColumn("usability_reason", c.usability("conclusive", "rate_lo", "rate_hi"))


def false_positive():
    """Failures of the base-rate study: a real paper that is reported missing. A mismatch isn't one."""
    return F.col("verdict").isin("not_found", "malformed")


def entries_of_sources(sources: DataFrame) -> DataFrame:
    """Citations of the first PER_PAPER entries of each LaTeX bibliography (doc_id, text), each entry read as a document of its own."""
    entries = corpora.bibitems(sources).where(F.col("pos") <= PER_PAPER)
    docs = entries.select(F.struct("doc_id", "pos").alias("doc_id"), F.concat(F.lit("References\n\n[1] "), "entry").alias("text"))
    found = extract.extract(docs)
    return found.select("doc_id.*", *[x for x in found.columns if x not in ("doc_id", "pos")])


def usable_references(works: DataFrame, per_work: int = 5, seed: int = 42) -> DataFrame:
    """References (of works: doi, refs) with a DOI and a title of 15 characters, per_work of them by hash: doi, ref_doi, title, author (surname), year."""
    good = F.filter("refs", lambda r: r["doi"].isNotNull() & (F.length(r["title"]) >= 15))
    picked = F.slice(F.sort_array(F.transform(good, lambda r: F.struct(F.xxhash64(r["doi"], F.lit(seed)).alias("h"), r.alias("r")))), 1, per_work)
    rows = works.select(F.col("doi").alias("source"), F.explode(picked).alias("x"))
    year = F.regexp_extract("x.r.year", r"^(\d{4})", 1).try_cast("int")
    return rows.select("source", F.lower("x.r.doi").alias("ref_doi"), F.col("x.r.title").alias("title"), F.element_at(F.split(F.trim("x.r.author"), r"\s+"), -1).alias("author"), F.when(year.between(1500, 2100), year).alias("year"))


def markdown(title: str, rows: list[dict]) -> str:
    """A study's blocks as a table; a rate that may not be used is shown with the reason."""
    shown = lambda x: "" if x is None else f"{x:.2%}" if isinstance(x, float) else str(x)
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(shown(r[n]) for n in names) + " |" for r in rows)]) + "\n"


_MATCH = "regexp_matches(c.identifier, '^10\\.\\d{4,9}/\\S+$')"
_FOUND = ("found", f"""SELECT c.line % 2 AS mode, year(c.shipped) AS source_year, CASE WHEN c.identifier IS NULL THEN 'unverifiable' WHEN NOT {_MATCH} THEN 'malformed' WHEN w.crossref = 'unreachable' THEN 'unreachable'
    WHEN w.crossref = 'hit' OR w.openalex = 'hit' THEN CASE WHEN c.claimed_key = w.work_id THEN 'verified' ELSE 'mismatch' END WHEN w.openalex = 'unreachable' THEN 'unreachable' ELSE 'not_found' END AS verdict FROM cites c LEFT JOIN works w ON c.identifier = w.doi""")
_SUMS = ("sums", """SELECT mode, source_year, count(*) AS checks, sum(CASE WHEN verdict IN ('not_found', 'malformed') THEN 1 ELSE 0 END) AS failed,
    sum(CASE WHEN verdict IN ('unreachable', 'unverifiable') THEN 0 ELSE 1 END) AS conclusive, sum(CASE WHEN verdict = 'verified' THEN 1 ELSE 0 END) AS verified FROM found GROUP BY GROUPING SETS ((), (mode), (source_year))""")
_LO, _HI = _wilson_sql("failed", "conclusive")


@query("q59_baserate_blocks", with_(WORKS, CITES, _FOUND, _SUMS, ("r", f"SELECT *, cast(failed AS double) / nullif(conclusive, 0) AS rate, {_LO} AS rate_lo, {_HI} AS rate_hi FROM sums")) + """
    SELECT cast(mode AS int) AS mode, cast(source_year AS int) AS source_year, checks, cast(failed AS bigint) AS failed, cast(conclusive AS bigint) AS conclusive, cast(verified AS bigint) AS verified, rate, rate_lo, rate_hi,
           CASE WHEN conclusive < 30 THEN 'too few checks' WHEN rate_lo IS NULL THEN 'no interval' WHEN rate_hi - rate_lo > 0.15 THEN 'interval too wide' END AS usability_reason FROM r""")
def q59(spark, sf_dir):
    checks = findings(spark, sf_dir).select((F.col("line") % 2).alias("mode"), F.year("shipped").alias("source_year"), "verdict")
    return block(checks, "mode", "source_year", failed=false_positive())


# A synthetic trial: cohorts by week, arms in turn, and draws that depend on the one before, from hashes.
_SEGMENTS = "(VALUES ('rich', 0.9, 0.64, 0.18, 0.88, 0.004, 0.004, 0.55, 0.35), ('partial', 0.82, 0.52, -0.1, 0.8, 0.01, 0.064, 0.43, 0.25)) AS s(segment, p_start, p_act, delta, p_apply, i_control, i_treat, r7, r28)"
_UNITS = """SELECT concat(cast(k.week AS string), '-', s.segment, '-', cast(u.n AS string)) AS unit_id, cast(k.week * 7 AS int) AS cohort_day, s.segment, CASE WHEN u.n % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, s.*
    FROM ({weeks}) k CROSS JOIN ({units}) u CROSS JOIN """ + _SEGMENTS
_DRAW = "{u1}substring(md5(concat(unit_id, '{stage}')), 1, 8){u2} / 4294967296.0"


def _draw(stage: str) -> str:
    return _DRAW.replace("{stage}", stage)


_JOURNEY = ("j", _UNITS.replace("s.*", "s.p_start, s.p_act, s.delta, s.p_apply, s.i_control, s.i_treat, s.r7, s.r28")), ("a", f"SELECT *, CASE WHEN {_draw('start')} < p_start THEN 1 ELSE 0 END AS started FROM j"), (
    "b", f"SELECT *, started * CASE WHEN {_draw('complete')} < p_act + CASE WHEN arm = 'treatment' THEN delta ELSE 0 END THEN 1 ELSE 0 END AS completed FROM a"), (
    "c", f"SELECT *, completed * CASE WHEN {_draw('apply')} < p_apply THEN 1 ELSE 0 END AS activated, completed * CASE WHEN {_draw('incident')} < CASE WHEN arm = 'treatment' THEN i_treat ELSE i_control END THEN 1 ELSE 0 END AS incident FROM b")
both("q60_synthetic_journeys", with_(*_JOURNEY) + f"""
    SELECT unit_id, cohort_day, segment, arm, cast(started AS int) AS started, cast(completed AS int) AS completed, cast(activated AS int) AS activated, cast(incident AS int) AS incident,
           CASE WHEN cohort_day + 7 <= 56 THEN cast(activated * CASE WHEN {_draw('day7')} < r7 THEN 1 ELSE 0 END AS int) END AS retained7,
           CASE WHEN cohort_day + 28 <= 56 THEN cast(activated * CASE WHEN {_draw('day28')} < r28 THEN 1 ELSE 0 END AS int) END AS retained28 FROM c""",
     weeks="SELECT id AS week FROM range(8)||SELECT range AS week FROM range(8)", units="SELECT id AS n FROM range(160)||SELECT range AS n FROM range(160)", u1="cast(conv(||cast(cast(concat('0x', ", u2=", 16, 10) AS double)||) AS bigint) AS double)")

_REFS = """SELECT o.o_orderkey AS doi, o.o_orderkey % 4 AS n FROM orders o"""


@query("q61_usable_references", f"WITH w AS ({_REFS}) SELECT cast(doi AS string) AS source, '10.1/a' || cast(doi AS string) AS ref_doi, 'Smith' AS author, CASE WHEN n = 1 THEN NULL ELSE 2001 END AS year FROM w WHERE n > 0")
def q61(spark, sf_dir):
    """Of a work's references those with a DOI and a title that is long enough."""
    ref = lambda doi, title: F.struct(doi.alias("doi"), F.lit(title).alias("title"), F.lit("J. K. Smith").alias("author"), F.when(F.col("n") == 1, "n.d.").otherwise("2001-02").alias("year"))
    good = ref(F.when(F.col("n") > 0, F.concat(F.lit("10.1/A"), F.col("doi"))), "A title that is long enough")
    works = sql(spark, sf_dir, _REFS).withColumn("refs", F.array(good, ref(F.lit("10.1/b"), "Short"), ref(F.lit(None).cast("string"), "Another title of some length")))
    return usable_references(works.withColumn("doi", F.col("doi").cast("string"))).select("source", "ref_doi", "author", "year")


# Works without a DOI, of all years, some without authors; the draws are by hash, in both engines.
_RECORDS = ("records", """SELECT CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE '10.1/w' || cast(p.p_partkey AS string) END AS doi, p.p_name || ' ' || p.p_type AS title, 1990 + p.p_size % 30 AS year, p.p_partkey % 3 AS k FROM part p""")
_BY_HASH = "ORDER BY md5('42:' || {key}), {key}"


@query("q64_sample_works", with_(_RECORDS) + f"SELECT doi, cast(year AS int) AS year FROM records WHERE doi IS NOT NULL AND year BETWEEN 1995 AND 2005 {_BY_HASH.format(key='doi')} LIMIT 50")
def q64(spark, sf_dir):
    return samples.works(sql(spark, sf_dir, with_(_RECORDS) + "SELECT doi, cast(year AS int) AS year FROM records"), 50, (1995, 2005))


@query("q65_calibration_sample", with_(_RECORDS, ("r", f"""SELECT doi, title, cast(year AS int) AS year, row_number() OVER (PARTITION BY CASE WHEN year < 2000 THEN 0 WHEN year < 2010 THEN 1 ELSE 2 END {_BY_HASH.format(key='doi')}) AS nth
    FROM records WHERE doi IS NOT NULL AND length(title) >= 20 AND k > 0""")) + "SELECT doi, title, year FROM r WHERE nth <= 20")
def q65(spark, sf_dir):
    rows = sql(spark, sf_dir, with_(_RECORDS) + "SELECT doi, title, cast(year AS int) AS year, CASE WHEN k > 0 THEN array('A') ELSE array() END AS authors FROM records")
    return samples.calibration_works(rows, 60, [(1990, 1999), (2000, 2009), (2010, 2019)]).select("doi", "title", "year")


_DATED = ("dated", "SELECT cast(o.o_orderkey AS string) AS arxiv_id, o.o_orderpriority AS category, substring(cast(o.o_orderdate AS string), 1, 10) AS published FROM orders o")


@query("q66_newest_preprints", with_(_DATED, ("once", "SELECT * FROM dated QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY category, published) = 1")) + """
    SELECT arxiv_id, category, published FROM once QUALIFY row_number() OVER (PARTITION BY category ORDER BY published DESC, arxiv_id) <= 5""")
def q66(spark, sf_dir):
    return samples.newest_preprints(sql(spark, sf_dir, with_(_DATED) + "SELECT * FROM dated"), 5)


@query("q67_sample_articles", f"SELECT cast(d.doc_id AS string) AS title, strlen(d.text) AS bytes FROM documents d WHERE strlen(d.text) >= 8000 {_BY_HASH.format(key='cast(d.doc_id AS string)')} LIMIT 40")
def q67(spark, sf_dir):
    return samples.articles(sql(spark, sf_dir, "SELECT cast(d.doc_id AS string) AS title, d.text FROM documents d"), 40).select("title", F.octet_length("text").cast("long").alias("bytes"))


@query("q68_preprints_of_index", f"""WITH i AS (SELECT cast(p.p_partkey AS string) AS arxiv_id FROM part p WHERE p.p_partkey % 2 = 0) SELECT arxiv_id FROM i {_BY_HASH.format(key='arxiv_id')} LIMIT 30""")
def q68(spark, sf_dir):
    rows = sql(spark, sf_dir, "SELECT CASE WHEN p.p_partkey % 2 = 0 THEN '10.48550/arXiv.' ELSE '10.1/' END || cast(p.p_partkey AS string) AS doi FROM part p")
    return samples.preprints_of_index(rows, 30)


@query("q69_source_works", f"""WITH w AS (SELECT '10.1/' || cast(o.o_orderkey AS string) AS doi, o.o_orderkey % 5 AS year, o.o_orderkey % 4 AS n FROM orders o),
    u AS (SELECT DISTINCT doi, year FROM w WHERE n > 0) SELECT doi, cast(year AS int) AS year FROM u QUALIFY row_number() OVER (PARTITION BY year {_BY_HASH.format(key='doi')}) <= 3""")
def q69(spark, sf_dir):
    """Of works those with a usable reference, three a year."""
    ref = F.struct(F.when(F.col("n") > 0, F.lit("10.1/r")).alias("doi"), F.lit("A title that is long enough").alias("title"))
    rows = sql(spark, sf_dir, "SELECT '10.1/' || cast(o.o_orderkey AS string) AS doi, cast(o.o_orderkey % 5 AS int) AS year, o.o_orderkey % 4 AS n FROM orders o")
    return samples.source_works(rows.select("doi", "year", F.array(ref).alias("refs")), 3).select("doi", "year")


both("q62_quote_summary", """
    WITH q AS (SELECT d.source AS document, CASE WHEN d.doc_id % 7 = 0 THEN 'found' WHEN d.doc_id % 7 = 1 THEN 'not_found' WHEN d.doc_id % 7 < 4 THEN 'absent_from_abstract' ELSE 'source_unavailable' END AS verdict FROM documents d)
    SELECT document, count(*) AS total, cast(sum(CASE WHEN verdict = 'found' THEN 1 ELSE 0 END) AS bigint) AS found, cast(sum(CASE WHEN verdict = 'not_found' THEN 1 ELSE 0 END) AS bigint) AS not_found,
           cast(sum(CASE WHEN verdict IN ('found', 'not_found') THEN 1 ELSE 0 END) AS double) / count(*) AS coverage_rate FROM q GROUP BY document""")


@query("q63_verifier")
def q63(spark, sf_dir):
    """All kinds of citations of the made-up documents through one verifier."""
    from ..verifier import Verifier
    from .references import docs

    works = sql(spark, sf_dir, with_(WORKS) + "SELECT work_id, doi, title, crossref, openalex, year FROM works")
    authority = lambda name: works.select(F.lower("doi").alias("doi"), F.col(name).alias("status"), "title", F.array(F.lit("Smith")).alias("authors"), "year")
    titles = sql(spark, sf_dir, "SELECT p.p_partkey AS work_id, 'A study of ' || p.p_name || ' and its kin' AS title, array('Jones') AS authors, 2000 AS year FROM part p WHERE p.p_partkey % 5 = 0")
    found = Verifier(first=authority("crossref"), second=authority("openalex"), works=titles, common=200).findings(docs(spark, sf_dir))
    return found.groupBy("kind", "verdict", "authority").agg(F.count("*").alias("n"))
