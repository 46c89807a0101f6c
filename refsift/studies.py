"""Studies from snapshot tables: sample, check, sum up, write; python -m refsift.studies NAME --out DIR --TABLE PATH...

baserate: how often real references of published works are reported missing, with and without their identifier.
preprints: how often references that authors wrote can't be verified, by form and field.
wikipedia: the same for articles, by template, those of scholarly kinds apart.

Checks are written as CSV, guarded against the loss of a better earlier result, and the report (report.md, summary.json)
is made from what was written. The report is a few lines, whatever the size of the study.
"""
from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpora
from .plans import studies
from .sinks import guards
from .sources import samples, tables
from .verifier import Verifier

NOTES = {
    "baserate": "The references exist, so a failure here is the checker's own. A mismatch isn't counted: the record was found.",
    "preprints": "A failure means that no index has the reference as it is written; authors cite what indexes lack, so this is not a rate of invented references.",
    "wikipedia": "Sources outside scholarly indexes (web, news, books, reports) fail for want of coverage; only the scholarly rate says something of integrity.",
}
GROUPS = {"baserate": ("mode", "source_year"), "preprints": ("kind", "category"), "wikipedia": ("template", "scholarly")}
_CITATION = ("doc_id", "line", "pos", "raw", "kind", "identifier", "ref_number", "claimed_title", "claimed_authors", "claimed_year", "context")


def _cited(rows: DataFrame, doc_id, kind: Column, identifier, title, author, year, *more: str) -> DataFrame:
    """Rows as citations, and further columns by the citation's number."""
    rows = rows.withColumn("line", F.lit(1)).withColumn("pos", F.lit(0))
    shown = F.concat_ws(". ", F.col(author), F.col(title), F.col(year).cast("string"))
    names = F.when(F.col(author).isNotNull(), F.array(author)).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.col(doc_id).alias("doc_id"), "line", "pos", shown.alias("raw"), kind.alias("kind"), F.when(kind != "bibliographic", F.col(identifier)).alias("identifier"), F.lit(None).cast("int").alias("ref_number"),
        F.col(title).alias("claimed_title"), names.alias("claimed_authors"), F.col(year).cast("int").alias("claimed_year"), shown.alias("context"), *more,
    )


def _checked(verifier: Verifier, cited: DataFrame, *more: str) -> DataFrame:
    """Findings with the further columns of their citations, which they share doc_id with."""
    key = F.struct("doc_id", *more)
    found = verifier.check(cited.withColumn("doc_id", key).select(*_CITATION))
    return found.select("doc_id.*", *[x for x in found.columns if x != "doc_id"])


def baserate(verifier: Verifier, works: DataFrame, per_year: int = 12, per_work: int = 5, seed: int = 42) -> DataFrame:
    """Findings of references drawn from works (doi, title, year, refs): each by its DOI (mode identifier), and by its description (mode withheld)."""
    drawn = samples.source_works(works, per_year, seed)
    refs = studies.usable_references(drawn, per_work, seed).join(drawn.select(F.col("doi").alias("source"), F.col("year").alias("source_year")), "source")
    mode = F.explode(F.array(F.lit("identifier"), F.lit("withheld"))).alias("mode")
    refs = refs.select("*", mode)
    kind = F.when(F.col("mode") == "identifier", "doi").otherwise("bibliographic")
    return _checked(verifier, _cited(refs, "ref_doi", kind, "ref_doi", "title", "author", "year", "mode", "source_year"), "mode", "source_year")


def preprints(verifier: Verifier, sources: DataFrame, known: DataFrame | None = None, max_checks: int | None = None) -> DataFrame:
    """Findings of the bibliographies of preprints (doc_id, category, text); papers in known are passed over, and of the rest the first max_checks by paper stay."""
    if known is not None:
        sources = sources.join(known.select(F.col("arxiv_id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    cited = studies.entries_of_sources(sources.select("doc_id", "text")).join(sources.select("doc_id", "category"), "doc_id").withColumn("pos", F.lit(0))
    if max_checks is not None:
        cited = cited.orderBy(*samples.order("doc_id", 42), "ref_number", "raw").limit(max_checks)
    return _checked(verifier, cited, "category")


def wikipedia(verifier: Verifier, pages: DataFrame, articles: int = 40, per_article: int = 8, seed: int = 42) -> DataFrame:
    """Findings of the citation templates of articles drawn from pages (title, text)."""
    drawn = samples.articles(pages, articles, seed).select(F.col("title").alias("doc_id"), "text")
    refs = samples.top(corpora.wiki_references(drawn), per_article, *samples.order("title", seed), per=["doc_id"])
    kind = F.when(F.col("doi").isNotNull(), "doi").when(F.col("arxiv").isNotNull(), "arxiv").otherwise("bibliographic")
    refs = refs.withColumn("identifier", F.coalesce("doi", "arxiv"))
    return _checked(verifier, _cited(refs, "doc_id", kind, "identifier", "title", "author", "year", "template", "scholarly"), "template", "scholarly")


def summary(name: str, checks: DataFrame) -> dict:
    """The study's blocks: of all checks, and by each of its groups."""
    failed = studies.false_positive() if name == "baserate" else None
    rows = [r.asDict() for r in studies.block(checks, *GROUPS[name], failed=failed).collect()]
    by = lambda g: sorted((r for r in rows if r[g] is not None), key=lambda r: str(r[g]))
    return {"study": name, "all": [r for r in rows if all(r[g] is None for g in GROUPS[name])], **{f"by_{g}": by(g) for g in GROUPS[name]}}


def render(name: str, found: dict) -> str:
    """A study as Markdown; a rate that may not be relied on is shown with the reason."""
    drop = lambda rows, keep: [{k: v for k, v in r.items() if k not in GROUPS[name] or k == keep} for r in rows]
    parts = [studies.markdown(f"Study: {name}", drop(found["all"], None)), NOTES[name] + "\n"]
    parts += [studies.markdown(f"By {g}", drop(found[f"by_{g}"], g)).replace("# ", "## ", 1) for g in GROUPS[name]]
    return "\n".join(parts)


def write(name: str, checks: DataFrame, out: str, allow_smaller: bool = False) -> dict:
    """Write the checks below out, then the report made from them; returns the summary."""
    guards.write(checks, f"{out}/checks", allow_smaller)
    spark = checks.sparkSession
    stored = spark.read.csv(f"{out}/checks", header=True, multiLine=True, escape='"')
    found = summary(name, stored)
    for file, text in (("report.md", render(name, found)), ("summary.json", json.dumps(found, indent=2, default=str))):
        guards.put(spark, f"{out}/{file}", text)
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="refsift.studies", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("study", choices=sorted(GROUPS))
    p.add_argument("--input", required=True, help="Parquet table that is sampled: works, preprints' sources or pages")
    p.add_argument("--out", required=True)
    p.add_argument("--known", help="earlier checks (CSV) of preprints, which are not checked again")
    p.add_argument("--allow-smaller", action="store_true")
    for n in ("first", "second", "arxiv", "works", "more-works"):
        p.add_argument(f"--{n}", help="Parquet snapshot, as for refsift")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("refsift-studies").getOrCreate()
    given = {n: getattr(a, n) for n in ("first", "second", "arxiv", "works", "more_works")}
    verifier = Verifier(**{n: spark.read.parquet(path) for n, path in given.items() if path})
    table = spark.read.parquet(a.input)
    checks = {"baserate": lambda: baserate(verifier, table), "wikipedia": lambda: wikipedia(verifier, table),
              "preprints": lambda: preprints(verifier, table, tables.checks(spark, a.known) if a.known else None)}[a.study]()
    try:
        write(a.study, checks, a.out, a.allow_smaller)
    except (guards.EmptyStudy, guards.DegradedStudy) as e:
        print(f"refsift: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
