"""refsift FILE...: check the references of documents against snapshots of authorities.

Exit code 0: no failure; 1: failures, or a score below --fail-under; 2: a document or an option that can't be used.
"""
from __future__ import annotations

import argparse
import logging
import os
import shlex
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .operators import extract
from .sinks import report
from .sources import authorities, documents
from .verifier import Verifier

SNAPSHOTS = {"first": "DOIs", "second": "DOIs, asked about what the first lacks", "arxiv": "arXiv records", "urls": "links", "works": "works to search", "more-works": "works to search next", "sources": "source texts of quotations"}
SUMMARY = "GITHUB_STEP_SUMMARY"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="refsift", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("files", nargs="+", metavar="FILE", help="documents to check: " + " ".join((*documents.PLAIN, *documents.HTML, ".pdf", ".docx")))
    p.add_argument("--format", choices=("terminal", "json", "markdown", "html"), default="terminal")
    p.add_argument("-o", "--output", help="write the report to this file")
    p.add_argument("--findings", metavar="DIR", help="write all findings as Parquet, from the executors; for many documents")
    p.add_argument("--show-verified", action="store_true")
    p.add_argument("--no-urls", action="store_true", help="leave links unchecked")
    p.add_argument("--no-search", action="store_true", help="leave references without an identifier unchecked")
    p.add_argument("--check-quotes", action="store_true", help="look quotations up in source texts")
    p.add_argument("--strict", action="store_true", help="checks that were not concluded fail too")
    p.add_argument("--fail-under", type=float, metavar="PERCENT")
    for name, what in SNAPSHOTS.items():
        p.add_argument(f"--{name}", metavar="SNAPSHOT", help=f"Parquet snapshot of {what}; without it these checks are disabled")
    p.add_argument("--fetch", action="store_true", help="ask the authorities for the DOIs, preprints and links that no snapshot was given for")
    p.add_argument("--cache-dir", default=".refsift-cache", help="answers that were fetched before (an empty string: none)")
    p.add_argument("--no-cache", action="store_true", help="neither read nor keep fetched answers")
    p.add_argument("--mailto", default=os.environ.get("REFSIFT_MAILTO"), help="contact address for the authorities that ask for one")
    p.add_argument("--workers", type=int, default=4, help="tasks that fetch at the same time, each from hosts of its own")
    p.add_argument("--timeout", type=int, default=authorities.TIMEOUT, help="seconds that a request may take")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--version", action="version", version=f"refsift {__version__}")
    return p


def fetched(spark: SparkSession, citations: DataFrame, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Snapshots of what the citations name, from the cache or the authorities; only for checks without a snapshot."""
    get = authorities.Getter(a.timeout, a.mailto)
    cache = None if a.no_cache or not a.cache_dir else a.cache_dir
    return authorities.snapshots(spark, citations, cache, get, a.workers, urls=not a.no_urls)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.ERROR if a.quiet else logging.WARNING, format="%(levelname)s %(name)s: %(message)s")
    fail = lambda what: print(f"refsift: {what}", file=sys.stderr) or 2
    spark = SparkSession.builder.appName("refsift").getOrCreate()
    try:
        every = documents.read_all(spark, [path for f in a.files for path in documents.expand(spark, shlex.quote(f))])
        given = {n.replace("-", "_"): getattr(a, n.replace("-", "_")) for n in SNAPSHOTS}
        tables = {n: spark.read.parquet(path) for n, path in given.items() if path}
    except (documents.UnsupportedDocument, FileNotFoundError) as e:
        return fail(e)
    except AnalysisException as e:
        return fail(str(e).split("\n")[0])
    if a.fetch:
        tables = fetched(spark, extract.extract(every), a) | tables
    verifier = Verifier(**tables, check_urls=not a.no_urls, search_unidentified=not a.no_search)
    found = verifier.findings(every)
    if a.findings:
        found.write.mode("overwrite").partitionBy("verdict").parquet(a.findings)
        found = spark.read.schema(found.schema).parquet(a.findings)
    # A report is for reading: its rows come to the driver, one at a time.
    rows = [r.asDict() for r in found.orderBy("doc_id", "line", "raw").toLocalIterator()]
    quoted = [r.asDict() for r in verifier.quotations(every).toLocalIterator()] if a.check_quotes else []
    name = a.files[0] if len(a.files) == 1 else f"{len(a.files)} documents"
    text = {
        "terminal": lambda: report.terminal(rows, a.show_verified, quotes=quoted), "json": lambda: report.as_json(name, rows, quoted),
        "markdown": lambda: report.markdown(name, rows, quoted), "html": lambda: report.as_html(name, rows, quoted),
    }[a.format]()
    if a.output:
        os.makedirs(os.path.dirname(a.output) or ".", exist_ok=True)
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
        if not a.quiet:
            print(f"wrote {a.output}")
    else:
        print(text, end="")
    if summary := os.environ.get(SUMMARY):
        with open(summary, "a", encoding="utf-8") as f:
            f.write(report.markdown(name, rows, quoted) + "\n")
    open_ = sum(r["verdict"] == "unreachable" for r in rows)
    if open_ and not a.quiet:
        print(f"refsift: {open_} checks could not be completed; they count as inconclusive, not as failures", file=sys.stderr)
    return report.exit_code(rows, a.strict, a.fail_under, quoted)


if __name__ == "__main__":
    sys.exit(main())
