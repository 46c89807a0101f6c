"""Reference corpora: LaTeX bibliographies, BibTeX and wiki citation templates."""
from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

# The markup of bibliography items and citation templates.
BIBITEM = r"\\bibitem(?:\[[^\]]*\])?\{[^}]*\}"
TEMPLATE = r"(?s)\{\{\s*[Cc]ite\s+(journal|book|report|web|news|conference|thesis|arxiv)\s*\|([^{}]{0,2000}?)\}\}"
PARAMETER = r"\|\s*([A-Za-z0-9_\-]+)\s*=\s*([^|]*)"
#: Templates whose sources a scholarly index can be expected to hold.
SCHOLARLY = ("journal", "arxiv", "conference", "thesis")
MIN_TITLE = 15


def bibitems(sources: DataFrame) -> DataFrame:
    """doc_id, pos and entry (30 to 1200 characters, as plain text) of each item of LaTeX bibliographies (doc_id, text)."""
    parts = F.slice(F.split("text", BIBITEM), 2, 1 << 30)
    rows = sources.select("doc_id", F.posexplode(parts).alias("pos", "raw"))
    entry = c.latex_entry(F.regexp_replace("raw", r"(?s)\\end\{thebibliography\}.*", ""))
    return rows.select("doc_id", (F.col("pos") + 1).alias("pos"), entry.alias("entry")).where(F.length("entry").between(30, 1200))


def bibtex(sources: DataFrame) -> DataFrame:
    """doc_id, pos, title, author (the first's), year, doi, journal and entry (a reference string) of BibTeX entries with a title of MIN_TITLE characters."""
    body = F.transform(F.slice(F.split("text", r"@[A-Za-z]+\s*\{"), 2, 1 << 30), lambda x: x)
    rows = sources.select("doc_id", F.posexplode(body).alias("pos", "raw"))
    field = lambda name: F.nullif(c.latex_entry(F.regexp_extract("raw", rf'(?is)\b{name}\s*=\s*[{{"](.*?)[}}"]\s*(?:,|\n|\}}|$)', 1)), F.lit(""))
    out = rows.select("doc_id", (F.col("pos") + 1).alias("pos"), field("title").alias("title"), F.split(field("author"), r"\s+and\s+")[0].alias("author"), field("year").alias("year"), field("doi").alias("doi"), field("journal").alias("journal"))
    quoted = lambda left, name, right="": F.concat(F.lit(left), name, F.lit(right))
    entry = F.concat_ws(" ", "author", quoted("(", "year", ")"), quoted('"', "title", '"'), "journal", quoted("doi:", "doi"))
    return out.where(F.length("title") >= MIN_TITLE).withColumn("entry", entry)


def wiki_references(pages: DataFrame) -> DataFrame:
    """Citation templates of pages (doc_id, text): template, title, doi, arxiv, author (surname), year, scholarly.

    Links become their labels before parameters are split, since both use bars.
    A later parameter replaces an earlier one of the same name.
    """
    found = pages.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TEMPLATE), F.lit(0))).alias("pos", "raw"))
    body = F.concat(F.lit("|"), c.links_resolved(F.regexp_extract("raw", TEMPLATE, 2)))
    pairs = F.transform(F.regexp_extract_all(body, F.lit(PARAMETER), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, PARAMETER, 1)).alias("k"), c.wiki_text(F.regexp_extract(x, PARAMETER, 2)).alias("v")))
    rows = found.select("doc_id", "pos", F.lower(F.regexp_extract("raw", TEMPLATE, 1)).alias("template"), pairs.alias("pairs"))
    value = lambda name: F.nullif(F.element_at(F.filter(F.concat(F.array(F.struct(F.lit(name).alias("k"), F.lit("").alias("v"))), "pairs"), lambda p: p["k"] == name), -1)["v"], F.lit(""))
    year = lambda name: F.nullif(F.regexp_extract(value(name), r"\b(1[5-9]\d{2}|20\d{2})\b", 1), F.lit("")).cast("int")
    author = F.trim(F.split(F.coalesce(*map(value, ("last", "last1", "author", "author1", "surname"))), ",")[0])
    out = rows.select(
        "doc_id", "pos", "template", F.coalesce(value("title"), value("chapter")).alias("title"), F.lower(value("doi")).alias("doi"),
        F.coalesce(value("arxiv"), value("eprint")).alias("arxiv"), F.element_at(F.split(author, r"\s+"), -1).alias("author"),
        F.coalesce(year("year"), year("date"), year("publication-date")).alias("year"), F.col("template").isin(*SCHOLARLY).alias("scholarly"),
    )
    return out.where(F.length("title") >= MIN_TITLE)


def _bibliography(raw: bytes) -> str | None:
    """The bibliography of a source archive: a .bbl file, else .bib, else a .tex file that has one; None for a bad archive."""
    try:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as tar:
            files = {m.name: tar.extractfile(m).read().decode("utf-8", "replace") for m in tar.getmembers() if m.isfile() and m.name.endswith((".bbl", ".bib", ".tex"))}
    except (tarfile.TarError, OSError, EOFError):
        try:
            files = {"main.tex": gzip.decompress(raw).decode("utf-8", "replace")}
        except (OSError, EOFError):
            return None
    for suffix in (".bbl", ".bib", ".tex"):
        text = "\n".join(files[n] for n in sorted(files) if n.endswith(suffix) and (suffix != ".tex" or "thebibliography" in files[n]))
        if text:
            return text
    return None


def archives(files: DataFrame) -> DataFrame:
    """path and text (the bibliography, or null) of source archives read by the binaryFile source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [_bibliography(bytes(x)) for x in frame["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
