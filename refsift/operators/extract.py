"""Citations from document text.

Lines stay arrays within their document until citations are exploded, so
numbering, the bibliography latch and duplicates within a line need no shuffle.
Only the document-wide removal of duplicates does, by document and key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.titles import strip, title_of

#: What ends a line (fixed values, those of Unicode text files).
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
# The patterns of identifiers, headings and numbered entries.
DOI = r"(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[-._;()/:A-Za-z0-9<>\[\]+]+)"
ARXIV = r"(?i)arXiv:\s*(?:(\d{4}\.\d{4,5}(?:v\d+)?)|([a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?))"
URL = r"(?i)https?://[^\s<>\"'\)\]]+"
HEADING = r"(?i)^\s*(?:#+\s*)?(?:\d+\.?\s*)?(references|bibliography|works cited|sources|citations|footnotes|endnotes)\s*:?\s*$"
NUMBERED = r"^\s*(?:\[(\d{1,3})\]|\((\d{1,3})\)|(\d{1,3})\.)\s+(.{20,})$"
_TAIL = r"[.,;:)\]}>\"']+$"


def strip_trailing(text) -> Column:
    """Drop closing punctuation; a bracket that closes one inside stays, and with it what stands before.

    Most tails have no bracket, and one pattern drops them; of the others, characters go one at a time.
    """
    def drop(x: Column) -> Column:
        tail = F.regexp_extract(x, _TAIL, 0)
        count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
        balanced = lambda s, a, b: F.endswith(s, F.lit(b)) & (count(s, a) >= count(s, b))
        ends = lambda s: balanced(s, "(", ")") | balanced(s, "[", "]") | ~s.rlike(_TAIL)
        slow = F.aggregate(F.split(tail, ""), x, lambda s, _: F.when(ends(s), s).otherwise(s.substr(F.lit(1), F.length(s) - 1)))
        return F.when(tail == "", x).when(tail.rlike(r"[)\]]"), slow).otherwise(x.substr(F.lit(1), F.length(x) - F.length(tail)))

    return c.let(c.col(text), drop)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text (stripped) and in_bibliography of every line that is neither blank nor a bibliography heading.

    After a heading all lines belong to the bibliography. A null text has no lines.
    """
    of = lambda x: c.let(strip(x), lambda t: F.struct(t.alias("text"), t.rlike(HEADING).alias("heads")))
    parts = docs.select("doc_id", F.transform(F.split("text", LINE_END), of).alias("parts"))
    heading = F.array_position(F.col("parts.heads"), True)
    rows = parts.select("doc_id", heading.alias("heading"), F.posexplode("parts").alias("pos", "part"))
    rows = rows.where((F.col("part.text") != "") & ~F.col("part.heads"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line"), "part.text", ((F.col("heading") > 0) & (F.col("pos") >= F.col("heading"))).alias("in_bibliography"))


def entries(rows: DataFrame) -> DataFrame:
    """Add ref_number, body and is_entry to lines(). The pattern of numbered entries is matched once a line."""
    number = r"^[\[(]?(\d{1,3})[\]).]\s+"
    head = F.when(F.col("text").rlike(NUMBERED), F.regexp_extract("text", number, 0)).otherwise(F.lit(""))
    rows = c.once(rows, head=head)
    numbered = F.col("head") != ""
    return rows.select(
        "doc_id", "line", "text", "in_bibliography", F.when(numbered, F.regexp_extract("head", r"\d+", 0).cast("int")).alias("ref_number"),
        F.when(numbered, F.col("text").substr(F.length("head") + 1, F.length("text"))).otherwise(F.col("text")).alias("body"),
        (numbered | (F.col("in_bibliography") & (F.length("text") > 40))).alias("is_entry"),
    )


def identifiers(text) -> Column:
    """Array of kind, identifier and raw in a span: DOIs, then arXiv ids, then URLs, each identifier once.

    arxiv.org/abs links without an arXiv: prefix count neither as arXiv ids nor as URLs.
    """
    item = lambda kind, ident, raw: F.struct(F.lit(kind).alias("kind"), ident.alias("identifier"), F.trim(raw).alias("raw"))
    none = F.array().cast("array<struct<kind:string,identifier:string,raw:string>>")

    def every(t: Column, kind: str, sign: Column, pattern: str, ident, keep) -> Column:
        """What a pattern finds, where a sign of it is there at all."""
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: item(kind, ident(x), x))
        return F.when(sign, F.filter(found, lambda x: keep(x["identifier"]))).otherwise(none)

    def search(t: Column) -> Column:
        lower = F.lower(t)
        dois = every(t, "doi", F.contains(t, F.lit("10.")), DOI, lambda x: F.lower(strip_trailing(F.regexp_extract(x, DOI, 1))), lambda i: F.length(i) >= 8)
        arxiv = every(t, "arxiv", F.contains(lower, F.lit("arxiv")), ARXIV, lambda x: strip_trailing(F.concat(F.regexp_extract(x, ARXIV, 1), F.regexp_extract(x, ARXIV, 2))), lambda i: i != "")
        links = F.transform(F.regexp_extract_all(t, F.lit(URL), F.lit(0)), lambda x: c.let(strip_trailing(x), lambda u: item("url", u, u)))
        links = F.filter(links, lambda x: ~F.lower(x["identifier"]).rlike(r"doi\.org/|arxiv\.org/abs"))
        return F.concat(dois, arxiv, F.when(F.contains(lower, F.lit("http")), links).otherwise(none))

    names = lambda a: F.transform(a, lambda x: x["identifier"])
    once = lambda a: F.when(F.size(a) < 2, a).otherwise(F.filter(a, lambda x, i: F.array_position(names(a), x["identifier"]) == i + 1))
    return c.let(F.coalesce(c.let(c.col(text), search), none), once)


def extract(docs: DataFrame) -> DataFrame:
    """The citations of each document (doc_id, text), in the CITATION schema, each key of a document once."""
    entry = F.col("is_entry")
    # A claim is made of entries only.
    claim = F.struct(title_of("body").alias("claimed_title"), c.authors_in("body").alias("claimed_authors"), c.year_in("body").alias("claimed_year"), F.col("ref_number").alias("number"))
    nothing = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("claimed_title", "string"), ("claimed_authors", "array<string>"), ("claimed_year", "int"), ("number", "int"))])
    rows = c.once(entries(lines(docs)), ids=identifiers("body"), claim=F.when(entry, claim).otherwise(nothing))
    rows = rows.select("doc_id", "line", "ids", "body", "claim.claimed_title", F.coalesce("claim.claimed_authors", F.array().cast("array<string>")).alias("claimed_authors"), "claim.claimed_year", F.col("claim.number").alias("ref_number"))
    described = F.col("claimed_title").isNotNull() & ((F.size("claimed_authors") > 0) | F.col("claimed_year").isNotNull())
    alone = F.array(F.struct(F.lit("bibliographic").alias("kind"), F.lit(None).cast("string").alias("identifier"), F.substring("body", 1, 300).alias("raw")))
    found = rows.select("*", F.posexplode(F.when(F.size("ids") > 0, F.col("ids")).when(described, alone)).alias("pos", "id"))
    return first_by_key(found.select(
        "doc_id", "id.raw", "id.kind", "line", "pos", "id.identifier", "claimed_title", "claimed_authors", "claimed_year", F.substring(F.trim("body"), 1, 400).alias("context"), "ref_number"
    ))


def first_by_key(citations: DataFrame) -> DataFrame:
    """The first citation of each key in a document, by line and place, then by what is written, so that reruns agree."""
    key = c.cite_key("kind", "identifier", "raw", "claimed_title")
    first = Window.partitionBy("doc_id", "cite_key").orderBy("line", "pos", *[n for n in ("raw", "context") if n in citations.columns])
    return citations.withColumn("cite_key", key).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "cite_key")
