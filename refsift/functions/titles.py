"""Titles of references, as column expressions.

A reference offers spans that may be its title: the one in quotation marks
alone, if there is one, else the sentence after the year, then all sentences.
Of each span a few features are counted by regular expressions (words, letters,
initials, names), the guards are conditions on these counts, and the first span
that passes is the title. Everything runs in the JVM, once a reference.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, let

# What marks a title, a year, and what isn't a title; word lists and thresholds of the guards.
QUOTED = r'[""«"]([^""»"]{12,300})[""»"]|"([^"]{12,300})"'
YEAR = r"\((?:\d{4}[a-z]?)\)|(?<![\d(,:\-])\b(?:19\d{2}|20\d{2})\b(?![\d)\-])"
SENTENCE_AFTER_YEAR = r"(?U)(?<=[a-z0-9])\.\s+(?=[A-Z])"
SENTENCE = r"(?U)(?<=[a-z0-9)])\.\s+"
DEBRIS = r"(?iU)arxiv\s*:|doi\s*:|\b10\.\d{4,9}/|https?://|^\s*[\d\W]"
LOCATOR = r"(?iU)\bpp?\.\s*\d|\bpages?\s+\d|\b\d+\s*-{2,}\s*\d|^\s*(?:volume|vol\.|issue|no\.|in:|proceedings\b)|\blecture notes in\b|\bproceedings\s*,"
FUNCTION_WORDS = (
    "a an the of in on for and or to with from by at as is are be using via into all you we it its how why what when not "
    "no can do does toward towards under over"
)
LENGTHS, LETTER_WORDS, LETTERS = (8, 300), 0.6, 0.55
INITIALS, NAMES = 0.20, 0.7

#: What counts as white space at the ends of a span (that of Unicode).
BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
_WORD = r"(?U)\S+"
_CAPITALISED = r"(?:[\p{Lu}\-]\S*(?:\s+|$))"


def strip(text) -> Column:
    return F.btrim(col(text), F.lit(BLANK))


def count(text, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


def is_author_list(text) -> Column:
    """Whether a span names authors: many initials, or a list of which most parts are capitalised names, or names up to a last "and"."""
    def listed(parts: Column) -> Column:
        names = lambda least: F.size(F.filter(parts, lambda p: p.rlike(rf"(?U)^\s*{_CAPITALISED}{{{least},4}}$")))
        return (F.size(parts) > 2) & (names(1) / F.size(parts) >= NAMES) | (F.size(parts) == 2) & (names(2) == 2)

    def passes(t: Column, words: Column, initials: Column) -> Column:
        abbreviated = (initials >= 2) & ((initials / words > INITIALS) | t.rlike(rf"(?sU)^.+ and \s*{_CAPITALISED}{{1,3}}$"))
        parts = F.filter(F.split(t, r"(?U),\s*and\s|\sand\s|,\s*"), lambda p: p.rlike(_WORD))
        # Only a comma or an "and" makes a list.
        return (words > 1) & (abbreviated | t.rlike(r"(?U),|\sand\s") & let(parts, listed))

    counted = lambda t: F.struct(count(t, _WORD).alias("words"), count(t, r"(?U)\b[A-Z]\.").alias("initials"))
    return F.coalesce(let(strip(text), lambda t: let(counted(t), lambda n: passes(t, n["words"], n["initials"]))), F.lit(False))


def is_personal_name(text) -> Column:
    """Whether a span is one name: up to four capitalised words, one of them of three characters, none a function word."""
    text = col(text)
    words = count(text, _WORD)
    function_word = r"(?iU)(?<!\S)[.,;:]*(?:" + FUNCTION_WORDS.replace(" ", "|") + r")[.,;:]*(?!\S)"
    long = r"(?U)(?<!\S)[.,;:]*[^\s.,;:]\S+[^\s.,;:][.,;:]*(?!\S)"
    return F.coalesce(words.between(1, 4) & (count(text, r"(?U)(?<!\S)\p{Lu}") == words) & ~text.rlike(function_word) & text.rlike(long), F.lit(False))


def is_title(text, quoted: Column | bool = False) -> Column:
    """Whether a span can be a title; one in quotation marks need only not be debris. quoted may be a column."""
    quoted = F.lit(quoted) if isinstance(quoted, bool) else quoted

    def passes(t: Column, words: Column) -> Column:
        size = F.length(t)
        prose = (count(t, r"(?U)\S*\p{L}\S*\p{L}\S*") / words >= LETTER_WORDS) & (count(t, r"\p{L}") / size >= LETTERS)
        clean = size.between(*LENGTHS) & (words > 1) & (quoted | prose) & ~t.rlike(DEBRIS) & ~t.rlike(LOCATOR)
        return F.coalesce(clean & (quoted | ~is_author_list(t)), F.lit(False))

    return let(strip(text), lambda t: let(count(t, _WORD), lambda words: passes(t, words)))


def _closed(span: Column) -> Column:
    """A span without white space and full stops at its end."""
    return F.regexp_replace(strip(span), r"\.+$", "")


def title_of(text) -> Column:
    """The title of a reference, or null: in quotation marks, else after the year, else the first sentence that can be one.

    A quoted span that can't be a title ends the search. A name in front is no title.
    """
    def valid(span: Column) -> Column:
        return let(_closed(span), lambda x: F.when(is_title(x), x))

    def search(t: Column) -> Column:
        rest = F.regexp_replace(F.get(F.split(t, YEAR, 2), F.lit(1)), r"^[ .),]+", "")
        sentences = F.transform(F.split(t, SENTENCE), _closed)
        spans = F.filter(sentences, lambda x, i: is_title(x) & ~((i == 0) & is_personal_name(x)))
        # What comes later is looked at only where nothing was found before.
        return F.coalesce(valid(F.get(F.split(rest, SENTENCE_AFTER_YEAR, 2), F.lit(0))), F.get(spans, F.lit(0)))

    def title(t: Column) -> Column:
        quoted = strip(F.coalesce(F.nullif(F.regexp_extract(t, QUOTED, 1), F.lit("")), F.regexp_extract(t, QUOTED, 2)))
        return let(quoted, lambda q: F.when(q == "", search(t)).when(is_title(q, True), q))

    return F.when(col(text).isNotNull(), let(col(text), title))

