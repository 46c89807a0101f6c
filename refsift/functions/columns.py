"""Native column expressions: statistics, decisions and text clean-up."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The normal quantile and the thresholds of decisions.
Z = 1.959963984540054
MISMATCH, STRONG, YEAR_TOLERANCE = 66.0, 85.0, 2
SURE, LEAST_PLAUSIBLE = 90.0, 75.0
QUOTE_MATCH = 88.0
MIN_CHECKS, MAX_WIDTH = 30, 0.15


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, which later steps refer to: plain columns would be copied into each expression that uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))))


def share(part, whole) -> Column:
    """part / whole as a double, null where whole is 0."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def wilson(successes, n, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    p, n = share(successes, n), F.nullif(col(n).cast("double"), F.lit(0.0))
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    known = n.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), centre - margin)), F.when(known, F.least(F.lit(1.0), centre + margin))


def newcombe(ts, tn, cs, cn, z: float = Z) -> tuple[Column, Column, Column]:
    """Difference of two shares and the bounds that follow from their Wilson intervals."""
    t, c = share(ts, tn), share(cs, cn)
    (tl, tu), (cl, cu) = wilson(ts, tn, z), wilson(cs, cn, z)
    gap = lambda a, b: F.sqrt(a * a + b * b)
    return t - c, F.greatest(F.lit(-1.0), t - c - gap(t - tl, cu - c)), F.least(F.lit(1.0), t - c + gap(tu - t, c - cl))


def usability(n, low, high) -> Column:
    """Why a rate should not be relied on; null if it may be."""
    n, low, high = col(n), col(low), col(high)
    return (
        F.when(n < MIN_CHECKS, F.lit("too few checks"))
        .when(low.isNull() | high.isNull(), F.lit("no interval"))
        .when(high - low > MAX_WIDTH, F.lit("interval too wide"))
    )


def assess(similarity, overlap) -> Column:
    """mismatch only on evidence of a different work: a low title similarity that agreeing authors don't explain."""
    sim, overlap = col(similarity), col(overlap)
    low = (sim < MISMATCH) & ~F.coalesce(overlap >= 0.75, F.lit(False))
    return F.when(F.coalesce(low, F.lit(False)), "mismatch").otherwise("verified")


def plausible(similarity, overlap) -> Column:
    sim = F.coalesce(col(similarity), F.lit(0.0))
    return (sim >= SURE) | ((sim >= LEAST_PLAUSIBLE) & F.coalesce(col(overlap) >= 0.5, F.lit(False)))


def years_agree(claimed, resolved) -> Column:
    return F.abs(col(claimed) - col(resolved)) <= YEAR_TOLERANCE


def quote_verdict(has_source_id, coverage, similarity) -> Column:
    """Only a full text can refute a quotation; absence from less of it says so."""
    coverage = col(coverage)
    return (
        F.when(~col(has_source_id), "not_attributed").when(coverage == "none", "source_unavailable")
        .when(col(similarity) >= QUOTE_MATCH, "found").when(coverage == "full", "not_found")
        .otherwise(F.concat(F.lit("absent_from_"), coverage))
    )


def author_overlap(claimed, resolved) -> Column:
    """Share of claimed names (normalised) that a resolved one equals, holds as a word or is held by; null if either is empty."""
    c, r = (F.array_distinct(F.filter(col(x), lambda n: n != "")) for x in (claimed, resolved))
    same = lambda a, b: (a == b) | F.array_contains(F.split(b, " "), a) | F.array_contains(F.split(a, " "), b)
    hits = F.size(F.filter(c, lambda a: F.exists(r, lambda b: same(a, b))))
    return F.when((F.size(c) > 0) & (F.size(r) > 0), hits / F.size(c))


def plain(text) -> Column:
    """normalise_title for text without accents: lower case, punctuation as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"(?U)[^\w\s]", " "), r"\s+", " "))


def squeeze(text) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def html_text(html) -> Column:
    """Text of a page: scripts and styles dropped, block ends as line feeds, other tags as spaces; entities stay."""
    # Elements without text, and those that end a line.
    out = F.regexp_replace(col(html), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</div>|</li>", "\n")
    return F.regexp_replace(out, r"<[^>]+>", " ")


def markup_text(text) -> Column:
    return squeeze(F.regexp_replace(col(text), r"<[^>]+>", " "))


def latex_entry(text) -> Column:
    """A LaTeX bibliography entry as a reader sees it."""
    out = col(text)
    # The commands whose argument is text.
    for _ in range(3):
        out = F.regexp_replace(out, r"\\(?:emph|textit|textbf|texttt|mbox|text|href\{[^}]*\}|url|doi|newblock)\s*\{([^{}]*)\}", "$1")
    for pattern, by in ((r"\\%", "%"), (r"\\&", "&"), (r"``|''", '"'), ("~", " "), (r"\\[a-zA-Z@]+\s*", " "), (r"[{}]", "")):
        out = F.regexp_replace(out, pattern, by)
    return squeeze(out)


def latex_text(text) -> Column:
    """The prose of a LaTeX source, without comments and environments that hold none."""
    # Environments without prose, and commands whose argument is prose.
    out = F.regexp_replace(col(text), r"(?m)(?<!\\)%.*$", " ")
    out = F.regexp_replace(out, r"(?s)\\begin\{(equation|align|figure|table|tabular|thebibliography|lstlisting|verbatim)\*?\}.*?\\end\{\1\*?\}", " ")
    for _ in range(3):
        out = F.regexp_replace(out, r"\\(?:emph|textit|textbf|texttt|text|section|subsection|subsubsection|title|caption|footnote)\*?\s*\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\[a-zA-Z@]+\*?\s*(\[[^\]]*\])?", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[{}]", " "), "``|''", '"'), "~", " "))


def wiki_text(text) -> Column:
    """Wikitext with links as their labels and without markup."""
    # The markup that goes.
    return squeeze(F.regexp_replace(links_resolved(text), r"'''|''|<[^>]+>", ""))


def links_resolved(text) -> Column:
    return F.regexp_replace(col(text), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")


def from_inverted(index) -> Column:
    """The text of a map of words to positions."""
    placed = F.transform(F.map_entries(col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    return F.array_join(F.transform(F.sort_array(F.flatten(placed)), lambda x: x["w"]), " ")


def year_in(text) -> Column:
    """The publication year of a reference: the first candidate from 1900 to 2100, else from 1600."""
    pattern = r"\((\d{4})[a-z]?\)|(?<![\d(,:\-])\b(19\d{2}|20\d{2})\b(?![\d)\-])"
    years = F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), lambda x: F.regexp_extract(x, r"(\d{4})", 1).cast("int"))
    first = lambda low: F.get(F.filter(years, lambda y: y.between(low, 2100)), F.lit(0))
    return F.coalesce(first(1900), first(1600))


def authors_in(text) -> Column:
    """Surnames of a reference, each once whatever its case, in order."""
    stem = r"([A-Z][a-zA-Z'\-]{1,24})"
    found = F.regexp_extract_all(col(text), F.lit(rf"\b{stem}\s*,\s*(?:[A-Z]\.\s*){{1,4}}|\b{stem}\s+(?:et\s+al\.?)"), F.lit(0))
    names = F.transform(found, lambda x: F.regexp_extract(x, f"^{stem}", 1))
    names = F.filter(names, lambda x: ~F.lower(x).isin("the", "and", "in", "on", "of", "for"))
    lower = F.transform(names, F.lower)
    return F.filter(names, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def cache_key(url) -> Column:
    return F.substring(F.sha2(col(url), 256), 1, 24)


def cite_key(kind, identifier, raw, title) -> Column:
    """What makes two citations of a document one."""
    return F.concat(col(kind), F.lit(":"), F.lower(F.coalesce(col(identifier), col(raw))), F.lit("|"), F.substring(F.lower(F.coalesce(col(title), F.lit(""))), 1, 120))


def evidence_url(authority, key) -> Column:
    base = {"crossref": "https://doi.org/", "openalex": "https://openalex.org/", "arxiv": "https://arxiv.org/abs/"}
    out = F.lit(None).cast("string")
    for name, prefix in base.items():
        out = F.when(col(authority) == name, F.concat(F.lit(prefix), col(key))).otherwise(out)
    return out
