"""Names and types of the engine's tables.

The one rule that every query keeps: a check that could not be completed is
inconclusive, never a failure. Scores divide by conclusive checks only and are
null without any.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAILURES = ("not_found", "mismatch", "malformed")
INCONCLUSIVE = ("unreachable", "unverifiable")
VERDICTS = ("verified", *FAILURES, *INCONCLUSIVE)
KINDS = ("doi", "arxiv", "url", "bibliographic")
#: Outcome of looking a key up in an authority; never inferred from nulls.
HIT, MISS, UNREACHABLE, DISABLED = "hit", "miss", "unreachable", "disabled"
COVERAGE = ("full", "abstract", "excerpt", "none")

CITATION = (
    "doc_id long, raw string, kind string, line int, pos int, identifier string, claimed_title string, "
    "claimed_authors array<string>, claimed_year int, context string, ref_number int"
)


def is_failure(verdict: Column | str = "verdict") -> Column:
    return (F.col(verdict) if isinstance(verdict, str) else verdict).isin(*FAILURES)


def is_inconclusive(verdict: Column | str = "verdict") -> Column:
    return (F.col(verdict) if isinstance(verdict, str) else verdict).isin(*INCONCLUSIVE)
