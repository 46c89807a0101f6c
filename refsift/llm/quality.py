"""Quality rules: a decision list learned from labelled statistics.

Measures of whole texts are plain column expressions. For learning, each
feature is cut at a few quantiles of the labelled rows, and the rows are counted
by cell, at most BINS ** len(FEATURES) cells whatever their number. Sequential
covering over these counts grows a conjunction of thresholds until it covers
good documents no more, prunes it on rows held back for that, and goes on with
the rows it leaves. The rules come out as one ordered conditional expression.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, cut, let, stored, whole

MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
FEATURES = ("symbol_rate", "mark_rate", "upper_rate", "dup_line_rate", "repeat_rate", "word_length")
#: Quantiles of good and bad labelled rows at which features are cut, and the number of bins that follows.
GOOD_CUTS, BAD_CUTS = (0.01, 0.99), (0.1, 0.25, 0.5, 0.75, 0.9)
BINS = len(GOOD_CUTS) + len(BAD_CUTS) + 1
#: A rule stays if so many of the labelled rows it covers are bad, when growing and when pruning.
PRECISION = 0.98
EDGE = 0.05
#: Labelled bad rows that a rule covers at least.
SUPPORT = 3
MAX_RULES, MAX_CONDITIONS = 12, 4


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words in WINDOW-word windows that are found twice or more.

    Windows are compared by 64-bit hash: sorted with their places, equal ones
    are neighbours, and the places of those cover a union of intervals.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return let(
            F.sort_array(F.transform(again, lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
            ),
        )

    return F.when(n >= WINDOW, let(F.sort_array(hashes), covered)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of what is counted in a whole text (null: empty)."""
    text = whole(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANK, "") != "")
    counts = let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r")))
    return let(F.struct(counts.alias("w"), lines.alias("l")), lambda m: F.struct(
        m["w"]["n"].cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(m["l"]) - F.size(F.array_distinct(m["l"]))).cast("long").alias("n_dup_lines"),
        m["w"]["r"].cast("long").alias("n_repeat_words"),
        F.size(m["l"]).cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    ))


def features(m: Column) -> list[Column]:
    words, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    return [
        (m["n_symbols"] / words).alias("symbol_rate"), (m["n_marks"] / words).alias("mark_rate"), (m["n_upper"] / chars).alias("upper_rate"),
        (m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1))).alias("dup_line_rate"), (m["n_repeat_words"] / words).alias("repeat_rate"),
        (m["word_chars"] / words).alias("word_length"),
    ]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def learn(measured: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """The decision list for a table of doc_id and m (measures) with labels (doc_id, quality).

    A document with several labels counts as bad if any says so; labels other
    than 0 and 1, and labels of no document, are left out. Without bad rows, or
    without labels, the list is empty.
    """
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.join(marks, "doc_id").where(~base_failed(F.col("m"))).select("doc_id", "quality", *features(F.col("m")))
    rows = cut(rows)
    quantiles = {
        r["quality"]: r for r in rows.groupBy("quality").agg(*[F.percentile_approx(f, list(BAD_CUTS + GOOD_CUTS), 10000).alias(f) for f in FEATURES]).collect()
    }
    if 0 not in quantiles or 1 not in quantiles:
        return []
    cuts = {f: sorted({*quantiles[1][f][len(BAD_CUTS) :], *quantiles[0][f][: len(BAD_CUTS)]}) for f in FEATURES}
    bins = [sum([(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)).alias(f) for f in FEATURES]
    back = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    cells = rows.select(*bins, back.alias("back"), "quality").groupBy(*FEATURES).agg(
        *[F.count_if((F.col("quality") == q) & (F.col("back") == b)).alias(f"c{q}{int(b)}") for q in (0, 1) for b in (False, True)]
    ).collect()
    at = np.array([[r[f] for f in FEATURES] for r in cells])
    bad, good = (np.array([[r[f"c{q}0"], r[f"c{q}1"]] for r in cells], float) for q in (0, 1))
    rules = _cover(at, bad, good, cuts)
    return _proven(rows.where(back), rules, _eased(rows, rules))


def _eased(rows: DataFrame, rules: list[list[Condition]]) -> list[list[Condition]]:
    """Move each threshold halfway to the bad rows that its rule covers, all but EDGE of them, away from the good ones."""
    if not rules:
        return rules
    edges = {r["rule"]: r for r in rows.where("quality = 0").withColumn("rule", verdict(rules)).where("rule is not null").groupBy("rule").agg(
        *[F.percentile_approx(f, [EDGE, 1 - EDGE], 10000).alias(f) for f in FEATURES]
    ).collect()}
    return [
        [Condition(c.feature, c.above, (c.value + edges[k][c.feature][not c.above]) / 2) if k in edges else c for c in rule]
        for k, rule in enumerate(rules, 1)
    ]


def _proven(held: DataFrame, rules: list[list[Condition]], moved: list[list[Condition]]) -> list[list[Condition]]:
    """The moved rules that are as sharp as asked for on the rows held back; of others the rule as it was."""
    if not rules:
        return rules
    counts = held.withColumn("rule", verdict(moved)).groupBy("rule").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good")).collect()
    blunt = {r["rule"] for r in counts if r["bad"] < PRECISION * (r["bad"] + r["good"])}
    return [rule if k in blunt else new for k, (rule, new) in enumerate(zip(rules, moved), 1)]


def _cover(at: np.ndarray, bad: np.ndarray, good: np.ndarray, cuts: dict) -> list[list[Condition]]:
    """Sequential covering over cells: bins, and counts of bad and good rows, for growing and held back."""
    tests = [(i, above, j, Condition(f, above, float(c))) for i, f in enumerate(FEATURES) for j, c in enumerate(cuts[f]) for above in (True, False)]
    hit = {t[3]: (at[:, t[0]] > t[2]) if t[1] else (at[:, t[0]] <= t[2]) for t in tests}
    left = np.ones(len(at), bool)
    rules: list[list[Condition]] = []

    def covered(rule: list[Condition]) -> np.ndarray:
        where = left.copy()
        for c in rule:
            where &= hit[c]
        return where

    def precision(where: np.ndarray, part: int) -> float:
        p, n = bad[where, part].sum(), good[where, part].sum()
        return p / (p + n) if p + n else 1.0

    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        where = left.copy()
        while len(rule) < MAX_CONDITIONS and good[where, 0].sum():
            p0, n0 = bad[where, 0].sum(), good[where, 0].sum()
            best = (0.0, None)
            for c in hit:
                now = where & hit[c]
                p, n = bad[now, 0].sum(), good[now, 0].sum()
                if p >= SUPPORT:
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, c)
            if best[1] is None:
                break
            rule.append(best[1])
            where &= hit[best[1]]
        if not rule:
            break
        # Prune: the shortest beginning of the rule that is as sharp on the rows held back.
        choices = [(precision(covered(rule[:k]), 1), -k) for k in range(1, len(rule) + 1) if precision(covered(rule[:k]), 0) >= PRECISION]
        if not choices:
            break
        sharp, k = max(choices)
        rule = rule[:-k]
        if sharp < PRECISION:
            break
        rules.append(rule)
        left &= ~covered(rule)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that applies, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and verdict of every row of docs (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and rule (the one that rejects it). A null or empty text
    has no words and fails the base test. Rows are judged alone, so repeated
    rows get equal results; a null doc_id has no label but is judged like any
    other. An empty table gives an empty result. Other columns are ignored.
    """
    measured = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text")).alias("m")))
    rules = learn(measured, labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = measured.select("doc_id", *[F.col("m")[n].alias(n) for n in names], base_failed(F.col("m")).alias("base_failed"), *features(F.col("m")))
    out = out.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return out.select("doc_id", *names, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns; texts are measured once and written with their measures.

    A null or empty text fails the base test and goes. Repeated rows stay or go together. Without labels, or without
    documents, only the base test decides; an empty table gives an empty result. Columns may have any names.
    """
    rows = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), measures(F.col("text")).alias("m")), "measured")
    rules = learn(rows.select(F.col("row.doc_id").alias("doc_id"), "m"), labels)
    found = rows.select("row", base_failed(F.col("m")).alias("_failed"), *features(F.col("m")))
    return found.where(~F.col("_failed") & verdict(rules).isNull()).select("row.*")
