"""Titles compared with titles, all with all, where a bound on their similarity leaves few to be computed."""
from __future__ import annotations

import uuid
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns as c
from ..functions import text as t

# Titles that meet in one step, letters told apart by the bound, tasks wanted at least and at most, sizes of strings that are compared side by side.
CLAIMS, WORKS, LETTERS, SPREAD, TASKS = 8192, 65536, 64, 24, 4096
LONGEST, WORD, FEW = 128, 64, 32


class Claim:
    """A title that is looked for: its words, and the lengths that the bound takes."""

    def __init__(self, plain: str):
        self.plain, self.words = plain, sorted(set(plain.split()))
        self.form = " ".join(self.words)
        self.letters = Counter(ord(x) % LETTERS for w in self.words for x in w)


class Titles:
    """Titles, and for another title those that reach a token_set_ratio to it.

    Titles of the same words are one form, compared once. The bound on a form is
    proven. With s characters of shared words and the spaces behind them, and a
    common subsequence of c characters of the rests, the ratio of two forms of n
    and m characters is 200 (s + c) / (n + m). s + c is at most the letters that
    both hold, letter by letter (letters of one bucket count as one), and one
    space less than the words of the one with fewer. The ratios of the shared
    words to each form are exact. So a form is compared only where its common
    letters or its shared words reach a number that follows from its length; both
    are counted for all forms at once. The rests of those that do are compared
    side by side, a machine word each (t.common_subsequence), the longer ones one
    by one.
    """

    def __init__(self, ids, texts):
        """ids and texts of titles; those without a word are like nothing."""
        self.ids, self.texts = ids, texts
        rows: dict[str, list[int]] = {}
        for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])):
            if words := set(t.normalise_title(texts[i]).split()):
                rows.setdefault(" ".join(sorted(words)), []).append(i)
        # The rows of a form are in order of id.
        self.forms, self.rows = list(rows), list(rows.values())
        size = len(self.forms)
        self.length = np.array([len(f) for f in self.forms], dtype=np.int64)
        self.count = np.array([f.count(" ") + 1 for f in self.forms], dtype=np.int64)
        # What is counted is at most the length, and one more with the space behind a last word.
        self.kind = np.uint8 if size == 0 or self.length.max() <= 250 else np.uint16 if self.length.max() <= 65_000 else np.int64
        self.most = np.iinfo(self.kind).max
        where: dict[str, list[int]] = {}
        for i, form in enumerate(self.forms):
            for word in form.split(" "):
                where.setdefault(word, []).append(i)
        self.number = {w: k for k, w in enumerate(where)}
        # Characters of all forms in a row, to count letters and to lay out the short ones.
        chars = np.frombuffer("".join(self.forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(size), self.length)
        blank = chars == 32
        self.letters = np.bincount((chars[~blank] % LETTERS).astype(np.int64) * size + owner[~blank], minlength=LETTERS * size).reshape(LETTERS, size).astype(self.kind)
        self.often, self.seldom = {}, {}
        for word, at in where.items():
            if len(at) * 64 >= size:
                self.often[word] = row = np.zeros(size, dtype=self.kind)
                row[at] = len(word) + 1
            else:
                self.seldom[word] = np.array(at)
        self._laid_out(chars, owner, blank)
        self._cut: dict[tuple, tuple] = {}
        self._common: dict[tuple, np.ndarray] = {}

    def _laid_out(self, chars, owner, blank):
        """The short forms as columns: their characters by number, and of each the place of its word, that of spaces apart."""
        self.short = self.length <= LONGEST
        width = int(self.length[self.short].max(initial=0))
        self.slots = int(self.count[self.short].max(initial=0))
        self.alphabet, code = np.unique(chars, return_inverse=True)
        self.letter = {int(x): k for k, x in enumerate(self.alphabet)}
        begins = np.cumsum(self.length) - self.length
        place = np.arange(len(chars)) - begins[owner]
        # A space belongs to the word behind it.
        spaces = np.cumsum(blank)
        slot = spaces - (spaces[begins] if len(chars) else spaces)[owner]
        ok = self.short[owner]
        self.code = np.zeros((width, len(self.forms)), dtype=np.uint16 if len(self.alphabet) < 65_536 else np.uint32)
        self.code[place[ok], owner[ok]] = code[ok]
        self.slot = np.full((width, len(self.forms)), 2 * self.slots, dtype=np.uint8 if self.slots < 127 else np.uint16)
        self.slot[place[ok], owner[ok]] = np.where(blank, slot + self.slots, slot)[ok]
        self.word = np.full((self.slots, len(self.forms)), -1, dtype=np.int32)
        for i in np.flatnonzero(self.short):
            for k, word in enumerate(self.forms[i].split(" ")):
                self.word[k, i] = self.number[word]

    def _least(self, claim: Claim, least: float):
        """How many common letters, or characters of shared words, each form must have to reach a similarity."""
        key = (len(claim.words), len(claim.form), least)
        if key not in self._cut:
            if len(self._cut) >= 64:
                self._cut.clear()
            n = len(claim.form)
            first = least / 200 * (n + self.length) - np.minimum(self.count, len(claim.words)) + 1
            shared = least / (200 - least) * np.minimum(n, self.length) + 1
            self._cut[key] = tuple(np.clip(np.ceil(x - 1e-6), 0, self.most).astype(self.kind) for x in (first, shared))
        return self._cut[key]

    def counts(self, claim: Claim) -> tuple[np.ndarray, np.ndarray]:
        """Common letters of each form, and characters of shared words with the spaces behind them."""
        common, shared = np.zeros(len(self.forms), self.kind), np.zeros(len(self.forms), self.kind)
        for letter, k in claim.letters.items():
            if (least_of := self._common.get((letter, k))) is None:
                if len(self._common) >= 256:
                    self._common.clear()
                least_of = self._common[letter, k] = np.minimum(self.letters[letter], self.kind(min(k, self.most)))
            common += least_of
        for word in claim.words:
            if word in self.often:
                shared += self.often[word]
            elif word in self.seldom:
                shared[self.seldom[word]] += self.kind(len(word) + 1)
        return common, shared

    def likely(self, claim: Claim, least: float, counts) -> np.ndarray:
        """Numbers of the forms whose bound is at least that similarity, which is above 0."""
        first, enough = self._least(claim, least)
        at = counts[0] >= first
        at |= counts[1] >= enough
        return np.flatnonzero(at)

    def scores(self, claim: Claim, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarity of forms, and the number of words they share."""
        score, shared = np.zeros(len(at)), np.zeros(len(at), dtype=np.int64)
        # Some are sooner compared one by one.
        side = self.short[at] if len(claim.form) <= WORD and len(at) > FEW else np.zeros(len(at), dtype=bool)
        for k in np.flatnonzero(~side):
            form = self.forms[at[k]]
            score[k], shared[k] = t.token_set_ratio(claim.form, form), len(set(claim.words).intersection(form.split(" ")))
        if side.any():
            score[side], shared[side] = self._side_by_side(claim, at[side])
        return score, shared

    def _side_by_side(self, claim: Claim, at: np.ndarray):
        word, ahead = self.word[:, at], np.zeros(len(at), dtype=bool)
        keep, bits = word >= 0, np.zeros(len(at), dtype=np.uint64)
        for b, w in enumerate(claim.words):
            if (number := self.number.get(w)) is not None:
                same = word == number
                bits[same.any(axis=0)] |= np.uint64(1 << b)
                keep &= ~same
        kept = np.zeros((2 * self.slots + 1, len(at)), dtype=bool)
        for k in range(self.slots):
            kept[k], kept[self.slots + k] = keep[k], keep[k] & ahead
            ahead |= keep[k]
        # Forms that share the same words meet the same rest of the claim.
        patterns, pattern = np.unique(bits, return_inverse=True)
        fits = np.zeros((len(patterns), len(self.alphabet)), dtype=np.uint64)
        every, left, same, shared = (np.zeros(len(patterns), dtype=d) for d in (np.uint64, np.int64, np.int64, np.int64))
        for p, mask in enumerate(patterns.tolist()):
            held = [w for b, w in enumerate(claim.words) if mask >> b & 1]
            rest = " ".join(w for b, w in enumerate(claim.words) if not mask >> b & 1)
            masks: dict[str, int] = {}
            for i, x in enumerate(rest):
                masks[x] = masks.get(x, 0) | 1 << i
            for x, m in masks.items():
                if (k := self.letter.get(ord(x))) is not None:
                    fits[p, k] = m
            every[p], left[p], same[p], shared[p] = (1 << len(rest)) - 1, len(rest), sum(map(len, held)), len(held)
        row, column = np.full(len(at), np.uint64(2**64 - 1)), np.arange(len(at))
        width = int(self.length[at].max())
        for code, slot in zip(self.code[:width, at], self.slot[:width, at]):
            hit = fits[pattern, code]
            hit *= kept[slot, column]
            hit &= row
            up = row + hit
            row ^= hit
            row |= up
        common = np.bitwise_count(~row & every[pattern]).astype(np.int64)
        left, same, shared = left[pattern], same[pattern], shared[pattern]
        outer = self.count[at] - shared
        right = self.length[at] - self.count[at] + 1 - same + np.maximum(outer - 1, 0)
        gap, both = (shared > 0).astype(np.int64), same + np.maximum(shared - 1, 0)
        n, m = both + gap + left, both + gap + right
        score = 100 - 100 * (left + right - 2 * common) / (n + m)
        rest = np.maximum(100 - 100 * (gap + left) / (both + n + (gap == 0)), 100 - 100 * (gap + right) / (both + m + (gap == 0)))
        score = np.where(gap == 1, np.where((left == 0) | (right == 0), 100.0, np.maximum(score, rest)), score)
        return score, shared

    def _reach(self, claim: Claim, least: float, counts=None):
        at = self.likely(claim, least, counts or self.counts(claim)) if least > 0 else np.arange(len(self.forms))
        score, shared = self.scores(claim, at)
        ok = score >= least
        return at[ok], score[ok], shared[ok]

    def at_least(self, title: str | None, least: float):
        """Number of row, similarity and number of shared words of all titles of at least that similarity."""
        if plain := t.normalise_title(title):
            for form, score, shared in zip(*self._reach(Claim(plain), least)):
                for i in self.rows[form]:
                    yield i, float(score), int(shared)

    def nearest(self, own, title: str | None, k: int, most: float):
        """Number of row, similarity and number of shared words of the k titles most like it up to a similarity, but its own; the lesser id of equal ones."""
        if not (plain := t.normalise_title(title)) or not self.forms:
            return
        claim, best = Claim(plain), []
        counts = self.counts(claim)
        for least in (*(x for x in (most - 2, most - 4, most - 6, most - 9, most - 13, most - 20, most - 30, most - 50) if x > 0), 0.0):
            at, score, shared = self._reach(claim, least, counts)
            ok = np.flatnonzero(score <= most)
            # Of all forms of one similarity those with the least ids count; a form gives k rows, and its own is left out.
            best = []
            for value in np.unique(score[ok])[::-1]:
                rows = [(i, j) for j in ok[score[ok] == value] for i in self._but(self.rows[at[j]], own, k)]
                best += sorted(rows, key=lambda x: (self.ids[x[0]] is None, self.ids[x[0]]))[: k - len(best)]
                if len(best) >= k:
                    break
            if len(best) >= k:
                break
        for i, j in best:
            yield i, float(score[j]), int(shared[j])

    def _but(self, rows, own, k: int):
        out = []
        for i in rows:
            if self.ids[i] != own:
                out.append(i)
                if len(out) == k:
                    break
        return out

    def best(self, title: str | None, least: float, agrees):
        """Number of row, similarity, number of shared words and plausibility of the first plausible title of at least that similarity, and of the closest.

        The order is by shared words, then id; of the closest by similarity before. agrees(i): whether the names of row i let a similarity below SURE do.
        """
        if not (plain := t.normalise_title(title)) or not self.forms:
            return
        at, score, shared = self._reach(Claim(plain), least)
        if not len(at):
            return
        order = lambda i: (self.ids[i] is None, self.ids[i])
        top = np.flatnonzero(score == score.max())
        top = top[shared[top] == shared[top].max()]
        i, j = min(((self.rows[at[j]][0], j) for j in top), key=lambda x: order(x[0]))
        yield i, float(score[j]), int(shared[j]), bool(score[j] >= c.SURE or agrees(i))
        for level in np.unique(shared)[::-1]:
            here = np.flatnonzero(shared == level)
            sure, open_ = here[score[here] >= c.SURE], here[(score[here] < c.SURE) & (score[here] >= c.LEAST_PLAUSIBLE)]
            found = min(((self.rows[at[j]][0], j) for j in sure), key=lambda x: order(x[0]), default=None)
            for i, j in sorted(((i, j) for j in open_ for i in self.rows[at[j]]), key=lambda x: order(x[0])) if agrees.asked else ():
                if found is not None and order(found[0]) < order(i):
                    break
                if agrees(i):
                    found = (i, j)
                    break
            if found is not None:
                yield found[0], float(score[found[1]]), int(level), True
                return


class Agrees:
    """Whether half of the claimed names are among those of a row; each list of names is compared once."""

    def __init__(self, claimed, names):
        self.claimed, self.names, self.known = claimed, names, {}
        self.asked = bool(claimed) and names is not None

    def __call__(self, i: int) -> bool:
        if not self.asked:
            return False
        key = tuple(self.names[i] or ())
        if key not in self.known:
            overlap = t.author_overlap(self.claimed, key)
            self.known[key] = overlap is not None and overlap >= 0.5
        return self.known[key]


def dealt(rows: DataFrame, size: int, name: str, key: str, text: str, more: str | None = None, least: int = 1) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, as arrays of id, text and one column more, and how many there are; ``least`` if 64 rows each are left for them."""
    count = rows.count()
    n = max(1, ceil(count / size), min(least, ceil(count / 64)))
    row = F.struct(F.col(key).alias("id"), F.col(text).alias("text"), *(F.col(x).alias("more") for x in (more,) if x))
    return rows.select(F.pmod(F.xxhash64(key, text), F.lit(n)).alias(name + "_block"), row.alias("row")).groupBy(name + "_block").agg(F.collect_list("row").alias(name)), n


#: The titles that this process has compared last; tasks that follow each other meet the same works.
_last: dict = {}


def _titles(key, works) -> tuple[Titles, list | None]:
    if _last.get("key") != key:
        _last.clear()
        names = [f.name for f in works.type]
        _last.update(key=key, titles=Titles(works.field("id").to_pylist(), works.field("text").to_pylist()), more=works.field("more").to_pylist() if "more" in names else None)
    return _last["titles"], _last["more"]


def _meet(claims: DataFrame, works: DataFrame, find, fields: list, more: bool = False) -> DataFrame:
    """What find(titles, authors of works, claim) yields of each claim (claim_id, claimed_title) and block of works (work_id, title): number of row and fields.

    Each block of claims meets each block of works once, in a task that reads
    the two of them: blocks are written once, and no pair of blocks is.
    """
    b, m = dealt(works, WORKS, "works", "work_id", "title", "authors" if more else None)
    a, n = dealt(claims, CLAIMS, "claims", "claim_id", "claimed_title", "claimed_authors" if more else None, ceil(SPREAD / m))
    kind = T.StructType([T.StructField("claim_id", claims.schema["claim_id"].dataType), T.StructField("claimed_title", T.StringType()), T.StructField("work_id", works.schema["work_id"].dataType), T.StructField("title", T.StringType()), *fields])
    names, arrow, run_id = kind.fieldNames(), to_arrow_schema(kind), uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                titles, authors = _titles((run_id, batch.column("works_block")[i].as_py()), batch.column("works")[i].values)
                found = []
                for claim in batch.column("claims")[i].as_py():
                    found += [dict(zip(names, (claim["id"], claim["text"], titles.ids[k], titles.texts[k], *rest))) for k, *rest in find(titles, authors, claim)]
                    if len(found) >= 10_000:
                        yield pa.RecordBatch.from_pylist(found, schema=arrow)
                        found = []
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    # A product of partitions; that of works stays while those of claims follow.
    pairs = b.repartition(min(m, TASKS)).hint("shuffle_replicate_nl").crossJoin(a.repartition(min(n, TASKS)))
    return pairs.select("claims", "works", "works_block").mapInArrow(run, kind)


_LIKE = [T.StructField("similarity", T.DoubleType()), T.StructField("shared", T.IntegerType())]


def at_least(claims: DataFrame, works: DataFrame, least: float) -> DataFrame:
    """All pairs of claim and work of at least that similarity: claim_id, claimed_title, work_id, title, similarity, shared."""
    return _meet(claims, works, lambda titles, _, claim: titles.at_least(claim["text"], least), _LIKE)


def nearest(claims: DataFrame, works: DataFrame, k: int, most: float) -> DataFrame:
    """Pairs among which are, for each claim, the k works most like it up to a similarity, but the one of its own id."""
    return _meet(claims, works, lambda titles, _, claim: titles.nearest(claim["id"], claim["text"], k, most), _LIKE)


def best(claims: DataFrame, works: DataFrame, least: float) -> DataFrame:
    """Pairs of at least that similarity among which are, for each claim (with claimed_authors), the first plausible work (with authors) and the closest; a column plausible."""
    def find(titles, authors, claim):
        return titles.best(claim["text"], least, Agrees(claim["more"], authors))

    return _meet(claims, works, find, [*_LIKE, T.StructField("plausible", T.BooleanType())], more=True)
