"""Many passages looked for in many texts at once, with edits anywhere."""
from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np

from . import text as t

# The bits of a machine word, characters of a run, characters of a text that are looked at together.
WORD, RUN, CHUNK = 64, 3, 8
# Chunks (at least) and cells of one step, candidates compared in one step, bytes of a table of runs, and its keys, where more runs share one.
SLAB, CELLS, ROWS, TABLE, KEYS = 64, 16384, 8192, 1 << 25, 262139


class Passages:
    """Passages of which a text may hold one with a similarity (find_passage) of at least ``least``.

    The bounds are proven. Of a passage of n characters, let x be left out and y put
    in, so that it has a window of n - x + y characters with a common subsequence
    of n - x. The similarity 200 (n - x) / (2n - x + y) is at least ``least`` only
    if (200 - least) x + least y <= (200 - 2 least) n. Cut the passage into blocks:
    at least one of them keeps to this by itself, for its own length b. So it is
    enough to find every place of every block that does.

    Runs: a character left out breaks RUN runs of RUN characters, one put in breaks
    RUN - 1, so that the block keeps a certain number of its runs, each shifted by
    as many places as there are edits at most. For each chunk of a text there is a
    word of bits per block: which of the block's runs are in it. If a block begins
    in a chunk, then so many of its runs are in the chunks where they may be.

    Edits: at such a place Myers' bit-parallel search gives the block's edit
    distance; it is at most (200 - 2 least) b / least, as no edit costs less.

    Windows: every window that is similar enough lies in a region around such a
    place, so only those are scored. Texts shorter than a passage are also looked
    for in the passage, by the same bounds.
    """

    def __init__(self, quotes, least: float):
        assert 0 < least <= 100
        self.least, self.raw = least, list(quotes)
        self.quotes = [t.normalise_passage(q) for q in self.raw]
        cuts = [(i, len(q) * k // n, len(q) * (k + 1) // n) for i, q in enumerate(self.quotes) if q for n in [-(-len(q) // WORD)] for k in range(n)]
        parts = [self.quotes[i][a:b] for i, a, b in cuts]
        self.owner, self.at = (np.array([c[k] for c in cuts], dtype=np.int64) for k in (0, 1))
        self.size = np.array([len(p) for p in parts], dtype=np.uint64)
        letters = sorted({c for p in parts for c in p})
        self.code = np.zeros(0x110000, dtype=np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        # Most characters put in, left out, and edits of all kinds.
        self.most = np.array([self._put_in(len(p)) for p in parts], dtype=np.uint64)
        out = max((self._left_out(len(p)) for p in parts), default=0)
        put = int(self.most.max()) if parts else 0
        # The first and the last chunk in which runs can be, seen from that in which the block begins.
        self.low, self.high = -out // CHUNK, (CHUNK - 1 + WORD - RUN + put) // CHUNK
        self.width = CHUNK - 1 + WORD + put
        self.tables = self._tables(np.arange(len(parts)), parts)
        # A pattern is in the high bits; those below it fit any character, so that it may begin anywhere.
        full = (1 << WORD) - 1
        free = [full >> len(p) if len(p) < WORD else 0 for p in parts]
        fits = [[f] * self.letters for f in free]
        for j, p in enumerate(parts):
            for k, c in enumerate(self.code[_points(p)].tolist()):
                fits[j][c] |= 1 << WORD - len(p) + k
        self.fits = np.array(fits, dtype=np.uint64).ravel()
        self.start = np.array([full ^ f for f in free], dtype=np.uint64)

    def _put_in(self, n: int) -> int:
        return int((200 - 2 * self.least) * n / self.least + 1e-9)

    def _left_out(self, n: int) -> int:
        return int((200 - 2 * self.least) * n / (200 - self.least) + 1e-9)

    def _kept(self, n: int) -> int:
        """Least number of runs that n characters keep."""
        rest = lambda x: int(((200 - 2 * self.least) * n - (200 - self.least) * x) / self.least + 1e-9)
        return n - RUN + 1 - max(RUN * x + (RUN - 1) * rest(x) for x in range(self._left_out(n) + 1))

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        """Of the run that begins at each character but the last."""
        key = codes[: len(codes) - RUN + 1]
        for k in range(1, RUN):
            key = key * self.letters + codes[k : len(codes) - RUN + 1 + k]
        return key % KEYS

    def _tables(self, blocks: np.ndarray, parts) -> list[tuple]:
        """Tables of blocks: where a run's row is by its key, and at which places each block has it; row 0 is that of runs in no block."""
        if not len(blocks):
            return []
        keys = [self._keys(self.code[_points(parts[b])]) if len(parts[b]) >= RUN else np.zeros(0, np.int64) for b in blocks]
        known = np.unique(np.concatenate(keys))
        if len(blocks) > 1 and 8 * len(known) * len(blocks) > TABLE:
            half = len(blocks) // 2
            return self._tables(blocks[:half], parts) + self._tables(blocks[half:], parts)
        row = np.zeros(KEYS, dtype=np.int32)
        row[known] = np.arange(1, len(known) + 1)
        table = np.zeros((len(known) + 1, len(blocks)), dtype=np.uint64)
        for k, key in enumerate(keys):
            np.bitwise_or.at(table, (row[key], k), np.uint64(1) << np.arange(len(key), dtype=np.uint64))
        # For each chunk seen from that in which a block begins, the places whose runs may be in it.
        place, size = np.arange(WORD), np.array([len(parts[b]) for b in blocks])[:, None]
        low = np.floor_divide(place - np.array([[self._left_out(n)] for n in size[:, 0]]), CHUNK)
        high = (CHUNK - 1 + place + np.array([[self._put_in(n)] for n in size[:, 0]])) // CHUNK
        bits = np.uint64(1) << place.astype(np.uint64)
        masks = [np.bitwise_or.reduce(np.where((low <= d) & (d <= high) & (place <= size - RUN), bits, np.uint64(0)), axis=1) for d in range(self.low, self.high + 1)]
        return [(blocks, row, table, masks, np.array([self._kept(n) for n in size[:, 0]]))]

    def _shared(self, keys: np.ndarray, chunks: int):
        """Chunks, and blocks that may begin in them by the runs that they share."""
        span = self.high - self.low
        for blocks, row, table, masks, least in self.tables:
            rows = np.zeros((chunks + span, CHUNK), dtype=np.int32)
            rows[-self.low : -self.low + chunks] = row[keys].reshape(-1, CHUNK)
            rows, slab = rows.T.copy(), max(SLAB, CELLS // len(blocks))
            seen = np.zeros((0, len(blocks)), dtype=np.uint64)
            for at in range(0, chunks, slab):
                n = min(slab, chunks - at)
                # The runs of the chunks that the step before has not seen.
                here = rows[:, at + len(seen) : at + n + span]
                runs = table.take(here[0], axis=0)
                more = np.empty_like(runs)
                for k in here[1:]:
                    table.take(k, axis=0, out=more, mode="clip")
                    runs |= more
                seen = np.concatenate([seen, runs])
                near, more = np.zeros((n, len(blocks)), dtype=np.uint64), np.empty((n, len(blocks)), dtype=np.uint64)
                for d, mask in enumerate(masks):
                    np.bitwise_and(seen[d : d + n], mask, out=more)
                    near |= more
                chunk, block = np.nonzero(np.bitwise_count(near) >= least)
                yield chunk + at, blocks[block]
                seen = seen[n:]

    def _gathered(self, keys: np.ndarray, chunks: int):
        """The same, ROWS at a time."""
        held, n = [], 0
        for chunk, block in self._shared(keys, chunks):
            held.append((chunk, block))
            n += len(chunk)
            if n >= ROWS:
                chunk, block = (np.concatenate(x) for x in zip(*held))
                for at in range(0, n - n % ROWS, ROWS):
                    yield chunk[at : at + ROWS], block[at : at + ROWS]
                held, n = [(chunk[n - n % ROWS :], block[n - n % ROWS :])], n % ROWS
        if n:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def _nearest(self, block: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Least edit distance of each block to a stretch of its row of codes."""
        up, score = self.start[block], self.size[block]
        down, best = np.zeros(len(block), np.uint64), score.copy()
        fit, x, h, more, less = (np.empty(len(block), np.uint64) for _ in range(5))
        one, top, base = np.uint64(1), np.uint64(WORD - 1), block * self.letters
        for column in codes.T:
            self.fits.take(base + column, out=fit, mode="clip")
            np.bitwise_or(fit, down, out=x)
            np.bitwise_and(fit, up, out=h)
            h += up
            h ^= up
            h |= fit
            np.bitwise_or(h, up, out=more)
            np.invert(more, out=more)
            more |= down
            np.bitwise_and(up, h, out=less)
            np.right_shift(more, top, out=h)
            score += h
            np.right_shift(less, top, out=h)
            score -= h
            np.minimum(best, score, out=best)
            more <<= one
            less <<= one
            np.bitwise_and(more, x, out=down)
            np.bitwise_or(x, more, out=up)
            np.invert(up, out=up)
            up |= less
        return best

    def _regions(self, plain: list[str]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """By text and passage, the regions outside of which no window is similar enough."""
        # Each text begins with a chunk; where it runs on into the next, that only adds candidates.
        sizes = [-(-len(x) // CHUNK) for x in plain]
        first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        chunks = int(first[-1])
        codes = np.zeros(chunks * CHUNK + self.width, dtype=np.int64)
        for a, x in zip(first.tolist(), plain):
            codes[a * CHUNK : a * CHUNK + len(x)] = self.code[_points(x)]
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        reach = np.arange(self.width)
        for chunk, block in self._gathered(self._keys(codes)[: chunks * CHUNK], chunks):
            near = self._nearest(block, codes[chunk[:, None] * CHUNK + reach]) <= self.most[block]
            c, b = chunk[near], block[near]
            text = np.searchsorted(first, c, side="right") - 1
            for i, j, begin, o in zip(text.tolist(), self.owner[b].tolist(), ((c - first[text]) * CHUNK).tolist(), self.at[b].tolist()):
                n = len(self.quotes[j])
                more = self._put_in(n)
                found.setdefault((i, j), []).append((max(0, begin - o - more), min(len(plain[i]), begin + CHUNK - 1 + n - o + more)))
        return {pair: _merged(regions) for pair, regions in found.items()}

    def held(self, texts):
        """Number of text, number of passage and similarity of all that are held."""
        plain = [t.normalise_passage(x) for x in texts]
        found = self._regions(plain)
        longest = max(map(len, self.quotes), default=0)
        short = [i for i, x in enumerate(plain) if x and len(x) < longest]
        # The other way round: short texts in passages that are longer.
        inside = Passages([plain[i] for i in short], self.least)._regions(self.quotes) if short else {}
        whole = {(short[k], j) for j, k in inside if len(plain[short[k]]) < len(self.quotes[j])}
        for i, j in sorted(found.keys() | whole):
            if len(plain[i]) < len(self.quotes[j]):
                similarity = t.find_passage(self.raw[j], texts[i])[0]
            else:
                similarity = best_window(self.quotes[j], plain[i], found[i, j], self.least)
            if similarity >= self.least:
                yield i, j, similarity


@lru_cache(maxsize=2)
def prepared(quotes: tuple, least: float) -> Passages:
    """Kept by a worker, as the same passages meet one block of texts after another."""
    return Passages(quotes, least)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(regions):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def best_window(q: str, s: str, regions, least: float) -> float:
    """The similarity of find_passage for a normalised passage and a text no shorter, if all windows that reach ``least`` are in the regions; else less than ``least``."""
    if q in s:
        return 100.0
    n, best = len(q), 0.0
    score = lambda a, b: 200.0 * t.common_subsequence(q, s[a:b]) / (n + b - a)
    fits = lambda a, b: 200.0 * min(n, b - a) / (n + b - a) >= max(least, best)
    words = s.split(" ")
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    size = q.count(" ") + 1
    width = max(size, int(size * t.SLACK))
    step = max(1, width // 3)
    for low, high in regions:
        # Windows of words, as find_passage places them.
        k = -(-bisect_left(ends, low) // step) * step
        k = max(0, k - step)
        while k < max(1, len(words) - width + 1):
            a, b = ends[k] - len(words[k]), ends[min(k + width, len(words)) - 1]
            if a >= high:
                break
            if low <= a and b <= high and fits(a, b):
                best = max(best, score(a, b))
            k += step
        # Windows of the passage's length; a step to the side changes the common subsequence by one at most.
        end = low + n
        while end <= high:
            common = t.common_subsequence(q, s[end - n : end])
            best = max(best, 200.0 * common / (2 * n))
            end += max(1, int(max(least, best) * n / 100 - 1e-9) - common)
        # Shorter ones at the ends of the text.
        for cut in range(1, n):
            if low == 0 and cut <= high and fits(0, cut):
                best = max(best, score(0, cut))
            if high == len(s) and len(s) - cut >= low and fits(len(s) - cut, len(s)):
                best = max(best, score(len(s) - cut, len(s)))
    return best
