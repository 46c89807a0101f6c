"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the smallest hash of the
GRAM-word grams in it, the leftmost of equal ones. Consecutive windows that
share a minimiser travel as one packed string, the words that they cover, to the
bucket of that minimiser; equal windows meet there, because their minimisers
are equal, and sorting counts them exactly.

Three things keep this small. A minimiser that occurs once can't have a window
that occurs twice. One whose packed strings are all equal, as copies of a
document have, needs no comparison: all its windows are repeated. So strings
travel only for minimisers with different strings; bitmaps of fixed size tell
which those are (bits that coincide cost work, not results; the count itself is
looked up exactly). A task sends a string once, and equal strings of several
tasks are merged before they go to their bucket.

A bucket of over BUCKET different strings is split, still as packed strings. A
window of it has the minimiser at some place from lo to hi. That range is cut in
PARTS, and the windows of a string whose places lie in one part travel as one
string to the bucket named by the words that all windows of the part hold: a
longer minimiser, of WINDOW words less the width of the part. Equal windows have
their minimiser at the same place, so they meet again. Buckets that are still
large are split again; after three times a bucket is a single window.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, long_rows, release, stored, whole

WINDOW, GRAM = 35, 8
#: Bits of a map of minimisers, as a power of two: 32 MB, at any size of the data.
MAP_BITS = 28
_SLICE_BITS = 20
#: Different strings that are compared in one bucket; more are split.
BUCKET = 1000
#: Parts of a range of places when a bucket is split, and tasks over which it is dealt for that.
PARTS, SALTS = 4, 32
#: Digests of strings that a task remembers to have sent.
SENT = 500_000
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_A, _B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = 2**64 - 1


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(_A), _Powers(_B)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _ranges(values: np.ndarray, powers: _Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end]."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in UTF-8."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _BLANK[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def super_kmers(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of windows with one minimiser."""
    n = len(starts)
    words = _ranges(np.frombuffer(raw, np.uint8).astype(np.uint64), _BYTES, starts, ends)
    at = np.arange(n - GRAM + 1)
    grams = _ranges(words, _GRAMS, at, at + GRAM)
    best, width, span = at, 1, WINDOW - GRAM + 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        width += step
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return first, np.diff(np.r_[first, len(best)]), grams[best[first]]


def place_of_minimiser(packed: bytes) -> int:
    """The number of the word where the minimiser that all windows of a packed string share begins."""
    starts, ends = word_bounds(packed)
    words = _ranges(np.frombuffer(packed, np.uint8).astype(np.uint64), _BYTES, starts, ends)
    at = np.arange(WINDOW - GRAM + 1)
    return int(np.argmin(_ranges(words, _GRAMS, at, at + GRAM)))


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Number, bytes and word bounds of the texts that have a window."""
    for i, text in enumerate(batch.column(column)):
        raw = text.as_buffer()
        if raw is not None and raw.size >= 2 * WINDOW - 1:
            raw = raw.to_pybytes()
            starts, ends = word_bounds(raw)
            if len(starts) >= WINDOW:
                yield i, raw, starts, ends


def _strings(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[bytes]:
    """The packed strings of super-k-mers: their words, joined by one space."""
    line = b" ".join(raw.split())
    at = np.r_[0, np.cumsum(ends - starts + 1)]
    return [line[a:b] for a, b in zip(at[first].tolist(), (at[first + count + WINDOW - 1] - 1).tolist())]


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """minimiser, and the halves of the digest of its string, of every super-k-mer; equal rows of a batch are one."""
    import xxhash

    for batch in batches:
        found, digests = [], []
        for _, raw, s, e in _rows(batch, 0):
            first, count, minimiser = super_kmers(raw, s, e)
            found.append(minimiser)
            digests += map(xxhash.xxh3_128_digest, _strings(raw, s, e, first, count))
        if found:
            rows = np.c_[np.concatenate(found), np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)]
            rows = rows[np.lexsort(rows.T[::-1])]
            lo, hi = _runs_of(rows)
            rows = rows[lo].view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, rows.T), pa.array(hi - lo)], ["minimiser", "a", "b", "n"])


def minimisers(docs: DataFrame) -> DataFrame:
    """minimiser and varied (whether its packed strings differ) of those that occur twice or more; a written table."""
    found = docs.select("text").mapInArrow(_minimisers, "minimiser long, a long, b long, n long").groupBy("minimiser").agg(
        F.sum("n").alias("n"), *[f(c).alias(f"{c}{k}") for c in "ab" for k, f in enumerate((F.min, F.max))]
    )
    return stored(found.where("n > 1").select("minimiser", F.expr("a0 <> a1 or b0 <> b1").alias("varied")), "minimisers")


def bitmap(found: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A bitmap of the minimisers in found, made in slices."""
    place = F.shiftrightunsigned("minimiser", 64 - bits)
    part = min(_SLICE_BITS, bits)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bitmap = None, None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([current]), pa.array([np.packbits(bitmap).tobytes()])], ["slice", "bits"])
        for batch in batches:
            ids, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo, hi in zip(*_runs_of(ids[:, None])):
                if ids[lo] != current:
                    if current is not None:
                        yield pack()
                    current, bitmap = int(ids[lo]), np.zeros(1 << part, np.uint8)
                bitmap[places[lo:hi] & ((1 << part) - 1)] = 1
        if current is not None:
            yield pack()

    cut_up = found.select(F.shiftright(place, part).alias("slice"), place.alias("place")).repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(1 << bits >> 3, np.uint8)
    step = 1 << part >> 3
    for r in cut_up.mapInArrow(slices, "slice long, bits binary").toLocalIterator():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def _runs_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal rows."""
    edge = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return edge, np.r_[edge[1:], len(rows)]


def pack(docs: DataFrame, repeated: np.ndarray, varied: np.ndarray, bits: int = MAP_BITS) -> DataFrame:
    """doc_id, h, first and count (of windows), minimiser, digest and packed of the super-k-mers whose minimiser may be repeated.

    digest is null unless its strings may differ, and packed is null, too, where the task has sent it before.
    """
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast((repeated, varied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        sent: set[bytes] = set()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            size = 0
            for i, raw, starts, ends in _rows(batch, 2):
                first, count, minimiser = super_kmers(raw, starts, ends)
                place = minimiser >> np.uint64(64 - bits)
                byte, bit = place >> np.uint64(3), (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)
                again, differ = (m[byte] >> bit & 1 == 1 for m in maps)
                again |= differ
                if not again.any():
                    continue
                first, count, minimiser, differ = first[again], count[again], minimiser[again], differ[again]
                digests, packed = [None] * len(first), [None] * len(first)
                at = np.flatnonzero(differ).tolist()
                for k, p in zip(at, _strings(raw, starts, ends, first[differ], count[differ])):
                    digests[k] = d = xxhash.xxh3_128_digest(p)
                    if d not in sent:
                        sent.add(d)
                        packed[k] = p
                for column, values in zip(out, ([i] * len(first), first.tolist(), count.tolist(), minimiser.view(np.int64).tolist(), digests, packed)):
                    column += values
                size += len(raw)
                if len(sent) > SENT:
                    sent = set()
                if size > 1 << 22:
                    yield _packed(batch, out)
                    out, size = [[], [], [], [], [], []], 0
            if out[0]:
                yield _packed(batch, out)

    schema = "doc_id long, h long, first int, count int, minimiser long, digest binary, packed binary"
    return docs.select("doc_id", "h", "text").mapInArrow(run, schema)


def _packed(batch: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
    rows = pa.array(out[0])
    columns = [batch.column(0).take(rows), batch.column(1).take(rows)]
    columns += [pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "first", "count", "minimiser", "digest", "packed"])


def _windows(packed: bytes) -> list[bytes]:
    """The windows of a packed string, in order."""
    ends, at = [], packed.find(b" ")
    while at >= 0:
        ends.append(at)
        at = packed.find(b" ", at + 1)
    ends.append(len(packed))
    return [packed[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[WINDOW - 1 :])]


def _repeats(group: list[tuple[bytes, int, bytes]]) -> Iterator[tuple[bytes, list[int]]]:
    """digest and the windows that occur elsewhere, by place, of each packed string (digest, times, packed) of one minimiser."""
    if len(group) == 1:
        digest, n, packed = group[0]
        if n > 1:
            yield digest, list(range(packed.count(b" ") + 2 - WINDOW))
        return
    every = sorted((w, i, k) for i, (_, _, packed) in enumerate(group) for k, w in enumerate(_windows(packed)))
    hit: list[list[int]] = [[] for _ in group]
    for j, (w, i, k) in enumerate(every):
        if group[i][1] > 1 or j and every[j - 1][0] == w or j + 1 < len(every) and every[j + 1][0] == w:
            hit[i].append(k)
    for (digest, _, _), places in zip(group, hit):
        if places:
            yield digest, sorted(places)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (minimiser, digest, n, packed) sorted by minimiser; a group has BUCKET rows at most."""
    key, group = None, []
    for batch in batches:
        found = []
        for minimiser, digest, n, packed in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if minimiser != key:
                found += _repeats(group) if group else ()
                key, group = minimiser, []
            group.append((digest, n, packed))
        yield _places(found)
    if group:
        yield _places(list(_repeats(group)))


def _places(found: list[tuple[bytes, list[int]]]) -> pa.RecordBatch:
    """digest, and the windows as spans (first and last)."""
    spans = []
    for _, places in found:
        edge = [i for i in range(1, len(places)) if places[i] != places[i - 1] + 1]
        spans.append([{"lo": places[a], "hi": places[b - 1]} for a, b in zip([0, *edge], [*edge, len(places)])])
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array(spans, kind)], ["digest", "spans"])


def _pieces(packed: bytes, at: int, lo: int, hi: int) -> Iterator[tuple[int, int, bytes, int, int, int]]:
    """The string cut up by the place of its minimiser, which is word number at of it, in its windows.

    Of each part (a to b) of the places lo to hi: the first window, the bucket, the string, the number of its minimiser, a and b.
    """
    import xxhash

    edge, found = [0], packed.find(b" ")
    while found >= 0:
        edge.append(found + 1)
        found = packed.find(b" ", found + 1)
    edge.append(len(packed) + 1)
    words, width = len(edge) - 1, -(-(hi - lo + 1) // PARTS)
    for a in range(lo, hi + 1, width):
        b = min(a + width - 1, hi)
        least, most = max(a, at + WINDOW - words), min(b, at)
        if least <= most:
            every = packed[edge[at - a] : edge[at - b + WINDOW] - 1]
            bucket = xxhash.xxh3_64_intdigest(every, a * WINDOW + b)
            yield at - most, bucket - (bucket >> 63 << 64), packed[edge[at - most] : edge[at - least + WINDOW] - 1], most, a, b


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of strings (digest, n, packed, at, lo, hi); at is null if it is to be found."""
    import xxhash

    for batch in batches:
        rows: list[tuple] = []
        for digest, n, packed, at, lo, hi in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if at is None:
                at = place_of_minimiser(packed)
            for first, bucket, piece, place, a, b in _pieces(packed, at, lo, hi):
                rows.append((digest, first, bucket, xxhash.xxh3_128_digest(piece + bytes([place, a, b])), n, piece, place, a, b))
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        columns = zip(*rows) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _PIECES)


_PIECES = ["parent", "shift", "minimiser", "digest", "n", "packed", "at", "lo", "hi"]


def repeats(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """digest and spans (of its windows that occur elsewhere) of a written table of different packed strings.

    distinct: minimiser, digest, n (times), packed, at (the number of the word where the minimiser begins, or null), lo and hi
    (its first and last possible place in a window). A digest may come in several rows.
    """
    hot = cut(distinct.where("lo < hi").groupBy("minimiser").agg(F.count("*").alias("m")).where(F.col("m") > bucket).select("minimiser"))
    large = not hot.isEmpty()
    if large:
        # Salted, so that one minimiser's strings are looked up in SALTS tasks.
        hot = hot.select("minimiser", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = distinct.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
        distinct = salted.join(hot, ["minimiser", "salt"], "left_anti")
    cold = distinct.select("minimiser", "digest", "n", "packed").repartition("minimiser").sortWithinPartitions("minimiser")
    cold = cold.mapInArrow(_count, "digest binary, spans array<struct<lo:int,hi:int>>")
    if not large:
        return cold
    split = salted.join(hot, ["minimiser", "salt"], "left_semi").select("digest", "n", "packed", "at", "lo", "hi").mapInArrow(
        _split, "parent binary, shift int, minimiser long, digest binary, n long, packed binary, at int, lo int, hi int"
    )
    split = stored(split, "pieces", compression="zstd")
    # Pieces that are equal become one row in each task before they meet.
    merged = split.groupBy(*_PIECES[2:4], *_PIECES[5:]).agg(F.sum("n").alias("n"))
    inner = repeats(stored(merged, "distinct", compression="zstd"), bucket)
    shift = lambda x: F.struct((x["lo"] + F.col("shift")).alias("lo"), (x["hi"] + F.col("shift")).alias("hi"))
    inner = split.select("parent", "shift", "digest").join(inner, "digest").select(F.col("parent").alias("digest"), F.transform("spans", shift).alias("spans"))
    return cold.unionByName(inner)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, removed, hashes = [], [], []
        for text, cuts in zip(batch.column(1), batch.column(2)):
            raw = text.as_buffer()
            words = raw.to_pybytes().split() if raw is not None else []
            gone = 0
            if cuts.is_valid:
                edge = np.zeros(len(words) + 1, np.int64)
                spans = cuts.values.flatten()
                np.add.at(edge, spans[0].to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, spans[1].to_numpy(zero_copy_only=False) + WINDOW, -1)
                keep = (np.cumsum(edge)[:-1] == 0).tolist()
                gone = keep.count(False)
                kept = [w for w, k in zip(words, keep) if k]
            else:
                kept = words
            n_words.append(len(words))
            removed.append(gone)
            hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, bits: int = MAP_BITS, bucket: int = BUCKET) -> DataFrame:
    """Remove each word that a repeated window covers from every whole text of docs (doc_id, text).

    Returns doc_id, n_words, n_removed and kept_sha256 (of the words kept, joined
    by one space). Windows are judged on the input: one counts as repeated if its
    words start anywhere else, in the same text too, and all its places lose
    them. A null or empty text, and one of fewer than WINDOW words, has no
    window. Repeated rows are copies of each other, so they lose all windows. A
    row is known by its doc_id (null is a value) and a hash of doc_id and text.
    An empty table gives an empty result. Other columns are ignored.
    """
    spark = long_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    known = minimisers(rows)
    packed = stored(pack(rows, bitmap(known, bits), bitmap(known.where("varied"), bits), bits), "packed", compression="zstd")
    release(spark)
    different = packed.where("digest is not null")
    times = different.groupBy("digest").agg(F.count("*").alias("n"))
    strings = different.where("packed is not null").select("minimiser", "digest", "packed").distinct()
    somewhere = [F.lit(None).cast("int").alias("at"), F.lit(0).alias("lo"), F.lit(WINDOW - GRAM).alias("hi")]
    distinct = stored(strings.join(times, "digest").select("minimiser", "digest", "n", "packed", *somewhere), "distinct", compression="zstd")
    release(spark)
    alike = packed.select("doc_id", "h", "first", "count", "minimiser").join(known.where("not varied"), "minimiser")
    alike = alike.select("doc_id", "h", F.array(F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("count") - 1).alias("hi"))).alias("spans"))
    found = different.select("doc_id", "h", "first", "digest").join(repeats(distinct, bucket), "digest")
    shift = lambda x: F.struct((x["lo"] + F.col("first")).alias("lo"), (x["hi"] + F.col("first")).alias("hi"))
    found = alike.unionByName(found.select("doc_id", "h", F.transform("spans", shift).alias("spans")))
    cuts = found.groupBy("doc_id", "h").agg(F.flatten(F.collect_set("spans")).alias("cuts")).select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), "cuts")
    cuts = stored(cuts, "cuts", compression="zstd")  # as a table, so that Spark may split the texts of one key
    joined = rows.join(cuts, rows["doc_id"].eqNullSafe(cuts["_doc_id"]) & (rows["h"] == cuts["_h"]), "left")
    return joined.select("doc_id", "text", "cuts").mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string")
