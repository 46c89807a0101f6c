"""SimHash near-dedup with pivot distance tables.

A fingerprint's Hamming distances to the PIVOTS, reference fingerprints, are computed
once a bucket. By the triangle inequality, two fingerprints whose distances to any pivot
differ by more than the threshold differ by more than it themselves. A pair is
compared only if its largest coordinate difference is within the threshold;
survivors are verified.

Pivot distances prune but cannot place: those of unrelated fingerprints lie
within a few units of 32, so cells of them would each hold a large part of all
data. What meets is therefore laid down by agreement: if 64 bits are cut in b
blocks, fingerprints that differ in 3 bits agree on b - 3 blocks. b grows with
the number of fingerprints, so that buckets stay small, and buckets that hold
more than SPLIT are cut further by the same rule. In a bucket, fingerprints are
sorted by distance to the first pivot, so that each meets a window of it. A
bucket returns a forest of its links, never all of them.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_spread, long_rows, whole

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Reference fingerprints: the fractional parts of multiples of the golden ratio, in 64 bits.
PIVOTS = np.array([(i * 0x9E3779B97F4A7C15) % 2**64 for i in range(1, 33)], np.uint64)
#: Fingerprints of a bucket that are compared as one.
SPLIT = 4096
#: Fingerprints for each possible key, at most, when the number of blocks is chosen.
FILL = 4.0
_CHUNK = 1 << 18


def fingerprint(text: str) -> int:
    """The SimHash of a whole text, over 3-word shingles with A-Z in lower case; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return int.from_bytes(digest(b" ".join(words), SEED), "big")
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        some = words[at : at + _CHUNK + SHINGLE - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some]).tolist()
        starts = [0, *ends]
        hashes = b"".join([digest(line[a : e - 1], SEED) for a, e in zip(starts, ends[SHINGLE - 1 :])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t or "") for t in texts], np.uint64).view(np.int64))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def pivot_table(fp: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """The distances of fingerprints to all pivots, a row for each pivot."""
    return np.bitwise_count(fp[None, :] ^ pivots[:, None]).astype(np.int8)


def _first_distance() -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(PIVOTS[0])))))


def _masks(bits: list[int], parts: int, agree: int) -> list[int]:
    """Masks of all choices of agree out of parts blocks of the given bits."""
    blocks = [sum(1 << b for b in block.tolist()) for block in np.array_split(bits, parts)]
    return [sum(c) for c in combinations(blocks, agree)]


def _layout(n: int) -> list[int]:
    """The fewest masks whose keys hold FILL fingerprints on average at most."""
    for parts in range(THRESHOLD + 1, 12):
        agree = parts - THRESHOLD
        if n <= FILL * 2 ** (64 * agree // parts):
            break
    return _masks(list(range(64)), parts, agree)


def _forest(size: int) -> tuple:
    """A union of indexes below size: (labels, join)."""
    labels = np.arange(size)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = labels[a], labels[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            low = np.minimum(la, lb)
            np.minimum.at(labels, la, low)
            np.minimum.at(labels, lb, low)
            while (nxt := labels[labels] != labels).any():
                labels[nxt] = labels[labels[nxt]]

    return labels, join


def links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within each bucket.

    The rows are sorted by mask, key and distance to the first pivot; far is
    their pivot table. A pair is discarded at the first pivot whose distances
    differ by more than the threshold.
    """
    n = len(fp)
    labels, join = _forest(n)
    left, step = np.arange(n - 1), 1
    first = far[0]
    while len(left):
        right = left + step
        meet = (key[left] == key[right]) & (mask[left] == mask[right]) & (first[right] - first[left] <= THRESHOLD)
        left = left[meet]
        a, b = left, left + step
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
        for pivot in far[1:]:
            near = np.abs(pivot[a] - pivot[b]) <= THRESHOLD
            a, b = a[near], b[near]
            if not len(a):
                break
        same = np.bitwise_count(fp[a] ^ fp[b]) <= THRESHOLD
        join(a[same], b[same])
        step += 1
        left = left[left + step < n]
    child = np.flatnonzero(labels != np.arange(n))
    return fp[child], fp[labels[child]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest is not None:
            got = [np.concatenate(x) for x in zip(rest, got)]
        mask, key = got[0], got[1]
        # The last bucket may go on in the next batch.
        end = int(np.flatnonzero((key != key[-1]) | (mask != mask[-1]))[-1]) + 1 if ((key != key[-1]) | (mask != mask[-1])).any() else 0
        rest = [x[end:] for x in got]
        if end:
            yield _edges([x[:end] for x in got])
    if rest is not None and len(rest[0]):
        yield _edges(rest)


def _edges(got: list[np.ndarray]) -> pa.RecordBatch:
    mask, key, fp = got
    fp = np.ascontiguousarray(fp).view(np.uint64)
    a, b = links(mask, key, fp, pivot_table(fp))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _close(table: DataFrame) -> DataFrame:
    """Forest edges (a, b) of the fingerprints (fp, all distinct) within THRESHOLD bits, cut."""
    spark = table.sparkSession
    masks = _layout(table.count())
    rows = table.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
    found = None
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = cut(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("m", F.col("n")))
        rows = cut(join_spread(rows, counts, ["mask", "key"], "m"))
        # A bucket of few open bits is small by itself and isn't cut again.
        large = (F.col("n") > SPLIT) & (F.bit_count("mask") <= 48)
        edges = (
            rows.where(~large).select("mask", "key", "fp").repartition("mask", "key")
            .sortWithinPartitions("mask", "key", _first_distance()).mapInArrow(_compare, "a long, b long")
        )
        found = edges if found is None else found.unionByName(edges)
        rest = rows.where(large)
        parents = [m["mask"] for m in rest.select("mask").distinct().collect()]
        if not parents:
            return cut(found.distinct())
        finer = [(p, _signed(p % 2**64 | m)) for p in parents for m in _masks([b for b in range(64) if not p >> b & 1], THRESHOLD + 1, 1)]
        # At most four masks for each one of the layout, at any size of the data.
        finer = F.broadcast(spark.createDataFrame(finer, "mask long, finer long"))
        rows = rest.join(finer, "mask").select("fp", F.col("finer").alias("mask"))


def _with_least(edges: DataFrame) -> DataFrame:
    """Add m, the least v of all edges of u; the edges of one u need not meet."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")))
    return join_spread(edges, least, ["u"], "_n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root the smallest node reachable.

    Large-star and small-star steps in turn; a node's neighbours are never
    gathered, only their minimum is, and those of a hot node are dealt over tasks.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = cut(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = _with_least(edges)
        edges = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(slim: DataFrame) -> DataFrame:
    """fp, n (of its rows), component_id and keep_fp (the fingerprint with which the document component_id comes; of several the
    least) of each distinct fp of a materialised table (doc_id, fp); a written table."""
    table = cut(slim.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(_close(table))
    table = table.join(roots, table["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "fp"))
    ids = cut(table.groupBy("root").agg(first.alias("first"), F.count("*").alias("of")).select("root", "of", F.col("first.least").alias("component_id"), F.col("first.fp").alias("keep_fp")))
    return cut(join_spread(table, ids, ["root"], "of").select("fp", "n", "component_id", "keep_fp"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs (doc_id, text).

    Fingerprints link at THRESHOLD or fewer differing bits, and component_id is
    the smallest doc_id of those reachable. Texts without words, null ones
    included, have fingerprint zero and link like any other. Repeated rows have
    one fingerprint and so one component. A null doc_id counts only where all of
    a component are null; then component_id is null. An empty table gives an
    empty result. Other columns are ignored.
    """
    long_rows(docs.sparkSession)
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(whole("text")).alias("fp")))
    found = join_spread(slim, grouped(slim), ["fp"], "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def only(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all columns: of each component the one with the smallest
    doc_id; of repeated rows, and of components without a doc_id, one.

    Nulls and empty tables are as in dedup(); columns may have any names. A text
    is fingerprinted once; then its row is known by its doc_id and a hash of its text.
    """
    long_rows(docs.sparkSession)
    known = [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("_id"), F.xxhash64(whole("text")).alias("_h")]
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *known, fingerprints(whole("text")).alias("fp")))
    kept = grouped(slim).select(F.coalesce(F.col("component_id").cast("string"), F.lit("")).alias("_id"), F.col("keep_fp").alias("fp")).distinct()
    # Texts of one doc_id may have one fingerprint; one of them stays.
    best = slim.select("_id", "fp", "_h").distinct().join(kept, ["_id", "fp"]).groupBy("_id", "fp").agg(F.min("_h").alias("_h")).select("_id", "_h")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *known)
    nth = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("row.text"))
    return rows.select("*", nth.alias("nth")).where("nth = 1").join(best, ["_id", "_h"], "left_semi").select("row.*")
