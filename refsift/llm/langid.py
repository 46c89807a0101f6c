"""Language identification by compression.

Each language has a raw-content zstandard dictionary of training text. A text
is compressed in pieces with each dictionary; the language whose dictionary
makes it smallest is predicted. Letters alone count: text is lower-cased, and
everything but words of letters dropped. Short texts are compressed as all
their word suffixes and prefixes at a level that also uses short matches,
since sizes are whole bytes.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import long_rows

UNKNOWN = "und"
#: Bytes of a dictionary, and of all together: with more than TOTAL / DICTIONARY languages, each has a smaller one.
DICTIONARY, TOTAL = 64_000, 1 << 24
#: The training sample, its one bound: so many texts a language at most, by hash of doc_id, preferably of these lengths,
#: and of a longer one a stretch of the larger length, from anywhere in it.
SAMPLE_DOCS, SAMPLE_CHARS = 200, (200, 4000)
LEVEL, PIECE = 6, 1000
#: Below so many bytes a text is short.
SHORT, SHORT_LEVEL = 300, 19
#: A prediction whose size is not smaller than the next by this part is not accepted.
MARGIN = 0.02
#: Code points that are handled at once.
STEP = 1 << 20

#: Runs of letters: Unicode categories L, so neither digits, fractions nor enclosed or Roman numerals.
_LETTERS = regex.compile(r"\p{L}+")


def canonical(text: str) -> bytes:
    return " ".join(_LETTERS.findall(text.lower())).encode()


def held_out(doc_id="doc_id"):
    """Whether a row is held out: crc32 of the doc_id as text (null: empty) modulo 5 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def shares(lengths: list[int], size: int) -> list[int]:
    """How much of each text a dictionary of so many bytes takes: all of the short ones, and of the others the same."""
    out, left = [0] * len(lengths), size
    for k, i in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[i] = min(lengths[i], left // (len(lengths) - k))
        left -= out[i]
    return out


def dictionary(texts: list[str], size: int) -> bytes:
    """Training text of all given texts, a share of each, cut between words."""
    raw = [r for r in map(canonical, texts) if r]
    parts = [r if len(r) <= n else r[: n + 1].rpartition(b" ")[0] for r, n in zip(raw, shares([len(r) for r in raw], size - len(raw)))]
    return b"\n".join(p for p in parts if p)


def fit(docs: DataFrame, size: int = DICTIONARY, sample: int = SAMPLE_DOCS, total: int = TOTAL) -> dict[str, bytes]:
    """Dictionaries by language, of all languages, from the rows of docs that are not held out and have a lang.

    A dictionary has size bytes at most, and all of them have total bytes. The
    sample of a language is joined on the executors; only dictionaries reach the driver.
    """
    low, high = SAMPLE_CHARS
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = min(size, total // max(1, known.select("lang").distinct().count()))
    h = F.xxhash64("doc_id")
    # Others serve languages that have too few of these lengths.
    order = Window.partitionBy("lang").orderBy(~F.length("text").between(low, high), h, "doc_id", "text")
    start = F.pmod(h, F.greatest(F.length("text") - high + 1, F.lit(1))).cast("int") + 1
    rows = known.select(F.col("lang").cast("string").alias("lang"), F.substring("text", start, F.lit(high)).alias("text"), F.row_number().over(order).alias("k")).where(F.col("k") <= sample)

    def join(of: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": of["lang"].iloc[:1], "dictionary": [dictionary(of.sort_values("k")["text"].tolist(), size)]})

    found = rows.groupBy("lang").applyInPandas(join, "lang string, dictionary binary").collect()
    return {r["lang"]: bytes(r["dictionary"]) for r in found if r["dictionary"]}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        def compressors(level: int) -> list:
            out = []
            for name in self.names:
                d = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                out.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress)
            return out

        self.names = sorted(dictionaries)
        self.usual, self.fine = compressors(LEVEL), compressors(SHORT_LEVEL)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin by which it wins, as a part of the next one's size."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        sizes, first = [0] * len(self.names), b""
        for at in range(0, len(text), STEP):
            raw = canonical(text[at : at + STEP])
            if not at and len(text) <= STEP and len(raw) < SHORT:
                first = raw
                break
            parts = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
            sizes = [s + sum(map(len, map(c, parts))) for s, c in zip(sizes, self.usual)]
        if first:
            words = first.split(b" ")
            parts = [b" ".join(words[k:]) for k in range(len(words))] + [b" ".join(words[:k]) for k in range(1, len(words))]
            sizes = [sum(map(len, map(c, parts))) for c in self.fine]
        if not any(sizes):
            return UNKNOWN, 0.0
        ranked = sorted(zip(sizes, self.names))
        if len(ranked) == 1:
            return ranked[0][1], 1.0
        return ranked[0][1], (ranked[1][0] - ranked[0][0]) / ranked[1][0]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row of docs (doc_id, text).

    score is the margin of the prediction, from 0 to 1; accepted is false where
    it is below margin. lang_pred is ``und`` with score 0 if the text is null or
    has no letter, or if there is no dictionary. Whole texts are read, in pieces.
    Rows are independent: repeated rows get equal results, an empty table gives
    an empty one. Other columns are ignored.
    """
    # TOTAL bytes at most.
    shared = long_rows(docs.sparkSession).sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            names, scores = pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            accepted = pa.array([n != UNKNOWN and s >= margin for n, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, scores, accepted], ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, then predict() all; adds held_out."""
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
