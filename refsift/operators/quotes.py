"""Quotations, what they rely on, and whether their source has them."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import columns as c
from ..functions.passages import prepared
from ..functions.udfs import find_passage
from . import titles
from .extract import LINE_END

# Quotation marks and lengths, markers, headings.
QUOTE = '(?s)"([^"]{40,600})"|“([^”]{40,600})”|«([^»]{40,600})»'
MARKER = r"^[\s.,;:]*(?:\[(\d{1,3})\]|\((\d{1,3})\)|\^(\d{1,3}))"
HEADING = r"(?i)^\s*(?:#+\s*)?(?:\d+\.?\s*)?(references|bibliography|works cited|sources|citations)\s*:?\s*$"
MIN_WORDS, TAIL = 8, 40
# Texts and passages that meet in one step.
TEXTS, PASSAGES = 64, 256


def body(docs: DataFrame) -> DataFrame:
    """doc_id and text up to the first bibliography heading, lines ended by line feeds."""
    parts = F.split("text", LINE_END)
    at = F.array_position(F.transform(parts, lambda x: F.trim(x).rlike(HEADING)), True)
    return docs.select("doc_id", F.array_join(F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).cast("int"))).otherwise(parts), "\n").alias("text"))


def quotes(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text, line, end_line and marker of each quotation of MIN_WORDS words in the body.

    Quotations are found in turn, so the text before one is what precedes its
    first occurrence after the one before.
    """
    rows = body(docs).where(F.col("text").isNotNull())
    found = F.regexp_extract_all("text", F.lit(QUOTE), F.lit(0))
    rows = rows.select("doc_id", F.col("text").alias("body"), found.alias("found")).where(F.size("found") > 0)
    rows = rows.select("doc_id", "body", F.posexplode(F.arrays_zip("found", _offsets(F.col("body"), F.col("found")).alias("at"))).alias("pos", "q"))
    line = lambda at: F.size(F.split(F.substring("body", F.lit(1), at), "\n"))
    end = F.col("q.at") + F.length("q.found")
    tail = F.substring("body", end, F.lit(TAIL))
    marker = F.concat(*[F.regexp_extract(tail, MARKER, i) for i in (1, 2, 3)]).try_cast("int")
    text = c.squeeze(F.col("q.found").substr(F.lit(2), F.length("q.found") - 2))
    out = rows.select("doc_id", "pos", text.alias("text"), line(F.col("q.at") - 1).alias("line"), line(end - 1).alias("end_line"), marker.alias("marker"))
    return out.where(F.size(F.split("text", " ")) >= MIN_WORDS)


def _offsets(text, found):
    """Where each string of an array is in text, from 1, each after the last."""
    empty = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))

    def step(a, q):
        at = F.call_function("locate", q, text, a["next"])
        return F.struct((at + F.length(q)).alias("next"), F.concat(a["at"], F.array(at)).alias("at"))

    return F.aggregate(found, empty, step)["at"]


def attribute(found: DataFrame, citations: DataFrame) -> DataFrame:
    """Add cite_line and identifier of the citation each quotation relies on: that with its marker, else the nearest line's."""
    cites = citations.select("doc_id", "ref_number", F.col("line").alias("cite_line"), "identifier", "pos")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("cite_line", "pos"))
    marked = cites.where("ref_number is not null").withColumn("nth", first("doc_id", "ref_number")).where("nth = 1").select("doc_id", F.col("ref_number").alias("marker"), "cite_line", "identifier")
    by_line = cites.withColumn("nth", first("doc_id", "cite_line")).where("nth = 1").select("doc_id", "cite_line", "identifier", F.lit(True).alias("matched"))
    with_marker = found.join(marked, ["doc_id", "marker"], "left")
    done = with_marker.where("cite_line is not null")
    rest = with_marker.where("cite_line is null").drop("cite_line", "identifier")
    # Each line that may hold the citation, in order of preference; an equi-join on lines instead of a range join.
    order = F.array(*[F.struct(F.lit(i).alias("rank"), (F.col("end_line") + d).alias("cite_line")) for i, d in enumerate((0, 1, -1, -2, -3))])
    near = rest.select("*", F.inline(order)).join(by_line, ["doc_id", "cite_line"], "left")
    best = Window.partitionBy("doc_id", "pos").orderBy(F.coalesce("matched", F.lit(False)).cast("int").desc(), "rank")
    near = near.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    near = near.withColumn("cite_line", F.when(F.col("matched"), F.col("cite_line")))
    return done.unionByName(near.select(*done.columns))


def judge(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Verdict of each quotation (identifier, text) against source texts (identifier, coverage, source_text), each identifier once."""
    joined = found.join(sources, "identifier", "left").withColumn("coverage", F.coalesce("coverage", F.lit("none")))
    joined = joined.withColumn("match", F.when(F.col("coverage") != "none", find_passage("text", "source_text")))
    verdict = c.quote_verdict(F.col("identifier").isNotNull(), "coverage", F.coalesce("match.similarity", F.lit(0.0)))
    return joined.select("doc_id", "pos", "text", "identifier", "coverage", F.col("match.similarity").alias("similarity"), F.col("match.passage").alias("best_passage"), verdict.alias("verdict"))


def best_source(candidates: DataFrame) -> DataFrame:
    """One source text an identifier: arXiv source, arXiv abstract, OpenAlex, then Crossref."""
    rank = F.array_position(F.array(*map(F.lit, ("arxiv-source", "arxiv-abstract", "openalex", "crossref"))), F.col("origin"))
    least = F.when(F.col("origin") == "arxiv-source", 200).when(F.col("origin") == "arxiv-abstract", 21).otherwise(20)
    enough = candidates.where(F.size(F.split(c.squeeze("source_text"), " ")) >= least)
    return enough.groupBy("identifier").agg(F.min_by(F.struct("origin", "coverage", "source_text"), rank).alias("s")).select("identifier", "s.*")


def similar(documents: DataFrame, passages: DataFrame, least: float = c.QUOTE_MATCH) -> DataFrame:
    """All pairs of document (doc_id, text) and passage (item_id, text) of at least that similarity: doc_id, item_id, similarity.

    Every passage is looked for in every document; see Passages for what is spared.
    """
    (a, n), (b, m) = titles.dealt(documents, TEXTS, "documents", "doc_id", "text"), titles.dealt(passages, PASSAGES, "passages", "item_id", "text")
    kind = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("item_id", passages.schema["item_id"].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                texts, asked = batch.column("documents")[i].as_py(), batch.column("passages")[i].as_py()
                held = prepared(tuple(p["text"] for p in asked), least).held([d["text"] for d in texts])
                yield pa.RecordBatch.from_pylist([{"doc_id": texts[k]["id"], "item_id": asked[j]["id"], "similarity": s} for k, j, s in held], schema=arrow)

    pairs = a.crossJoin(b).repartition(min(titles.TASKS, n * m), "documents_block", "passages_block")
    return pairs.select("documents", "passages").mapInArrow(run, kind)
