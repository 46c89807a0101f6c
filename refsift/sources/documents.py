"""Documents by file type, as doc_id (path) and text."""
from __future__ import annotations

import io
import os
import shlex
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import html_text

PLAIN = (".md", ".txt", ".rst", ".tex", ".csv", ".json")
HTML = (".html", ".htm")
KNOWN = (*PLAIN, *HTML, ".docx", ".pdf")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsupportedDocument(ValueError):
    """A file type that can't be read here."""


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text of the files at path (a glob is fine); the suffix says how they are read."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in PLAIN + HTML:
        # binaryFile keeps a file whole and lets invalid bytes be replaced.
        rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        return rows.withColumn("text", html_text("text")) if suffix in HTML else rows
    if suffix == ".docx":
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_docx, "doc_id string, text string")
    if suffix == ".pdf":
        return _pdf(spark, path)
    raise UnsupportedDocument(f"can't read {suffix or 'a file without a suffix'}")


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id and text of all files; a path that isn't there raises FileNotFoundError."""
    for path in paths:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if os.path.splitext(path)[1].lower() in KNOWN and not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath):
            raise FileNotFoundError(f"no such file: {path}")
    return reduce(DataFrame.unionByName, [read(spark, p) for p in paths])


def _docx(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["path"], "text": [docx_text(bytes(x)) for x in frame["content"]]})


def docx_text(raw: bytes) -> str:
    """Paragraphs of a Word file, then the cells of its tables, a line each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t"))
    cells = [text(cell) for table in body.findall(f"{_WORD}tbl") for cell in table.iter(f"{_WORD}tc")]
    return "\n".join([text(p) for p in body.findall(f"{_WORD}p")] + cells)


def _pdf(spark: SparkSession, path: str) -> DataFrame:
    try:
        import pypdf
    except ImportError as e:
        raise UnsupportedDocument("PDF files need pypdf") from e

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages = [[p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(bytes(x))).pages] for x in frame["content"]]
            yield pd.DataFrame({"doc_id": frame["path"], "text": ["\n".join(p) for p in pages]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, text string")


def expand(spark: SparkSession, patterns: str) -> list[str]:
    """Paths that shell-like patterns name, sorted by pattern; one that names nothing stays as it is."""
    out: list[str] = []
    for pattern in shlex.split(patterns):
        if pattern.startswith("-"):
            raise ValueError(f"a path can't begin with a dash: {pattern}")
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath)
        out += sorted(s.getPath().toString() for s in found or []) or [pattern]
    return out
