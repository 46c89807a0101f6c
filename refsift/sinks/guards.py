"""Writing results without losing better ones."""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EmptyStudy(RuntimeError):
    """A study without a row isn't written."""


class DegradedStudy(RuntimeError):
    """A study much smaller than the one it would replace isn't written."""


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text where Spark's tables are, in place of what is there."""
    system, jpath = _file_system(spark, path)
    out = system.create(jpath, True)
    out.write(bytearray(text.encode()))
    out.close()


def write(df: DataFrame, path: str, allow_smaller: bool = False, least: float = 0.5) -> int:
    """Write df as CSV in place of what is at path, unless it is empty or much smaller; returns its rows.

    Lists are joined by "; ". Where nothing is at path, nothing can be lost; what is there but can't be read raises,
    unless allow_smaller. df runs once, into a folder beside path that then takes its place, so df may read path.
    """
    spark = df.sparkSession
    system, target = _file_system(spark, path)
    before = 0
    if system.exists(target):
        try:
            before = spark.read.csv(path, header=True, multiLine=True, escape='"').count()
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e) and not allow_smaller:
                raise
    draft = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    flat = [F.array_join(n, "; ").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    df.select(*flat).write.option("escape", '"').csv(draft, header=True)
    made = _file_system(spark, draft)[1]
    try:
        rows = spark.read.schema(", ".join(f"`{n}` string" for n in df.columns)).csv(draft, header=True, multiLine=True, escape='"').count()
        if not rows:
            raise EmptyStudy(path)
        if rows < least * before and not allow_smaller:
            raise DegradedStudy(f"{rows} rows would replace {before}")
        system.delete(target, True)
        system.rename(made, target)
    finally:
        system.delete(made, True)
    return rows


def manifest(files: dict[str, bytes]) -> str:
    """SHA-256 of files by name, as JSON."""
    return json.dumps({k: hashlib.sha256(v).hexdigest() for k, v in sorted(files.items())}, indent=2) + "\n"
