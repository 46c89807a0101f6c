"""Stored results, events and specifications."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHECKS = "arxiv_id string, category string, reference_text string, kind string, identifier string, verdict string, authority string, detail string"
EVENTS = "event_id string, session_id string, event string, elapsed_ms double, source string"


def checks(spark: SparkSession, path: str) -> DataFrame:
    """Earlier checks; a path without any is an empty table."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], CHECKS)
    return spark.read.csv(path, header=True, schema=CHECKS, multiLine=True, escape='"')


def accumulate(old: DataFrame, new: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Old checks, and new ones of papers that have none."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def observations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').select("paper", "category", "verdict")
    if rows.where("paper is null or category is null or verdict is null").limit(1).count():
        raise ValueError("observations have nulls")
    return rows


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=EVENTS)


def spec(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
