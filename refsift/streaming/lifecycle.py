"""Product events as a stream (an extension: what is batch elsewhere, kept up to date)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def started_completed(events: DataFrame, late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Events by window and type, of events (event_id, ts, event_type), each id once; later ones than the watermark are left out."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def accumulate(checks: DataFrame, path: str, checkpoint: str, key: str = "arxiv_id"):
    """Add checks of papers that the table at path lacks, batch by batch.

    A batch has a folder of its own, which a retry replaces, so one that failed half-way leaves nothing behind and loses nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            before = spark.read.schema(f"{key} {dict(batch.dtypes)[key]}, batch long").parquet(path).where(F.col("batch") != number)
            batch = batch.join(before.select(key).distinct(), key, "left_anti")
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return checks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
