"""Helpers shared by the corpus operators."""
from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
#: The characters that separate words.
BLANK = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, one of this application's own in that which ``spark.checkpoint.dir`` names.

    Only on one machine (master local), as in tests, may that be unset; then a
    temporary folder takes its place. clean() removes it.
    """
    context = spark.sparkContext
    where = getattr(context, "_refsift_dir", None)
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="refsift-")
        where = context._refsift_dir = f"{where.rstrip('/')}/refsift-{context.applicationId}"
    return where


def clean(spark: SparkSession) -> None:
    """Delete what operators wrote for themselves in this application; for callers that have read all results."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably in the shared folder and cut its lineage."""
    context = df.sparkSession.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def long_rows(spark: SparkSession) -> SparkSession:
    """Let Arrow batches hold fewer rows, since texts are long: BATCH_ROWS, unless the session says otherwise than by default.

    Spark has no such option for a single plan, and plans run after the operator has returned, so the session keeps the setting.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find that jobs which have ended need their shuffle files no more.

    It notices only when the driver's garbage is collected, which an idle driver rarely does; texts that were shuffled would
    stay on the executors' disks meanwhile. Costs a fraction of a second; results don't depend on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Like cut(), as a Parquet table, for tables of which readers need a few columns."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def whole(text: str | Column) -> Column:
    """The text of a row, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


#: A key is hot if it has more than one part in HOT of all rows, so there are under HOT such keys; tasks over which it is dealt.
HOT, SALTS = 4096, 64


def join_spread(rows: DataFrame, side: DataFrame, on: list[str], n: str, salt: Column | None = None) -> DataFrame:
    """Inner join of rows with side, a written table that has one row for each key and in its column n how many of rows it meets.

    No task gets all rows of a hot key: such keys, fewer than HOT whatever the data, are broadcast to mark their rows,
    which are dealt over SALTS tasks by salt (a number; by default at random), as are copies of their row in side.
    The columns of on must not be null. n is dropped; the result has a column _salt.
    """
    least = (side.agg(F.sum(n)).first()[0] or 0) // HOT
    hot = side.where(F.col(n) > least).select(*on, F.lit(True).alias("_hot"))
    salt = F.xxhash64(F.monotonically_increasing_id()) if salt is None else salt
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(F.broadcast(hot), on, "left")
    rows = rows.withColumn("_salt", F.when(F.col("_hot"), F.col("_salt")).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col(n) > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(side.withColumn("_salt", F.explode(copies)).drop(n), [*on, "_salt"])
