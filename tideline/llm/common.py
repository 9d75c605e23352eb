"""What the training-data operators share: shared storage, size-checked joins, text columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beyond this many rows a side of a join is shuffled, never broadcast. Keys and a number or two: under 10 MB.
BROADCAST_ROWS = 100_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset (one machine)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-"))
    return jsc.getCheckpointDir().get().rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python BATCH_ROWS at a time, unless the session has a smaller number: ten thousand long ones, and what is
    made of them, are too much for a small executor."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and survives a lost executor. The
    shuffle files of the write, which nothing reads again, go when it has ended."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that stored() wrote, when what came of it is stored too."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(table: DataFrame) -> DataFrame:
    """A broadcast hint if the (stored) table has at most BROADCAST_ROWS rows; else Spark shuffles it and splits skewed keys."""
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(table) if few else table.hint("merge")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
