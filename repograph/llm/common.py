"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as in ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir, or an earlier call, names.

    Where neither does, a temporary one is taken if Spark runs on one machine only; on a cluster that would part the data, so it is an error.
    """
    set_, earlier = spark.conf.get("spark.checkpoint.dir", ""), spark.sparkContext.getCheckpointDir()
    if not set_ and not earlier:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return set_ or earlier or spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the shared folder of checkpoints."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that one task takes.
ROWS = 100_000


def sized(df: DataFrame, n: int, rows: int = ROWS) -> DataFrame:
    """df in as many partitions as n rows need (or as it has, if fewer). A small table is then one task's work and needs no shuffles."""
    return df.coalesce(max(1, -(-n // rows)))


def settled(df: DataFrame, rows: int = ROWS) -> tuple[DataFrame, int]:
    """df checkpointed, in partitions of about ``rows`` rows, and the number of its rows."""
    done = checkpointed(df)
    n = done.count()
    return sized(done, n, rows), n


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of checkpoints."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read back, and the table's path: smaller than a checkpoint, and without df's lineage as well."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """The words of a text, in order: runs of anything but BLANKS; null gives none."""
    spaced = F.translate(text_or_empty(text), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
