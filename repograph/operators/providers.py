"""Answers of registered models to requests, asked once for each different request and kept in a table.

A key names a provider and a request by a hash. Requests are made distinct, those that the table knows are left out, the rest goes to the provider in
batches from the tasks, and the answers are appended. So a build that is started again asks only what is new, and equal requests cost one answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.operators.graph import checkpointed

_CHAT: dict[str, Callable[[list[str]], list[str]]] = {}
ANSWER = "key string, provider string, response string"


def register_chat(name: str, answer: Callable[[list[str]], list[str]]) -> None:
    """Make a function from requests to answers, one each, available by name."""
    _CHAT[name] = answer


def tried(ask: Callable[[list], list], items: list, tries: int = 3, delay: float = 1.0) -> list:
    """ask(items), again after 1, 2, 4 ... times ``delay`` seconds if it fails; the last failure is raised."""
    for k in range(tries):
        try:
            found = ask(items)
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(delay * 2**k)
            continue
        if len(found) != len(items):
            raise ValueError(f"{len(items)} requests got {len(found)} answers")
        return found
    raise ValueError("a request must be tried once at least")


def request_key(provider: str, request: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{provider}\n"), request), 256)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The kept answers, one for each key (of two builds that asked at once the smaller one); none if there is no table yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ANSWER)
    return spark.read.schema(ANSWER).parquet(path).groupBy("key").agg(F.min("provider").alias("provider"), F.min("response").alias("response"))


def answered(rows: DataFrame, request: str, provider: str, cache: str | None = None, column: str = "response", batch: int = 20, tries: int = 3, delay: float = 1.0) -> DataFrame:
    """rows with the provider's answer to the text in column ``request``; a null or blank request has a null answer.

    cache is the folder of the table of answers, which all executors see; without it equal requests are still asked once. A provider that fails is asked
    again, see ``tried``; if it fails for good the job fails and nothing is appended.
    """
    ask, spark = _CHAT[provider], rows.sparkSession
    keyed = rows.withColumn("_key", F.when(F.length(F.trim(request)) > 0, request_key(provider, F.col(request))))
    wanted = keyed.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first(request).alias("request"))
    if cache is not None:
        wanted = wanted.join(read_answers(spark, cache).select("key"), "key", "left_anti")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                some = part.slice(at, batch)
                found = tried(ask, some.column("request").to_pylist(), tries, delay)
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array([provider] * len(found), pa.string()), pa.array(found, pa.string())], names=["key", "provider", "response"])

    made = wanted.mapInArrow(each, ANSWER)
    if cache is None:
        known = checkpointed(made)
    else:
        made.write.mode("append").parquet(cache)
        known = read_answers(spark, cache)
    known = known.select(F.col("key").alias("_key"), F.col("response").alias(column))
    return keyed.join(known, "_key", "left").drop("_key")
