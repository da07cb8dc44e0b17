"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0 to n - 1 in the order of the given columns. A keyed permutation of these numbers is a reproducible
shuffle that no task has to hold: row r goes to place p = permute(r), place p lies in shard p mod shards at slot p div shards.
Shards therefore differ by one row at most and slots have no gaps, and the place of any row (or the row at any place) can be
computed alone.

The permutation works on a grid of a x b cells with a = ceil(sqrt(n)) and b = ceil(n / a): rounds add, in turn, a hash of the
column to the line and a hash of the line to the column. At most a - 1 cells are not row numbers; a walk that lands on one
is continued until it lands on a row number (cycle walking), which keeps the map one to one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from repograph.llm.common import checkpointed, shuffle_partitions, text_or_empty

#: A walk leaves the row numbers with a chance of about 1 / sqrt(n) a step, so more steps than this do not occur for large n;
#: for small n the number of cells outside bounds the walk. Going beyond raises an error rather than giving a wrong place.
LONGEST_WALK = 64


def _grid(n: int) -> tuple[int, int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))
    return a, b, min(a * b - n, LONGEST_WALK) + 1


def _mixed(value: Column, seed: int, turn: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(seed), F.lit(turn)), F.lit(modulus))


def permute(row: Column, n: int, seed: int = 0, rounds: int = 4, inverse: bool = False) -> Column:
    """The place of a row number in 0..n-1 (or, inverse, the row number at a place)."""
    a, b, longest = _grid(n)

    def once(cell: Column) -> Column:
        state = F.struct(F.call_function("div", cell, F.lit(b)).cast("long").alias("l"), F.pmod(cell, F.lit(b)).cast("long").alias("c"))

        def turn(s: Column, k: Column) -> Column:
            sign = -1 if inverse else 1
            line = F.pmod(s.l + sign * F.pmod(F.xxhash64(s.c, F.lit(seed), k), F.lit(a)), F.lit(a))
            column = F.pmod(s.c + sign * F.pmod(F.xxhash64(s.l, F.lit(seed), k), F.lit(b)), F.lit(b))
            even = F.pmod(k, F.lit(2)) == 0
            return F.struct(F.when(even, line).otherwise(s.l).alias("l"), F.when(even, s.c).otherwise(column).alias("c"))

        turns = range(rounds - 1, -1, -1) if inverse else range(rounds)
        return F.aggregate(F.array(*map(F.lit, turns)), state, turn, lambda s: s.l * F.lit(b) + s.c)

    start = row.cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), once(start), lambda cell, _: F.when(cell < n, cell).otherwise(once(cell)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk of a row number did not end")).cast("long"))


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with the rank (from 0) of each row in the order of the columns, and the number of rows.

    Range partitions are sorted on their own and written once; only one count for each partition is added up. Rows with the same order are told apart by a
    hash of the whole row, and equal rows (in any number) may spread over partitions, so that the order of the input makes no difference.
    """
    spark = df.sparkSession
    ties = [F.col("_hash"), F.col("_tie")]
    tied = df.withColumns({"_hash": F.xxhash64(*(F.to_json(F.struct(c)) if isinstance(kind.dataType, MapType) else F.col(c) for c, kind in zip(df.columns, df.schema, strict=True))), "_tie": F.monotonically_increasing_id()})
    parts = tied.repartitionByRange(shuffle_partitions(spark), *order, *ties).sortWithinPartitions(*order, *ties).drop("_hash", "_tie")
    placed = checkpointed(parts.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # One row for each range partition, so its size is bounded by the number of partitions.
    joined = placed.join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), n


def shard_rows(df: DataFrame, n_shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """df with row_number, shard (int) and slot (long).

    Any columns of df may be null and rows may repeat: repeated rows are rows of their own. An empty df gives an empty
    result. Columns of df named row_number, shard or slot are replaced.
    """
    rows, n = numbered(df.drop("row_number", "shard", "slot"), order)
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    place = permute(F.col("row_number"), n, seed)
    return (
        rows.withColumn("_place", place)
        .withColumns({"shard": F.pmod("_place", F.lit(n_shards)).cast("int"), "slot": F.call_function("div", F.col("_place"), F.lit(n_shards)).cast("long")})
        .drop("_place")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder for each shard, its rows in the order of their slots: within a file, and from file to file by name."""
    spark = sharded.sparkSession
    ordered = sharded.repartitionByRange(shuffle_partitions(spark), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 0) -> DataFrame:
    """The digest of a sharding of documents under the law ``rows``.

    Sizes count the UTF-8 bytes of the text plus 16; a null text counts as empty. Only doc_id, size and checksum are moved.
    """
    text = text_or_empty("text")
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(slim, n_shards, ["doc_id", "text_crc32", "size"], seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
