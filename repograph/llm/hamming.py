"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into SEGMENTS parts. Two codes that differ in at most d bits differ in at most d // SEGMENTS bits in one of the parts,
so the codes within a growing distance are found by looking up, part after part, all keys at a growing radius. After the parts up to j have been
searched to radius r (the others to r - 1), every code within SEGMENTS * r + j is found (j from 0). A query stops when its k-th verified distance
is no more than that, so the result is exact, ties included.

Codes are held in blocks of bounded size, each a set of tables of its own; queries go to every block and their best k of all blocks are merged.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.common import checkpointed

BITS, SEGMENTS = 64, 4
PART = BITS // SEGMENTS
#: Rows of a block of codes, and of queries that a task answers, about.
BLOCK, QUERIES = 1 << 16, 256


def sign_code(vector: str | Column) -> Column:
    """64 bits from the signs of the first 64 elements: bit i is set where element i is above zero (missing, null or NaN: not set)."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when((F.get(vector, i) > 0) & ~F.isnan(F.get(vector, i)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(vector.isNotNull(), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _masks() -> list[np.ndarray]:
    """For each radius the keys at that distance from zero."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(PART), r)], dtype=np.int64) for r in range(PART + 1)]


class Block:
    """Tables of the codes of one block, equal codes held once."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, codes))
        self.ids, codes = ids[order], codes[order]
        self.codes, self.first, self.copies = np.unique(codes, return_index=True, return_counts=True)
        self.tables = []
        for j in range(SEGMENTS):
            key = self.part(self.codes, j)
            self.tables.append((np.argsort(key, kind="stable"), np.r_[0, np.cumsum(np.bincount(key, minlength=1 << PART))]))
        self.masks = _masks()

    @staticmethod
    def part(codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(j * PART)) & np.uint64((1 << PART) - 1)).astype(np.int64)

    def lookup(self, j: int, keys: np.ndarray) -> np.ndarray:
        rows, starts = self.tables[j]
        low, sizes = starts[keys], starts[keys + 1] - starts[keys]
        total = int(sizes.sum())
        return rows[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(total)]

    def nearest(self, code: np.uint64, k: int) -> list[tuple[int, int]]:
        """The k nearest (distance, id), smaller ids first at the same distance."""
        seen = np.zeros(len(self.codes), dtype=bool)
        found, held, enough = [np.zeros((0, 2), dtype=np.int64)], 0, min(k, len(self.ids))
        kth = BITS + 1
        for radius in range(PART + 1):
            for j in range(SEGMENTS):
                rows = self.lookup(j, self.part(np.array([code]), j) ^ self.masks[radius])
                rows = rows[~seen[rows]]
                seen[rows] = True
                if len(rows):
                    distance = np.bitwise_count(self.codes[rows] ^ code).astype(np.int64)
                    found.append(np.column_stack([distance, rows]))
                    held += int(self.copies[rows].sum())
                if held >= enough:
                    every = np.concatenate(found)
                    every = every[np.argsort(every[:, 0], kind="stable")]
                    kth = every[np.searchsorted(np.cumsum(self.copies[every[:, 1]]), enough), 0]
                    found = [every]
                if kth <= SEGMENTS * radius + j:
                    near = every[every[:, 0] <= kth]
                    best = [(int(d), int(i)) for d, r in near for i in self.ids[self.first[r] : self.first[r] + min(self.copies[r], k)]]
                    return sorted(best)[:k]
        raise AssertionError("a search to the full radius covers all codes")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id and distance: the k nearest of codes(id, code) for each row of queries(query_id, code).

    Fewer than k codes give fewer rows; rows with a null id or code take no part; repeated ids of codes are results of their own; a query_id that
    repeats with the same code is one query. Ties go to the smaller id.
    """
    codes, queries = codes.where("id is not null and code is not null"), queries.where("query_id is not null and code is not null").distinct()
    # The first count only sets the number of blocks.
    n_blocks = max(1, -(-codes.count() // BLOCK))
    blocks = codes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    batches = max(1, -(-queries.count() // QUERIES))
    asked = queries.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # A task holds one block and answers some batches of queries on it; a block goes to several tasks if there are few blocks.
    copies = max(1, min(batches, 64 // n_blocks))
    asked = asked.withColumn("copy", F.pmod(F.col("batch"), F.lit(copies)))
    held = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def answer(codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(codes) and len(queries):
            block = Block(codes["code"].to_numpy(np.int64).view(np.uint64), codes["id"].to_numpy(np.int64))
            for query, code in zip(queries["query_id"], queries["code"].to_numpy(np.int64).view(np.uint64), strict=True):
                rows += [(query, i, d) for d, i in block.nearest(code, k)]
        return pd.DataFrame(rows, columns=["query_id", "id", "distance"]).astype("int64")

    best = held.groupBy("block", "copy").cogroup(asked.groupBy("block", "copy")).applyInPandas(answer, "query_id long, id long, distance long")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest_embeddings(embeddings: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """top_k of the sign codes of embeddings(vec_id, embedding); the queries are the rows whose vec_id is divisible by ``every``."""
    codes = checkpointed(embeddings.select(F.col("vec_id").cast("long").alias("id"), sign_code("embedding").alias("code")))
    queries = codes.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "code")
    return top_k(codes, queries, k)
