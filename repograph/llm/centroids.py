"""Centroid clustering with a vantage-point tree over the centroids.

Vectors are small whole numbers, so that distances, sums and means are exact. Each round builds a vantage-point tree over the centroids on the
driver (their number is a parameter, not a matter of the data) and sends it to the tasks. A vector's nearest centroid is found by best-first
branch and bound: the open node with the smallest lower bound is looked at next, its vantage point is measured in whole numbers, and a node
is passed over only if its lower bound lies above the best distance, so that ties are still met and go to the smaller number. A batch of
vectors advances together, each with bounds of its own. Tasks send sums and counts of their clusters, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import written

#: Components beyond this are held to it, so that a squared distance of 64 components fits 63 bits.
LARGEST = 1 << 27
#: Vectors that are searched together; bounds are widened by this part of the distances they come from, so that rounding never passes over a tie.
BATCH, SLACK = 2048, 1e-12
LEAF = -1


@dataclass(frozen=True)
class VantageTree:
    """Nodes as arrays: the centroid that is the vantage point, the range of distances from it to all of each half, and the halves' nodes."""

    points: np.ndarray
    vantage: np.ndarray
    child: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> VantageTree:
        vantage, child, near, far = [], [], [], []

        def grow(some: np.ndarray) -> int:
            """The node of some centroids; the one that is farthest from their first is the vantage point, the rest is halved by the distance to it."""
            if not len(some):
                return LEAF
            at = len(vantage)
            away = ((points[some] - points[some[0]]) ** 2).sum(axis=1)
            own = some[int(np.argmax(away))]
            rest = some[some != own]
            vantage.append(own)
            for table, empty in ((child, LEAF), (near, 0.0), (far, 0.0)):
                table.append([empty, empty])
            distance = np.sqrt(((points[rest] - points[own]) ** 2).sum(axis=1).astype(np.float64))
            order = np.argsort(distance, kind="stable")
            for side, half in enumerate((order[: len(order) // 2], order[len(order) // 2 :])):
                if len(half):
                    near[at][side], far[at][side] = float(distance[half].min()), float(distance[half].max())
                    child[at][side] = grow(rest[half])
            return at

        grow(np.arange(len(points)))
        return cls(points, np.array(vantage), np.array(child).reshape(-1, 2), np.array(near).reshape(-1, 2), np.array(far).reshape(-1, 2))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each vector the number of the nearest centroid (the smaller one of equals) and the squared distance; and how many distances were measured."""
        n, rows = len(vectors), np.arange(len(vectors))
        # A node that is not open has an infinite bound; the root opens the search.
        bound = np.full((n, len(self.vantage)), np.inf)
        bound[:, 0] = 0.0
        best, distance = np.full(n, len(self.vantage), dtype=np.int64), np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
        measured = 0
        while len(rows):
            node = np.argmin(bound[rows], axis=1)
            lowest = bound[rows, node]
            # Inclusive: a node whose bound equals the best distance may hold a tie.
            going = np.isfinite(lowest) & (lowest <= np.sqrt(distance[rows].astype(np.float64)) * (1 + SLACK))
            rows, node, lowest = rows[going], node[going], lowest[going]
            if not len(rows):
                break
            bound[rows, node] = np.inf
            own = self.vantage[node]
            exact = ((vectors[rows] - self.points[own]) ** 2).sum(axis=1)
            measured += len(rows)
            better = (exact < distance[rows]) | ((exact == distance[rows]) & (own < best[rows]))
            best[rows[better]], distance[rows[better]] = own[better], exact[better]
            away = np.sqrt(exact.astype(np.float64))
            for side in (0, 1):
                to = self.child[node, side]
                held = to != LEAF
                least = np.maximum(self.near[node, side] - away, away - self.far[node, side]) - SLACK * (away + self.far[node, side])
                bound[rows[held], to[held]] = np.maximum(lowest[held], np.maximum(least[held], 0.0))
        return best, distance, measured


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite numbers, held within LARGEST."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def kept_vectors(embeddings: DataFrame, width: int) -> DataFrame:
    """vec_id and embedding (doubles) of the rows with exactly ``width`` components, none of them null, NaN or infinite."""
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    wide = F.col("embedding").cast("array<double>")
    return embeddings.where(F.size("embedding") == width).select("vec_id", wide.alias("embedding")).where(~F.exists("embedding", infinite))


def _hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def _batches(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, whole_numbers(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)


def _gathered(vectors: DataFrame, tree: VantageTree, width: int, scale: int) -> list[tuple[int, int, list[int]]]:
    """cluster, number of vectors and sum of each component, for the clusters that have any; each task sends one row a cluster."""
    spark = vectors.sparkSession
    held, kinds = spark.sparkContext.broadcast(tree), "cluster int, n long, sums array<long>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        counts, sums = np.zeros(len(tree.points), dtype=np.int64), np.zeros((len(tree.points), width), dtype=np.int64)
        for _, numbers in _batches(batches, width, scale):
            cluster, _, _ = tree.nearest(numbers)
            counts += np.bincount(cluster, minlength=len(counts))
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
            sums[cluster[order[starts]]] += np.add.reduceat(numbers[order], starts, axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    summed = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    rows = vectors.select("embedding").mapInArrow(each, kinds).groupBy("cluster").agg(F.sum("n").alias("n"), *summed).collect()
    held.unpersist()
    return [(r["cluster"], r["n"], [r[f"s{i}"] for i in range(width)]) for r in rows]


def _assigned(vectors: DataFrame, tree: VantageTree, width: int, scale: int) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast(tree)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers in _batches(batches, width, scale):
            cluster, distance, _ = held.value.nearest(numbers)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(each, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, width: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and vec_id, in that order; of rows with the same vec_id those with smaller components first."""
    rows = vectors.select(_hash(seed).alias("_hash"), "embedding").orderBy("_hash", "embedding").limit(k).collect()
    return whole_numbers(np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(-1, width), scale)


def cluster_vectors(embeddings: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each kept row of embeddings(vec_id, embedding).

    Rows are kept that have ``width`` components, none null or not finite; a component x counts as floor(scale * x), held within LARGEST. Centroids start as the
    k vectors with the smallest sha256 of ``seed:vec_id`` (fewer vectors: fewer centroids). Each round gives every vector to its nearest centroid (ties:
    smaller number) and moves the centroid to floor(sum / count) of its vectors; one without vectors stays. A null vec_id hashes as empty; rows that repeat are
    vectors of their own. Without kept rows the result has no rows. An inertia beyond 63 bits is null.
    """
    spark = embeddings.sparkSession
    vectors = kept_vectors(embeddings, width)
    centroids = first_centroids(vectors, k, width, seed, scale)
    kinds = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        none = spark.createDataFrame([], kinds)
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(none, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    for _ in range(rounds):
        for cluster, n, sums in _gathered(vectors, VantageTree.build(centroids), width, scale):
            centroids[cluster] = [s // n for s in sums]
    placed, _ = written(_assigned(vectors, VantageTree.build(centroids), width, scale), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    name = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    # One row for each centroid.
    known = spark.createDataFrame([(i, fits(s), fits(sum(sums.values())), name(centroids[i])) for i, s in sorted(sums.items())], kinds)
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
