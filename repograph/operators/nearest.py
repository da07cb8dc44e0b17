"""The best vectors for each query, block against block: products of matrices choose candidates, whose scores are then added up in order.

A product of matrices adds up in an order of its own, so it only tells which pairs can't be among the best; what is left, a few for each query, is scored
as columns.cosine does and rounded as Spark does. A block is held at once, and a tile of its products.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, rows of queries and of vectors in a tile of products.
BLOCK, QUERY_TILE, VECTOR_TILE = 8192, 256, 4096
#: More than a score can lose by its rounding and that of the k-th best, and by the order in which products are added up.
SLACK = 1e-6 + 1e-9
#: Lengths beyond these may leave the range of doubles in a product; such vectors are always candidates.
SHORT, LONG = 1e-100, 1e100


def _matrices(column: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dimension, rows and vectors of an array column, for each dimension there is; null vectors and those with a null in them are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    begins = np.cumsum(sizes) - sizes
    broken = np.zeros(len(sizes), bool)
    if flat.null_count:
        broken[np.searchsorted(begins + sizes, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), "right")] = True
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[(sizes > 0) & ~broken]):
        rows = np.flatnonzero((sizes == n) & ~broken)
        yield int(n), rows, values[begins[rows][:, None] + np.arange(n)]


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, each added up from the left."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores of six decimals, halves away from zero, of the shortest decimal number that stands for a score, as Spark's round."""
    scaled = np.abs(scores) * 1e6
    out = np.copysign(np.floor(scaled + 0.5) / 1e6, scores)
    near = np.isfinite(scaled) & (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    for i in np.flatnonzero(near):
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.where(np.isfinite(scores), out, scores) + 0.0


def _first(query: np.ndarray, vector: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """The positions of the k best of each query, the best first: by score, NaN above all, then by the order of the vectors."""
    at = np.lexsort((order[vector], -np.where(np.isnan(score), np.inf, score), query))
    own = query[at]
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
    return at[place < k]


def best_pairs(queries: np.ndarray, vectors: np.ndarray, order: np.ndarray, k: int, allowed: np.ndarray | None = None, ring: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors and scores of the k best for each query, equal scores by ``order``; vectors and queries of length zero have no score.

    With allowed, a query meets the vectors only of which allowed[query, ring] holds.
    """
    with np.errstate(all="ignore"):
        length, other = np.sqrt(_in_order(vectors, vectors)), np.sqrt(_in_order(queries, queries))
        unit, asked = vectors / length[:, None], queries / other[:, None]
        odd, odd_query = ~((length > SHORT) & (length < LONG)), ~((other > SHORT) & (other < LONG))
        unit[odd], asked[odd_query] = 0.0, 0.0
        found = []
        for start in range(0, len(queries), QUERY_TILE):
            tile = slice(start, start + QUERY_TILE)
            n = len(asked[tile])
            held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            least = np.full(n, -np.inf)
            for begin in range(0, len(vectors), VECTOR_TILE):
                some = slice(begin, begin + VECTOR_TILE)
                near = asked[tile] @ unit[some].T
                barred = None if allowed is None else ~allowed[tile][:, ring[some]]
                near[:, odd[some]] = -np.inf
                if barred is not None:
                    near[barred] = -np.inf
                if begin == 0 and near.shape[1] > k:
                    # What is always a candidate bars no other.
                    least = np.where(odd_query[tile], -np.inf, np.partition(near, -k, axis=1)[:, -k] - SLACK)
                if odd[some].any() or odd_query[tile].any():
                    near[:, odd[some]] = near[odd_query[tile]] = np.inf
                    if barred is not None:
                        near[barred] = -np.inf
                q, v = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                if not len(q):
                    continue
                v += begin
                # Many equal vectors are many candidates: their rows are taken in parts.
                made = np.concatenate([_in_order(queries[q[a : a + 100_000] + start], vectors[v[a : a + 100_000]]) for a in range(0, len(q), 100_000)])
                both = length[v] * other[q + start]
                sound = both != 0
                q, v, score = q[sound], v[sound], rounded(made[sound] / both[sound])
                held = tuple(np.concatenate(x) for x in zip(held, (q, v, score), strict=True))
                kept = _first(*held, order, k)
                held = tuple(x[kept] for x in held)
                full = np.flatnonzero(np.bincount(held[0], minlength=n) == k)
                if len(full):
                    last = np.searchsorted(held[0], full, "right") - 1
                    least[full] = np.where(np.isnan(held[2][last]), np.inf, held[2][last]) - SLACK
            found.append((held[0] + start, held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, by_type: bool = False) -> DataFrame:
    """query_id, id, node_id, repo, type and score of the k best vectors(id, node_id, repo, type, embedding) for each row of queries(query_id, query) among the
    rows that are equal in ``keys``; of each type, if asked for. With queries(rings), only vectors(ring) of those."""
    ringed = "rings" in queries.columns
    columns = ["id", "node_id", "repo", "type"]
    types = {f.name: f.dataType.simpleString() for f in [*vectors.schema.fields, *queries.schema.fields]}
    out = ", ".join(f"{c} {types[c]}" for c in ("query_id", *columns)) + ", score double"

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        ids = left.column("id").to_pylist()
        order = np.empty(len(ids), int)
        order[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))] = np.arange(len(ids))
        kinds = np.array([-1 if x is None else x for x in left.column("type").combine_chunks().dictionary_encode().indices.to_pylist()], int) if by_type else np.zeros(len(ids), int)
        ring = left.column("ring").to_numpy() if ringed else None
        width = int(ring.max()) + 1 if ringed and len(ring) else 0
        pairs = []
        asked = [*_matrices(right.column("query"))] if len(left) and len(right) else []
        for n, rows, vectors in _matrices(left.column("embedding")) if asked else ():
            for m, asking, queries in asked:
                if n != m:
                    continue
                allowed = None
                if ringed:
                    allowed = np.zeros((len(asking), width), bool)
                    for i, own in enumerate(right.column("rings").take(pa.array(asking)).to_pylist()):
                        allowed[i, [r for r in own if r < width]] = True
                for kind in np.unique(kinds[rows]):
                    of = kinds[rows] == kind
                    q, v, score = best_pairs(queries, vectors[of], order[rows[of]], k, allowed, ring[rows[of]] if ringed else None)
                    pairs.append((asking[q], rows[of][v], score))
        q, v, score = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        chosen = left.select(columns).take(pa.array(v))
        return pa.Table.from_arrays([right.column("query_id").take(pa.array(q)), *chosen.columns, pa.array(score)], names=["query_id", *columns, "score"])

    left = vectors.select(*keys, *(c for c in (*columns, "embedding") if c not in keys), *(["ring"] if ringed else []))
    # Both sides may come from one table: the keys of one get names of their own.
    right = queries.select("query_id", "query", *(["rings"] if ringed else []), *(F.col(c).alias(f"_of_{c}") for c in keys))
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"_of_{c}" for c in keys))).applyInArrow(each, out)
