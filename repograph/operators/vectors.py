"""Embeddings of nodes and search by cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.functions import columns as C
from repograph.functions import dims
from repograph.operators.graph import checkpointed
from repograph.operators.nearest import BLOCK, nearest
from repograph.operators.providers import tried

DIMENSION = 64
#: Queries of a block at most.
BROADCAST_QUERIES = 10_000
#: More than the error of an angle that comes from a rounded cosine.
ANGLE_ERROR = 1e-6
_PROVIDERS: dict[str, Callable] = {}


def register_provider(name: str, embed: Callable[[list[str]], list[list[float]]]) -> None:
    """Make a function from texts to vectors available to embed_nodes."""
    _PROVIDERS[name] = embed


def embed_nodes(nodes: DataFrame, text: str = "summary", provider: str | None = None, batch: int = 100, tries: int = 3, delay: float = 1.0) -> DataFrame:
    """nodes with embedding of the trimmed text; rows with a blank text go. Without a provider the hashed counts of words are taken.

    A provider is called for batches in the tasks, again after 1, 2, 4 ... times ``delay`` seconds if it fails.
    """
    wanted = nodes.withColumn(text, F.trim(text)).where(F.length(text) > 0)
    if provider is None:
        return wanted.withColumn("embedding", C.hash_embedding(F.col(text), DIMENSION))
    embed = _PROVIDERS[provider]

    def asked(texts: list[str]) -> list[list[float]]:
        return tried(embed, texts, tries, delay)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [*texts]
            yield pd.Series([v for a in range(0, len(values), batch) for v in asked(values[a : a + batch])])

    return wanted.withColumn("embedding", F.pandas_udf(each, "array<double>")(text))


def vector_records(nodes: DataFrame) -> DataFrame:
    """nodes(id, name, label, repo, summary, embedding) as records of the collection of their label."""
    collection = None
    for label, name in dims.COLLECTIONS.items():
        collection = F.when(F.col("label") == label, name) if collection is None else collection.when(F.col("label") == label, name)
    return nodes.select(F.md5("id").alias("id"), collection.alias("collection"), "name", F.col("id").alias("node_id"), "repo", F.col("label").alias("type"), "summary", "embedding")


def code_records(nodes: DataFrame) -> DataFrame:
    """Class and Method nodes(id, name, label, repo, code, embedding) as records of the code collections."""
    collection = F.element_at(F.create_map(*(F.lit(x) for pair in dims.CODE_COLLECTIONS.items() for x in pair)), F.col("label"))
    return nodes.where(F.col("label").isin(*dims.CODE_COLLECTIONS)).select(F.md5(F.concat("id", F.lit("#code"))).alias("id"), collection.alias("collection"), "name", F.col("id").alias("node_id"), "repo", F.col("label").alias("type"), F.col("code").alias("summary"), "embedding")


#: Characters of a chunk of a long text, and how many two neighbours share.
CHUNK, OVERLAP = 2000, 200


def chunks(nodes: DataFrame, text: str = "content", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """nodes(id, label, name, repo, <text>) as overlapping pieces of the text: chunk_no (from 0), offset (characters before it) and chunk.

    Each piece but the last has ``size`` characters and begins size - overlap behind the one before; the last ends with the text. Null and blank texts have none.
    """
    step, length = size - overlap, F.length(text)
    last = F.greatest(F.ceil((length - overlap) / F.lit(step)).cast("int") - 1, F.lit(0))
    rows = nodes.where(F.length(F.trim(text)) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.withColumn("offset", F.col("chunk_no") * step)
    return rows.select("id", "label", "name", "repo", "chunk_no", "offset", F.substring(F.col(text), F.col("offset") + 1, F.lit(size)).alias("chunk"))


def detail_records(nodes: DataFrame, text: str = "content", provider: str | None = None) -> DataFrame:
    """The chunks of nodes (see chunks) that are not blank, embedded, as records of the collection of details, which also have chunk_no and offset."""
    nodes = embed_nodes(chunks(nodes, text).withColumn("_trimmed", F.col("chunk")), "_trimmed", provider)
    made = F.md5(F.concat("id", F.lit("#"), F.col("chunk_no").cast("string")))
    return nodes.select(made.alias("id"), F.lit(dims.DETAIL_COLLECTION).alias("collection"), "name", F.col("id").alias("node_id"), "repo", F.col("label").alias("type"), F.col("chunk").alias("summary"), "embedding", "chunk_no", "offset")


def _blocked(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None, within: tuple[str, ...], by_type: bool = False) -> DataFrame:
    """query_id, id, node_id, repo, type and score of the k best for each query in every block of vectors.

    Metadata are tested before any distance. Vectors and queries(query_id, query) are dealt into blocks of bounded size and each block of one side meets each of the
    other. Queries have the columns of ``within`` too and meet only vectors that are equal in them.
    """
    rows = vectors if where is None else vectors.where(where)
    n, asked = rows.count(), queries.count()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n / BLOCK), min(spread, math.ceil(n / 1024)))
    parts = max(1, math.ceil(asked / max(1, BROADCAST_QUERIES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = rows.withColumns({"_block": dealt("id", blocks), "_part": every(parts)})
    queries = queries.select("query_id", "query", *within).withColumns({"_part": dealt("query_id", parts), "_block": every(blocks)})
    return nearest(rows, queries, [*within, "_block", "_part"], k, by_type)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """scores with rank, of the k vectors that are most similar to each query: the best k of each block, then the best of those."""
    return _ranked(_blocked(vectors, queries, k, where, within), k)


def topk_per_type(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "id"))
    return _blocked(vectors, queries, k, None, (), True).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "type", "id", "node_id", "score", "rank")


def _angle(a: str, b: str) -> Column:
    return F.acos(F.greatest(F.least(C.cosine(F.col(a), F.col(b)), F.lit(1.0)), F.lit(-1.0)))


@dataclass(frozen=True)
class IvfIndex:
    """Vectors in lists around centers, each list in rings by the angle to its center.

    listed: id, node_id, repo, type, embedding, list and ring. rings: one row for each list and ring that has vectors, with the list's center, the smallest and
    largest angle in the ring (low, high) and the number of vectors (n). Both are bounded by the numbers of lists and rings but for listed.
    """

    listed: DataFrame
    rings: DataFrame

    def _near(self, queries: DataFrame) -> DataFrame:
        """query_id, list, ring, n, most (no member of the ring has a larger cosine) and rank for each query and ring, the most promising first."""
        centers = self.rings.select("list", "center").dropDuplicates(["list"])
        near = queries.select("query_id", "query").join(F.broadcast(centers), F.lit(True)).withColumn("_angle", _angle("query", "center")).drop("center", "query")
        near = near.join(F.broadcast(self.rings.drop("center")), "list")
        # By the triangle inequality a member is no nearer to the query than the angles to the center differ.
        least = F.greatest(F.col("_angle") - F.col("high"), F.col("low") - F.col("_angle"), F.lit(0.0))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_least", "_angle", "list", "ring"))
        near = near.withColumn("_least", least).withColumn("_rank", rank)
        return near.select("query_id", "list", "ring", "n", F.cos(F.greatest(F.col("_least") - ANGLE_ERROR, F.lit(0.0))).alias("most"), "_rank")

    def _best(self, probed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best for each query in the rings of probed(query_id, list, ring): of each list, in blocks of bounded size, then of those."""
        parts = max(1, math.ceil(queries.count() / max(1, BROADCAST_QUERIES)))
        blocks = F.broadcast(self.rings.groupBy("list").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("_blocks")))
        dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows = self.listed.join(blocks, "list").withColumns({"_block": dealt("id", F.col("_blocks")), "_part": every(F.lit(parts))})
        asked = probed.groupBy("query_id", "list").agg(F.collect_list("ring").alias("rings")).join(queries.select("query_id", "query"), "query_id").join(blocks, "list")
        asked = asked.withColumns({"_part": dealt("query_id", F.lit(parts)), "_block": every(F.col("_blocks"))}).drop("_blocks")
        return _ranked(nearest(rows, asked, ["list", "_block", "_part"], k), k)

    def _searched(self, queries: DataFrame, k: int, n_probe: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The best of the first rings, those rings, and the other rings that the k-th score so far does not rule out."""
        near = checkpointed(self._near(queries))
        few = near.where(F.col("_rank") <= n_probe)
        first = checkpointed(self._best(few, queries, k))
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
        more = near.where(F.col("_rank") > n_probe).join(least, "query_id", "left")
        # Scores are rounded to six decimals, so a member may score half of the last one above its bound; equal scores are told apart by id.
        return first, few, more.where(F.col("_least").isNull() | (F.col("most") + 1e-6 >= F.col("_least")))

    def search(self, queries: DataFrame, k: int = 10, n_probe: int = 10) -> DataFrame:
        """As topk: no neighbour is lost, as a ring is left out only if none of its members can be among the k best."""
        first, _, more = self._searched(queries, k, n_probe)
        return _ranked(first.drop("rank").union(self._best(more, queries, k).drop("rank")), k)

    def scored(self, queries: DataFrame, k: int = 10, n_probe: int = 10) -> DataFrame:
        """query_id and n: how many vectors a search compares with each query."""
        _, few, more = self._searched(queries, k, n_probe)
        return few.select("query_id", "n").union(more.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("n"))


def ivf_index(vectors: DataFrame, n_lists: int = 128, n_rings: int = 16, sample: int = 100_000, seed: int = 7) -> IvfIndex:
    """An index of all vectors by k-means over a sample of at most about ``sample`` of them; at most the square root of their number in lists."""
    unit = lambda v: F.transform(v, lambda x: x.cast("double"))
    n = vectors.count()
    n_lists = max(1, min(n_lists, math.isqrt(n)))
    rows = vectors.withColumn("_v", array_to_vector(unit(F.col("embedding"))))
    fitted = KMeans(k=n_lists, seed=seed, featuresCol="_v", predictionCol="list", maxIter=10, distanceMeasure="cosine").fit(rows.sample(min(1.0, sample / max(1, n)), seed=seed) if n > sample else rows)
    centers = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(fitted.clusterCenters())], "list int, center array<double>")
    placed = fitted.transform(rows).select("id", "node_id", "repo", "type", "embedding", "list").join(F.broadcast(centers), "list").withColumn("_angle", _angle("embedding", "center")).drop("center")
    placed = checkpointed(placed)
    widths = placed.groupBy("list").agg(F.max("_angle").alias("_width"))
    ring = F.least(F.floor(F.col("_angle") / (F.col("_width") + ANGLE_ERROR) * n_rings), F.lit(n_rings - 1)).cast("int")
    listed = checkpointed(placed.join(F.broadcast(widths), "list").withColumn("ring", ring).drop("_width"))
    rings = listed.groupBy("list", "ring").agg(F.min("_angle").alias("low"), F.max("_angle").alias("high"), F.count("*").alias("n"))
    return IvfIndex(listed.drop("_angle"), checkpointed(rings.join(F.broadcast(centers), "list")))


def ivf_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, n_lists: int = 128, n_probe: int = 10, sample: int = 100_000, seed: int = 7) -> DataFrame:
    """As topk, through an index that is made for it (see ivf_index); ``n_probe`` rings are searched before any is ruled out."""
    return ivf_index(vectors, n_lists, sample=sample, seed=seed).search(queries, k, n_probe)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def union_hits(per_type: DataFrame, k: int = 10) -> DataFrame:
    """The best k hits of all types together."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return per_type.drop("rank").withColumn("rank", rank).where(F.col("rank") <= k)


def hydrate(hits: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with columns of their nodes; hits without a node go."""
    return hits.join(nodes.select(F.col("id").alias("node_id"), *columns), "node_id")
