"""Queries on a property graph of nodes(id, label, name, repo, ...) and edges(src, dst, rel_type, ...)."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repograph.functions import columns as C


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df in the folder of spark.checkpoint.dir. Where that is unset a temporary one is taken on one machine; on a cluster it is an error."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder of checkpoints."""
    if not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext.getCheckpointDir():
        checkpointed(spark.range(1))
    return f"{spark.conf.get('spark.checkpoint.dir', '') or spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of checkpoints, read back. Unlike a checkpoint it has the size of its files and not an estimate, which in a loop of
    joins is multiplied each time until the planner can't hold the number."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parent_directory(children: DataFrame, dirs: DataFrame) -> DataFrame:
    """children(repo, id, parent_path) with parent_id: the directory at parent_path, else the repository."""
    above = dirs.select("repo", F.col("path").alias("parent_path"), F.col("id").alias("_dir"))
    return children.join(above, ["repo", "parent_path"], "left").withColumn("parent_id", F.coalesce("_dir", C.node_id("repo", "repo"))).drop("_dir")


def method_parent(symbols: DataFrame) -> DataFrame:
    """Class and Method nodes with parent_id: a method's class in the same file by name, else the file."""
    classes = symbols.where("label = 'Class'").select("repo", "file_path", F.col("name").alias("parent_name"), F.col("id").alias("_class")).distinct()
    return symbols.join(classes, ["repo", "file_path", "parent_name"], "left").withColumn("parent_id", F.coalesce("_class", C.node_id("file", "repo", "file_path"))).drop("_class")


def contain_edges(files: DataFrame, dirs: DataFrame, symbols: DataFrame) -> DataFrame:
    """All CONTAIN edges of repositories, directories, files and symbols."""
    placed = parent_directory(dirs.select("repo", "id", "parent_path"), dirs).union(parent_directory(files.select("repo", "id", "parent_path"), dirs)).select("repo", "id", "parent_id")
    both = placed.union(method_parent(symbols).select("repo", "id", "parent_id"))
    return both.select("repo", F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAIN").alias("rel_type")).distinct()


def incident(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """id, other, rel_type and direction of the edges at ids(id)."""
    out = edges.join(ids.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel_type", F.lit("out").alias("direction"))
    into = edges.where("src <> dst" if direction == "both" else "true").join(ids.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel_type", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def contain_closure(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """root, id and distance of everything below roots(id) through CONTAIN edges, which form a tree, to its leaves or to a given depth.

    Edges that form a cycle raise a ValueError.
    """
    down = edges.where("rel_type = 'CONTAIN'").select(F.col("src").alias("id"), "dst")
    at = roots.select(F.col("id").alias("root"), "id")
    found, longest = None, None
    for distance in count(1) if depth is None else range(1, depth + 1):
        at = checkpointed(at.join(down, "id").select("root", F.col("dst").alias("id")))
        if at.isEmpty():
            break
        if distance % 64 == 0:
            longest = longest or down.count()
            if distance > longest:
                raise ValueError("CONTAIN edges form a cycle")
            found = checkpointed(found)
        level = at.withColumn("distance", F.lit(distance))
        found = level if found is None else found.union(level)
    return found if found is not None else at.withColumn("distance", F.lit(0)).limit(0)


def node_dependencies(edges: DataFrame, sources: DataFrame, depth: int = 1, most: int | None = 100) -> DataFrame:
    """source, target, rel_types and distance of all paths of at most ``depth`` edges in either direction from sources(id).

    No edge is used twice in a path and a path does not end where it began. ``most`` paths for each source are returned, nearest first. So that a node with
    very many edges is no burden, the last step goes to its first neighbours only: as many as can be among the first ``most``, beside the source and those that
    the path has been at.
    """
    e = edges.select("src", "dst", "rel_type").withColumn("edge", F.xxhash64("src", "dst", "rel_type"))
    either = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "rel_type", "edge").union(e.where("src <> dst").select("dst", "src", "rel_type", "edge"))
    paths = sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.array().cast("array<string>").alias("rel_types"), F.array().cast("array<bigint>").alias("edges"))
    found = None
    for distance in range(1, depth + 1):
        ways = either
        if most is not None and distance == depth:
            near = F.dense_rank().over(Window.partitionBy("at").orderBy("to"))
            ways = either.withColumn("_near", near).where(F.col("_near") <= most + depth + 1).drop("_near")
        step = paths.join(ways, "at").where("not array_contains(edges, edge)")
        paths = step.select("source", F.col("to").alias("at"), F.concat("rel_types", F.array("rel_type")).alias("rel_types"), F.concat("edges", F.array("edge")).alias("edges"))
        level = paths.where("at <> source").select("source", F.col("at").alias("target"), F.array_join("rel_types", ",").alias("rel_types"), F.lit(distance).alias("distance"))
        found = level if found is None else found.union(level)
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target", "rel_types"))
        found = found.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
    return found


def k_hop_shortest(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """source, target and the least distance of everything within ``depth`` edges in either direction."""
    either = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).union(edges.select("dst", "src")).distinct()
    seen = sources.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0).alias("distance"))
    front = seen
    for distance in range(1, depth + 1):
        reached = front.select("source", F.col("target").alias("at")).join(either, "at").select("source", F.col("to").alias("target")).distinct()
        front = checkpointed(reached.join(seen, ["source", "target"], "left_anti").withColumn("distance", F.lit(distance)))
        seen = seen.union(front)
    return seen.where("distance > 0")


def with_related(nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """nodes with the sorted distinct values of pairs(id, value) as an array, empty if there are none."""
    lists = pairs.where("value is not null").groupBy("id").agg(F.sort_array(F.collect_set("value")).alias(name))
    return nodes.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def methods_with_calls(methods: DataFrame, calls: DataFrame) -> DataFrame:
    return with_related(methods, calls.select(F.col("src").alias("id"), F.col("dst").alias("value")), "callee_ids")


def children_summaries(nodes: DataFrame, edges: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """nodes with the summaries of what they contain directly among children(id, summary)."""
    below = edges.where("rel_type = 'CONTAIN'").join(children.select(F.col("id").alias("dst"), "summary"), "dst")
    return with_related(nodes, below.select(F.col("src").alias("id"), F.col("summary").alias("value")), name)


def paginate(nodes: DataFrame, skip: int, limit: int) -> DataFrame:
    return nodes.orderBy("id").offset(skip).limit(limit)


def first_rows(df: DataFrame, key: str | list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
