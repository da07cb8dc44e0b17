"""Graph and vector tables, the event log and the registry at rest, and trees of files as a source.

Nodes and edges are changed in the buckets that a change falls into, see versions; the other tables are appended to. A task that is lost leaves nothing behind.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repograph.functions import dims
from repograph.functions.columns import decoded
from repograph.operators.graph import checkpointed
from repograph.operators.runs import EVENT
from repograph.sources.versions import VersionedTable

log = logging.getLogger(__name__)


class _SubTree(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, repo: str):
        self.root, self.repo = root, repo

    def partitions(self) -> list[InputPartition]:
        entries = sorted(os.scandir(self.root), key=lambda e: e.name)
        return [_SubTree("", False), *(_SubTree(e.name, True) for e in entries if e.is_dir(follow_symlinks=False))]

    def read(self, partition: _SubTree) -> Iterator[tuple]:
        def row(path: str, is_dir: bool) -> tuple:
            content = None
            if not is_dir:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read()
            return self.repo, path.replace(os.sep, "/"), is_dir, content

        if not partition.deep:
            for entry in os.scandir(self.root):
                yield row(entry.name, entry.is_dir(follow_symlinks=False))
            return
        for folder, dirs, names in os.walk(os.path.join(self.root, partition.path)):
            for name in [*dirs, *names]:
                yield row(os.path.relpath(os.path.join(folder, name), self.root), name in dirs)


class TreeSource(DataSource):
    """All directories and files below a folder, those with a leading dot or underscore included; one partition for each sub-tree."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "repo string, path string, is_dir boolean, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["root"], self.options["repo"])


def scan_repo_tree(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """repo, path, is_dir and content (text) of what is below root, a folder that all executors see."""
    spark.dataSource.register(TreeSource)
    found = spark.read.format("repo_tree").options(root=root, repo=repo).load()
    return found.withColumn("content", decoded(F.col("content")))


def scan_nodes(nodes: DataFrame, label: str, repo: str | None = None, columns: list[str] | None = None) -> DataFrame:
    out = nodes.where(F.col("label") == label)
    out = out if repo is None else out.where(F.col("repo") == repo)
    return out.select(*(columns or out.columns))


def write_nodes(nodes: DataFrame, root: str, buckets: int = 64) -> VersionedTable:
    """Nodes at rest in buckets of their id."""
    return VersionedTable.create(nodes, root, "id", buckets)


def write_edges(edges: DataFrame, root: str, buckets: int = 64) -> VersionedTable:
    """Edges at rest in buckets of their src."""
    return VersionedTable.create(edges, root, "src", buckets)


def insert_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Append records to the table of vectors; returns their ids and collections, as the nodes' backlink (node_id, embedding_id)."""
    vectors.write.mode("append").partitionBy("collection").parquet(path)
    return vectors.select("node_id", F.col("id").alias("embedding_id"), "collection")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert_nodes(nodes: VersionedTable, new: DataFrame) -> list[int]:
    """Merge new rows into nodes by id: given values replace, nulls keep what was there, unknown ids are added. Returns the buckets that were written."""
    return nodes.merge(new)


def insert_edges(edges: VersionedTable, new: DataFrame, nodes: DataFrame) -> list[int]:
    """Add the rows of new of which both ends exist (with the labels src_label and dst_label, if new has them) and that are not there yet. Returns the buckets."""
    found = matched_edges(new, nodes).where("success")
    return edges.add(found.select(*[c for c in found.columns if c not in ("success", "src_label", "dst_label")]), ["src", "dst", "rel_type"])


def matched_edges(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """new with ``success``: whether both ends exist, with the labels that new asks for."""
    out = new
    for end in ("src", "dst"):
        asked = [end] + ([f"{end}_label"] if f"{end}_label" in new.columns else [])
        known = nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")).select(*asked).distinct().withColumn(f"_{end}", F.lit(True))
        out = out.join(known, asked, "left")
    return out.withColumn("success", F.col("_src").isNotNull() & F.col("_dst").isNotNull()).select(*new.columns, "success")


def delete_repo_graph(nodes: VersionedTable, edges: VersionedTable, repo: str) -> DataFrame:
    """Drop the nodes of a repo and all edges at them; ``deleted`` is the number of nodes that went. Edges go first, so that none is left without its ends."""
    gone = checkpointed(nodes.read().where(F.col("repo") == repo).select("id").distinct())
    at = edges.read()
    touched = at.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(at.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    same = ["src", "dst", "rel_type"]
    edges.delete(checkpointed(touched.select(*same).distinct()), same)
    nodes.delete(gone)
    return gone.agg(F.count("*").alias("deleted"))


def delete_repo_vectors(vectors: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Vectors without a repo, and how many went from each collection, zeros included."""
    spark = vectors.sparkSession
    gone = vectors.where(F.col("repo") == repo).groupBy("collection").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(c,) for c in dims.ALL_COLLECTIONS], "collection string")
    counts = every.join(gone, "collection", "left").select("collection", F.coalesce("n", F.lit(0).cast("long")).alias("deleted"))
    return vectors.where(~F.col("repo").eqNullSafe(repo)), counts


def update_property(nodes: VersionedTable, updates: DataFrame, column: str) -> DataFrame:
    """Set a column of nodes from updates(id, value); ``matched`` is the number of nodes that were there, ids that are not are passed over."""
    matched = checkpointed(nodes.read().join(updates.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("matched")))
    nodes.update(updates, column)
    return matched


def _logged(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log with what they say; a line without event or timestamp says nothing."""
    lines = spark.read.text(path).withColumn("e", F.from_json("value", EVENT))
    return lines.withColumn("sound", F.col("e.event").isNotNull() & F.col("e.timestamp").isNotNull())


def event_log_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def malformed_events(spark: SparkSession, path: str) -> DataFrame:
    """The lines (``value``) of a log that are not blank and no events: no JSON, or without event or timestamp."""
    return _logged(spark, path).where(~F.col("sound") & (F.trim("value") != "")).select("value")


def read_events(spark: SparkSession, path: str, count_malformed: bool = False) -> DataFrame:
    """Events from JSON lines, none if there is no log yet; blank lines are passed over, malformed ones too, with a warning of how many if they are counted."""
    if not event_log_exists(spark, path):
        return spark.createDataFrame([], EVENT)
    if count_malformed and (n := malformed_events(spark, path).count()):
        log.warning("%d malformed lines in %s", n, path)
    return _logged(spark, path).where("sound").select("e.*")


def append_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; columns beyond the fixed ones go to metadata."""
    fixed = [part.split()[0] for part in EVENT.split(", ")]
    extra = [c for c in events.columns if c not in fixed]
    if extra:
        pairs = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
        more = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        events = events.withColumn("metadata", F.map_concat("metadata", more) if "metadata" in events.columns else more).drop(*extra)
    events.write.mode("append").json(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("repo_id string, initial_status string, repo_name string, repo_path string").csv(path)


def write_registry(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").option("header", True).csv(path)


def upsert_registry(spark: SparkSession, root: str, updates: DataFrame) -> DataFrame:
    """Merge updates(repo_id, initial_status and maybe more) into the registry at rest, which is made if it isn't there; returns its rows."""
    table = VersionedTable(spark, root)
    if not table.exists():
        empty = spark.createDataFrame([], "repo_id string, initial_status string, repo_name string, repo_path string")
        table = VersionedTable.create(empty, root, "repo_id", 8)
    table.merge(updates)
    return table.read()


def render_json(rows: DataFrame, repo: str, name: str, columns: list[str], order: str) -> DataFrame:
    """A bounded result as one JSON document."""
    items = F.sort_array(F.collect_list(F.struct(order, *(c for c in columns if c != order))))
    return rows.agg(F.to_json(F.struct(F.lit(repo).alias("repository"), items.alias(name))).alias("doc"))
