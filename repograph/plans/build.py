"""A knowledge graph of many repositories from a table of files, and the user's functions on it.

A build has five stages. Each is a function from the tables so far to the tables that it adds; they are kept by checkpoints, or, with a folder, as tables
at rest under the name of the run, where a stage counts as done once its event is in the log (``build_at_rest``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.functions import columns as C
from repograph.functions import dims
from repograph.operators import files as files_ops
from repograph.operators import graph, layers, references, runs, semantic, symbols, vectors
from repograph.operators.graph import checkpointed
from repograph.sources import tables


@dataclass
class KnowledgeGraph:
    """nodes, edges and vectors; files and symbols are the tables that they were made of."""

    files: DataFrame
    directories: DataFrame
    symbols: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    code_vectors: DataFrame | None = None
    details: DataFrame | None = None

    def labelled(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def project_structure(self, repo: str) -> DataFrame:
        """Directories and files of a repo in the order of their paths."""
        return self.nodes.where((F.col("repo") == repo) & F.col("label").isin("Directory", "File")).select("path", "name", F.col("label").alias("type")).orderBy("path")

    def node(self, node_id: str) -> tuple[DataFrame, DataFrame]:
        """A node and its edges in both directions."""
        found = self.nodes.where(F.col("id") == node_id)
        return found, graph.incident(self.edges, found.select("id"))

    def dependencies(self, node_id: str, depth: int = 1) -> DataFrame:
        return graph.node_dependencies(self.edges, self.nodes.where(F.col("id") == node_id).select("id"), depth)

    def file_content(self, node_id: str | None = None) -> DataFrame:
        """The content of a file (or of every file) as JSON; what is known of it where there is none."""
        found = self.labelled("File") if node_id is None else self.labelled("File").where(F.col("id") == node_id)
        return found.select("id", F.coalesce(F.when(F.col("content").isNotNull(), F.to_json(F.struct("path", "content"))), F.to_json(F.struct("id", "name", "path"))).alias("doc"))

    def modules(self, repo: str) -> DataFrame:
        return self.labelled("Module").where((F.col("repo") == repo) | F.col("id").startswith(f"module_{repo}_")).select("id", "name", "description", "summary")

    def module_workflows(self, module_id: str | None = None) -> DataFrame:
        """The workflows that belong to a module (or to every module)."""
        of = self.edges.where("rel_type = 'BELONG_TO'").select(F.col("src").alias("id"), F.col("dst").alias("module_id"))
        of = of if module_id is None else of.where(F.col("module_id") == module_id)
        return self.labelled("Workflow").join(of, "id").select("module_id", "id", "name", "description", "summary")

    def _search(self, records: DataFrame, queries: DataFrame, types: list[str], k: int, columns: list) -> DataFrame:
        within = ("repo",) if "repo" in queries.columns else ()
        asked = vectors.embed_nodes(queries.withColumnRenamed("text", "summary")).select("query_id", *within, F.col("embedding").alias("query"))
        return vectors.hydrate(vectors.topk(records, asked, k, F.col("type").isin(types), within), self.nodes, columns)

    def search_nodes(self, queries: DataFrame, types: list[str] | None = None, k: int = 10) -> DataFrame:
        """The k best nodes for each row of queries(query_id, text), in one repo if queries have the column repo."""
        return self._search(self.vectors, queries, types or ["File", "Class", "Method"], k, ["name", "label"])

    def search_code(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k best classes and methods by their code, as search_nodes, with the path and the beginning of the code."""
        return self._search(self.code_vectors, queries, ["Class", "Method"], k, ["name", "label", "file_path", F.left("code", F.lit(semantic.HIT_CODE)).alias("code")])


#: The columns of nodes, before summaries.
NODE = ["id", "label", "name", "repo", "path", "file_path", "start_line", "end_line", "language", "code", "content", "real_type", "file_type"]
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Settings:
    """What a build is given beside its files: answers on modules (see with_modules), the embedding and chat providers by name, and the chat's table of answers."""

    responses: DataFrame | None = None
    provider: str | None = None
    chat: str | None = None
    cache: str | None = None


def structure_nodes(facts: DataFrame, dirs: DataFrame, found: DataFrame) -> DataFrame:
    """Repository, Directory, File, Class and Method nodes; columns that found lacks are null."""
    of_symbols = [c for c in ("id", "label", "name", "repo", "file_path", "start_line", "end_line", "language", "code", "real_type") if c in found.columns]
    parts = [
        facts.select("repo").distinct().select(C.node_id("repo", "repo").alias("id"), F.lit("Repository").alias("label"), F.col("repo").alias("name"), "repo"),
        dirs.select("id", F.lit("Directory").alias("label"), "name", "repo", "path"),
        facts.select("id", F.lit("File").alias("label"), "name", "repo", "path", "language", "content", "file_type"),
        found.select(*of_symbols),
    ]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part, allowMissingColumns=True)
    for column in NODE:
        if column not in nodes.columns:
            nodes = nodes.withColumn(column, F.lit(None).cast("string"))
    return nodes.select(*NODE)


def structure_stage(spark: SparkSession, known: Tables, _: Settings) -> Tables:
    """files, directories, symbols and contain (edges) of corpus(repo, path, content)."""
    facts = checkpointed(files_ops.with_file_facts(known["corpus"]))
    dirs, found = files_ops.directories(facts), checkpointed(symbols.symbol_nodes(symbols.symbols(facts)))
    return {"files": facts, "directories": dirs, "symbols": found, "contain": graph.contain_edges(facts, dirs, found)}


def dependency_stage(spark: SparkSession, known: Tables, _: Settings) -> Tables:
    """dependencies: USE edges between files and CALL edges between methods."""
    calls = references.call_edges(known["symbols"].where("label = 'Method'"))
    return {"dependencies": references.use_edges(known["files"]).unionByName(calls, allowMissingColumns=True)}


def semantic_stage(spark: SparkSession, known: Tables, settings: Settings) -> Tables:
    """summaries: id, label, name, repo and summary of methods, classes and files, each from what is below it."""
    found, contain = known["symbols"], known["contain"]
    methods, calls = found.where("label = 'Method'"), known["dependencies"].where("rel_type = 'CALL'")
    if settings.chat is None:
        made = semantic.extractive_summaries(methods, calls)
    else:
        made = semantic.bottom_up_summaries(methods, calls, layers.call_layers(methods.select("id"), calls), provider=settings.chat, cache=settings.cache)
    of_methods = methods.join(made.select("id", "summary"), "id").select("id", "label", "name", "repo", "summary")
    classes = graph.children_summaries(found.where("label = 'Class'").select("id", "label", "name", "repo"), contain, of_methods, "method_summaries")
    of_classes = semantic.rollup_summaries(classes, ["method_summaries"]).select("id", "label", "name", "repo", "summary")
    files = known["files"].where("file_type = 'code'").select("id", F.lit("File").alias("label"), "name", "repo")
    files = graph.children_summaries(graph.children_summaries(files, contain, of_classes, "class_summaries"), contain, of_methods, "method_summaries")
    of_files = semantic.rollup_summaries(files, ["class_summaries", "method_summaries"]).select("id", "label", "name", "repo", "summary")
    return {"summaries": of_methods.union(of_classes).union(of_files)}


def module_stage(spark: SparkSession, known: Tables, settings: Settings) -> Tables:
    """semantic_nodes (modules and workflows) and semantic_edges."""
    nodes, edges = with_modules(_graph(known), settings.responses)
    return {"semantic_nodes": nodes, "semantic_edges": edges}


def vector_stage(spark: SparkSession, known: Tables, settings: Settings) -> Tables:
    """vectors of summaries, code_vectors of classes and methods, and details: chunks of the contents of files."""
    every = known["summaries"].union(known["semantic_nodes"].select("id", "label", "name", "repo", "summary"))
    code = known["symbols"].where("label in ('Class', 'Method')")
    files = known["files"].select("id", F.lit("File").alias("label"), "name", "repo", "content")
    return {
        "vectors": vectors.vector_records(vectors.embed_nodes(every, provider=settings.provider)),
        "code_vectors": vectors.code_records(vectors.embed_nodes(code, "code", settings.provider)),
        "details": vectors.detail_records(files, provider=settings.provider),
    }


#: The functions of dims.STAGES, in their order.
STAGES: dict[str, Callable[[SparkSession, Tables, Settings], Tables]] = {
    "structure_graph_build": structure_stage,
    "dependency_graph_build": dependency_stage,
    "semantic_analysis": semantic_stage,
    "module_detection": module_stage,
    "vector_db_store": vector_stage,
}


def _graph(known: Tables) -> KnowledgeGraph:
    """The graph that the tables so far stand for."""
    nodes = structure_nodes(known["files"], known["directories"], known["symbols"])
    edges = known["contain"]
    for name in ("dependencies", "semantic_edges"):
        edges = edges.unionByName(known[name], allowMissingColumns=True) if name in known else edges
    if "summaries" in known:
        nodes = nodes.join(known["summaries"].select("id", "summary"), "id", "left")
    if "semantic_nodes" in known:
        nodes = nodes.withColumn("description", F.lit(None).cast("string")).unionByName(known["semantic_nodes"], allowMissingColumns=True)
    if "vectors" in known:
        nodes = nodes.join(known["vectors"].select(F.col("node_id").alias("id"), F.col("id").alias("embedding_id")), "id", "left")
    return KnowledgeGraph(known["files"], known["directories"], known["symbols"], nodes, edges, known.get("vectors"), known.get("code_vectors"), known.get("details"))


def structure(spark: SparkSession, corpus: DataFrame) -> KnowledgeGraph:
    """The structure and dependency graph of files(repo, path, content)."""
    known: Tables = {"corpus": corpus}
    for stage in (structure_stage, dependency_stage):
        known |= stage(spark, known, Settings())
    return _graph(known)


def label_counts(corpus: DataFrame) -> DataFrame:
    """repo, label and n of the structure's nodes, without the code of symbols or any edge."""
    facts = files_ops.with_file_facts(corpus)
    found = symbols.symbol_nodes(symbols.symbols(facts, code=False))
    return structure_nodes(facts, files_ops.directories(facts), found).groupBy("repo", "label").agg(F.count("*").alias("n"))


def with_modules(kg: KnowledgeGraph, responses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Module and Workflow nodes (id, label, name, repo, summary, description) and their edges.

    responses(repo, response) are a model's answers to structure_doc; without them modules are top directories and workflows what is connected in them.
    """
    if responses is None:
        modules, workflows, edges = semantic.default_modules(checkpointed(semantic.detect_modules(kg.files, kg.edges.where("rel_type = 'USE'"))))
    else:
        modules, workflows = semantic.explode_modules(semantic.parse_modules(responses))
        workflows = workflows.withColumn("description", F.lit(None).cast("string"))
        edges = semantic.file_module_edges(modules, kg.files).union(semantic.file_module_edges(workflows, kg.files)).union(semantic.workflow_contains(workflows, kg.symbols))
        edges = edges.union(workflows.select("repo", F.col("id").alias("src"), F.col("module_id").alias("dst"), F.lit("BELONG_TO")))
    labelled = lambda df, label: df.select("id", F.lit(label).alias("label"), "name", "repo", "summary", "description")
    return labelled(modules, "Module").union(labelled(workflows, "Workflow")), edges


def build_knowledge_graph(spark: SparkSession, corpus: DataFrame, responses: DataFrame | None = None, provider: str | None = None, chat: str | None = None, cache: str | None = None) -> KnowledgeGraph:
    """Structure, dependencies, summaries, modules with workflows, and vectors of files(repo, path, content); nothing is left at rest.

    responses: see with_modules; provider: see vectors.embed_nodes; chat and cache: see semantic.bottom_up_summaries.
    """
    known: Tables = {"corpus": corpus}
    for stage in STAGES.values():
        known |= {name: df if name in ("files", "symbols") else checkpointed(df) for name, df in stage(spark, known, Settings(responses, provider, chat, cache)).items()}
    return _graph(known)


class RunLog:
    """The events of one run in a log at ``path``: what its stages did, and where their tables are."""

    def __init__(self, spark: SparkSession, path: str, run_id: str, repos: DataFrame):
        self.spark, self.path, self.run_id, self.repos = spark, path, run_id, repos

    def events(self) -> DataFrame:
        return tables.read_events(self.spark, self.path).where(F.col("pipeline_id") == self.run_id)

    def append(self, event: str, stage: str | None = None, error: str | None = None, **metadata: str) -> None:
        """One event for each repo of the run, numbered on from those that are there."""
        seq = self.events().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        pairs = [F.lit(x) for pair in metadata.items() for x in pair]
        row = self.repos.select(
            F.col("repo").alias("repo_id"), F.lit(self.run_id).alias("pipeline_id"), F.lit(datetime.now(UTC)).alias("timestamp"), F.lit(seq).cast("long").alias("seq"), F.lit("ERROR" if error else "INFO").alias("level"),
            F.lit(event).alias("event"), F.lit(stage).cast("string").alias("stage"), F.lit(error).cast("string").alias("error"), (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("metadata"),
        )
        tables.append_events(row, self.path)

    def done(self) -> dict[str, str]:
        """The stages that are complete for all repos of the run, before the first that is not, with the folders of their tables."""
        events = self.events()
        open_ = self.repos.select(F.col("repo").alias("repo_id")).join(runs.resume_stage(events), "repo_id", "left")
        # A repo without events has no row of its own in resume_stage: nothing is done for it.
        known = events.select("repo_id").distinct()
        if not self.repos.select(F.col("repo").alias("repo_id")).join(known, "repo_id", "left_anti").isEmpty():
            return {}
        # Five stages at most.
        first = {r["stage"] for r in open_.select("stage").distinct().collect()} - {None}
        at = {r["stage"]: r["folder"] for r in events.where("event = 'stage_completed'").groupBy("stage").agg(F.max_by(F.col("metadata")["folder"], "seq").alias("folder")).collect()}
        out = {}
        for stage, _, _ in dims.STAGES:
            if stage in first or stage not in at:
                break
            out[stage] = at[stage]
        return out


def build_at_rest(spark: SparkSession, corpus: DataFrame, root: str, run_id: str, settings: Settings = Settings()) -> KnowledgeGraph:
    """build_knowledge_graph with its tables, log of events and registry below ``root``, a folder that all executors see; it goes on where it ended.

    A stage appends that it has started, writes its tables into a new folder, and appends that it is complete with the folder's name: only then do its tables
    count. A run that is called again with the same run_id reads what the log says is complete and starts at the first open stage; what an interrupted stage
    left is not read. A stage that fails appends so, with the error, and raises it. run_id stands for one corpus. The registry holds each repo as
    Pending, Completed or Failed.
    """
    repos = checkpointed(corpus.select("repo").distinct())
    log, registry = RunLog(spark, f"{root}/events", run_id, repos), f"{root}/registry"
    done, known = log.done(), {"corpus": corpus}
    if not done:
        log.append("pipeline_started")
    tables.upsert_registry(spark, registry, repos.select(F.col("repo").alias("repo_id"), F.lit("Pending").alias("initial_status"), F.col("repo").alias("repo_name"), F.lit(root).alias("repo_path")))
    for stage, make in STAGES.items():
        folder = done.get(stage)
        if folder is None:
            folder = f"{root}/{run_id}/{stage}-{uuid.uuid4().hex}"
            log.append("stage_started", stage)
            try:
                made = make(spark, known, settings)
                for name, df in made.items():
                    df.write.parquet(f"{folder}/{name}")
            except Exception as e:
                log.append("stage_failed", stage, str(e)[:500])
                tables.upsert_registry(spark, registry, repos.select(F.col("repo").alias("repo_id"), F.lit("Failed").alias("initial_status")))
                raise
            log.append("stage_completed", stage, folder=folder, tables=",".join(made))
            names = [*made]
        else:
            names = log.events().where((F.col("stage") == stage) & (F.col("metadata")["folder"] == folder)).select(F.col("metadata")["tables"].alias("t")).first()["t"].split(",")
        known |= {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    if log.events().where("event = 'pipeline_completed'").isEmpty():
        log.append("pipeline_completed")
    tables.upsert_registry(spark, registry, repos.select(F.col("repo").alias("repo_id"), F.lit("Completed").alias("initial_status")))
    return _graph(known)
