"""Summaries from the bottom of the call graph up, and modules with their workflows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.operators.graph import checkpointed, first_rows, with_related
from repograph.operators.providers import answered
from repograph.operators.substrings import containing

PROMPT_CODE, FILE_TEXT, DOC_SUMMARY, HIT_CODE, CALLEES = 3000, 5000, 200, 500, 5

MODULES = "struct<modules:array<struct<name:string,description:string,summary:string,confidence:double,files:array<string>,keywords:array<string>,workflows:array<struct<name:string,description:string,summary:string,confidence:double,files:array<string>,keywords:array<string>>>>>>"


def summary_prompt(code: Column, kind: Column, language: Column, docstring: Column | None = None, callees: Column | None = None) -> Column:
    """The request for a summary: the code's beginning, its documentation if any, and at most five summaries of what it uses."""
    parts = [F.concat(F.lit("Summarise this "), language, F.lit(" "), kind, F.lit(".")), F.lit("Code:"), F.left(code, F.lit(PROMPT_CODE))]
    if docstring is not None:
        parts.append(F.when(docstring != "", F.concat(F.lit("Documentation: "), docstring)))
    if callees is not None:
        some = F.slice(callees, 1, CALLEES)
        parts.append(F.when(F.size(some) > 0, F.concat(F.lit("It uses:\n"), F.array_join(F.transform(some, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))))
    return F.concat_ws("\n", *parts)


def extractive_summary(kind: Column, name: Column, start: Column, end: Column, uses: Column) -> Column:
    """The summary without a model: kind, name, number of lines and at most five names of what it uses."""
    some = F.array_join(F.slice(uses, 1, CALLEES), ", ")
    return F.concat(F.lower(kind), F.lit(" "), name, F.lit(" of "), (end - start + 1).cast("string"), F.lit(" lines"), F.when(some != "", F.concat(F.lit(" uses "), some)).otherwise(F.lit("")))


def skip_existing(nodes: DataFrame, summarised: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes with summaries: only those without one go to ``summarised``."""
    have = F.coalesce("summary", F.lit("")) != ""
    return nodes.where(have).unionByName(summarised(nodes.where(~have)))


def extractive_summaries(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """methods(id, name, start_line, end_line) with the summary without a model, for which no method has to wait for another, so no layers are needed."""
    name = methods.select(F.col("id").alias("dst"), F.col("name").alias("callee"))
    uses = with_related(methods, calls.join(name, "dst").select(F.col("src").alias("id"), F.col("callee").alias("value")), "uses")
    return uses.withColumn("summary", extractive_summary(F.lit("method"), F.col("name"), F.col("start_line"), F.col("end_line"), F.col("uses"))).drop("uses")


def bottom_up_summaries(methods: DataFrame, calls: DataFrame, layers: DataFrame, summarise: Callable[[Column], Column] | None = None, provider: str | None = None, cache: str | None = None) -> DataFrame:
    """id, level and summary of methods(id, name, start_line, end_line): each level is given the names or summaries of the one below.

    ``summarise`` turns the request column (name and summaries of the callees) into a summary; ``provider`` names a registered chat provider that is asked with
    the prompt of code and callees' summaries (methods also have code and language), see providers.answered for ``cache``. Without either the extractive
    summary is taken, whose parts are the callees' names. Levels are joined one after another, as each needs the one before.
    """
    known = None
    leveled = checkpointed(methods.join(layers.select("id", "level"), "id"))
    if summarise is None and provider is None:
        return extractive_summaries(leveled, calls).select("id", "level", "summary")
    for (level,) in leveled.select("level").distinct().orderBy("level").collect():
        now = leveled.where(F.col("level") == level)
        below = calls.join(known.select(F.col("id").alias("dst"), "summary"), "dst").select(F.col("src").alias("id"), F.col("summary").alias("value")) if known is not None else now.select("id", F.lit(None).cast("string").alias("value")).limit(0)
        uses = with_related(now, below, "uses")
        if provider is None:
            made = uses.select("id", "level", summarise(F.concat(F.col("name"), F.lit(": "), F.array_join(F.slice("uses", 1, CALLEES), "; "))).alias("summary"))
        else:
            asked = uses.select("id", "level", summary_prompt(F.col("code"), F.lit("method"), F.col("language"), callees=F.col("uses")).alias("_request"))
            made = answered(asked, "_request", provider, cache, "summary").select("id", "level", "summary")
        known = checkpointed(made if known is None else known.union(made))
    return known if known is not None else leveled.select("id", "level", F.lit(None).cast("string").alias("summary"))


def rollup_summaries(nodes: DataFrame, lists: list[str]) -> DataFrame:
    """nodes with summary: the name and at most five non-empty summaries of the given array columns, one list after another."""
    every = F.filter(F.concat(*(F.col(x) for x in lists)), lambda s: s != "")
    return nodes.withColumn("summary", F.concat(F.lower("label"), F.lit(" "), "name", F.when(F.size(every) > 0, F.concat(F.lit(": "), F.array_join(F.slice(every, 1, CALLEES), "; "))).otherwise(F.lit(""))))


def structure_doc(files: DataFrame, most: int = 100) -> DataFrame:
    """repo and doc: one JSON of at most ``most`` code files of a repo, with a note if more were left out."""
    by_repo = Window.partitionBy("repo")
    ranked = files.where("file_type = 'code'").withColumns({"_rank": F.row_number().over(by_repo.orderBy("path")), "_n": F.count("*").over(by_repo)}).where(F.col("_rank") <= most)
    item = F.struct("path", "name", F.col("suffix").alias("type"), F.left(F.coalesce("summary", F.lit("")), F.lit(DOC_SUMMARY)).alias("summary"))
    grouped = ranked.groupBy("repo").agg(F.sort_array(F.collect_list(item)).alias("files"), F.max("_n").alias("_n"))
    return grouped.select("repo", F.to_json(F.struct(F.col("repo").alias("repository"), "files", F.when(F.col("_n") > most, f"Truncated to {most} files").alias("note"))).alias("doc"))


def parse_modules(responses: DataFrame) -> DataFrame:
    """responses(repo, response) with ``modules`` (array, empty for what is no JSON); a fence around the JSON is taken off."""
    fenced = F.regexp_extract("response", r"(?s)```(?:json)?(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.col("response"))
    return responses.withColumn("modules", F.coalesce(F.from_json(F.trim(body), MODULES)["modules"], F.from_json(F.lit('{"modules":[]}'), MODULES)["modules"]))


def _semantic_id(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(kind + "_"), F.col("repo"), F.lit("_"), F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8))


def explode_modules(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Module and Workflow nodes of parsed(repo, modules): id, name, summary, confidence, keywords, files; workflows also have module_id."""
    m = parsed.select("repo", F.explode("modules").alias("m")).withColumn("name", F.coalesce("m.name", F.lit("Unknown Module")))
    confidence = lambda c: F.coalesce(c, F.lit(0.8))
    files = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    modules = m.select(_semantic_id("module", "repo", "name").alias("id"), "repo", "name", F.col("m.summary").alias("summary"), F.col("m.description").alias("description"), confidence(F.col("m.confidence")).alias("confidence"), F.coalesce("m.keywords", files(F.col("m.files"))).alias("keywords"), files(F.col("m.files")).alias("files"))
    w = m.select("repo", _semantic_id("module", "repo", "name").alias("module_id"), F.explode("m.workflows").alias("w")).withColumn("name", F.coalesce("w.name", F.lit("Unknown Workflow")))
    workflows = w.select(_semantic_id("workflow", "module_id", "name").alias("id"), "repo", "module_id", "name", F.col("w.summary").alias("summary"), confidence(F.col("w.confidence")).alias("confidence"), F.coalesce("w.keywords", files(F.col("w.files"))).alias("keywords"), files(F.col("w.files")).alias("files"))
    return modules, workflows


def default_modules(detected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Module and Workflow nodes and BELONG_TO edges of detected(repo, id, module, workflow), without a model.

    A top directory is a module; each component of its files that use one another, of two files at least, is a workflow of it. Files outside any
    directory have no module. Nothing is gathered by module: files are counted only.
    """
    placed = detected.where("module <> ''").select("repo", "id", "module", "workflow")
    counted = placed.groupBy("repo", "module").agg(F.count("*").alias("n"))
    nodes = ["id", "repo", "name", "summary", "description"]
    modules = counted.select("repo", F.col("module").alias("name"), "n").withColumn("id", _semantic_id("module", "repo", "name"))
    modules = modules.withColumns({"summary": F.concat(F.lit("module "), "name", F.lit(" of "), F.col("n").cast("string"), F.lit(" files")), "description": F.lit(None).cast("string")})
    flows = placed.groupBy("repo", "module", "workflow").agg(F.count("*").alias("n")).where("n > 1")
    flows = flows.withColumn("module_id", F.concat(F.lit("module_"), "repo", F.lit("_"), F.substring(F.md5(F.concat_ws("/", "repo", "module")), 1, 8)))
    flows = flows.withColumns({"id": _semantic_id("workflow", "module_id", "workflow"), "name": F.concat(F.lit("flow of "), "workflow"), "summary": F.concat(F.lit("workflow of "), F.col("n").cast("string"), F.lit(" files in "), "module"), "description": F.lit(None).cast("string")})
    edge = lambda df, src, dst: df.select("repo", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit("BELONG_TO").alias("rel_type"))
    of_file = placed.join(modules.select("repo", F.col("name").alias("module"), F.col("id").alias("_module")), ["repo", "module"])
    in_flow = placed.join(flows.select("repo", "module", "workflow", F.col("id").alias("_flow")), ["repo", "module", "workflow"])
    edges = edge(of_file, "id", "_module").union(edge(in_flow, "id", "_flow")).union(edge(flows, "id", "module_id"))
    return modules.select(*nodes), flows.select(*nodes, "module_id"), edges


def file_module_edges(owners: DataFrame, files: DataFrame) -> DataFrame:
    """BELONG_TO edges from the files that owners(id, repo, files) list by path; paths that are no file are dropped."""
    listed = owners.select("repo", F.col("id").alias("dst"), F.explode("files").alias("path"))
    return listed.join(files.select("repo", "path", F.col("id").alias("src")), ["repo", "path"]).select("repo", "src", "dst", F.lit("BELONG_TO").alias("rel_type")).distinct()


def workflow_contains(workflows: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """CONTAIN edges from a workflow to the first ``most`` classes or methods (by id) of its repo whose path contains a keyword, for each keyword.

    Keywords meet paths through an index of grams; of a path only its first ``most`` symbols count, so a keyword meets no more rows than ``most`` times its paths.
    """
    asked = workflows.select("repo", F.col("id").alias("src"), F.explode("keywords").alias("keyword")).distinct()
    met = containing(asked, symbols, "repo", "keyword", "file_path")
    first = first_rows(symbols.select("repo", "file_path", "id"), ["repo", "file_path"], ["id"], most)
    found = met.join(first, ["repo", "file_path"]).select("repo", "keyword", "id")
    ranked = first_rows(found, ["repo", "keyword"], ["id"], most)
    return asked.join(ranked, ["repo", "keyword"]).select("repo", "src", F.col("id").alias("dst"), F.lit("CONTAIN").alias("rel_type")).distinct()


def detect_modules(files: DataFrame, uses: DataFrame) -> DataFrame:
    """repo, id (file), module (top directory) and workflow: the smallest file id of the connected USE component inside the module."""
    placed = checkpointed(files.select("repo", "id", F.regexp_extract("path", r"^([^/]*)/", 1).alias("module")))
    side = lambda c: placed.select(F.col("id").alias(c), F.col("module").alias(f"_{c}"))
    inside = uses.join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst").select("src", "dst")
    both = checkpointed(inside.union(inside.select("dst", "src")).distinct())
    label = placed.select("id", F.col("id").alias("workflow"))
    while True:
        near = both.join(label.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("workflow").alias("_near"))
        new = label.join(near, "id", "left").select("id", F.least("workflow", F.coalesce("_near", "workflow")).alias("workflow"), "workflow")
        # Labels are file ids: following the label's own label halves the way.
        new = checkpointed(new.toDF("id", "new", "old"))
        hop = new.select(F.col("id").alias("new"), F.col("new").alias("_hop"))
        changed = new.where("new <> old").limit(1).count()
        label = checkpointed(new.join(hop, "new").select("id", F.col("_hop").alias("workflow")))
        if not changed:
            return placed.join(label, "id").select("repo", "id", "module", "workflow")


def present(nodes: DataFrame, column: str = "summary") -> DataFrame:
    """Rows of which the text is not null or blank, trimmed."""
    return nodes.withColumn(column, F.trim(column)).where(F.length(column) > 0)

