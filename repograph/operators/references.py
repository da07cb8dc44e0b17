"""Imports and calls, and the edges between files and between methods that they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repograph.functions import columns as C
from repograph.functions import dims
from repograph.operators.graph import checkpointed
from repograph.operators.substrings import containing


def extract_imports(files: DataFrame) -> DataFrame:
    """repo, path, language and module, one row for each import that the patterns of the language find."""
    found = F.array().cast("array<string>")
    for language, patterns in dims.IMPORT_PATTERNS.items():
        matches = F.concat(*(F.regexp_extract_all("content", F.lit(f"(?m){p}"), F.lit(1)) for p in patterns))
        found = F.when(F.col("language") == language, matches).otherwise(found)
    out = files.where("content is not null").select("repo", "path", "language", F.explode(found).alias("module"))
    return out.withColumn("module", F.trim("module")).where("module <> ''")


def extract_imports_rich(files: DataFrame) -> DataFrame:
    """repo, path, language, module, alias, names (array) and line_no of imports, with blocks in Go and wildcards in Rust."""
    lines = files.where("content is not null").select("repo", "path", "language", F.posexplode(F.split("content", "\n")).alias("_at", "text")).withColumn("line_no", F.col("_at") + 1)
    take = lambda regex, group=1: F.nullif(F.regexp_extract("text", regex, group), F.lit(""))
    names = lambda text: F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_extract(x, r"([\w*]+)", 1)), lambda x: x != "")
    block = Window.partitionBy("repo", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(F.when(F.col("text").rlike(r"^import\s*\(\s*$"), 1).when(F.col("text").rlike(r"^\)"), -1).otherwise(0)).over(block) > 0
    is_ = lambda *some: F.col("language").isin(*some)
    module = (
        F.when(is_("python"), F.coalesce(take(r"^\s*import\s+([\w.]+)"), take(r"^\s*from\s+([\w.]+)\s+import")))
        .when(is_("java", "kotlin"), take(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;"))
        .when(is_("javascript", "typescript"), F.coalesce(take(r"^\s*import\s+(?:.*?\s+from\s+)?['\"]([^'\"]+)['\"]"), take(r"require\(['\"]([^'\"]+)['\"]\)")))
        .when(is_("go"), F.coalesce(take(r"^import\s+(?:\w+\s+)?\"([^\"]+)\""), F.when(inside, take(r"^\s*(?:[\w.]+\s+)?\"([^\"]+)\""))))
        .when(is_("rust"), F.coalesce(take(r"^\s*extern\s+crate\s+(\w+)"), F.regexp_replace(take(r"^\s*(?:pub\s+)?use\s+([\w:]+)"), "::$", "")))
        .when(is_("c", "cpp"), take(r"^\s*#\s*include\s+[\"<]([^\">]+)[\">]"))
    )
    alias = F.when(is_("python"), take(r"^\s*import\s+[\w.]+\s+as\s+(\w+)")).when(is_("go"), take(r"^(?:import)?\s*([\w.]+)\s+\"")).when(is_("rust"), take(r"\s+as\s+(\w+)\s*;"))
    alias = F.when(alias != "import", alias)
    listed = F.when(is_("python"), names(take(r"^\s*from\s+[\w.]+\s+import\s+\(?([^)#]+)"))).when(is_("javascript", "typescript"), names(take(r"^\s*import\s+.*?\{([^}]*)\}"))).when(is_("rust"), names(take(r"\{([^}]*)\}")))
    out = lines.withColumns({"module": module, "alias": alias, "names": F.coalesce(listed, F.array().cast("array<string>"))})
    return out.where("module is not null").select("repo", "path", "language", "module", "alias", "names", "line_no")


def merge_imports(rich: DataFrame) -> DataFrame:
    """One row for each module of a file: the sorted union of its names, the first alias and line."""
    merged = rich.groupBy("repo", "path", "module").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.min_by("alias", F.when(F.col("alias").isNotNull(), F.col("line_no"))).alias("alias"), F.min("line_no").alias("line_no"))
    return merged


def extract_calls(methods: DataFrame) -> DataFrame:
    """repo, src, path, own_name and call_name of every call in methods(repo, id, file_path, name, code); repeats stay."""
    calls = methods.select("repo", F.col("id").alias("src"), F.col("file_path").alias("path"), F.col("name").alias("own_name"), F.explode(F.regexp_extract_all("code", F.lit(dims.CALL_PATTERN), F.lit(1))).alias("call_name"))
    return calls.where(~F.col("call_name").isin(dims.NOT_CALLS) & ~F.col("call_name").startswith("_"))


def extract_calls_rich(methods: DataFrame) -> DataFrame:
    """src, receiver, call_name and line_no (in the file) of calls, each name once a line, without calls of the method's own name and the stop names of its language."""
    lines = methods.select("repo", F.col("id").alias("src"), "name", "language", "start_line", F.posexplode(F.split("code", "\n")).alias("_at", "text"))
    pattern = r"(?:(\w+)\s*(?:\.|::|->)\s*)?([a-zA-Z_]\w*)\s*\("
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("receiver"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("call"))
    calls = lines.select("repo", "src", "name", "language", (F.col("start_line") + F.col("_at")).alias("line_no"), F.explode(both).alias("c"))
    calls = calls.select("repo", "src", "name", "language", F.nullif(F.col("c.receiver"), F.lit("")).alias("receiver"), F.col("c.call").alias("call_name"), "line_no")
    stopped = F.col("call_name").isin(dims.NOT_CALLS)
    for language, names in dims.RICH_STOPS.items():
        stopped = F.when(F.col("language") == language, F.col("call_name").isin(names)).otherwise(stopped)
    return calls.where(~stopped & (F.col("call_name") != F.col("name"))).groupBy("repo", "src", "call_name", "line_no").agg(F.min("receiver").alias("receiver"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with target (a file id of the same repo, or null) and match_tier.

    Tier 1: the module is a path or a file name. Tier 2: its last part with one of the known extensions is a file name, in their order. Tier 3, only for
    what is still open: the first path that contains the last part. The first path wins among equals.
    """
    first = F.min("path").alias("target_path")
    names = files.groupBy("repo", F.col("name").alias("key")).agg(first).union(files.select("repo", F.col("path").alias("key"), F.col("path")))
    names = names.groupBy("repo", "key").agg(F.min("target_path").alias("target_path"))
    parts = F.when(F.col("language").isin("c", "cpp"), F.regexp_replace(C.base_name(F.col("module")), r"\.[^.]+$", "")).otherwise(F.regexp_extract(F.regexp_replace(F.regexp_replace("module", r"\.", "/"), "::", "/"), r"([^/]*)$", 1))
    keyed = imports.select("repo", "module", "language").distinct().withColumn("part", parts)
    exact = keyed.join(names, (keyed["repo"] == names["repo"]) & (keyed["module"] == names["key"]), "left").select(keyed["*"], F.col("target_path").alias("_t1"))
    tried = exact.select("repo", "module", "language", F.posexplode(F.array(*(F.concat("part", F.lit(e)) for e in dims.IMPORT_EXTENSIONS))).alias("_rank", "key"))
    second = tried.join(names, ["repo", "key"]).groupBy("repo", "module", "language").agg(F.min_by("target_path", "_rank").alias("_t2"))
    both = exact.join(second, ["repo", "module", "language"], "left")
    both = checkpointed(both)
    # Only parts that nothing else resolved are looked for inside paths, once for each repo.
    open_ = both.where("_t1 is null and _t2 is null and part <> ''")
    third = containing(open_, files, "repo", "part", "path").groupBy("repo", "part").agg(F.min("path").alias("_t3"))
    found = both.join(third, ["repo", "part"], "left")
    tier = F.when(F.col("_t1").isNotNull(), 1).when(F.col("_t2").isNotNull(), 2).when(F.col("_t3").isNotNull(), 3)
    found = found.select("repo", "module", "language", F.coalesce("_t1", "_t2", "_t3").alias("target_path"), tier.alias("match_tier"))
    return imports.join(found, ["repo", "module", "language"], "left")


def use_edges(files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Edges(repo, src, dst, rel_type, match_tier) between different files, each once, with its best tier."""
    met = resolve_imports(extract_imports(files) if imports is None else imports, files).where("target_path is not null and target_path <> path")
    edges = met.groupBy("repo", "path", "target_path").agg(F.min("match_tier").alias("match_tier"))
    return edges.select("repo", C.node_id("file", "repo", "path").alias("src"), C.node_id("file", "repo", "target_path").alias("dst"), F.lit("USE").alias("rel_type"), "match_tier")


#: A name with fewer pairs of callers and targets than this many for each of them is not worth a class of its own.
FEW = 4


@dataclass(frozen=True)
class FactoredCalls:
    """Resolved calls without the pairs of names that many methods call and many have.

    plain: src, dst, call_name and same_file of the others. classes: repo, call_name, n_callers and n_targets of those names; callers(repo, call_name, src) and
    targets(repo, call_name, dst) are their members. Each caller of a class calls each of its targets, in another file. Rows in all are at most a
    few times the callers and targets.
    """

    plain: DataFrame
    classes: DataFrame
    callers: DataFrame
    targets: DataFrame

    def pairs(self) -> DataFrame:
        """repo, src, dst, call_name and same_file of all calls, the classes multiplied out."""
        more = self.callers.join(self.targets, ["repo", "call_name"]).select("repo", "src", "dst", "call_name", F.lit(False).alias("same_file"))
        return self.plain.union(more)

    def degree(self) -> DataFrame:
        """id and degree: how many different methods a method calls, itself left out, for those that call any; nothing is multiplied out.

        A method has one name, so what a method calls by one name it does not call by another; and it is asked by its own name never.
        """
        one = self.plain.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree"))
        more = self.callers.join(self.classes.select("repo", "call_name", "n_targets"), ["repo", "call_name"]).select(F.col("src").alias("id"), F.col("n_targets").alias("degree"))
        return one.union(more).groupBy("id").agg(F.sum("degree").alias("degree"))

    def counts(self) -> DataFrame:
        """repo, call_name and n: the number of calls (caller and target) by name, nothing multiplied out."""
        named = self.plain.groupBy("repo", "call_name").agg(F.count("*").alias("n"))
        return named.union(self.classes.select("repo", "call_name", F.col("n_callers") * F.col("n_targets"))).groupBy("repo", "call_name").agg(F.sum("n").alias("n"))


def factored_calls(calls: DataFrame, methods: DataFrame, few: int = FEW) -> FactoredCalls:
    """Calls resolved by name in the repo, to the methods of the same file alone where there are any (see FactoredCalls).

    Calls are made distinct before they meet their targets. A name becomes a class if callers times targets are more than ``few`` times their sum.
    """
    asked = calls.where("call_name <> own_name").select("repo", "src", "path", "call_name").distinct()
    target = methods.select("repo", F.col("name").alias("call_name"), F.col("id").alias("dst"), F.col("file_path").alias("_path"))
    local = asked.join(target.withColumnRenamed("_path", "path"), ["repo", "path", "call_name"]).select("repo", "src", "dst", "call_name", F.lit(True).alias("same_file"))
    rest = checkpointed(asked.join(target.select("repo", F.col("_path").alias("path"), "call_name").distinct(), ["repo", "path", "call_name"], "left_anti").select("repo", "call_name", "src").distinct())
    target = checkpointed(target.select("repo", "call_name", "dst").distinct())
    count = lambda df, name: df.groupBy("repo", "call_name").agg(F.count("*").alias(name))
    sizes = count(rest, "n_callers").join(count(target, "n_targets"), ["repo", "call_name"])
    classes = checkpointed(sizes.where(F.col("n_callers") * F.col("n_targets") > few * (F.col("n_callers") + F.col("n_targets"))))
    of, other = (lambda df: df.join(classes.select("repo", "call_name"), ["repo", "call_name"], "left_semi")), (lambda df: df.join(classes.select("repo", "call_name"), ["repo", "call_name"], "left_anti"))
    plain = other(rest).join(target, ["repo", "call_name"]).select("repo", "src", "dst", "call_name", F.lit(False).alias("same_file"))
    return FactoredCalls(local.union(plain), classes, of(rest), of(target))


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """repo, src, dst, call_name and same_file of all calls: factored_calls multiplied out, which a name that very many methods call and have makes large."""
    return factored_calls(calls, methods).pairs()


def call_edges(methods: DataFrame) -> DataFrame:
    """Edges(repo, src, dst, rel_type, same_file) between different methods, each once."""
    met = resolve_calls(extract_calls(methods), methods).where("src <> dst")
    return met.groupBy("repo", "src", "dst").agg(F.bool_or("same_file").alias("same_file")).select("repo", "src", "dst", F.lit("CALL").alias("rel_type"), "same_file")
