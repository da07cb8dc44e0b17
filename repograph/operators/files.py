"""Files of repositories: paths, kinds, languages, ignore rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.functions import columns as C


def with_file_facts(files: DataFrame) -> DataFrame:
    """files(repo, path, content) with id, name, suffix, file_type, language and parent_path; the path uses forward slashes."""
    path = C.normal_path(F.col("path"))
    out = files.withColumn("path", path).withColumns({"name": C.base_name(F.col("path")), "suffix": C.suffix(F.col("path")), "parent_path": C.parent_path(F.col("path"))})
    return out.withColumns({"file_type": C.file_type(F.col("suffix")), "language": C.language_of(F.col("suffix")), "id": C.node_id("file", "repo", "path")})


def directories(files: DataFrame) -> DataFrame:
    """repo, path, name and parent_path of every directory above a file."""
    parts = F.split(C.parent_path(F.col("path")), "/")
    above = files.select("repo", "path").where(F.col("path").contains("/")).select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    return above.distinct().withColumns({"name": C.base_name(F.col("path")), "parent_path": C.parent_path(F.col("path"))}).withColumn("id", C.node_id("dir", "repo", "path"))


def ignore_filter(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    return files.where(~C.ignored(F.col("path"), patterns))


def _gitignore_regex(line: Column) -> Column:
    """A line of a .gitignore, without negation, as a regular expression on a path below its folder whose directories end in a slash; it covers the name itself,
    for what lies below see gitignore_filter."""
    body = F.regexp_replace(line, r"/$", "")
    anchored = body.contains("/")
    regex = F.regexp_replace(F.regexp_replace(body, r"^/", ""), r"([.+^${}()|\\])", r"\\$1")
    for old, new in ((r"^\*\*/", "\u0001"), (r"/\*\*$", "\u0002"), (r"/\*\*/", "\u0003"), (r"\*\*", "\u0004"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(.*/)?"), ("\u0002", "/.*[^/]"), ("\u0003", "/(.*/)?"), ("\u0004", ".*")):
        regex = F.regexp_replace(regex, old, F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    start = F.when(anchored, "^").otherwise("^(.*/)?")
    return F.concat(start, regex, F.when(line.endswith("/"), "/$").otherwise("/?$"))


def gitignore_rules(files: DataFrame) -> DataFrame:
    """repo, folder (that of the .gitignore, "" at the root) and rules: an array of (negated, regex) in the order of the lines, of each .gitignore in files."""
    own = files.where((F.col("path") == ".gitignore") | F.col("path").endswith("/.gitignore"))
    lines = own.select("repo", C.parent_path(F.col("path")).alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.rtrim("line")).where("line <> '' and not startswith(line, '#')")
    negated = F.col("line").startswith("!")
    rules = lines.select("repo", "folder", "line_no", negated.alias("negated"), _gitignore_regex(F.when(negated, F.expr("substring(line, 2)")).otherwise(F.col("line"))).alias("regex"))
    return rules.groupBy("repo", "folder").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "negated", "regex"))), lambda r: F.struct(r["negated"].alias("negated"), r["regex"].alias("regex"))).alias("rules"))


@lru_cache(maxsize=65_536)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex)


def _left_out(path: str, rules: dict[str, list]) -> bool:
    """Whether rules by folder leave a path out: of each directory above it, then of the path itself, the last line that fits decides, those of the deepest
    .gitignore before those above it. Below a directory that is left out nothing is taken back in."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        name = "/".join(parts[:depth]) + ("/" if depth < len(parts) else "")
        # The folders above this name, the deepest first.
        for at in range(depth - 1, -1, -1):
            folder = "/".join(parts[:at])
            below = name[len(folder) + 1 :] if folder else name
            negated = next((r["negated"] for r in reversed(rules.get(folder, ())) if _compiled(r["regex"]).search(below)), None)
            if negated is False:
                return True
            if negated:
                break
    return False


def gitignore_filter(files: DataFrame) -> DataFrame:
    """Files that the .gitignore files of their repo keep; ``!`` takes back in what a line before it, or a .gitignore further up, leaves out (see _left_out).

    A path meets the rules of the folders above it only: they are joined by repo and folder, so a repo of any size is dealt out by folder, and what many files of a
    folder share is joined once for the folder.
    """
    parent = C.parent_path(F.col("path"))
    folders = files.select("repo", parent.alias("parent")).distinct()
    parts = F.split("parent", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("parent") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    met = folders.select("repo", "parent", F.explode(above).alias("folder")).join(gitignore_rules(files), ["repo", "folder"])
    ruled = met.groupBy("repo", "parent").agg(F.map_from_entries(F.collect_list(F.struct("folder", "rules"))).alias("_rules"))

    @F.pandas_udf("boolean")
    def left_out(path: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([r is not None and _left_out(p, dict(r)) for p, r in zip(path, rules, strict=True)])

    named = files.select(F.struct("*").alias("_row"), "repo", parent.alias("parent"), "path").join(ruled, ["repo", "parent"], "left")
    kept = named.where(F.col("_rules").isNull()).select("_row").union(named.where(F.col("_rules").isNotNull()).where(~left_out("path", "_rules")).select("_row"))
    return kept.select("_row.*")


def cap_files(files: DataFrame, most: int = 100) -> DataFrame:
    """At most so many files of each repo in the order of their paths, and whether more were left out."""
    by_repo = Window.partitionBy("repo")
    ranked = files.withColumns({"_rank": F.row_number().over(by_repo.orderBy("path")), "_n": F.count("*").over(by_repo)})
    return ranked.where(F.col("_rank") <= most).withColumn("truncated", F.col("_n") > most).drop("_rank", "_n")
