"""Declarations of classes, methods and functions, found line by line with the patterns of each language.

Strings and comments are blanked first, keeping line breaks. A declaration stands on one line (its parameters may go over several); braces or, in
Python, indentation close it. All of it is done where the file's row is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.functions import columns as C
from repograph.functions import dims

FILE = ["repo", "path"]


def _only_breaks(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]+", "")


def blanked(content: Column, language: Column) -> Column:
    """Content without what stands in strings and comments; lines stay where they are."""
    python = F.array_join(F.transform(F.split(content, "\"\"\""), lambda part, i: F.when(F.pmod(i, F.lit(2)) == 1, _only_breaks(part)).otherwise(part)), "")
    python = F.regexp_replace(F.regexp_replace(python, r"\"(\\.|[^\"\\\n])*\"|'(\\.|[^'\\\n])*'", "''"), r"#[^\n]*", "")
    quoted = F.regexp_replace(content, r"\"(\\.|[^\"\\\n])*\"|`[^`\n]*`", '""')
    quoted = F.when(language == "rust", F.regexp_replace(quoted, r"'(\\.|[^'\\\n])'", "''")).otherwise(F.regexp_replace(quoted, r"'(\\.|[^'\\\n])*'", "''"))
    rest = F.array_join(F.transform(F.split(quoted, r"/\*"), lambda part, i: F.when(i == 0, part).otherwise(F.concat(_only_breaks(F.substring_index(part, "*/", 1)), F.regexp_extract(part, r"(?s)\*/(.*)", 1)))), "")
    return F.when(language == "python", python).otherwise(F.regexp_replace(rest, r"//[^\n]*", ""))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def _declared(language: Column, text: Column) -> Column:
    """What a line declares: kind, symbol_type, name and, in Go, the receiver; null for nothing."""
    found = F.lit(None).cast("struct<kind:string,symbol_type:string,name:string,receiver:string>")
    for own, rules in dims.DECLARATIONS.items():
        for kind, symbol_type, regex, group in reversed(rules):
            made = F.struct(F.lit(kind).alias("kind"), F.lit(symbol_type).alias("symbol_type"), F.regexp_extract(text, regex, group).alias("name"), (F.regexp_extract(text, regex, 1) if group > 1 else F.lit(None).cast("string")).alias("receiver"))
            found = F.when((language == own) & text.rlike(regex), made).otherwise(found)
    return found


def lines_of(files: DataFrame) -> DataFrame:
    """Code files with arrays of an entry for each line, strings and comments blanked.

    opens: braces that open; change: those less the ones that close; indent: -1 for a blank line or one that begins by closing a bracket; stops: whether
    the line ends a statement; named: the name behind a closing brace. declared holds line_no, arrow (an arrow function) and what _declared finds.
    """
    text = files.where("language is not null").withColumn("_text", F.split(blanked(F.col("content"), F.col("language")), "\n"))
    each = lambda made: F.transform("_text", made)
    facts = each(lambda t, i: F.struct((i + 1).alias("line_no"), t.contains("=>").alias("arrow"), _declared(F.col("language"), t).alias("d")))
    return text.withColumns({
        "opens": each(lambda t: _count(t, r"\{")),
        "_closes": each(lambda t: _count(t, r"\}")),
        "indent": each(lambda t: F.when(t.rlike(r"^\s*[^\s)\]}]"), F.length(t) - F.length(F.ltrim(t))).otherwise(-1)),
        "stops": each(lambda t: t.rlike(r";\s*$")),
        "named": each(lambda t: F.regexp_extract(t, r"^\s*\}\s*(\w+)\s*;", 1)),
        "declared": F.filter(facts, lambda f: f["d"].isNotNull()),
    }).withColumn("change", F.zip_with("opens", "_closes", lambda a, b: a - b)).drop("_text", "_closes")


def _ends_by_indent(indent: list[int]) -> list[int]:
    """For each line the last line, blank ones left out, before the next that is indented no deeper; one pass with a stack of open lines."""
    ends, stack, last = list(range(len(indent))), [], -1
    for line, own in enumerate(indent):
        if own < 0:
            continue
        while stack and indent[stack[-1]] >= own:
            ends[stack.pop()] = last
        stack.append(line)
        last = line
    for line in stack:
        ends[line] = last
    return ends


def _ends_by_braces(declared: list[tuple[int, bool]], opens: list[int], change: list[int], stops: list[bool]) -> list[int | None]:
    """For each of declared(line, arrow) the line that closes it, None without a body; one pass with a stack of open bodies.

    A body begins with the first brace that opens and ends where the depth is back to what it was before the declaration. An arrow function without braces
    ends with its statement; other declarations need a body that opens before a statement ends.
    """
    n, begins, ends, depth = len(opens), {}, [None] * len(declared), 0
    before = [0] * n
    for line in range(n):
        before[line] = depth
        depth += change[line]
    opening = stopping = None
    at = len(declared) - 1
    for line in range(n - 1, -1, -1):
        opening, stopping = line if opens[line] > 0 else opening, line if stops[line] else stopping
        while at >= 0 and declared[at][0] == line:
            arrow = declared[at][1]
            if opening is not None and (stopping is None or stopping >= opening):
                begins.setdefault(opening, []).append(at)
            elif arrow:
                ends[at] = line if opening is None and stopping is None else stopping
            at -= 1
    stack: list[tuple[int, int]] = []
    for line in range(n):
        # Bodies that open on one line: the outermost goes first, so that depths grow along the stack.
        stack += sorted((before[declared[i][0]], i) for i in begins.get(line, ()))
        while stack and stack[-1][0] >= before[line] + change[line]:
            ends[stack.pop()[1]] = line
    return ends


def _around(spans: list[tuple[int, int, bool]]) -> list[int]:
    """For each of spans(first, last, whether it holds others), in order, the innermost holder around it, or -1."""
    found, stack = [], []
    for i, (first, last, holds) in enumerate(spans):
        while stack and spans[stack[-1]][1] < first:
            stack.pop()
        found.append(stack[-1] if stack else -1)
        if holds:
            stack.append(i)
    return found


def scopes(language: str, declared: list[dict], opens: list[int], change: list[int], indent: list[int], stops: list[bool], named: list[str], by_indent: bool) -> list[tuple]:
    """Symbols of one file as (kind, symbol_type, name, parent_name, start_line, end_line), each line looked at a bounded number of times."""
    at = [d["line_no"] - 1 for d in declared]
    if by_indent:
        by_line = _ends_by_indent(indent)
        ends = [by_line[line] for line in at]
    else:
        ends = _ends_by_braces([(line, d["arrow"]) for line, d in zip(at, declared, strict=True)], opens, change, stops)
    closed = []
    for line, end, d in zip(at, ends, declared, strict=True):
        # An anonymous struct is named where it closes.
        name = None if end is None else named[end] if d["d"]["kind"] == "typedef" else d["d"]["name"]
        if name:
            closed.append((line, end, d["d"] | {"name": name}))
    around = _around([(line, end, d["kind"] in ("class", "scope")) for line, end, d in closed])
    last: dict[tuple, tuple] = {}
    for (line, end, d), outer in zip(closed, around, strict=True):
        kind, holder = d["kind"], closed[outer][2] if outer >= 0 else None
        if kind == "scope":
            continue
        is_class = kind in ("class", "typedef")
        parent = d["receiver"] if kind == "receiver" else None if is_class or holder is None or language in ("go", "c") else holder["name"]
        what = "class" if is_class else "method" if parent is not None else "function" if kind == "function" else None
        if what is None or what == "method" and (holder is not None and holder["symbol_type"] in ("interface", "trait") or language in ("java", "cpp") and d["name"] == parent):
            continue
        # Of symbols with the same kind, parent and name the last stays.
        last[what, parent or "", d["name"]] = (what, d["symbol_type"] if is_class else what, d["name"], parent, line + 1, end + 1)
    return list(last.values())


SYMBOL = "struct<kind:string,symbol_type:string,name:string,parent_name:string,start_line:int,end_line:int>"
_MARKS = ("opens", "change", "indent", "stops", "named")


def _scoped(batches: Iterator[pa.RecordBatch], by_indent: frozenset[str]) -> Iterator[pa.RecordBatch]:
    fields = {"kind": pa.string(), "symbol_type": pa.string(), "name": pa.string(), "parent_name": pa.string(), "start_line": pa.int32(), "end_line": pa.int32()}
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("declared")), 0))
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            language, declared, *marks = (part.column(c).to_pylist() for c in ("language", "declared", *_MARKS))
            found = [[dict(zip(fields, s, strict=True)) for s in scopes(l, d, *m, l in by_indent)] for l, d, *m in zip(language, declared, *marks, strict=True)]
            kept = [part.column(c) for c in (*FILE, "language", "content")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.struct([*fields.items()])))], names=[*FILE, "language", "content", "found"])


def symbols(files: DataFrame, code: bool = True) -> DataFrame:
    """repo, path, language, kind (class, method or function), symbol_type, name, parent_name, start_line, end_line and, if asked for, code.

    files needs repo, path, language and content. A method belongs to the innermost class around it (in Go to its receiver's type, in Rust to the type
    of its impl); constructors of Java and C++, and declarations without a body, are left out. Of symbols with the same kind, parent and name in a file
    the last stays. Lines are matched with the patterns by Spark; where a declaration ends and what is around it is found in one ordered pass of each
    file, with a stack. Nothing is shuffled. Files without a declaration go no further than that pass: a filter before it would be put below the columns
    that it is made of, and so work out every pattern, with what the language is made of in each, again.
    """
    marked = lines_of(files).select(*FILE, "language", (F.col("content") if code else F.lit(None).cast("string")).alias("content"), "declared", *_MARKS)
    by_indent = frozenset(dims.BY_INDENT)
    found = marked.mapInArrow(lambda batches: _scoped(batches, by_indent), f"repo string, path string, language string, content string, found array<{SYMBOL}>")
    text = F.split("content", "\n")
    sliced = lambda s: F.array_join(F.slice(text, s["start_line"], s["end_line"] - s["start_line"] + 1), "\n")
    with_code = F.transform("found", lambda s: F.struct(s.alias("s"), (sliced(s) if code else F.lit(None).cast("string")).alias("code")))
    each = found.select(*FILE, "language", F.explode(with_code).alias("e")).select(*FILE, "language", "e.s.*", "e.code")
    return each if code else each.drop("code")


def symbol_nodes(found: DataFrame) -> DataFrame:
    """Class and Method nodes of symbols, with natural keys."""
    is_class = F.col("kind") == "class"
    key = F.when(is_class, C.node_id("class", "repo", "path", "name")).when(F.col("parent_name").isNotNull(), C.node_id("method", "repo", "path", "parent_name", "name")).otherwise(C.node_id("method", "repo", "path", "name"))
    code = ["code"] if "code" in found.columns else []
    return found.select(key.alias("id"), F.when(is_class, "Class").otherwise("Method").alias("label"), "name", "repo", F.col("path").alias("file_path"), "start_line", "end_line", "language", *code, F.when(is_class, C.real_type(F.col("symbol_type"))).alias("real_type"), "parent_name")

