"""Column expressions on paths, texts, properties and vectors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograph.functions import dims


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last .ext of the base name, case kept; a name that starts with its only dot has none."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def language_of(suffix: Column) -> Column:
    """The language of a suffix, in any case; null if there is none."""
    out = None
    for language, suffixes in dims.SUFFIXES.items():
        known = F.lower(suffix).isin(suffixes)
        out = F.when(known, language) if out is None else out.when(known, language)
    return out


def file_type(suffix: Column) -> Column:
    low = F.lower(suffix)
    code = sorted({*dims.CODE_SUFFIXES, *(s for some in dims.SUFFIXES.values() for s in some)})
    return F.when(low.isin(code), "code").when(low.isin(dims.DOC_SUFFIXES), "doc").when(low.isin(dims.CONFIG_SUFFIXES), "config").otherwise("other")


def glob_regex(pattern: str, inside: str = "[^/]") -> str:
    """A glob as a regular expression for a whole string; * stays inside a path segment unless told otherwise."""
    out = ""
    i = 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + inside + "*", i + 1
        elif pattern[i] == "?":
            out, i = out + inside, i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + ("[^" + re.escape(body[1:]) if body[0] == "!" else "[" + re.escape(body)).replace(r"\-", "-") + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether a pattern leaves the path out: ``x/**`` everything below x, ``**/x`` the name x anywhere, else a glob on path or base name."""
    tests = []
    for pattern in dims.EXCLUDED_PATHS if patterns is None else patterns:
        if pattern.endswith("/**"):
            tests.append(path.rlike(f"^{glob_regex(pattern[:-3])[1:-1]}(/|$)"))
        elif pattern.startswith("**/"):
            tests.append(path.rlike(f"(^|/){glob_regex(pattern[3:])[1:-1]}(/|$)"))
        else:
            regex = glob_regex(pattern, ".")
            tests += [path.rlike(regex), base_name(path).rlike(regex)]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def node_id(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws("_", F.lit(kind), *parts)


def real_type(symbol_type: Column) -> Column:
    return F.initcap(F.coalesce(symbol_type, F.lit("class")))


def decoded(content: Column) -> Column:
    """Bytes as text, with what is no UTF-8 dropped."""
    return F.replace(F.call_function("make_valid_utf8", content.cast("string")), F.lit("�"), F.lit(""))


def without_nulls(properties: Column) -> Column:
    """A map of properties without nulls and blanks left by empty lists."""
    return F.map_filter(properties, lambda _, v: v.isNotNull() & (v != "[]") & (v != "{}"))


def norm(v: Column) -> Column:
    """Length of a vector in doubles, added up in order."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity in doubles, added up in order; null if a vector is zero. Norms that are known are not worked out again."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    known = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return dot / F.nullif(known, F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_embedding(text: Column, dimension: int) -> Column:
    """A vector of token counts by hash, of length one: lower-cased words of letters and digits, bucket by the first 32 bits of md5."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    buckets = F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimension)))
    counted = let(buckets, lambda held: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(held, lambda b: b == i)).cast("double")))

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(F.transform(counts, lambda c: c * c), F.lit(0.0), lambda s, x: s + x))
        return let(norm, lambda n: F.transform(counts, lambda c: F.coalesce(c / F.nullif(n, F.lit(0.0)), F.lit(0.0))))

    return let(counted, scaled)
