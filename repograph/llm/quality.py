"""Quality rules: text statistics and a decision list learned from labelled ones.

The list is learned by sequential covering: rules for the low-quality class are grown one after another, each a conjunction of
thresholds on statistics chosen by information gain on two thirds of the labelled rows, then pruned on the other third and kept
only if it stays precise there; rows that a rule covers leave the set before the next one is grown. Rows that the fixed rule
rejects take no part, as the list never judges them. The rules in order become one
nested conditional expression of Spark, which judges every document in the scan.

All counting over labelled rows is done by Spark aggregations; the driver sees the counts for each statistic and threshold only.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import BLANKS, checkpointed, text_or_empty

#: A fixed bound on the labelled rows that the rules are learned from; which ones follows from a hash of doc_id.
MAX_LABELLED = 20_000
#: Thresholds tried for each statistic.
N_THRESHOLDS = 24
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule must cover so many rows of the growing set, and so large a part of what it covers in the pruning set must be of low quality.
LEAST_COVERED, LEAST_PRECISION = 5, 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics as parts of a whole, so that thresholds mean the same at every length.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_part": ("n_symbols", "word_chars"),
    "dup_line_part": ("n_dup_lines", "n_lines"),
    "repeat_part": ("n_repeat_words", "n_words"),
    "upper_part": ("n_upper", "word_chars"),
    "line_words": ("n_words", "n_lines"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(places: Column) -> Column:
    """Words in the windows at these places."""
    return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))))


def _beside(rows: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """The rows that equal the one before or after them."""
    same = lambda x, y: F.coalesce(equal(x, y), F.lit(False))
    return F.filter(rows, lambda r, j: same(r, F.get(rows, j + 1)) | F.when(j > 0, same(r, F.get(rows, j - 1))).otherwise(False))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more among the words, the first one included.

    The upper bits of a window's hash and its place make one long, with as many bits for the place as the text needs, so that windows that may be equal meet in
    a sorted array of longs. Only those, few in most texts, are sorted again by their whole hash, which decides.
    """
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def counted(upper: Column) -> Column:
        place = lambda k: k.bitwiseAND(F.bitwise_not(upper)).cast("int")
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: hashed(i).bitwiseAND(upper).bitwiseOR(i.cast("long"))))
        near = let(keys, lambda held: _beside(held, lambda x, y: x.bitwiseXOR(y).bitwiseAND(upper) == 0))
        whole = F.array_sort(F.transform(near, lambda k: F.struct(hashed(place(k)).alias("h"), place(k).alias("i"))))
        return let(whole, lambda held: _covered(F.transform(_beside(held, lambda x, y: x.h == y.h), lambda r: r.i)))

    bits = F.ceil(F.log2(F.size(words).cast("double"))).cast("int")
    return F.when(F.size(words) >= 3, let(F.call_function("shiftleft", F.lit(-1).cast("long"), bits), counted)).otherwise(F.lit(0))


def statistics(text: Column) -> Column:
    """The counts that the rules use, as a struct of longs, found in the whole text; a null text counts as empty.

    One expression that names nothing twice, so that it is worked out once for a row wherever the optimizer moves it.
    """
    without = lambda t, chars: F.length(t) - F.length(F.regexp_replace(t, chars, ""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    def of_words(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        return F.struct(F.size(words).alias("n"), chars.alias("chars"), repeated_words(words).alias("repeated"))

    def of(t: Column) -> Column:
        words = let(F.filter(F.split(t, f"[{BLANKS}]+"), lambda w: w != ""), of_words)
        lines = let(F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), of_lines)
        return F.struct(words.alias("words"), lines.alias("lines"), without(t, r"[#*$%&|<>]+").alias("symbols"), without(t, r"[A-Z]+").alias("upper"))

    def named(s: Column) -> Column:
        by_name = {"n_words": s.words.n, "word_chars": s.words.chars, "n_symbols": s.symbols, "n_dup_lines": s.lines.dup, "n_repeat_words": s.words.repeated, "n_lines": s.lines.n, "n_upper": s.upper}
        return F.struct(*(c.cast("long").alias(name) for name, c in by_name.items()))

    return let(let(text_or_empty(text), of), named)


def ratio(s: Column, name: str) -> Column:
    over, under = RATIOS[name]
    return F.coalesce(s[over] / F.nullif(s[under], F.lit(0)), F.lit(0.0))


def base_failed(s: Column) -> Column:
    """The fixed rule: too few words, or too many in repeated windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    """A statistic that is at least (or below) a threshold."""

    name: str
    at_least: bool
    threshold: float

    def column(self, s: Column) -> Column:
        value = ratio(s, self.name)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule, s: Column) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column(s)
    return out


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gain of covering bad and good rows instead of those before."""
    if not bad:
        return -math.inf
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def with_steps(rows: DataFrame, thresholds: dict[str, list[float]]) -> DataFrame:
    """rows with ``steps``: for each statistic the number of its thresholds that the value reaches."""
    reached = lambda name, ts: F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: ratio(F.col("s"), name) >= t)) if ts else F.lit(0)
    return rows.withColumn("steps", F.array(*(reached(name, ts) for name, ts in thresholds.items())))


def _counted(rows: DataFrame, thresholds: dict[str, list[float]]) -> list[tuple[str, float, int, int]]:
    """For each statistic and threshold: low-quality and other rows at or above it. One pass that counts rows by step."""
    found = rows.select("bad", F.posexplode("steps").alias("k", "step")).groupBy("k", "step").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    out = []
    for k, (name, ts) in enumerate(thresholds.items()):
        bad = good = 0
        by_step = {r.step: r for r in found if r.k == k}
        for step in range(len(ts), 0, -1):
            r = by_step.get(step)
            bad, good = bad + (r.bad if r else 0), good + (r.good if r else 0)
            out.append((name, ts[step - 1], bad, good))
    return out


def _grown(rows: DataFrame, thresholds: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    bad, good = rows.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    while bad and good and len(rule) < MAX_CONDITIONS:
        options = []
        for name, t, above_bad, above_good in _counted(rows.where(holds(rule, F.col("s"))), thresholds):
            options += [(_gain(above_bad, above_good, bad, good), Condition(name, True, t), above_bad, above_good)]
            options += [(_gain(bad - above_bad, good - above_good, bad, good), Condition(name, False, t), bad - above_bad, good - above_good)]
        options = [o for o in options if o[2] + o[3] >= LEAST_COVERED and o[2]]
        best = max(options, key=lambda o: (o[0], o[2], str(o[1])), default=None)
        if best is None or best[0] <= 0:
            break
        rule, bad, good = (*rule, best[1]), best[2], best[3]
    return rule


def learn(labelled: DataFrame) -> list[Rule]:
    """The decision list for rows of doc_id, ``bad`` (boolean) and ``s`` (their statistics): rules for bad rows, in order.

    Without rows of both kinds the list is empty. The same rows give the same rules.
    """
    s = F.col("s")
    rows = checkpointed(labelled.where("bad is not null").select("bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("third"), "s")).where(~base_failed(s))
    points = [i / N_THRESHOLDS for i in range(1, N_THRESHOLDS)]
    at = rows.agg(*(F.percentile_approx(F.when(F.col("bad") == kind, ratio(s, name)), points, 10_000).alias(f"{name}_{kind}") for name in RATIOS for kind in (True, False))).first()
    thresholds = {name: sorted({*(at[f"{name}_True"] or ()), *(at[f"{name}_False"] or ())}) for name in RATIOS}
    if not any(thresholds.values()):
        return []
    rows = checkpointed(with_steps(rows, thresholds))
    rules: list[Rule] = []
    grown: list[Rule] = []
    for _ in range(MAX_RULES):
        left = F.lit(True)
        for rule in grown:
            left = left & ~holds(rule, s)
        grow, prune = rows.where(left & (F.col("third") > 0)), rows.where(left & (F.col("third") == 0))
        rule = _grown(grow, thresholds)
        if not rule:
            break
        # Prune: the shortest beginning of the rule that is worth most on rows that it was not grown on.
        tries = [rule[:k] for k in range(1, len(rule) + 1)]
        seen = prune.agg(*(x for k, r in enumerate(tries) for x in (F.count_if(holds(r, s) & F.col("bad")).alias(f"bad{k}"), F.count_if(holds(r, s) & ~F.col("bad")).alias(f"good{k}")))).first()
        worth = [((seen[f"bad{k}"] - seen[f"good{k}"]) / max(1, seen[f"bad{k}"] + seen[f"good{k}"]), seen[f"bad{k}"], -k) for k in range(len(tries))]
        k = -max(worth)[2]
        bad, good = seen[f"bad{k}"], seen[f"good{k}"]
        grown.append(tries[k])
        if bad and bad >= LEAST_PRECISION * (bad + good):
            rules.append(tries[k])
    return rules


def verdict(rules: list[Rule], s: Column) -> Column:
    """True where no rule of the list holds."""
    out: Column | None = None
    for rule in rules:
        out = F.when(holds(rule, s), F.lit(False)) if out is None else out.when(holds(rule, s), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_statistics(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, bad (quality 0) and s (statistics) of at most ``bound`` labelled documents, chosen by a hash of doc_id.

    Labels without quality or document are left out; a document that is labelled twice counts twice.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad"))
    # Most of what is beyond the bound goes by its hash, where it is; what is left for the one task that takes the first rows is a little more than the bound.
    n = chosen.count()
    if n > 2 * bound:
        chosen = chosen.where(F.xxhash64("doc_id") < int(2**64 * 1.5 * bound / n) - 2**63)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(bound)
    # At most ``bound`` rows of 9 bytes.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "bad", statistics(F.col("text")).alias("s"))


def judge(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """docs with the counts, base_failed and kept (False if base_failed, else the verdict of the learned list).

    A null or empty text has no words and fails the base rule. Repeated rows get the same verdict. Columns of docs with the names of the counts,
    base_failed or kept are replaced.
    """
    rules, s = learn(labelled_statistics(docs, labels, bound)), F.col("_s")
    made = {c: s[c] for c in COUNTS} | {"base_failed": base_failed(s), "kept": ~base_failed(s) & verdict(rules, s)}
    judged = docs.select(F.struct("*").alias("_row"), statistics(F.col("text")).alias("_s"))
    return judged.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in made), *(v.alias(c) for c, v in made.items()))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that judge keeps, with the columns of docs."""
    rules = learn(labelled_statistics(docs, labels, bound))
    return docs.where(let(statistics(F.col("text")), lambda s: ~base_failed(s) & verdict(rules, s)))
