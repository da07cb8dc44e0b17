"""Spelling variants: words that differ by one code point, found through an index of variable-length grams.

Grams have 2 to LONGEST code points. A dictionary is pruned by frequency: all grams of two are in it, and a longer one is if what it has before its
last code point occurs in more than a bounded part of the words; rare grams are never made longer. A word is cut at each place into the longest
gram of the dictionary that starts there, unless that lies inside one before it.

For each place of an edit the grams of a word that it may change are known: those that it touches, those before it from where a longer
gram of the dictionary could reach over the edit, and those behind it that such a gram could cover. The most that one edit changes is the word's
bound. Two words that are one edit apart share all grams of either but for its bound, so each is listed under its rarest grams, one more than its bound.

Lists are by gram, place and the length of the shorter word (an edit moves grams by the difference of lengths at most). Grams have at most half as many code
points as the shorter word, so no edit changes all of them. A list is merged where it lies: pairs of which either lacks more grams of the other than its
bound, by bitmaps, go; the rest is verified. Long lists are dealt out block against block.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import checkpointed, removed, shuffle_partitions, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A text of more code points than this is read run by run.
LONG_TEXT = 1 << 22
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Code points of the shortest and longest grams; a gram is made longer if more than one word in PART (and LEAST words) have it, so the dictionary is bounded.
SHORTEST, LONGEST = 2, 4
PART, LEAST = 500, 16
#: Rows of a list that are compared together, of lists that are compared at once, and of a list from which on it is compared by itself.
BLOCK, TOGETHER, LARGE = 4096, 1 << 15, 64
#: Pairs that are looked at together, about, and code points of a word beyond which it is compared by itself.
VERIFIED, WIDE = 1 << 17, 64


def slips(doc_id: int | None, runs: Counter, every: int = 199) -> Iterator[tuple[str, int]]:
    """The lower-cased runs of a document and how often each occurs; where ``every`` divides the crc32 of ``doc_id:run`` one code point is left out."""
    lowered: Counter = Counter()
    for run, n in runs.items():
        # Only A-Z change: bytes know no other letters.
        lowered[run.encode().lower()] += n
    head = b"%s:" % (b"" if doc_id is None else str(doc_id).encode())
    for raw, n in lowered.items():
        run, h = raw.decode(), zlib.crc32(head + raw)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """word and n: the words of all texts of docs(doc_id, text) with so many code points and occurrences at least. Words are counted in their tasks first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    runs = Counter(RUN.findall(text) if len(text) < LONG_TEXT else (m.group() for m in RUN.finditer(text)))
                    for word, n in slips(doc_id, runs, every):
                        if len(word) >= least_length:
                            held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield made()
                    held = {}
        yield made()

    counted = docs.where("text is not null").select("doc_id", "text").mapInArrow(each, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Grams:
    """The dictionary of grams, given by the frequent ones and how often they occur: a gram is in it if it is of two or continues a frequent one."""

    def __init__(self, frequent: dict[str, int], longest: int = LONGEST):
        self.frequent, self.longest = frequent, longest
        #: What frequent grams end with: a gram of the dictionary may end with that and one code point more.
        self.ends = {g[i:] for g in frequent for i in range(1, len(g))}

    def cut(self, word: str, longest: int) -> list[tuple[int, int]]:
        """The grams of a word as (start, end), in order."""
        found, reach = [], 0
        for start in range(len(word) - SHORTEST + 1):
            end = start + SHORTEST
            while end < len(word) and end - start < longest and word[start:end] in self.frequent:
                end += 1
            if end > reach:
                found.append((start, end))
                reach = end
        return found

    def _first(self, word: str, at: int, longest: int) -> int:
        """From where a gram of the dictionary could reach over an edit at ``at``: the first start of a proper beginning of one."""
        for start in range(max(0, at - longest + 1), at):
            if at - start < SHORTEST or word[start:at] in self.frequent:
                return start
        return at

    def _last(self, word: str, at: int, longest: int) -> int:
        """Up to where a gram of the dictionary could reach that comes over an edit before ``at``: the last end of a proper end of one."""
        for end in range(min(len(word), at + longest - 1), at, -1):
            if end - at < SHORTEST or word[at : end - 1] in self.ends:
                return end
        return at

    def affected(self, word: str, grams: list[tuple[int, int]], longest: int) -> int:
        """The most grams of a word that one edit may change."""
        most, starts, ends = 0, [s for s, _ in grams], [e for _, e in grams]
        for at in range(len(word) + 1):
            # Grams lie in order of both ends. What changes lies between those that end before `first` reaches and those that start behind.
            first = self._first(word, at, longest)
            # An inserted code point stands before `at`; a changed or deleted one is at `at`.
            for behind in (at, at + 1) if at < len(word) else (at,):
                last = self._last(word, behind, longest)
                # Unchanged: grams that end by `at` and start before `first`, and grams that start from `behind` on and end after `last`.
                left = min(bisect_right(ends, at), bisect_right(starts, first - 1))
                right = min(len(grams) - bisect_right(starts, behind - 1), len(grams) - bisect_right(ends, last))
                most = max(most, len(grams) - left - right)
        return most

    def rarest(self, word: str, grams: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k grams that come first by frequency, text and place."""
        return sorted(grams, key=lambda g: (self.frequent.get(word[g[0] : g[1]], 0), word[g[0] : g[1]], g[0]))[:k]


def _bitmap(word: str, grams: list[tuple[int, int]]) -> int:
    bits = 0
    for start, end in grams:
        bits |= 1 << (zlib.crc32(word[start:end].encode()) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def entries(word: str, grams: Grams, shortest_word: int) -> Iterator[tuple[int, str, int, int, int]]:
    """The lists of a word: length of the shorter word, gram, place, bitmap of all grams and bound.

    With words of its own length and longer ones a word has its grams at their places. With shorter ones, which lack one code point, a gram's place is
    the same or one less.
    """
    for shorter in (len(word), len(word) - 1):
        if shorter < shortest_word:
            continue
        longest = min(grams.longest, shorter // 2)
        own = grams.cut(word, longest)
        bound, bits = grams.affected(word, own, longest), _bitmap(word, own)
        for start, end in grams.rarest(word, own, bound + 1):
            for place in (start,) if shorter == len(word) else (start, start - 1):
                if place >= 0:
                    yield shorter, word[start:end], place, bits, bound


ENTRIES = "list long, shorter int, word string, n long, bits long, bound int"


def listed(words: DataFrame, grams: Grams, shortest_word: int = 6) -> DataFrame:
    """The entries of words(word, n); ``list`` names gram, place and length by a hash (lists that share one are merged together, which does no harm)."""
    held = words.sparkSession.sparkContext.broadcast(grams)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = [(f"{shorter} {place} {gram}", shorter, word, n, bits, bound) for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True) for shorter, gram, place, bits, bound in entries(word, held.value, shortest_word)]
                if rows:
                    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["name", "shorter", "word", "n", "bits", "bound"])

    found = words.select("word", "n").mapInArrow(each, "name string, shorter int, word string, n long, bits long, bound int")
    return found.select(F.xxhash64("name").alias("list"), "shorter", "word", "n", "bits", "bound")


class Words:
    """Words as rows of code points, so that many pairs are told apart at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        #: Code points of the words up to WIDE; longer ones are compared as strings.
        self.codes = np.array([w if len(w) <= WIDE else "" for w in words], dtype=f"U{max(1, int(self.size.clip(max=WIDE).max(initial=1)))}")
        self.codes = self.codes.view(np.uint32).reshape(len(words), -1)

    def one_edit_apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words i and j, pair by pair, differ by exactly one inserted, deleted or replaced code point."""
        out = np.zeros(len(i), dtype=bool)
        i, j = np.where(self.size[i] >= self.size[j], i, j), np.where(self.size[i] >= self.size[j], j, i)
        size, apart = self.size[i], self.size[i] - self.size[j]
        for at in np.flatnonzero((size > WIDE) & (apart <= 1)):
            out[at] = _apart(self.words[i[at]], self.words[j[at]])
        for own in np.unique(size[(size <= WIDE) & (apart <= 1)]):
            for less in (0, 1):
                rows = np.flatnonzero((size == own) & (apart == less))
                # A million code points at a time.
                for part in np.array_split(rows, len(rows) * int(own) // (1 << 20) + 1):
                    x, y = self.codes[i[part], :own], self.codes[j[part], : own - less]
                    if less:
                        # The shorter word is the longer one without one code point: as many as it has are equal from the front and from the back together.
                        front = np.logical_and.accumulate(x[:, :-1] == y, axis=1).sum(axis=1)
                        back = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
                        out[part] = front + back >= own - 1
                    else:
                        out[part] = (x != y).sum(axis=1) == 1
        return out


def _apart(x: str, y: str) -> bool:
    """one_edit_apart for two words, x no shorter."""
    front = 0
    while front < len(y) and x[front] == y[front]:
        front += 1
    return x != y and x[front + 1 :] == (y[front + 1 :] if len(x) == len(y) else y[front:])


class Lists:
    """Rows of one or more lists, one after another, given as columns."""

    def __init__(self, group: np.ndarray, shorter: np.ndarray, words: list[str], bits: np.ndarray, bound: np.ndarray, side: np.ndarray):
        self.words, self.shorter, self.bits, self.bound, self.side = Words(words), shorter, bits.view(np.uint64), bound.astype(np.uint8), side
        self.size = self.words.size
        starts = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        self.starts, self.ends = starts, np.r_[starts[1:], len(group)]
        # The rows of a list are of one block or of two; of two, only pairs across count.
        self.apart = np.minimum.reduceat(side, starts) != np.maximum.reduceat(side, starts)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of two words that are one edit apart, many candidates verified at a time."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i, j in chain(self._of_short(), self._of_long()):
            held.append((i, j))
            size += len(i)
            if size >= VERIFIED:
                yield self._verified(held)
                held, size = [], 0
        yield self._verified(held)

    def _verified(self, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate([h[k] for h in held] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
        near = self.words.one_edit_apart(i, j)
        return i[near], j[near]

    def _merged(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray | bool) -> np.ndarray:
        """Which of the pairs i, j (arrays that broadcast) count: one has the list's length, the other at most one code point more, and each lacks no more
        grams of the other than its bound. Grams that share a bit only let more through."""
        a, b = self.size[i], self.size[j]
        met = (self.shorter[i] == self.shorter[j]) & (np.minimum(a, b) == self.shorter[i]) & (np.maximum(a, b) <= self.shorter[i] + 1)
        met &= ~np.asarray(apart) | (self.side[i] != self.side[j])
        x, y = self.bits[i], self.bits[j]
        return met & (np.bitwise_count(x & ~y) <= self.bound[i]) & (np.bitwise_count(y & ~x) <= self.bound[j])

    def _of_short(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates of lists below LARGE, by their distance in the order of rows."""
        sizes = self.ends - self.starts
        rows = np.flatnonzero(np.repeat(sizes <= LARGE, sizes))
        end, apart = np.repeat(self.ends, sizes)[rows], np.repeat(self.apart, sizes)[rows]
        for lag in range(1, LARGE):
            inside = rows + lag < end
            rows, end, apart = rows[inside], end[inside], apart[inside]
            if not len(rows):
                break
            met = self._merged(rows, rows + lag, apart)
            yield rows[met], rows[met] + lag

    def _of_long(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates of the other lists, some rows against all behind them at a time."""
        for start, end, apart in zip(self.starts, self.ends, self.apart, strict=True):
            if end - start <= LARGE:
                continue
            at, some = start, max(1, VERIFIED // (end - start))
            while at < end - 1:
                i, j = np.arange(at, min(at + some, end - 1)), np.arange(at + 1, end)
                k, m = np.nonzero(self._merged(i[:, None], j[None, :], apart) & (j[None, :] > i[:, None]))
                yield i[k], j[m]
                at += some


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of whole lists, TOGETHER rows or one list (of at most two blocks) at a time; rows come in the order of list, _i and _j."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        name, i, j, shorter, n, bits, bound, side = (table.column(c).to_numpy() for c in ("list", "_i", "_j", "shorter", "n", "bits", "bound", "side"))
        words = table.column("word").to_pylist()
        group = np.cumsum(np.r_[0, (np.diff(name) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
        found = {(words[a], words[b], int(n[a]), int(n[b])) if words[a] < words[b] else (words[b], words[a], int(n[b]), int(n[a])) for x, y in Lists(group, shorter, words, bits, bound, side).pairs() for a, b in zip(x, y, strict=True)}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["a", "b", "a_n", "b_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            last = [batch.column(c).to_numpy() for c in ("list", "_i", "_j")]
            same = np.logical_and.reduce([c == c[-1] for c in last])
            cut = 0 if same.all() else batch.num_rows - int(np.argmin(same[::-1]))
            if cut:
                held[-1] = batch.slice(0, cut)
                yield made(held)
                held = [batch.slice(cut)]
    if held:
        yield made(held)


def frequent_grams(words: DataFrame, longest: int = LONGEST) -> dict[str, int]:
    """The grams that more than one word in PART, and more than LEAST, have, with the number of words. Their number is bounded by PART times the grams of a word."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                words = batch.column("word").slice(at, 4096).to_pylist()
                held = Counter(g for w in words for g in {w[i : i + k] for k in range(SHORTEST, longest + 1) for i in range(len(w) - k + 1)})
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])

    most = max(LEAST, words.count() // PART)
    counted = words.select("word").mapInArrow(each, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counted.where(F.col("n") > most).collect()}


def near_pairs(words: DataFrame, shortest_word: int = 6) -> DataFrame:
    """a, b, a_n and b_n: all pairs of words(word, n), a before b, that are one edit apart; words have ``shortest_word`` (4 at least) code points at least."""
    spark = words.sparkSession
    found, path = written(listed(words, Grams(frequent_grams(words)), shortest_word), "grams")
    long_ = checkpointed(found.groupBy("list").count().where(F.col("count") > BLOCK).select("list", (F.call_function("div", F.col("count") - 1, F.lit(BLOCK)) + 1).alias("_blocks")))
    if long_.isEmpty():
        dealt = found.withColumns({"_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long"), "side": F.lit(0).cast("long")})
    else:
        placed = found.join(long_, "list", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long"))).withColumn("side", F.pmod(F.xxhash64("word"), F.col("_blocks")))
        placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        dealt = placed.withColumns({"_i": F.least("side", "_other"), "_j": F.greatest("side", "_other")})
    columns = ["list", "_i", "_j", "shorter", "word", "n", "bits", "bound", "side"]
    dealt = dealt.select(*columns).repartition(shuffle_partitions(spark), "list", "_i", "_j").sortWithinPartitions("list", "_i", "_j")
    pairs = checkpointed(dealt.mapInArrow(_merge, "a string, b string, a_n long, b_n long").distinct())
    removed(spark, path)
    return pairs


def variants(words: DataFrame, times: int = 5, shortest_word: int = 6) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of words(word, n).

    Words are near that are one edit apart. A word's form is its near word with the largest n (ties: smallest in code-point order) if that n is ``times``
    the word's or more, else null; its root is where forms lead to in the end. As n grows with each form, a root is found by doubling its
    pointers a few times.
    """
    words = checkpointed(words)
    pairs = near_pairs(words, shortest_word)
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m"))))
    near = pairs.select(ways.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")
    led = -F.col("best.m") >= times * F.col("n")
    known = checkpointed(known.select("word", "n", "n_near", F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n")))
    to = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        to = checkpointed(to)
        jump = to.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        if to.join(jump, "root", "left_semi").isEmpty():
            break
        to = to.join(jump, "root", "left").select("word", F.coalesce("_further", "root").alias("root"))
    return known.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """variants of the words of docs(doc_id, text): maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased.

    If ``every`` divides the crc32 h of ``doc_id:run`` (a null doc_id counts as empty), code point h % length of the run is left out. Words with fewer than ``least_length``
    code points or ``least`` occurrences are left out. Null texts have no words; rows that repeat count again.
    """
    return variants(word_counts(docs, least_length, least, every), times, least_length)
