"""N-gram Jaccard join: all links between documents whose shingle sets are similar, without comparing all pairs.

Texts with equal sets form a class; classes are compared, copies are not. If two sets link, they differ in at most D shingles, where D
follows from the smaller size and the threshold. Sizes are banded; a band cuts the hash space into more than D segments, so that two linked
sets agree on all shingles of a whole segment. The classes that agree on a segment of a band form a tile. A class belongs to the tiles of its own
band and of those bands below that a partner may be in.

Classes that share a tile with another one get a row each in a table of classes: size, parity bitmap and sorted set. It is made once, from one document
of each class, and all comparisons read it.

1. Every class is compared with the smallest one that it shares a tile with, which already joins most copies.
2. Tiles whose classes are then still in several components compare the classes of different components. The xor of two parity bitmaps (each
   shingle flips one bit) has at most as many bits as the sets differ in, so its bit count bounds the overlap from above; only pairs that pass go
   on to the exact intersection of the sorted arrays. Tiles of more than TILE classes are compared block against block in tasks of their own.
   In the first rounds every class names only its nearest partner in another component, in its largest tiles: each round joins what belongs
   together with one pair for each class. When a round joins few, all pairs of the tiles that are still open are named, so that no link is lost.

Pairs inside a component are left out in step 2: they cannot change what is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograph.llm.common import checkpointed, removed, settled, shuffle_partitions, written
from repograph.llm.components import connected_components
from repograph.llm.hashing import U64, mix, shingle_sets

#: Sizes in a band differ by this factor at most.
BAND = 1.5
#: Classes of a tile that are compared with one another or with so many others at once.
TILE = 512
#: Classes of tiles that are compared together, about, and of a tile from which on it is compared by itself.
TOGETHER, LARGE = 1 << 15, 48
#: Rounds in which a class names one partner, in so many of its tiles, go on while one joins at least this part of the classes.
LARGEST_TILES, JOINED = 2, 0.1
#: Bits of a bitmap: at least these, and so many for each shingle that two linked sets may differ in, so that few flips fall together.
LEAST_BITS, BITS_PER_DIFFERENCE = 256, 16
#: Classes of which the texts are picked by a broadcast of their ids (16 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 1_000_000
#: Rows with a set or bitmap that one task compares.
SETS = 10_000
#: Bits (4 MB at any size of the input) by which tiles of a single class are passed over before they are dealt out. When nearly all are set the test
#: passes more, and the join with the tiles decides as before.
MARKS = 1 << 25


def band_starts(longest: int) -> list[int]:
    starts = [1]
    while starts[-1] <= longest:
        starts.append(int(starts[-1] * BAND) + 1)
    return starts


def most_differing(size: int, percent: int) -> int:
    """Shingles by which a set of this size differs at most from a linked one that is no smaller."""
    return size * (100 - percent) // percent


def n_segments(band_end: int, percent: int) -> int:
    """Segments for the band of sizes below band_end; a few more than needed, so that enough of them hold shingles."""
    d = most_differing(band_end - 1, percent)
    return d + d // 16 + 2 if d else 0


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The tiles that a sorted set belongs to. Empty segments count only where the others alone don't guarantee a match."""
    n = len(shingles)
    if not n:
        return np.zeros(0, dtype=np.int64)
    starts, keys = band_starts(n), []
    scrambled = np.concatenate([[U64(0)], np.cumsum(mix(shingles + U64(0x5851F42D4C957F2D)))])
    high = shingles >> U64(32)
    least_partner = -(-n * percent // 100)
    for band, (low, end) in enumerate(zip(starts, starts[1:], strict=False)):
        if end <= least_partner or low > n or not (k := n_segments(end, percent)):
            continue
        segment = (high * U64(k)) >> U64(32)
        bounds = np.searchsorted(segment, np.arange(k + 1, dtype=np.uint64))
        held = bounds[1:] > bounds[:-1]
        wanted = held if np.count_nonzero(held) > most_differing(n, percent) else np.ones(k, dtype=bool)
        which = np.flatnonzero(wanted)
        keys.append(mix(mix((scrambled[bounds[1:]] - scrambled[bounds[:-1]])[which]) + which.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(band + 1)))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)


def fingerprint(shingles: np.ndarray, shared: frozenset[int] = frozenset()) -> tuple[int, int]:
    """Two numbers for a set, 128 bits together. The first names its class, unless it is one of those that different sets share (see twice_used)."""
    if not len(shingles):
        return 0, 0
    first, second = (int(np.add.reduce(mix(shingles ^ U64(x)), dtype=np.uint64).view(np.int64)) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
    if first in shared:
        first = int(mix(np.array([first ^ second], dtype=np.int64).view(np.uint64)).view(np.int64)[0])
    return first, second


def parity_bitmap(shingles: np.ndarray, percent: int) -> bytes:
    bits = LEAST_BITS
    while bits < BITS_PER_DIFFERENCE * most_differing(len(shingles), percent):
        bits *= 2
    flips = np.bincount((shingles & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def bound_on_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of bitmaps differ, a against every row of b: at most the number of shingles that they differ in."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A few hundred documents at a time with their sets."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield part, list(shingle_sets(texts, width))


def _made(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def key_of() -> Column:
    """What tells a document from others: doc_ids may be null or repeat with other texts."""
    return F.xxhash64("doc_id", "text")


def classes_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (see key_of), n_shingles, class and check (both halves of the fingerprint) of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches, width):
            names = np.array([fingerprint(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            yield _made(doc_id=part.column("doc_id"), key=part.column("key"), n_shingles=pa.array([len(s) for s in sets], pa.int64()), **{"class": pa.array(names[:, 0]), "check": pa.array(names[:, 1])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", key_of().alias("key"), "text").mapInArrow(each, f"doc_id {kind}, key long, n_shingles long, class long, check long")


def twice_used(classes: DataFrame) -> frozenset[int]:
    """The first halves that different sets share: N**2 / 2**65 of N classes are expected, so none below a billion and 300 of 10**11."""
    by_half = classes.groupBy("class").agg(F.min("check").alias("_low"), F.max("check").alias("_high"))
    return frozenset(r["class"] for r in by_half.where("_low <> _high").select("class").toLocalIterator())


def tiles_of(docs: DataFrame, width: int, percent: int, shared: frozenset[int] = frozenset(), marked: Broadcast | None = None) -> DataFrame:
    """class and tile, one row for each tile of each document; with ``marked`` (see marks) only tiles that are marked."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if marked is None else np.frombuffer(marked.value, dtype=np.uint8)
        for _, sets in _slices(batches, width):
            tiles = [segment_keys(s, percent) for s in sets]
            if bits is not None:
                tiles = [keys[bits[(at := keys & (MARKS - 1)) >> 3] >> (at & 7).astype(np.uint8) & 1 == 1] for keys in tiles]
            names = np.array([fingerprint(s, shared)[0] if len(keys) else 0 for s, keys in zip(sets, tiles, strict=True)], dtype=np.int64)
            yield _made(**{"class": pa.array(np.repeat(names, [len(keys) for keys in tiles])), "tile": pa.array(np.concatenate(tiles))})

    return docs.select("text").mapInArrow(each, "class long, tile long")


def tiles_of_several(tiles: DataFrame) -> DataFrame:
    """The tiles of tiles(class, tile) that hold two classes at least. Copies are counted in their tasks."""
    counted = tiles.groupBy("tile").agg(F.min("class").alias("_least"), F.max("class").alias("_most"))
    return counted.where("_least <> _most").select("tile")


def marks(tiles: DataFrame) -> Broadcast:
    """MARKS bits, of which those of the tiles are set: a bounded first test of whether a tile is one of them."""
    at = F.col("tile").bitwiseAND(F.lit(MARKS - 1))
    parts = tiles.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(MARKS // 8)
    for row in parts.toLocalIterator():
        out[row.part * 4096 : (row.part + 1) * 4096] = row.bits
    return tiles.sparkSession.sparkContext.broadcast(out)


def table_of(docs: DataFrame, width: int, percent: int, shared: frozenset[int]) -> DataFrame:
    """class, n, bitmap and shingles (the sorted set) of the rows of docs(class, text) whose text is of the class."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _slices(batches, width):
            rows = [(c, len(s), parity_bitmap(s, percent), s.tobytes()) for c, s in zip(part.column("class").to_pylist(), sets, strict=True) if fingerprint(s, shared)[0] == c]
            columns = [*zip(*rows, strict=True)] or [(), (), (), ()]
            yield _made(**{"class": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()), "bitmap": pa.array(columns[2], pa.binary()), "shingles": pa.array(columns[3], pa.binary())})

    return docs.select("class", "text").mapInArrow(each, "class long, n long, bitmap binary, shingles binary")


def sent(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it was counted to have at most BROADCAST_CLASSES rows (of 16 bytes), else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df


@F.pandas_udf(T.LongType())
def differing_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bits in which two bitmaps differ, folded to the same length."""
    return pd.Series([int(bound_on_difference(*_folded([x, y]))) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.LongType())
def in_both(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted arrays of unsigned numbers."""

    def one(x: bytes, y: bytes) -> int:
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        at = np.searchsorted(y, x)
        return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs(a, b) with n and the column of both classes; only rows of the table that pairs name are moved."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    picked, _ = settled(table.select("class", "n", column).join(sent(named), "class"), SETS)
    of = lambda side: picked.select(F.col("class").alias(side), F.col("n").alias(f"{side}_n"), F.col(column).alias(f"{side}_{column}"))
    return of("a").join(sent(pairs), "a").join(of("b"), "b")


def plausible(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) of classes that sizes and bitmaps do not rule out."""
    both = _sides(pairs, table, "bitmap").where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    sizes = F.col("a_n") + F.col("b_n")
    both = both.withColumn("_d", differing_bits("a_bitmap", "b_bitmap"))
    return both.where(100 * (sizes - F.col("_d")) >= percent * (sizes + F.col("_d"))).select("a", "b")


def verified(pairs: DataFrame, table: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """The pairs(a, b) of classes that link, by the exact intersection of their sets, and their number."""
    pairs, n = settled(pairs)
    if not n:
        return pairs, 0
    both = _sides(pairs, table, "shingles").withColumn("_both", in_both("a_shingles", "b_shingles"))
    return settled(both.where(100 * F.col("_both") >= percent * (F.col("a_n") + F.col("b_n") - F.col("_both"))).select("a", "b").distinct())


def _folded(bitmaps: list[bytes], shortest: int | None = None) -> np.ndarray:
    """Bitmaps of several lengths as rows of the shortest: halves are joined by xor, which keeps the bound."""
    shortest = shortest or min(map(len, bitmaps))
    rows = np.empty((len(bitmaps), shortest), dtype=np.uint8)
    for i, raw in enumerate(bitmaps):
        row = np.frombuffer(raw, dtype=np.uint8)
        rows[i] = row if len(row) == shortest else np.bitwise_xor.reduce(row.reshape(-1, shortest), axis=0)
    return rows.view(np.uint64)


class Compared:
    """Classes of one or more groups (a tile, or two blocks of one), given as columns."""

    def __init__(self, group: np.ndarray, name: np.ndarray, component: np.ndarray, n: np.ndarray, side: np.ndarray, bitmap: list[bytes], percent: int):
        self.group, self.name, self.component, self.n, self.side, self.bitmap, self.percent = group, name, component, n, side, bitmap, percent
        self.apart = np.minimum.reduceat(side, starts := np.flatnonzero(np.r_[True, np.diff(group) != 0])) != np.maximum.reduceat(side, starts)
        self.starts, self.ends = starts, np.r_[starts[1:], len(group)]

    def _meet(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs i, j that are in different components (and blocks, if apart) and of which the sizes allow a link."""
        low, high = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        wanted = (self.component[i] != self.component[j]) & (100 * low >= self.percent * high) & (~apart | (self.side[i] != self.side[j]))
        return i[wanted], j[wanted]

    def _pass(self, i: np.ndarray, j: np.ndarray, differing: np.ndarray) -> np.ndarray:
        # 100 * shared >= percent * union, with union = shared + difference and 2 * shared = sizes - difference.
        sizes = self.n[i] + self.n[j]
        return 100 * (sizes - differing) >= self.percent * (sizes + differing)

    def _small(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of groups below LARGE, by their distance in the order of rows."""
        sizes = self.ends - self.starts
        rows = np.flatnonzero(np.repeat(sizes <= LARGE, sizes))
        end, apart = np.repeat(self.ends, sizes)[rows], np.repeat(self.apart, sizes)[rows]
        length = np.array([len(b) for b in self.bitmap])
        for lag in range(1, LARGE):
            near = rows + lag < end
            rows, end, apart = rows[near], end[near], apart[near]
            if not len(rows):
                break
            i, j = self._meet(rows, rows + lag, apart)
            shortest = np.minimum(length[i], length[j])
            for size in np.unique(shortest):
                a, b = i[shortest == size], j[shortest == size]
                used, at = np.unique(np.r_[a, b], return_inverse=True)
                bits = _folded([self.bitmap[r] for r in used], int(size))
                differing = bound_on_difference(bits[at[: len(a)]], bits[at[len(a) :]])
                yield a, b, differing

    def _large(self, start: int, end: int, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bits = _folded(self.bitmap[start:end])
        for i in range(start, end - 1):
            a, b = self._meet(np.full(end - i - 1, i), np.arange(i + 1, end), np.bool_(apart))
            if len(b):
                yield a, b, bound_on_difference(bits[i - start], bits[b - start])

    def pairs(self, nearest: bool) -> np.ndarray:
        """Rows of two classes that may link; with ``nearest`` only the one with the fewest differing bits for each class and group."""
        found = [self._small()] + [self._large(s, e, a) for s, e, a in zip(self.starts, self.ends, self.apart, strict=True) if e - s > LARGE]
        kept = []
        for some in found:
            for i, j, differing in some:
                passed = self._pass(i, j, differing)
                if passed.any():
                    kept.append(np.column_stack([i[passed], j[passed], differing[passed]]))
        if not kept:
            return np.zeros((0, 2), dtype=np.int64)
        i, j, differing = np.concatenate(kept).T
        if nearest:
            own, other, d = np.r_[i, j], np.r_[j, i], np.r_[differing, differing]
            order = np.lexsort((self.name[other], d, own))
            first = order[np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])]
            i, j = own[first], other[first]
        a, b = self.name[i], self.name[j]
        return np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)


def _compared(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of whole groups, TOGETHER rows or one group at a time; rows come in the order of tile, _i and _j."""
    columns = ("tile", "_i", "_j", "class", "component", "n", "side")

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        tile, i, j, name, component, n, side = (table.column(c).to_numpy() for c in columns)
        group = np.cumsum(np.r_[0, (np.diff(tile) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
        pairs = Compared(group, name, component, n, side, table.column("bitmap").to_pylist(), percent).pairs(nearest)
        return _made(a=pa.array(pairs[:, 0]), b=pa.array(pairs[:, 1]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            last = [c.to_numpy(zero_copy_only=False) for c in (batch.column(x) for x in columns[:3])]
            same = np.logical_and.reduce([c == c[-1] for c in last])
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                held[-1] = batch.slice(0, cut)
                yield made(held)
                held = [batch.slice(cut)]
    if held:
        yield made(held)


def candidates(members: DataFrame, components: DataFrame, table: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs(a, b) of tiles(tile, class) whose classes are in several components."""
    placed = members.join(components, F.col("class") == F.col("node"), "left").select("tile", "class", F.coalesce("component", "class").alias("component"))
    tiles = placed.groupBy("tile").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("_who"))
    # Tiles with the same classes are compared once.
    tiles = tiles.where("_low <> _high").groupBy("_who", "_n").agg(F.min("tile").alias("tile"))
    open_ = placed.join(tiles.select("tile", "_n"), "tile")
    if nearest:
        open_ = open_.withColumn("_rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("_n"), "tile"))).where(F.col("_rank") <= LARGEST_TILES)
    open_ = open_.withColumn("_blocks", F.call_function("div", F.col("_n") - 1, F.lit(TILE)) + 1)
    open_ = open_.withColumn("_own", F.pmod(F.xxhash64("class"), F.col("_blocks")))
    # A class meets every block of its tile once: in the task (i, j) with i <= j.
    open_ = open_.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    open_ = open_.select("tile", "class", "component", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), F.col("_own").alias("side"))
    known = open_.join(table.select("class", "n", "bitmap"), "class").select("tile", "_i", "_j", "class", "component", "n", "side", "bitmap")
    # Dealt out by count and not by bytes: the work goes with pairs.
    dealt = known.repartition(shuffle_partitions(members.sparkSession), "tile", "_i", "_j").sortWithinPartitions("tile", "_i", "_j")
    return dealt.mapInArrow(lambda batches: _compared(batches, percent, nearest), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) for each row of docs(doc_id, text).

    Texts are lower-cased (A-Z) and cut into words by blanks; documents link if 100 * intersection >= percent * union of their sets of
    distinct shingles. A text with fewer than ``width`` words is one shingle; an empty or null one has none and links to nothing, so its
    component is its own doc_id. Repeated rows are rows of their own and share a component.
    """
    return _grouped(docs, width, percent).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, component (a class; null without words) and its smallest doc_id as component_id for each row of docs."""
    each = checkpointed(classes_of(docs, width))
    with_words = each.where("n_shingles > 0")
    shared = twice_used(with_words)
    if shared:
        # As in fingerprint; the value of the new name is of no matter, but it must be the same.
        renamed = F.udf(lambda a, b: int(mix(np.array([a ^ b], dtype=np.int64).view(np.uint64)).view(np.int64)[0]), T.LongType())
        each = each.withColumn("class", F.when(F.col("class").isin(*shared), renamed("class", "check")).otherwise(F.col("class")))
        with_words = each.where("n_shingles > 0")
    classes = with_words.groupBy("class").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"))
    several, several_at = written(tiles_of_several(tiles_of(docs, width, percent, shared)), "tiles")
    # Copies of a class are one before they meet the tiles.
    marked = marks(several)
    rows = tiles_of(docs, width, percent, shared, marked).distinct()
    members, members_at = written(rows.join(several, "tile").select("tile", "class"), "members")
    marked.unpersist()

    # One document of each class; a copy of it (an equal row) gives the same row of the table.
    picked, n_classes = settled(members.select("class").distinct().join(classes, "class").select("class", "key"))
    table, table_at = written(table_of(docs.select(key_of().alias("key"), "text").join(sent(picked), "key"), width, percent, shared), "classes")
    if table.count() > n_classes:
        table = table.dropDuplicates(["class"])
    least = members.groupBy("tile").agg(F.min("class").alias("_least"))
    stars = members.join(least, "tile").groupBy("class").agg(F.min("_least").alias("_least")).where("class <> _least").select(F.col("_least").alias("a"), F.col("class").alias("b"))
    stars, _ = settled(stars)
    links, _ = verified(plausible(stars, table, percent), table, percent)
    components, _ = settled(connected_components(links))
    nearest = True
    while True:
        more, joined = verified(candidates(members, components, table, percent, nearest), table, percent)
        if joined:
            links = links.union(more)
            components, _ = settled(connected_components(links))
        if not nearest:
            break
        nearest = joined > JOINED * n_classes
    removed(docs.sparkSession, several_at, members_at, table_at)

    named = classes.join(components, F.col("class") == F.col("node"), "left").select("class", "first", F.coalesce("component", "class").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = named.join(smallest, "component").select(F.col("class").alias("_class"), "component", "component_id")
    linked = each.join(by_class, (F.col("class") == F.col("_class")) & (F.col("n_shingles") > 0), "left")
    return linked.select("doc_id", "key", "n_shingles", "component", "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near copies, that with the smallest doc_id; documents without words all stay.

    Null doc_ids come last. Of texts of a group with the same doc_id that with the smallest key stays. Columns may have any name.
    """
    each = checkpointed(_grouped(docs, width, percent))
    with_words = each.where("n_shingles > 0").groupBy("component", "component_id", "doc_id", "key").agg(F.count("*").alias("_n"))
    # The smallest doc_id is null only if all of the group are.
    kept = with_words.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("key").alias("_kept"))
    judged = with_words.join(kept, "component").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "_n", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("_kept"))).alias("_stays"))
    # What goes is less than what stays, and so are rows that repeat, of which one stays.
    told = checkpointed(judged.where("not _stays or _n > 1"))
    rows = docs.select(F.struct("*").alias("_row"), key_of().alias("_own"))
    named = (F.col("_own") == F.col("_key")) & F.col("_row.doc_id").eqNullSafe(F.col("_id"))
    out = rows.join(sent(told.select("_id", "_key")), named, "left_anti").select("_row")
    repeated = told.where("_stays")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(sent(repeated), named).dropDuplicates(["_id", "_key"]).select("_row"))
    return out.select("_row.*")
