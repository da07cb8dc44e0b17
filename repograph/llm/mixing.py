"""Mixing sources to target weights by a low-discrepancy schedule.

Sources get a share of the words by weight (``water_level``: no source may give more than ``max_epochs`` times its own words,
and the excess goes to the others by weight). The mix is a row of slots of ``block`` words each. Slot i has the golden-ratio point
u(i) = frac(i * phi); the source whose interval of cumulative shares holds u(i) fills the slot. Any stretch of the mix therefore holds
each source nearly in its share. Sources whose target is a few blocks only have shorter blocks and a row of slots with their like, so that they too get
what is due to them; the rows run side by side. The documents of a source, shuffled by a hash, form a ring of words, cut into equal blocks; the
k-th slot of a source takes the k-th block, going round again after the last word, at most ``max_epochs`` times.

Everything that is counted along a source (words before a document, slots before a slot) is a prefix sum in two levels: sums of
small buckets, then sums of buckets, so that one source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.common import checkpointed, n_words

#: Points are whole numbers below 2**40; the multiplier is the odd number nearest to 2**40 / phi, so that all points occur once in a period.
POINTS, GOLDEN = 1 << 40, 679_535_556_991
#: Words in a block at most; small inputs get smaller blocks, so that there are LEAST_SLOTS slots.
LONGEST_BLOCK, LEAST_SLOTS = 1024, 1 << 16
#: Rows in a bucket of a two-level prefix sum, about.
BUCKET = 1 << 14
#: A source has so many blocks at least, as far as they can be made shorter, each time by this factor.
LEAST_BLOCKS, SHORTER = 64, 4
#: Cells of the unit interval by which points find their source with an equal join, at least and at most: as many as sources in between.
LEAST_CELLS, MOST_CELLS = 1 << 10, 1 << 20


def water_level(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources(source, weight, source_size) with ``target``: the share by weight of all words, at most max_epochs times the source's.

    The level is found in closed form: sources are ordered by cap / weight, and the first for which the rest's level reaches it ends
    the saturated ones. The table has one row for each source.
    """
    every = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(cap / F.col("weight"), "source_rank")
    level = (F.sum("source_size").over(every) - (F.sum(cap).over(order) - cap)) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    found = sources.withColumn("_level", level).withColumn("_level", F.min(F.when(cap / F.col("weight") >= F.col("_level"), F.struct(cap / F.col("weight"), "source_rank", "_level"))).over(every)["_level"])
    return found.withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.lit(0.0)))).drop("_level")


def weighted_sources(sized: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row for each source: source_rank (by code point, null last), weight, source_size, source_rows.

    Weights are 1, 2, 3, repeating by rank, unless weights(source, weight) gives them; a source without a row there weighs 0.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ranked = by_source.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    if weights is None:
        return ranked.withColumn("weight", (F.pmod("source_rank", F.lit(3)) + 1).cast("double"))
    given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double"))
    return ranked.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0.0, ["weight"])


def _before(df: DataFrame, group: str, bucket: str, order: list[Column | str], value: Column) -> DataFrame:
    """df with _start: the sum of value over the rows of the group before this one, in the order of bucket and order."""
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_offset", F.sum("_sum").over(Window.partitionBy(group).orderBy(bucket)) - F.col("_sum")).drop("_sum")
    within = F.sum(value).over(Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - value
    return df.withColumn("_within", within).join(sums, [group, bucket]).withColumn("_start", F.col("_offset") + F.col("_within")).drop("_offset", "_within")


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot: (slot + 1) * GOLDEN modulo POINTS, multiplied in two halves so that no product leaves 63 bits."""
    at, half = F.pmod(slot + 1, F.lit(POINTS)), 1 << 20
    high = F.pmod(F.shiftright(at, 20) * GOLDEN, F.lit(half)) * half
    return F.pmod(high + at.bitwiseAND(F.lit(half - 1)) * GOLDEN, F.lit(POINTS))


def most_apart(n_slots: int) -> int:
    """By how many slots a source may differ from its share among the first n: twice Niederreiter's bound on the discrepancy of golden-ratio points."""
    return 2 * math.ceil(4 + (1 / math.log((1 + math.sqrt(5)) / 2) + 1 / math.log(2)) * math.log(n_slots + 1))


def schedule(sources: DataFrame, n_slots: int, cells: int = LEAST_CELLS) -> DataFrame:
    """The slots of the mix: slot, source_rank, block (the rank of the slot among those of its source)."""
    every = Window.partitionBy()
    upto = F.sum("target").over(Window.orderBy("source_rank"))
    edges = sources.where("target > 0").select(
        "source_rank", F.round((upto - F.col("target")) / F.sum("target").over(every) * POINTS).cast("long").alias("_low"), F.round(upto / F.sum("target").over(every) * POINTS).cast("long").alias("_high")
    )
    width = POINTS // cells
    edges = edges.where("_high > _low").withColumn("_cell", F.explode(F.sequence(F.call_function("div", F.col("_low"), F.lit(width)), F.call_function("div", F.col("_high") - 1, F.lit(width)))))
    slots = edges.sparkSession.range(n_slots).withColumnRenamed("id", "slot")
    slots = slots.withColumn("_point", point(F.col("slot"))).withColumn("_cell", F.call_function("div", F.col("_point"), F.lit(width)))
    filled = slots.join(edges, "_cell").where("_point >= _low and _point < _high").select("slot", "source_rank", F.call_function("div", F.col("slot"), F.lit(BUCKET)).alias("_bucket"))
    return _before(filled, "source_rank", "_bucket", ["slot"], F.lit(1).cast("long")).select("slot", "source_rank", F.col("_start").alias("block"))


def block_length(target: Column, longest: int) -> Column:
    """Words in a block of a source: the longest, or that divided by SHORTER as often as it takes for LEAST_BLOCKS of them, 1 at least."""
    lengths = [longest]
    while lengths[-1] > 1:
        lengths.append(max(1, lengths[-1] // SHORTER))
    out = F.lit(lengths[-1])
    for length in reversed(lengths[:-1]):
        out = F.when(target >= LEAST_BLOCKS * length, length).otherwise(out)
    return out.cast("long")


def schedules(sources: DataFrame) -> tuple[DataFrame, int]:
    """The slots of all rows of slots, one row for each length of blocks among sources (a handful), and the number of slots in the longest."""
    made, most = [], 0
    for r in sources.where("target > 0").groupBy("length").agg(F.sum("target").alias("words"), F.count("*").alias("n")).orderBy(F.desc("length")).collect():
        n_slots, cells = math.ceil(r["words"] / r["length"]), min(MOST_CELLS, max(LEAST_CELLS, 1 << (r["n"] - 1).bit_length()))
        made.append(schedule(sources.where(F.col("length") == r["length"]), n_slots, cells))
        most = max(most, n_slots)
    out = made[0] if made else schedule(sources, 0)
    for more in made[1:]:
        out = out.union(more)
    return out, most


def mix_sources(docs: DataFrame, size: Column | None = None, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """How many words of each document a mix takes that is as long as the input.

    docs needs doc_id, source and, unless size is given, text. Returns one row for each row of docs: doc_id, source, size, source_size, weight,
    target, taken (words that the mix takes, repeats counted: at most max_epochs times size).

    A null text has size 0 and is never taken; a null source is a source of its own, ranked last; repeated rows are rows of their own. Without
    any word all targets are 0. The same rows give the same result, in whatever order they are stored. What a source gives differs from its target by
    ``most_apart`` of its blocks at most, in practice by one or two, of LEAST_BLOCKS or more (of one word each where the target is smaller than that).
    """
    size = n_words("text") if size is None else size
    sized = checkpointed(docs.select("doc_id", "source", size.alias("size")).withColumn("_row", F.monotonically_increasing_id()))
    sources = checkpointed(water_level(weighted_sources(sized, weights), max_epochs))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = sources.withColumn("length", block_length(F.col("target"), max(1, min(LONGEST_BLOCK, total // LEAST_SLOTS))))
    slots, n_slots = schedules(sources)

    known = sources.withColumnRenamed("source", "_source")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    hashed = F.xxhash64("doc_id", "size", F.lit(seed))
    n_buckets = F.call_function("div", F.col("source_rows"), F.lit(BUCKET)) + 1
    rows = rows.withColumn("_hash", hashed).withColumn("_bucket", F.pmod("_hash", n_buckets))
    ring = _before(rows, "source_rank", "_bucket", ["_hash", "doc_id", "size", "_row"], F.col("size"))

    # Each turn round the ring lays a document over one or more blocks; blocks beyond the source's target meet no slot.
    turns = ring.where("size > 0 and target > 0").select("_row", "source_rank", "size", "target", F.col("length").alias("_length"), F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("_turn"), "_start", "source_size")
    turns = turns.withColumn("_start", F.col("_start") + F.col("_turn") * F.col("source_size")).withColumn("_end", F.col("_start") + F.col("size"))
    length = F.col("_length")
    turns = turns.where(F.col("_start") < F.col("target") + most_apart(n_slots) * length)
    first, last = (F.call_function("div", x, length) for x in (F.col("_start"), F.col("_end") - 1))
    pieces = turns.select("_row", "source_rank", "_start", "_end", "_length", F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.least("_end", (F.col("block") + 1) * length) - F.greatest("_start", F.col("block") * length)
    taken = pieces.withColumn("_words", overlap).join(slots, ["source_rank", "block"]).groupBy("_row").agg(F.sum("_words").alias("taken"))
    return rows.join(taken, "_row", "left").select("doc_id", "source", "size", "source_size", "weight", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix_documents(docs: DataFrame, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """The documents of the mix: each as often as the mix takes its words, to the nearest whole number; columns as in docs.

    The count belongs to the row: it is found by doc_id and size, so rows that share both share their counts as well.
    """
    counts = mix_sources(docs, max_epochs=max_epochs, seed=seed).where("taken > 0")
    counts = counts.groupBy("doc_id", "size").agg(F.round(F.sum("taken") / F.count("*") / F.first("size")).cast("int").alias("_times"))
    return repeated(docs, counts)


def repeated(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """docs, each row as often as counts(doc_id, size, _times) say for its doc_id and number of words; columns of docs may have any name."""
    rows = docs.select(F.struct("*").alias("_row"), n_words("text").alias("_words"))
    counts = counts.where("_times > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_key"), "_times")
    kept = rows.join(counts, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_key")))
    return kept.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
