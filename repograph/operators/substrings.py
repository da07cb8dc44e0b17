"""Which texts of a group contain a part, through an inverted index of grams.

A part of GRAM characters or more is looked up by that of its grams that the fewest texts of its group have; a shorter one is a gram itself. Only the
postings of grams that were chosen are dealt out, by group and gram, and each candidate is verified. Groups of any size are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.operators.graph import checkpointed

GRAM = 3
#: Chosen grams that are sent to every task (some 100 bytes each); more are joined by a shuffle.
SENT = 100_000


def grams(text: Column, size: int) -> Column:
    """The different grams of ``size`` characters of a text, as an array; none of a shorter text."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def containing(asked: DataFrame, texts: DataFrame, group: str, part: str, text: str) -> DataFrame:
    """group, part and text: each text of texts(group, text) that contains a part of its group in asked(group, part).

    Parts and texts count once each; null ones take no part; an empty part is in every text of its group.
    """
    asked = checkpointed(asked.select(group, part).where(f"{part} is not null and {group} is not null").distinct())
    texts = checkpointed(texts.select(group, text).where(f"{text} is not null and {group} is not null").distinct())
    size = F.least(F.length(part), F.lit(GRAM))
    sizes = sorted(r["n"] for r in asked.select(size.alias("n")).distinct().collect())
    if not sizes:
        return asked.join(texts, group).limit(0)
    of = lambda column, n: grams(F.col(column), n) if n else F.array(F.lit(""))
    every = F.concat(*(of(text, n) for n in sizes))
    own = F.coalesce(*(F.when(size == n, of(part, n)) for n in sizes))
    # How many texts have each gram of a part: counted in the tasks first, as the grams of a group repeat.
    looked = asked.select(group, part, F.explode(own).alias("_gram"))
    counts = texts.select(group, F.explode(every).alias("_gram")).groupBy(group, "_gram").agg(F.count("*").alias("_n"))
    known = looked.join(counts, [group, "_gram"], "left").select(group, part, "_gram", F.coalesce("_n", F.lit(0).cast("long")).alias("_n"))
    # A gram that no text has is the rarest, so its part is found nowhere.
    chosen = checkpointed(known.groupBy(group, part).agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram")))
    wanted = chosen.select(group, "_gram").distinct()
    wanted = F.broadcast(wanted) if chosen.count() <= SENT else wanted
    postings = texts.select(group, text, F.explode(every).alias("_gram")).join(wanted, [group, "_gram"])
    return chosen.join(postings, [group, "_gram"]).where(F.col(text).contains(F.col(part))).select(group, part, text)
