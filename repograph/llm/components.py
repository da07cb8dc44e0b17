"""Connected components of links held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import checkpointed, settled, sized


def connected_components(links: DataFrame) -> DataFrame:
    """components(node, component) for links(a, b): every node that has a link, with the smallest node that it reaches.

    Alternates two steps until nothing changes: every node hands its larger neighbours its smallest one (large star), then its smaller
    neighbours and itself (small star). The number of rounds grows with the logarithm of the longest path; each is written and re-read, and all
    sums are made per task first, so that one node with very many links is no burden. Edges are held in partitions of a fixed size.
    """
    edges, n = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
        both = edges.select(ways).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # There are never more edges than before.
        edges = sized(checkpointed(sized(moved.union(least.select("a", F.col("m").alias("b"))), n).distinct()), n)
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == state:
            break
        state = now
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("e")
    return edges.select(ends).select("e.node", "e.component").distinct()
