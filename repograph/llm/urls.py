"""URL filters: path rules, and trust and distrust propagated over the links between hosts.

A rule fits its host with all subdomains and paths that start with its path; the longest rule that fits decides. Pages that no rule
fits are judged by their host: personalised PageRank runs from the hosts with allowed pages along the links (trust) and from the
hosts with blocked pages against them (distrust: who links to bad hosts is suspect). A host is blocked where its distrust is above
its trust by ``ratio``. Hosts also link to the domain that they belong to and back, so that a host without links is not alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import checkpointed, settled, sized, text_or_empty

#: Absolute and protocol-relative targets of links in a page.
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"

#: Share of a host's own rank below which a difference does not count, so that it means the same for any number of hosts.
TOLERANCE = 1e-6
#: Rounds between two looks at whether ranks still grow; the lineage is cut after them.
ROUNDS = 8
#: Hosts of which the scores (some 60 bytes each) are sent to every task; more are joined by a shuffle, which Spark splits for hosts with very many pages.
BROADCAST_HOSTS = 1_000_000
#: Second labels under which registries of countries hand out names, as in co.uk; such a suffix is no domain of its own.
REGISTRIES = ["ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org"]


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: str | Column) -> Column:
    """What is after the first :// up to /, ? or # or the end, with A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict)):
        fits = rule.fits(host, path)
        name = F.when(fits, F.lit(rule.name)) if name is None else name.when(fits, F.lit(rule.name))
        verdict = F.when(fits, F.lit(rule.verdict)) if verdict is None else verdict.when(fits, F.lit(rule.verdict))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """edges(src, dst, weight): the links between different hosts, counted, and each host's links to and from the domain above it.

    pages needs host and html. Null html has no links. One row for each pair of hosts.
    """
    # Links are counted within a page before pages meet, and within a task before tasks do.
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(text_or_empty("html"), F.lit(LINK), F.lit(1))).alias("url"))
    linked = linked.select("src", host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))).alias("dst"))
    linked = linked.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = checkpointed(pages.select(F.col("host").alias("h")).where("h <> ''").groupBy("h").agg(F.lit(1).alias("one")).select("h").union(linked.select("dst")).distinct())
    labels = F.split("h", "\\.")
    above = hosts.select("h", labels.alias("l")).where(F.size("l") >= 3)
    above = above.select("h", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - 3), lambda i: F.struct(F.array_join(F.slice("l", i + 1, F.size("l")), ".").alias("src"), F.array_join(F.slice("l", i + 2, F.size("l")), ".").alias("dst")))).alias("e"))
    ends = F.split("dst", "\\.")
    registry = (F.size(ends) == 2) & (F.length(ends[1]) == 2) & ends[0].isin(REGISTRIES)
    up = above.select("e.src", "e.dst").distinct().where(~registry).withColumn("weight", F.lit(1.0))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return linked.union(up).union(down).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85) -> DataFrame:
    """rank(kind, host, rank): for each kind PageRank over edges(kind, src, dst, weight) that restarts at seeds(kind, host, weight).

    What reaches a host without links is lost to it. Every round is one join on the source of the edges and one sum by target; the edges' shares are
    made once. Ranks only grow, as each round adds the walks that are one link longer; they are final when no host's rank has grown by more than
    TOLERANCE of itself over the last ROUNDS rounds, which includes that no more hosts are reached.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("_total"))
    restart = seeds.groupBy("kind", "host").agg(F.sum("weight").alias("weight")).join(total, "kind")
    restart, n = settled(restart.select("kind", "host", (F.col("weight") / F.col("_total") * (1 - damping)).alias("rank")))
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("_all"))
    shares, n_edges = settled(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("_all") * damping).alias("share")))
    # No more hosts can have a rank, so partitions are made for as many rows; those of a small graph are one task's work in each round.
    n += n_edges
    known = restart
    while True:
        rank = known
        for _ in range(ROUNDS):
            moved = rank.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            rank = sized(moved.union(restart), n).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = sized(checkpointed(rank), n)
        before = known.select("kind", "host", F.col("rank").alias("_before"))
        grown = F.col("rank") - F.coalesce("_before", F.lit(0.0)) > F.col("rank") * TOLERANCE
        if rank.join(before, ["kind", "host"], "left").where(grown).isEmpty():
            return rank
        known = rank


def filter_urls(pages: DataFrame, rules: list[UrlRule], ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust for each row of pages(page_id, url, html).

    A null url, or one without ://, has empty host and path and is allowed, as is a host that neither trust nor distrust reaches.
    Repeated rows are judged alike. Trust and distrust are given to nine significant digits, however small; they count as equal within TOLERANCE.
    """
    host, path = host_of("url"), path_of("url")
    name, verdict = rule_for(rules, F.col("host"), F.col("path"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": name, "_verdict": verdict})
    seeds = checkpointed(judged.where("host <> '' and _verdict is not null").groupBy("host", "_verdict").agg(F.count("*").cast("double").alias("weight")))
    edges = checkpointed(host_edges(pages.select(host.alias("host"), "html")))
    # Trust goes along the links and distrust against them; both are worked out together.
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("block"), "dst", "src", "weight"))
    ranks = page_rank(both, seeds.select(F.col("_verdict").alias("kind"), "host", "weight"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    scores = checkpointed(ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust")))
    scores = F.broadcast(scores) if scores.count() <= BROADCAST_HOSTS else scores
    out = judged.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > F.col("trust") * (ratio * (1 + TOLERANCE)), F.lit("block")).otherwise(F.lit("allow"))
    given = lambda score: F.format_string("%.8e", F.col(score)).cast("double").alias(score)
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", by_host).alias("verdict"), given("trust"), given("distrust"))
