"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repograph.llm import bpe, centroids, chat, hamming, improbable, jaccard, mixing, quality, sharding, spelling, suffixes, tokenfiles, urls
from repograph.llm.common import read, shared_path

#: The rules of the URL filter.
URL_RULES = [
    urls.UrlRule("block", "com", "/en/"),
    urls.UrlRule("allow", "example.com", "/en/7"),
    urls.UrlRule("allow", "net", "/de/"),
    urls.UrlRule("block", "example.net", "/de/8"),
    urls.UrlRule("block", "org", "/es/"),
]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "weight")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated strings of 200 bytes."""
    return suffixes.dedup_digest(read(spark, sf_dir, "documents"), length=200)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for each page."""
    return urls.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of each document."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=90)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for each document."""
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids, from token files that are written and read back."""
    path = shared_path(spark, "token-files")
    tokenfiles.write_token_files(read(spark, sf_dir, "documents"), path)
    return tokenfiles.read_documents(spark, path)


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every twentieth embedding."""
    return hamming.nearest_embeddings(read(spark, sf_dir, "embeddings"))


def op9_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of each conversation against itself with its neighbour's last answer."""
    return chat.format_preferences(chat.answer_pairs(read(spark, sf_dir, "conversations")))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of each document and of what they decode to."""
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each embedding of 64 components after three rounds over 16 centroids."""
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"), k=16, rounds=3)


def op12_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how near they and the next document's are."""
    return improbable.fingerprint_documents(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of each word that occurs five times or more."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_feistel_sharding": op7_feistel_sharding,
    "op8_hamming_topk": op8_hamming_topk,
    "op9_preference_formatting": op9_preference_formatting,
    "op10_prefix_bpe": op10_prefix_bpe,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_improbable_features": op12_improbable_features,
    "op13_spelling_variants": op13_spelling_variants,
}


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds of the clustering one after another, every vector against every centroid."""
    steps = [f"""
        WITH v AS MATERIALIZED (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS c, e
          FROM v QUALIFY row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) <= {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (
          SELECT vec_id, any_value(e) AS e, min(d) AS d, min_by(c, (d, c)) AS c FROM (
            SELECT v.vec_id, v.e, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i} c)
          GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY c, i),
        m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (c))""")
    return ",".join(steps) + f"""
        SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(k.e, ',')) AS centroid_sha256
        FROM a{rounds} JOIN (SELECT c, e FROM c{rounds}) k USING (c)"""


SQL: dict[str, str] = {
    "op11_centroid_clusters": _clusters_sql(),
    "op8_hamming_topk": """
        WITH pairs AS (
          SELECT q.vec_id AS query_id, c.vec_id AS id,
                 CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (c.embedding[i] > 0) AS INT))) AS BIGINT) AS distance
          FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
        SELECT query_id, CAST(rank AS INT) AS rank, id, distance FROM ranked WHERE rank <= 10""",
    "op9_preference_formatting": """
        WITH turns AS (
          SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        answers AS (
          SELECT conv_id, coalesce(max(pos) FILTER (WHERE role = 'assistant'), max(pos) + 1) AS ends,
                 arg_max(text, pos) FILTER (WHERE role = 'assistant') AS answer
          FROM turns GROUP BY 1),
        t AS (
          SELECT conv_id AS pair_id, 0 AS side, role, text, pos FROM turns
          UNION ALL SELECT conv_id, 1, role, text, pos FROM turns JOIN answers USING (conv_id) WHERE pos < ends
          UNION ALL SELECT a.conv_id, 1, 'assistant', b.answer, a.ends FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1) WHERE b.answer IS NOT NULL),
        same AS (
          SELECT a.pair_id, a.pos FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side = 1 AND a.role = b.role AND a.text = b.text),
        lcp AS (SELECT pair_id, count(*) AS n FROM (SELECT pair_id, pos, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS k FROM same) WHERE pos = k GROUP BY 1),
        r AS (
          SELECT t.*, coalesce(n, 0) AS n, length(replace(role, '<|', '< |')) AS rl,
                 concat('<|', replace(role, '<|', '< |'), '|>', chr(10), replace(text, '<|', '< |'), '<|end|>', chr(10)) AS piece
          FROM t LEFT JOIN lcp USING (pair_id)),
        w AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side, pos > n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
        SELECT pair_id, max(n) AS n_prompt_turns,
               coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos <= n), '') AS prompt,
               coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n), '') AS chosen,
               coalesce(string_agg(piece, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n), '') AS rejected,
               coalesce(string_agg(concat(CAST(before + rl + 5 AS BIGINT), '-', CAST(before + length(piece) - 1 AS BIGINT)), ' ' ORDER BY pos) FILTER (WHERE side = 0 AND pos > n AND role = 'assistant'), '') AS chosen_spans,
               coalesce(string_agg(concat(CAST(before + rl + 5 AS BIGINT), '-', CAST(before + length(piece) - 1 AS BIGINT)), ' ' ORDER BY pos) FILTER (WHERE side = 1 AND pos > n AND role = 'assistant'), '') AS rejected_spans
        FROM w GROUP BY 1""",
}
