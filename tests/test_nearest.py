"""Search block against block equals scoring of every pair, with vectors of odd lengths, equal ones and ones that have no score."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from repograph.functions import columns as C
from repograph.operators import nearest, vectors


def odd_vectors(n):
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(n)]
    strange = [[0.0] * 6, None, [], [1.0, None, 2.0, 0.0, 0.0, 1.0], [1.0, 2.0], [float("nan")] + [1.0] * 5, [1e-200] * 6, [1e200] * 6, [float("inf")] + [1.0] * 5, [-1.0] * 6]
    return [(f"v{i}", f"n{i}", f"r{i % 3}", ["File", "Class", None][i % 3], v) for i, v in enumerate([*some, *strange, *[[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 40, *strange])]


def every_pair(rows, asked, by, k):
    score = F.round(C.cosine(F.col("embedding"), F.col("query")), 6)
    scored = rows.crossJoin(asked).withColumn("score", score).where("score is not null")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "type", "id", "node_id", "score", "rank")


@pytest.mark.parametrize(("most", "k"), [(9, 1), (10_000, 7), (9, 7), (10_000, 60)])
def test_blocks_find_what_all_pairs_do(spark, monkeypatch, most, k):
    for name, value in (("QUERY_TILE", 4), ("VECTOR_TILE", 16)):
        monkeypatch.setattr(nearest, name, value)
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rows = spark.createDataFrame(odd_vectors(60), "id string, node_id string, repo string, type string, embedding array<double>")
    asked = rows.where("pmod(hash(id), 4) = 0 or type = 'File'").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    text = lambda df: sorted(map(str, df.collect()))
    assert text(vectors.topk(rows, asked, k).select("query_id", "type", "id", "node_id", "score", "rank")) == text(every_pair(rows, asked, ["query_id"], k))
    assert text(vectors.topk_per_type(rows, asked, k)) == text(every_pair(rows, asked, ["query_id", "type"], k).select("query_id", "type", "id", "node_id", "score", "rank"))


def test_no_join_of_all_pairs(spark):
    rows = spark.createDataFrame(odd_vectors(5), "id string, node_id string, repo string, type string, embedding array<double>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    for found in (vectors.topk(rows, asked), vectors.topk_per_type(rows, asked)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "zip_with" not in plan


def test_scores_are_rounded_as_spark_does(spark):
    rng = random.Random(3)
    made = [rng.uniform(-1, 1) for _ in range(2000)] + [s * (i + 0.5) / 1e6 for i in range(0, 1000, 7) for s in (1, -1)] + [0.0, -0.0, 1.0, -1e-9, 0.9999995, 1.0000000000000002]
    want = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(made)], "i int, x double").orderBy("i").select(F.round("x", 6).alias("x")).collect()]
    assert nearest.rounded(np.array(made)).tolist() == want


def test_rings_that_are_not_asked_for_have_no_pairs():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(40, 5)), rng.normal(size=(6, 5))
    ring, allowed = np.arange(40) % 3, np.array([[True, False, False], [False, True, True], [False] * 3] * 2)
    query, vector, _ = nearest.best_pairs(q, v, np.arange(40), 4, allowed, ring)
    assert {(a, r) for a, r in zip(query, ring[vector], strict=True)} <= {(a, r) for a in range(6) for r in range(3) if allowed[a, r]}
    assert np.bincount(query, minlength=6).tolist() == [4, 4, 0, 4, 4, 0]
