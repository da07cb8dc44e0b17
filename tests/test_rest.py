"""Tables at rest, builds that go on where they ended, providers with kept answers, and joins that must stay linear."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repograph.operators import graph, providers, references, runs, semantic, substrings, vectors
from repograph.plans import build
from repograph.sources import derived, tables
from repograph.sources.versions import VersionConflict, VersionedTable

SF = "/root/testdata/sf0.001"
CORPUS = [
    ("r", "app/a.py", "import b\ndef fa(x):\n    return fb(x)\n"), ("r", "app/b.py", "class B:\n    def fb(self, x):\n        return fc(x)\n"),
    ("r", "app/c.py", "def fc(x):\n    return 1\n"), ("q", "lib/d.py", "import e\ndef fd(x):\n    return fe(x)\n"), ("q", "lib/e.py", "def fe(x):\n    return 2\n"),
]


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame(CORPUS, "repo string, path string, content string")


def data_files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(os.path.join(root, "data")) for f in names if f.endswith(".parquet")}


def test_a_merge_touches_only_its_buckets(spark, tmp_path):
    nodes, root = derived.kg_nodes(spark, SF), str(tmp_path / "n")
    table = tables.write_nodes(nodes, root, 16)
    before, first = table.manifest()["folders"], data_files(root)
    new = spark.createDataFrame([("file_7", "seven"), ("new", "x")], "id string, name string")
    touched = tables.upsert_nodes(table, new)
    after = table.manifest()["folders"]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    assert first <= data_files(root)
    rows = {r.id: r for r in table.read().collect()}
    assert rows["file_7"].name == "seven" and rows["file_7"].label == "File" and rows["new"].label is None and len(rows) == nodes.count() + 1
    assert table.read(0).exceptAll(nodes).isEmpty() and table.read(0).count() == nodes.count()
    again = tables.upsert_nodes(table, new)
    assert again == touched and table.read().count() == len(rows)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    table = tables.write_nodes(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string"), str(tmp_path / "n"), 4)
    broken = F.udf(lambda x: 1 // 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        table.rewrite(spark.createDataFrame([("a",)], "id string"), lambda old: old.withColumn("name", broken("name")))
    assert table.versions() == [0] and {r.name for r in table.read().collect()} == {"x", "y"}
    # Two writers from the same version: the second is told, and nothing of the first is lost.
    stale = table.manifest()
    table.delete(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(VersionConflict):
        table._commit(stale | {"version": 1})
    assert [r.id for r in table.read().collect()] == ["b"]
    with pytest.raises(VersionConflict):
        VersionedTable.create(table.read(), str(tmp_path / "n"), "id")


def test_null_keys_repeats_and_no_rows_at_rest(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, name string")
    table = tables.write_nodes(empty, str(tmp_path / "n"), 4)
    assert table.read().count() == 0 and table.merge(empty) == []
    table.merge(spark.createDataFrame([("a", None), (None, "n")], "id string, name string"))
    table.update(spark.createDataFrame([("a", "z"), ("none", "q")], "id string, value string"), "name")
    assert {(r.id, r.name) for r in table.read().collect()} == {("a", "z"), (None, "n")}
    table.delete(table.read().select("id"))
    assert [r.id for r in table.read().collect()] == [None]


def test_a_repo_and_its_edges_go_together(spark, tmp_path):
    nodes, edges = tables.write_nodes(derived.kg_nodes(spark, SF), str(tmp_path / "n"), 8), tables.write_edges(derived.kg_edges(spark, SF), str(tmp_path / "e"), 8)
    gone = {r.id for r in nodes.read().where("repo = 'ASIA'").collect()}
    assert tables.delete_repo_graph(nodes, edges, "ASIA").first().deleted == len(gone)
    assert not {x for r in edges.read().collect() for x in (r.src, r.dst)} & gone and nodes.read().where("repo = 'ASIA'").isEmpty()
    tables.insert_edges(edges, derived.kg_edges(spark, SF), nodes.read())
    once = edges.read().count()
    tables.insert_edges(edges, derived.kg_edges(spark, SF), nodes.read())
    ids = nodes.read().select(F.col("id").alias("dst"))
    assert edges.read().count() == once and edges.read().join(ids, "dst", "left_anti").where("rel_type = 'CONTAIN'").isEmpty()


def rows_of(kg):
    keep = lambda df, columns: sorted(map(str, df.select(*columns).collect()))
    return keep(kg.nodes, ["id", "label", "name", "summary", "embedding_id"]), keep(kg.edges, ["src", "dst", "rel_type"]), keep(kg.vectors, ["id", "collection", "summary"]), keep(kg.details, ["id", "offset", "summary"])


def test_a_build_goes_on_where_it_ended(spark, corpus, tmp_path, monkeypatch):
    root, made = str(tmp_path / "kg"), []

    def counted(stage, make, fails):
        def run(*given):
            made.append(stage)
            if fails:
                raise RuntimeError("the power went")
            return make(*given)

        return run

    stages = dict(build.STAGES)
    for stage, make in stages.items():
        monkeypatch.setitem(build.STAGES, stage, counted(stage, make, stage == "semantic_analysis"))
    with pytest.raises(RuntimeError):
        build.build_at_rest(spark, corpus, root, "run1")
    assert made == ["structure_graph_build", "dependency_graph_build", "semantic_analysis"]
    events = tables.read_events(spark, f"{root}/events")
    assert {r.repo_id: r.stage for r in runs.resume_stage(events).collect()} == {"r": "semantic_analysis", "q": "semantic_analysis"}
    assert {(r.stage, r.status) for r in runs.stage_status(events).collect()} == {("structure_graph_build", "completed"), ("dependency_graph_build", "completed"), ("semantic_analysis", "failed")}
    assert {r.percent for r in runs.weighted_progress(events).collect()} == {50.0}
    assert {r.initial_status for r in VersionedTable(spark, f"{root}/registry").read().collect()} == {"Failed"}
    # What an interrupted stage has written without a word in the log is not read.
    spark.createDataFrame([("junk",)], "id string").write.parquet(f"{root}/run1/semantic_analysis-half/summaries")

    made.clear()
    for stage, make in stages.items():
        monkeypatch.setitem(build.STAGES, stage, counted(stage, make, False))
    kg = build.build_at_rest(spark, corpus, root, "run1")
    assert made == ["semantic_analysis", "module_detection", "vector_db_store"]
    assert rows_of(kg) == rows_of(build.build_knowledge_graph(spark, corpus))
    made.clear()
    assert rows_of(build.build_at_rest(spark, corpus, root, "run1")) == rows_of(kg) and made == []
    assert {(r.repo_id, r.initial_status, r.repo_name) for r in VersionedTable(spark, f"{root}/registry").read().collect()} == {("r", "Completed", "r"), ("q", "Completed", "q")}
    # Another run, or a repo that the log does not know, starts from the beginning.
    more = corpus.union(spark.createDataFrame([("s", "z.py", "def z(x):\n    return 1\n")], corpus.schema))
    build.build_at_rest(spark, more, root, "run1")
    assert made == list(stages)


def test_malformed_lines_are_counted(spark, tmp_path, caplog):
    path = tmp_path / "log"
    path.mkdir()
    assert tables.read_events(spark, str(tmp_path / "none")).count() == 0
    (path / "a.json").write_text('{"event":"e","timestamp":"2024-01-01T00:00:00Z","repo_id":"r"}\n\n   \n{"event":\nnot json\n{"event":"no time"}\n[1]\n')
    assert tables.malformed_events(spark, str(path)).count() == 4
    assert [r.repo_id for r in tables.read_events(spark, str(path), count_malformed=True).collect()] == ["r"]
    assert "4 malformed lines" in caplog.text


def test_answers_are_asked_once(spark, tmp_path):
    asked, cache = str(tmp_path / "asked"), str(tmp_path / "answers")
    os.mkdir(asked)

    def answer(requests):
        # Tasks run in other processes: each request leaves a line.
        with open(f"{asked}/{os.getpid()}", "a") as f:
            f.writelines(f"{r}\n" for r in requests)
        return [r.upper() for r in requests]

    def lines():
        return Counter(x for f in os.listdir(asked) for x in open(f"{asked}/{f}"))

    providers.register_chat("upper", answer)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, " ")], "id int, request string")
    out = {r.id: r.response for r in providers.answered(rows, "request", "upper", cache).collect()}
    assert out == {1: "A", 2: "A", 3: "B", 4: None, 5: None} and lines() == {"a\n": 1, "b\n": 1}
    more = rows.union(spark.createDataFrame([(6, "c")], rows.schema))
    assert {r.id: r.response for r in providers.answered(more, "request", "upper", cache).collect()}[6] == "C"
    assert lines() == {"a\n": 1, "b\n": 1, "c\n": 1}


def test_a_provider_is_asked_again(monkeypatch):
    calls, slept = [], []
    monkeypatch.setattr(providers.time, "sleep", slept.append)

    def flaky(items):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return items

    assert providers.tried(flaky, [1, 2], tries=3, delay=2) == [1, 2] and slept == [2, 4]
    with pytest.raises(ValueError, match="2 requests got 1"):
        providers.tried(lambda items: items[:1], [1, 2])


def test_a_second_build_asks_nothing(spark, corpus, tmp_path):
    asked = str(tmp_path / "asked")
    os.mkdir(asked)

    def answer(requests):
        with open(f"{asked}/{os.getpid()}-{len(os.listdir(asked))}", "w") as f:
            f.write("x" * len(requests))
        return [f"sum {len(r)}" for r in requests]

    providers.register_chat("sums", answer)
    settings = build.Settings(chat="sums", cache=str(tmp_path / "answers"))
    first = build.build_at_rest(spark, corpus, str(tmp_path / "one"), "a", settings)
    n = sum(os.path.getsize(f"{asked}/{f}") for f in os.listdir(asked))
    assert n == 5
    second = build.build_at_rest(spark, corpus, str(tmp_path / "two"), "b", settings)
    assert rows_of(first) == rows_of(second) and sum(os.path.getsize(f"{asked}/{f}") for f in os.listdir(asked)) == n
    # The caller is given the summary of what it calls.
    prompts = {r.id: r.summary for r in first.nodes.where("label = 'Method'").collect()}
    assert len(prompts) == 5 and all(s.startswith("sum ") for s in prompts.values())


def test_substrings_in_a_large_repo(spark):
    """100,000 paths of one repo: parts of any length, each found in exactly the paths that hold it, by few candidates."""
    paths = spark.range(100_000).select(F.lit("r").alias("repo"), F.concat(F.lit("src/common/module"), F.col("id") % 100, F.lit("/file"), "id", F.lit(".py")).alias("path"))
    paths = paths.union(spark.createDataFrame([("s", "src/other.py"), ("r", None)], "repo string, path string"))
    asked = [("r", "file77777"), ("r", "module42/file1234"), ("r", "nowhere"), ("s", "other"), ("s", "file1"), ("r", "9.p"), ("s", "o"), ("s", ""), ("s", "zz"), ("r", None), ("t", "src")]
    parts = spark.createDataFrame([*asked, asked[0]], "repo string, part string")
    found = substrings.containing(parts, paths, "repo", "part", "path")
    got = Counter((r.repo, r.part) for r in found.collect())
    rows = paths.where("path is not null").collect()
    assert got == Counter((a, p) for a, p in set(asked) if p is not None for r in rows if r.repo == a and p in r.path)
    assert substrings.containing(parts.limit(0), paths, "repo", "part", "path").count() == 0


@pytest.mark.parametrize("few", [0, 4, 10**9])
def test_factored_calls_equal_all_pairs(spark, few):
    draw = random.Random(few)
    methods = [("r", f"m{i}", f"p{i % 40}", draw.choice(["run", "go", f"n{i % 30}"])) for i in range(300)]
    calls = [("r", i, path, name, draw.choice(["run", "go", f"n{draw.randrange(40)}"])) for _, i, path, name in methods for _ in range(3)]
    m = spark.createDataFrame(methods, "repo string, id string, file_path string, name string")
    c = spark.createDataFrame(calls, "repo string, src string, path string, own_name string, call_name string")
    expected = set()
    for _, src, path, own, call in calls:
        if call != own:
            targets = [x for x in methods if x[3] == call]
            here = [x for x in targets if x[2] == path]
            expected |= {(src, x[1], call, bool(here)) for x in here or targets}
    made = references.factored_calls(c, m, few)
    assert Counter((r.src, r.dst, r.call_name, r.same_file) for r in made.pairs().collect()) == Counter(expected)
    assert {r.id: r.degree for r in made.degree().collect()} == Counter(x[0] for x in expected)
    assert {r.call_name: r.n for r in made.counts().collect()} == Counter(x[2] for x in expected)
    assert few == 4 or (made.classes.count() == 0) == (few > 4)


def test_factored_calls_grow_with_their_members(spark):
    n = 20_000
    methods = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("m"), "id").alias("id"), F.concat(F.lit("p"), "id").alias("file_path"), F.when(F.col("id") % 2 == 0, "run").otherwise(F.concat(F.lit("c"), "id")).alias("name"))
    calls = methods.where("name <> 'run'").select("repo", F.col("id").alias("src"), F.col("file_path").alias("path"), F.col("name").alias("own_name"), F.lit("run").alias("call_name"))
    made = references.factored_calls(calls, methods)
    assert made.plain.count() == 0 and made.callers.count() + made.targets.count() == n and made.classes.count() == 1
    assert {r.degree for r in made.degree().select("degree").distinct().collect()} == {n // 2} and made.counts().first().n == n * n // 4


def test_workflows_meet_the_first_symbols(spark):
    symbols = spark.createDataFrame([("r", f"s{i:04d}", f"src/p{i % 7}/x.py") for i in range(400)], "repo string, id string, file_path string")
    flows = spark.createDataFrame([("r", "w1", ["p3", "none"]), ("r", "w2", ["p3", "src"]), ("q", "w3", ["src"])], "repo string, id string, keywords array<string>")
    got = {(r.src, r.dst) for r in semantic.workflow_contains(flows, symbols).collect()}
    p3, src = [f"s{i:04d}" for i in range(400) if i % 7 == 3][:10], [f"s{i:04d}" for i in range(10)]
    assert got == {("w1", x) for x in p3} | {("w2", x) for x in [*p3, *src]}


def test_dependencies_through_a_hub(spark):
    """The first paths of each source are those of all paths, though a hub's edges are not all followed in the last step."""
    draw = random.Random(1)
    edges = [("hub", f"f{i:03d}", "CONTAIN") for i in range(150)] + [(f"f{draw.randrange(150):03d}", f"f{draw.randrange(150):03d}", draw.choice(["USE", "CALL"])) for _ in range(120)]
    e = spark.createDataFrame(edges, "src string, dst string, rel_type string").distinct()
    sources = spark.createDataFrame([("hub",), ("f000",), ("f001",), ("none",)], "id string")
    for depth in (1, 2, 3):
        every = graph.first_rows(graph.node_dependencies(e, sources, depth, None), "source", ["distance", "target", "rel_types"], 20)
        cut = graph.node_dependencies(e, sources, depth, 20)
        assert Counter(map(tuple, cut.collect())) == Counter(map(tuple, every.collect()))


def test_chunks_cover_a_text(spark):
    texts = ["", None, "  ", "ab", "x" * 2000, "y" * 2001, "".join(chr(97 + i % 26) for i in range(12_345))]
    nodes = spark.createDataFrame([(str(i), "File", "n", "r", t) for i, t in enumerate(texts)], "id string, label string, name string, repo string, content string")
    got = {}
    for r in vectors.chunks(nodes).orderBy("id", "chunk_no").collect():
        got.setdefault(int(r.id), []).append((r.offset, r.chunk))
    assert sorted(got) == [3, 4, 5, 6]
    for i, parts in got.items():
        assert all(texts[i][o : o + len(c)] == c and len(c) <= vectors.CHUNK for o, c in parts)
        assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == len(texts[i])
        assert all(b[0] - a[0] == vectors.CHUNK - vectors.OVERLAP for a, b in zip(parts, parts[1:], strict=False))
    assert len(got[4]) == 1 and len(got[5]) == 2
