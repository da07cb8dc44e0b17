"""Symbols of samples, trees of files, ignore rules, writes, graph invariants, vectors and the live status, on small inputs."""

import hashlib
import math
import random
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repograph import queries
from repograph.functions import dims
from repograph.operators import files, graph, references, runs, symbols, vectors
from repograph.plans import build
from repograph.sources import derived, tables
from repograph.streaming.status import stage_status_stream

SF = "/root/testdata/sf0.001"

SAMPLES = {
    "a.py": '"""Doc with class X:\n"""\nimport os\n\n\nclass Box:\n    """text\n  less indented"""\n\n    def put(self, x):\n        def inner():\n            pass\n        return inner\n\n\nasync def run(\n    y,\n):\n    return y\n',
    "B.java": "import java.util.List;\n/* class Not { */\npublic class B {\n  private int x;\n  public B(int x) {\n    this.x = x;\n  }\n  public List<String> get(int a) {\n    if (a > 1) {\n      return null;\n    }\n    return null; // }\n  }\n}\ninterface P {\n  void go(int a);\n}\n",
    "c.ts": "export class T {\n  constructor(\n    private a: string,\n  ) {}\n  m(x: number): number {\n    return f(`${x} {`);\n  }\n}\nconst g: (a: number) => number = (a) => a;\n",
    "d.go": 'import (\n\t"fmt"\n\t"strings"\n)\ntype S struct {\n}\nfunc (s *S) Do(x int) {\n}\nfunc New() *S {\n\treturn nil\n}\n',
    "e.rs": "pub struct R {\n}\nimpl Default for R {\n    fn default() -> Self {\n        R {}\n    }\n}\ntrait Q {\n    fn q(&self);\n}\nfn free<'a>(x: &'a str) -> char {\n    '{'\n}\n",
    "f.c": "typedef struct {\n  int x;\n} Pt;\nstatic int\nadd(int a,\n    int b)\n{\n  return a;\n}\nint decl(int a);\nchar *dup(const char *s) {\n  return 0;\n}\n",
    "g.cpp": "class V {\n public:\n  V(int n)\n      : n_(n) {}\n  virtual void p() = 0;\n  int size() const {\n    return n_;\n  }\n};\n",
}


@pytest.fixture(scope="module")
def sample_files(spark):
    return files.with_file_facts(spark.createDataFrame([("r", f"src/{p}", t) for p, t in SAMPLES.items()], "repo string, path string, content string"))


def test_symbols_of_samples(sample_files):
    found = {(r.path[4:], r.kind, r.parent_name, r.name, r.start_line, r.end_line) for r in symbols.symbols(sample_files).collect()}
    assert found >= {
        ("a.py", "class", None, "Box", 6, 13), ("a.py", "method", "Box", "put", 10, 13), ("a.py", "function", None, "run", 16, 19),
        ("B.java", "class", None, "B", 3, 14), ("B.java", "method", "B", "get", 8, 13), ("B.java", "class", None, "P", 15, 17),
        ("c.ts", "class", None, "T", 1, 8), ("c.ts", "method", "T", "constructor", 2, 4), ("c.ts", "method", "T", "m", 5, 7), ("c.ts", "function", None, "g", 9, 9),
        ("d.go", "class", None, "S", 5, 6), ("d.go", "method", "S", "Do", 7, 8), ("d.go", "function", None, "New", 9, 11),
        ("e.rs", "class", None, "R", 1, 2), ("e.rs", "method", "R", "default", 4, 6), ("e.rs", "function", None, "free", 11, 13),
        ("f.c", "class", None, "Pt", 1, 3), ("f.c", "function", None, "dup", 11, 13),
        ("g.cpp", "class", None, "V", 1, 9), ("g.cpp", "method", "V", "size", 6, 8),
    }
    names = {(p, n) for p, _, _, n, _, _ in found}
    assert not names & {("B.java", "Not"), ("B.java", "go"), ("f.c", "decl"), ("g.cpp", "p"), ("e.rs", "q")}


def test_patterns_stand_once_in_the_plan(spark):
    """One test and one extraction for each pattern: a filter put below the columns it is made of would work them out again for each line."""
    found = symbols.symbols(files.with_file_facts(derived.corpus(spark, SF)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count(dims.DECLARATIONS["python"][0][2]) == 2


def test_rich_imports(sample_files):
    found = {(r.path[4:], r.module, r.line_no) for r in references.extract_imports_rich(sample_files).collect()}
    assert {("a.py", "os", 3), ("B.java", "java.util.List", 1), ("d.go", "fmt", 2), ("d.go", "strings", 3)} <= found


def test_tree_and_ignore_rules(spark, tmp_path):
    for path, text in {"__init__.py": b"", "pkg/_x/a.py": b"x\xff = 1", ".gitignore": b"*.log\n!keep.log\nout/\n", "b.log": b"", "keep.log": b"", "pkg/out/z.py": b"", "dist/q.js": b"", "distribution/q.js": b""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    found = tables.scan_repo_tree(spark, str(tmp_path), "r").where("not is_dir")
    by_path = {r.path: r.content for r in found.collect()}
    assert len(by_path) == 8 and by_path["pkg/_x/a.py"] == "x = 1"
    kept = {r.path for r in files.gitignore_filter(files.ignore_filter(found)).collect()}
    assert kept == {"__init__.py", "pkg/_x/a.py", ".gitignore", "keep.log", "distribution/q.js"}


def test_ivf_equals_exact_when_all_lists_are_probed(spark):
    rows = derived.vectors(spark, SF)
    asked = rows.limit(5).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vectors.topk(rows, asked, 5).select("query_id", "id", "rank")
    assert vectors.ivf_topk(rows, asked, 5, n_lists=6, n_probe=6).select("query_id", "id", "rank").exceptAll(exact).isEmpty()


@pytest.mark.parametrize(("k", "n_probe"), [(10, 1), (10, 3), (60, 1)])
def test_ivf_loses_no_neighbour_in_unprobed_lists(spark, k, n_probe):
    rows = derived.vectors(spark, SF)
    asked = rows.where("cast(substring(id, 2) as int) % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vectors.topk(rows, asked, k).select("query_id", "id", "score", "rank")
    found = vectors.ivf_topk(rows, asked, k, n_probe=n_probe).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def test_ivf_rules_far_lists_out(spark):
    made = [(f"v{i}", "n", "r", "t", [float(k == i % 4) + 0.001 * ((i * 7 + k) % 5) for k in range(4)]) for i in range(80)]
    rows = spark.createDataFrame(made, "id string, node_id string, repo string, type string, embedding array<double>")
    asked = rows.limit(4).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    exact = vectors.topk(rows, asked, 5).select("query_id", "id", "rank")
    assert vectors.ivf_topk(rows, asked, 5, n_lists=4, n_probe=1).select("query_id", "id", "rank").exceptAll(exact).isEmpty()


def test_rings_leave_most_vectors_out(spark):
    """On clustered vectors an exact search looks at less than three in ten of them."""
    draw = random.Random(2)
    middles = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    made = [(f"v{i:04d}", "n", "r", "t", [m + draw.gauss(0, 0.25) for m in middles[i % 40]]) for i in range(2000)]
    rows = spark.createDataFrame(made, "id string, node_id string, repo string, type string, embedding array<double>")
    asked = rows.where("id < 'v0050'").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    index = vectors.ivf_index(rows)
    exact = vectors.topk(rows, asked, 10).select("query_id", "id", "score", "rank")
    found = index.search(asked, 10).select("query_id", "id", "score", "rank")
    assert found.exceptAll(exact).isEmpty() and found.count() == exact.count() == 500
    counts = [r.n for r in index.scored(asked, 10).collect()]
    assert len(counts) == 50 and sum(counts) < 0.3 * 2000 * 50


def _nearest(rows, query, k, same=lambda r: True):
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return [i for _, i in sorted((-round(cosine(r.embedding, query), 6), r.id) for r in rows if same(r))[:k]]


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_searches_ask_every_twentieth_vector(spark, monkeypatch, tmp_path, broadcast):
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", broadcast)
    made = [(i, [float((i * i * 7 + i * k * 5 + k) % 11 - 5) for k in range(6)], i % 7) for i in range(70)]
    spark.createDataFrame(made, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = derived.vectors(spark, str(tmp_path)).collect()
    found = {n: queries.QUERIES[n](spark, str(tmp_path)).orderBy("query_id", "rank" if n != "hydrate_hits_each_20th" else "id").collect() for n in queries.QUERIES if n.endswith("_each_20th")}
    assert len(found) == 5
    for q in (0, 20, 40, 60):
        best = _nearest(rows, made[q][1], 10)
        of = lambda n: [r for r in found[n + "_each_20th"] if r.query_id == q]  # noqa: E731, B023
        assert [r.id for r in of("cosine_topk")] == best
        assert [r.id for r in of("vector_filter")] == _nearest(rows, made[q][1], 10, lambda r: r.repo == "repo2" and r.type == "Method")
        for t in {r.type for r in rows}:
            assert [r.id for r in of("topk_per_type") if r.type == t] == _nearest(rows, made[q][1], 5, lambda r: r.type == t)  # noqa: B023
        assert len(of("union_hits")) == 10 and [r.id for r in of("hydrate_hits")] == sorted(i for i in best if int(i[1:]) % 2 == 0)
    assert {r.query_id for r in queries.ivf_topk(spark, str(tmp_path)).select("query_id").distinct().collect()} == {0, 20, 40, 60}


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_node_search_asks_classes_of_every_repo(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", broadcast)
    nodes = spark.createDataFrame([(f"{r}{i}", f"n{i} common", "Class" if i < 2 else "Method", r, "code", "p") for r in ("repo1", "repo11") for i in range(4)], "id string, name string, label string, repo string, code string, file_path string")
    monkeypatch.setattr(queries, "_nodes", lambda spark, sf_dir: nodes)
    for search in (queries.search_nodes, queries.search_code):
        found = search(spark, SF).collect()
        assert {r.query_id for r in found} == {"repo10", "repo11", "repo110", "repo111"} and len(found) == 16
        assert all(r.node_id[:-1] == r.query_id[:-1] for r in found)


def test_documents_are_embedded_whole(spark, tmp_path):
    texts = ["alpha beta " * 40 + "omega Omega", " " * 400 + "late", "", None, "  ", "short one"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = set()
    for i, t in enumerate(texts):
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in re.findall("[a-z0-9]+", (t or "").lower()))
        expected |= {(f"doc_{i}", b, round(n / math.sqrt(sum(c * c for c in counts.values())), 6)) for b, n in counts.items()}
    assert {tuple(r) for r in queries.embed_nodes(spark, str(tmp_path)).collect()} == expected
    assert {r.node_id for r in queries.build_vector_records(spark, str(tmp_path)).collect()} == {"doc_0", "doc_1", "doc_5"}


def test_provider_is_retried(spark):
    vectors.register_provider("ones", lambda texts: [[1.0, float(len(t))] for t in texts])
    out = vectors.embed_nodes(spark.createDataFrame([(1, " ab "), (2, " ")], "id int, summary string"), provider="ones").collect()
    assert [(r.id, list(r.embedding)) for r in out] == [(1, [1.0, 2.0])]


def test_live_status_equals_batch(spark, tmp_path):
    events = derived.run_events(spark, SF)
    tables.append_events(events.withColumn("extra", F.lit("e")), str(tmp_path / "log"))
    (tmp_path / "log" / "odd.json").write_text("\nnot json\n")
    assert tables.read_events(spark, str(tmp_path / "log")).count() == events.count()
    stream = stage_status_stream(spark, str(tmp_path / "log")).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    stream.awaitTermination()
    batch = runs.stage_status(events).select("repo_id", "stage", "status")
    assert spark.table("live").exceptAll(batch).isEmpty() and batch.exceptAll(spark.table("live")).isEmpty()


def test_registry_imports_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['repograph.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'use_edges' in e.queries() and 'op1_source_mixing' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=".")


def test_closure_deeper_than_64_and_cycles(spark):
    chain = spark.range(70).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"), F.lit("CONTAIN").alias("rel_type"))
    found = graph.contain_closure(chain, spark.createDataFrame([("0",)], "id string"))
    assert sorted(r.distance for r in found.collect()) == list(range(1, 71))
    ring = spark.createDataFrame([("a", "b", "CONTAIN"), ("b", "a", "CONTAIN")], "src string, dst string, rel_type string")
    with pytest.raises(ValueError):
        graph.contain_closure(ring, spark.createDataFrame([("a",)], "id string"))


def test_edges_with_labels_and_properties(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "File", "x"), ("b", "Class", "y")], "id string, label string, name string")
    new = spark.createDataFrame([("a", "b", "CONTAIN", "File", "Class"), ("a", "b", "USE", "File", "File"), ("a", "c", "CONTAIN", "File", "Class")], "src string, dst string, rel_type string, src_label string, dst_label string")
    assert [r.success for r in tables.matched_edges(new, nodes).orderBy("dst", "rel_type").collect()] == [True, False, False]
    edges = tables.write_edges(new.select("src", "dst", "rel_type").limit(0), str(tmp_path / "e"), 4)
    tables.insert_edges(edges, new, nodes)
    assert [(r.src, r.dst, r.rel_type) for r in edges.read().collect()] == [("a", "b", "CONTAIN")]
    table = tables.write_nodes(nodes, str(tmp_path / "n"), 4)
    matched = tables.update_property(table, spark.createDataFrame([("b", "z"), ("q", "z")], "id string, value string"), "name")
    assert {r.name for r in table.read().collect()} == {"x", "z"} and matched.first().matched == 1


def test_built_graph_with_modules_and_tools(spark):
    files = [("r", "app/a.py", "import b\ndef fa(x):\n    return fb(x)\n"), ("r", "app/b.py", "class B:\n    def fb(self, x):\n        return x\n"), ("r", "app/c.py", "def fc(x):\n    return 1\n"), ("r", "top.py", "def ft(x):\n    return 2\n")]
    corpus = spark.createDataFrame(files, "repo string, path string, content string")
    kg = build.build_knowledge_graph(spark, corpus)
    modules = kg.modules("r").collect()
    assert [(m.name, m.summary) for m in modules] == [("app", "module app of 3 files")]
    flows = kg.module_workflows(modules[0].id).collect()
    assert [f.summary for f in flows] == ["workflow of 2 files in app"]
    belongs = {(r.src, r.dst) for r in kg.edges.where("rel_type = 'BELONG_TO'").collect()}
    assert belongs == {(f"file_r_app/{c}.py", modules[0].id) for c in "abc"} | {(f"file_r_app/{c}.py", flows[0].id) for c in "ab"} | {(flows[0].id, modules[0].id)}
    assert {r.type for r in kg.vectors.select("type").distinct().collect()} == {"File", "Class", "Method", "Module", "Workflow"}
    asked = spark.createDataFrame([(1, "r", "def fc(x):\n    return 1")], "query_id int, repo string, text string")
    best = kg.search_code(asked, 3).orderBy("rank").first()
    assert (best.name, best.label, best.file_path) == ("fc", "Method", "app/c.py") and {r.collection for r in kg.code_vectors.collect()} == {"class_code", "method_code"}
    assert kg.search_nodes(asked.withColumn("text", F.lit("file c.py"))).count() > 0
    assert kg.file_content("file_r_top.py").count() == 1 and kg.project_structure("r").count() == 5
    answer = '{"modules":[{"name":"core","files":["app/a.py","none.py"],"workflows":[{"name":"run","keywords":["b.py"]}]}]}'
    made, edges = build.with_modules(kg, spark.createDataFrame([("r", answer)], "repo string, response string"))
    assert sorted((r.label, r.name) for r in made.collect()) == [("Module", "core"), ("Workflow", "run")]
    assert sorted(r.rel_type for r in edges.collect()).count("CONTAIN") == 2 and edges.where("rel_type = 'BELONG_TO'").count() == 2


def test_scopes_of_a_very_long_file(spark):
    """200,000 lines of nested, one-line and unclosed declarations: each is closed as by counting braces from it on, in one pass."""
    lines = []
    while len(lines) < 200_000:
        k = len(lines)
        lines += [f"class C{k} {{", f"  m{k}(x) {{", "    if (x) {", "      return 1;", "    }", "  }", f"  n{k}() {{}}", "}", f"const a{k} = (x) => x;", f"function f{k}() {{"] + ["}"] * (k % 3 != 0)
    content = "\n".join(lines)
    facts = files.with_file_facts(spark.createDataFrame([("r", "long.js", content)], "repo string, path string, content string"))
    found = {(r.kind, r.parent_name, r.name): (r.start_line, r.end_line) for r in symbols.symbols(facts, code=False).collect()}
    for at in range(0, len(lines), 12_347):
        k = next(i for i in range(at, len(lines)) if lines[i].startswith("class")) if at + 20 < len(lines) else 0
        assert found["class", None, f"C{k}"] == (k + 1, k + 8)
        assert found["method", f"C{k}", f"m{k}"] == (k + 2, k + 6) and found["method", f"C{k}", f"n{k}"] == (k + 7, k + 7)
        assert found["function", None, f"a{k}"] == (k + 9, k + 9)
        closes, depth = None, 0
        for i in range(k + 9, min(len(lines), k + 5000)):
            depth += lines[i].count("{") - lines[i].count("}")
            if depth <= 0:
                closes = i + 1
                break
        assert ("function", None, f"f{k}") not in found if closes is None and k + 5000 >= len(lines) else closes is None or found["function", None, f"f{k}"] == (k + 10, closes)


def test_scopes_take_time_in_proportion():
    """A file of declarations inside one another, which met all lines behind them before, in one pass."""
    n = 100_000
    ends = symbols._ends_by_braces([(i, False) for i in range(n)], [1] * n + [0] * n, [1] * n + [-1] * n, [False] * 2 * n)
    assert ends == [2 * n - 1 - i for i in range(n)]
    assert symbols._around([(i, 2 * n - 1 - i, True) for i in range(n)]) == list(range(-1, n - 1))
    assert symbols._ends_by_indent([*range(n), 0]) == [n - 1] * n + [n]


def plain_ignored(path, files):
    """Whether git would leave a file out, by fnmatch on each part: rules of each .gitignore from the root down, the last that fits decides, at each level."""
    import fnmatch

    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        name, is_dir, out = parts[:depth], depth < len(parts), None
        for at in range(depth):
            text = files.get("/".join([*parts[:at], ".gitignore"]), "")
            below = name[at:]
            for line in text.split("\n"):
                rule = line.rstrip()
                if not rule or rule.startswith("#"):
                    continue
                negated, rule = rule.startswith("!"), rule.removeprefix("!")
                only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
                if only_dirs and not is_dir:
                    continue
                if "/" in rule:
                    want = rule.lstrip("/").split("/")
                    fits = len(want) == len(below) and all(fnmatch.fnmatchcase(x, y) for x, y in zip(below, want, strict=True))
                else:
                    fits = fnmatch.fnmatchcase(below[-1], rule)
                if fits:
                    out = not negated
        if out:
            return True
    return False


def test_ignore_files_of_several_folders(spark):
    texts = {
        ".gitignore": "*.log\nbuild/\n!keep.log\n/top.txt\nsrc/gen\n# no\n",
        "src/.gitignore": "!debug.log\n*.tmp\n/only.py\nsub/x.py\n",
        "src/sub/.gitignore": "*.log\n!a.tmp\n",
        "build/.gitignore": "!*\n",
    }
    names = ["a.log", "keep.log", "top.txt", "only.py", "debug.log", "a.tmp", "x.py", "build/y.py", "gen/z.py", "gen"]
    paths = sorted({f"{d}{n}" for d in ("", "src/", "src/sub/", "src/sub/deep/", "lib/") for n in names if not (n == "gen" and d == "src/")})
    every = texts | {p: "" for p in paths}
    rows = [(repo, p, t if repo == "r" or p not in texts else "") for repo in ("r", "q") for p, t in every.items()]
    got = {(r.repo, r.path) for r in files.gitignore_filter(spark.createDataFrame(rows, "repo string, path string, content string")).collect()}
    assert got == {("r", p) for p in every if not plain_ignored(p, texts)} | {("q", p) for p in every}
    assert ("r", "build/.gitignore") not in got and ("r", "src/debug.log") in got and ("r", "src/sub/debug.log") not in got


def test_a_language_can_be_registered(spark):
    saved = {name: {k: [*v] for k, v in getattr(dims, name).items()} for name in ("SUFFIXES", "DECLARATIONS", "IMPORT_PATTERNS", "RICH_STOPS")}
    try:
        dims.register_language("ruby", ["RB", ".rake"], [("class", "class", r"^\s*class\s+(\w+)", 1), ("function", "function", r"^\s*def\s+(\w+)", 1)], [r"^\s*require\s+'([^']+)'"], ["puts"], by_indent=True)
        assert dims.language_of_extension("rb") == "ruby" and ".rake" in dims.supported_extensions() and "ruby" in dims.supported_languages()
        facts = files.with_file_facts(spark.createDataFrame([("r", "a.rb", "require 'b'\nclass A\n  def go(x)\n    puts(x)\n    run(x)\nend\n")], "repo string, path string, content string"))
        found = symbols.symbols(facts)
        assert {(r.kind, r.parent_name, r.name, r.start_line) for r in found.collect()} == {("class", None, "A", 2), ("method", "A", "go", 3)}
        assert [r.module for r in references.extract_imports(facts).collect()] == ["b"]
        assert {r.call_name for r in references.extract_calls_rich(symbols.symbol_nodes(found).where("label = 'Method'")).collect()} == {"run"}
    finally:
        for name, table in saved.items():
            getattr(dims, name).clear()
            getattr(dims, name).update(table)
        dims.BY_INDENT.discard("ruby")


def test_stop_names_go_by_language(spark):
    rows = [("r", i, "m", "p", lang, 1, "make(x); super(); panic(); require(1); run(y)\n") for i, lang in enumerate(["python", "go", "javascript", "rust", "kotlin"])]
    calls = references.extract_calls_rich(spark.createDataFrame([(*r[:1], str(r[1]), *r[2:]) for r in rows], "repo string, id string, name string, file_path string, language string, start_line int, code string"))
    got = {}
    for r in calls.collect():
        got.setdefault(r.src, set()).add(r.call_name)
    every = {"make", "super", "panic", "require", "run"}
    assert got == {"0": every - {"super"}, "1": every - {"make", "panic"}, "2": every - {"require"}, "3": every - {"panic"}, "4": every}
