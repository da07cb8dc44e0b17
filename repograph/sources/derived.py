"""Tables of code, graphs, run events and vectors derived from the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

P = """
  SELECT p_partkey AS k, p_size % 8 AS l,
         lower(replace(p_brand, 'Brand#', 'repo')) AS repo, lower(p_type) AS d,
         coalesce(lead(p_partkey) OVER w,
                  CASE WHEN p_partkey % 2 = 0 THEN first_value(p_partkey) OVER w END, p_partkey) AS n
  FROM part
  WINDOW w AS (PARTITION BY p_brand, floor(p_partkey / 400) ORDER BY p_partkey)"""

#: Lines of a file by language: {k} and {n} stand for the file's number and that of the one it refers to.
TEMPLATES = [
    ["import f{n}", "from pkg.s1 import join", "class C{k}:", "    def m{k}(self):", "        return h{n}(len(self.x))", "def h{k}(x):", "    return m{k}(x) + h{k}(1)"],
    ["import com.acme.f{n};", "public class C{k} {", "  public int m{k}(int x) {", "    return h{n}(x);", "  }", "}", "interface I{k} {", "}"],
    ["import { h{n} } from ''./f{n}'';", "class C{k} {", "  m{k}(x) {", "    return h{n}(x);", "  }", "}", "function h{k}(x) {", "  return m{k}(x);", "}", "const a{k} = (x) => h{k}(x);"],
    ["import { h{n} } from ''./f{n}'';", "interface I{k} {", "}", "class C{k} {", "  m{k}(x: number): number {", "    return h{n}(x);", "  }", "}", "function h{k}(x: number): number {", "  return m{k}(x);", "}"],
    ['import "acme/f{n}"', "type C{k} struct {", "}", "func (c *C{k}) m{k}(x int) int {", "  return h{n}(x)", "}", "func h{k}(x int) int {", "  return m{k}(x)", "}"],
    ["use acme::f{n};", "pub struct C{k} {", "}", "impl C{k} {", "  pub fn m{k}(&self, x: u32) -> u32 {", "    h{n}(x)", "  }", "}", "fn h{k}(x: u32) -> u32 {", "  x", "}"],
    ['#include "f{n}.c"', "typedef struct {", "  int x;", "} C{k};", "int h{k}(int x) {", "  return h{n}(x);", "}"],
    ['#include "f{n}.cpp"', "class C{k} {", "  int m{k}(int x) {", "    return h{n}(x);", "  }", "};", "int h{k}(int x) {", "  return x;", "}"],
]
EXTENSIONS = [".py", ".java", ".js", ".ts", ".go", ".rs", ".c", ".cpp"]
LANGUAGES = ["python", "java", "javascript", "typescript", "go", "rust", "c", "cpp"]


def _content(lines: list[str]) -> str:
    """A concat expression for the lines, each ended by a line feed."""
    parts = []
    for line in lines:
        parts.append("'" + line.replace("{k}", "', k, '").replace("{n}", "', n, '") + "', chr(10)")
    return f"concat({', '.join(parts)})"


def by_language(values: list[str]) -> str:
    return "CASE l " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


PATH = f"concat(d, '/s', k % 5, '/f', k, {by_language([repr(e) for e in EXTENSIONS])})"
CORPUS = f"SELECT repo, {PATH} AS path, {by_language([_content(t) for t in TEMPLATES])} AS content FROM p"
CORPUS_CTE = f"p AS ({P}), corpus AS ({CORPUS})"

KG_NODES = """
  SELECT concat('repo_', r_regionkey) AS id, 'Repository' AS label, r_name AS name, r_name AS repo FROM region
  UNION ALL SELECT concat('dir_', n_nationkey), 'Directory', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('file_', c_custkey), 'File', c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT concat('class_', o_orderkey), 'Class', concat('Order', o_orderkey), r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
KG_EDGES = """
  SELECT concat('repo_', n_regionkey) AS src, concat('dir_', n_nationkey) AS dst, 'CONTAIN' AS rel_type FROM nation
  UNION ALL SELECT concat('dir_', c_nationkey), concat('file_', c_custkey), 'CONTAIN' FROM customer
  UNION ALL SELECT concat('file_', o_custkey), concat('class_', o_orderkey), 'CONTAIN' FROM orders
  UNION ALL SELECT concat('file_', c_custkey), concat('file_', (c_custkey * 7 + 1) % 1000), 'USE' FROM customer WHERE (c_custkey * 7 + 1) % 1000 <> c_custkey"""
RUN_EVENTS = """
  SELECT concat('r', user_id) AS repo_id, ts AS timestamp, event_id AS seq,
    CASE CAST(floor(value) AS INT) % 5 WHEN 0 THEN 'structure_graph_build' WHEN 1 THEN 'dependency_graph_build'
         WHEN 2 THEN 'semantic_analysis' WHEN 3 THEN 'module_detection' ELSE 'vector_db_store' END AS stage,
    CASE event_type WHEN 'view' THEN 'stage_started' WHEN 'purchase' THEN 'stage_completed' WHEN 'error' THEN 'stage_failed' ELSE 'stage_started' END AS event
  FROM events"""
VECTORS = """
  SELECT concat('v', vec_id) AS id, concat('node_', vec_id) AS node_id, concat('repo', vec_id % 4) AS repo,
    CASE label % 5 WHEN 0 THEN 'File' WHEN 1 THEN 'Class' WHEN 2 THEN 'Method' WHEN 3 THEN 'Module' ELSE 'Workflow' END AS type, embedding FROM embeddings"""
DOC_FILES = """
  SELECT concat('doc_', doc_id) AS id, source AS repo, concat(lang, '/', source, '/doc', doc_id, '.md') AS path, 'doc' AS file_type, text AS content FROM documents"""


def derived(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    """The rows of a query over some of the given tables."""
    for table in tables:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(query)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path and content of code files in eight languages."""
    return derived(spark, sf_dir, f"WITH {CORPUS_CTE} SELECT * FROM corpus", "part")


def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, KG_NODES, "region", "nation", "customer", "orders")


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, KG_EDGES, "nation", "customer", "orders")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RUN_EVENTS, "events")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VECTORS, "embeddings")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DOC_FILES, "documents")
