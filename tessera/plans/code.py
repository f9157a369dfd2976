"""A small product made of the driver's tables: a source file for each part, a page for each supplier, a migration for
each nation and a test for each region; its declarations, chunks, graph, and answers over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, codegraph
from tessera.plans.tables import table

PRODUCT = "shop"


def _lines(*rows: list) -> Column:
    return F.concat_ws("\n", *(F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in row)) if row else F.lit("") for row in rows))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s, n, r = F.col("p_partkey"), F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    code = table(spark, sf_dir, "part").select(F.concat(F.lit("src/b"), k % 10, F.lit("/part"), k, F.lit(".py")).alias("uri"), _lines(
        ["import os"], ["from suppliers.s", k % 10, " import fetch", k % 10, ", store as keep", k % 7], [], ['@router.get("/parts/{item}/v', k % 3, '")'],
        ["def part_", k, "(x):"], ['    size = os.getenv("SIZE_', F.col("p_size"), '")'], ["    keep", k % 7, "(size)"], ["    return fetch", k % 10, "(x)"], [],
        ["class Part", k, "Store:"], ["    def load(self):"], ["        return part_", k, "(self)"]).alias("content"))
    docs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("docs/supplier"), s, F.lit(".md")).alias("uri"), _lines(
        ["# Supplier ", s], ["Read src/b", s % 10, "/part", s, ".py and `part_", s, "`."], [], ["## Routes"],
        ['Call /suppliers/{id} with os.getenv("NATION_', F.col("s_nationkey"), '").']).alias("content"))
    data = table(spark, sf_dir, "nation").select(F.concat(F.lit("db/migration_"), n, F.lit(".sql")).alias("uri"), _lines(
        ["CREATE TABLE IF NOT EXISTS nation_", n, " (id int);"], ["ALTER TABLE region_", F.col("n_regionkey"), " ADD COLUMN x int;"]).alias("content"))
    tests = table(spark, sf_dir, "region").select(F.concat(F.lit("tests/test_region"), r, F.lit(".py")).alias("uri"), _lines(["def test_region_", r, "():"], ["    assert True"]).alias("content"))
    return reduce(DataFrame.unionByName, (code, docs, data, tests)).select("uri", "content", F.lit("main").alias("source_key"), F.lit("git").alias("source_id"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.declarations(resources(spark, sf_dir)).select("uri", "name", "label", "is_test", "start_line", "end_line", "signature", "context")


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.edges(resources(spark, sf_dir), PRODUCT).select("edge_type", "from_id", "to_id", "uri")


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each set of labels there are."""
    return codegraph.nodes(resources(spark, sf_dir), PRODUCT).groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count("*").alias("n"), F.count("start_line").alias("n_placed"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).filter(F.col("uri").rlike(codegraph.CODE))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir)
    return chunking.code_chunks(code, codegraph.declarations(code)).select("uri", "start_line", "end_line", "context_path", F.length("content").alias("n_chars"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = resources(spark, sf_dir).filter(F.col("uri").rlike(codegraph.MARKDOWN))
    return chunking.markdown_chunks(docs, codegraph._headings(chunking.lines(docs)).select("uri", "at", "level", "title"))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown(spark, sf_dir).select("uri", "start_line", "end_line", "context_path", F.length("content").alias("n_chars"))


def chunk_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = codegraph.read(_code(spark, sf_dir))  # scanned once for chunks and nodes
    chunks = chunking.code_chunks(held.resources, codegraph.declarations(held)).select(F.concat_ws(":", "uri", "start_line").alias("chunk_id"), "uri", "start_line", "end_line")
    return codegraph.chunk_nodes(chunks, codegraph.nodes(held, PRODUCT)).select("chunk_id", F.array_join("node_ids", "|").alias("node_ids"))


def folder_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.communities(codegraph.nodes(resources(spark, sf_dir), PRODUCT))


def community_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = codegraph.read(resources(spark, sf_dir))
    return codegraph.community_sentences(codegraph.nodes(held, PRODUCT), codegraph.edges(held, PRODUCT))


def polyglot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each supplier, a Go file for each nation and a Java class for each region."""
    s, n, r = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    script = table(spark, sf_dir, "supplier").select(F.concat(F.lit("web/s"), s, F.lit(".ts")).alias("uri"), _lines(
        ["import { load", F.col("s_nationkey"), " as load } from './nations';"], ["// Shows supplier( ", s, " )."], ["export const Show", s, " = async ({ id }) => {"], ["  const name = 'fake(' + load(id);"], ["  return render", s, "(name);"], ["};"],
        ["function render", s, "(x) { return `call(${x})`; }"], ["class Box", s, " extends Base {"], ["  open() { return render", s, "(this); }"], ["}"]).alias("content"))
    go = table(spark, sf_dir, "nation").select(F.concat(F.lit("svc/n"), n, F.lit(".go")).alias("uri"), _lines(
        ["package svc"], ["import \"fmt\""], [], ["// Run", n, " starts it."], ["func (s *Nation", n, ") Run", n, "(x int) error {"], ["\treturn help", n, "(x)"], ["}"], ["type Nation", n, " struct {"], ["\tname string"], ["}"],
        ["func help", n, "(x int) error { return fmt.Errorf(\"none()\") }"]).alias("content"))
    java = table(spark, sf_dir, "region").select(F.concat(F.lit("jv/R"), r, F.lit(".java")).alias("uri"), _lines(
        ["package jv;"], ["import java.util.List;"], ["/**"], [" * Region ", r, "."], [" */"], ["public class R", r, " {"], ["    public int get", r, "(int a) {"], ["        return add(a);"], ["    }"], ["    private int add(int a) { return a; }"], ["}"]).alias("content"))
    return reduce(DataFrame.unionByName, (script, go, java)).select("uri", "content", F.lit("main").alias("source_key"), F.lit("git").alias("source_id"))


def polyglot_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.declarations(polyglot(spark, sf_dir)).select("uri", "name", "label", "start_line", "end_line", "doc_line", "context", "signature")


def polyglot_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codegraph.edges(polyglot(spark, sf_dir), PRODUCT)
    return found.filter("edge_type in ('CALLS', 'IMPORTS')").select("edge_type", "from_id", "to_id", "uri")


def polyglot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all kinds of resources, those of code with the comments above their declarations."""
    both = polyglot(spark, sf_dir).unionByName(resources(spark, sf_dir).filter("uri like 'docs/%' or uri like 'db/%'"))
    return codegraph.chunks(both).select("uri", "kind", "start_line", "end_line", "context_path")


QUERIES = {f.__name__: f for f in (polyglot_symbols, polyglot_edges, polyglot_chunks, code_symbols, code_edges, code_nodes, code_chunks, markdown_chunks, chunk_graph_nodes, folder_summaries, community_sentences)}

_PARTS = "parts AS (SELECT p_partkey AS k, p_size, 'src/b' || (p_partkey % 10) || '/part' || p_partkey || '.py' AS uri, 'src.b' || (p_partkey % 10) || '.part' || p_partkey AS module FROM part)"
_SYMBOLS = f"""{_PARTS}, symbols AS (SELECT uri, 'part_' || k AS name, 'Function' AS label, false AS is_test, 5 AS start_line, 8 AS end_line, 'def part_' || k || '(x)' AS signature, 'part_' || k AS context FROM parts
 UNION ALL SELECT uri, 'Part' || k || 'Store', 'Class', false, 10, 12, 'class Part' || k || 'Store', 'Part' || k || 'Store' FROM parts
 UNION ALL SELECT uri, 'load', 'Function', false, 11, 12, 'def load(self)', 'Part' || k || 'Store.load' FROM parts
 UNION ALL SELECT 'tests/test_region' || r_regionkey || '.py', 'test_region_' || r_regionkey, 'Function', true, 1, 2, 'def test_region_' || r_regionkey || '()', 'test_region_' || r_regionkey FROM region)"""
_FILES = f"""files AS (SELECT uri FROM parts UNION ALL SELECT 'docs/supplier' || s_suppkey || '.md' FROM supplier UNION ALL SELECT 'db/migration_' || n_nationkey || '.sql' FROM nation UNION ALL SELECT 'tests/test_region' || r_regionkey || '.py' FROM region)"""
_EDGES = f"""{_SYMBOLS}, {_FILES}, code AS (SELECT uri, module FROM parts UNION ALL SELECT 'tests/test_region' || r_regionkey || '.py', 'tests.test_region' || r_regionkey FROM region),
 docs AS (SELECT s_suppkey AS s, s_nationkey AS n, 'docs/supplier' || s_suppkey || '.md' AS uri, 'docs.supplier' || s_suppkey AS module FROM supplier),
 edges AS (SELECT DISTINCT * FROM (
 SELECT 'CONTAINS' AS edge_type, 'source:shop:main' AS from_id, 'repo:shop:git' AS to_id, uri FROM files UNION ALL SELECT 'CONTAINS', 'repo:shop:git', 'file:shop:' || uri, uri FROM files
 UNION ALL SELECT 'CONTAINS', 'file:shop:' || uri, 'module:shop:' || module, uri FROM code
 UNION ALL SELECT 'DECLARES', 'module:shop:' || c.module, 'symbol:shop:' || s.uri || ':' || s.name || ':' || s.label, s.uri FROM symbols s JOIN code c USING (uri)
 UNION ALL SELECT 'COVERS', 'symbol:shop:' || s.uri || ':' || s.name || ':' || s.label, 'module:shop:' || c.module, s.uri FROM symbols s JOIN code c USING (uri) WHERE is_test
 UNION ALL SELECT 'IMPORTS', 'module:shop:' || module, 'module:shop:os', uri FROM parts UNION ALL SELECT 'IMPORTS', 'module:shop:' || module, 'module:shop:suppliers.s' || (k % 10), uri FROM parts
 UNION ALL SELECT 'CALLS', 'symbol:shop:' || uri || ':part_' || k || ':Function', 'module:shop:suppliers.s' || (k % 10), uri FROM parts
 UNION ALL SELECT 'CALLS', 'symbol:shop:' || uri || ':Part' || k || 'Store:Class', 'symbol:shop:' || uri || ':part_' || k || ':Function', uri FROM parts
 UNION ALL SELECT 'HANDLES', 'symbol:shop:' || uri || ':part_' || k || ':Function', 'api:shop:GET:/parts/{{}}/v' || (k % 3) || ':' || module, uri FROM parts
 UNION ALL SELECT 'EXPOSES', 'file:shop:' || uri, 'api:shop:GET:/parts/{{}}/v' || (k % 3) || ':' || module, uri FROM parts
 UNION ALL SELECT 'READS', 'file:shop:' || uri, 'config:shop:SIZE_' || p_size, uri FROM parts
 UNION ALL SELECT 'WRITES', 'file:shop:db/migration_' || n_nationkey || '.sql', 'dbtable:shop:default:nation_' || n_nationkey, 'db/migration_' || n_nationkey || '.sql' FROM nation
 UNION ALL SELECT 'WRITES', 'file:shop:db/migration_' || n_nationkey || '.sql', 'dbtable:shop:default:region_' || n_regionkey, 'db/migration_' || n_nationkey || '.sql' FROM nation
 UNION ALL SELECT 'CONTAINS', 'file:shop:' || uri, 'document:shop:' || uri || ':Supplier ' || s, uri FROM docs
 UNION ALL SELECT 'CONTAINS', 'document:shop:' || uri || ':Supplier ' || s, 'document:shop:' || uri || ':Routes', uri FROM docs
 UNION ALL SELECT 'DOCUMENTS', 'document:shop:' || uri || ':Supplier ' || s, 'file:shop:src/b' || (s % 10) || '/part' || s || '.py', uri FROM docs
 UNION ALL SELECT 'MENTIONS', 'document:shop:' || uri || ':Supplier ' || s, 'api:shop:ANY:/b' || (s % 10) || '/part' || s || '.py:' || module, uri FROM docs
 UNION ALL SELECT 'MENTIONS', 'document:shop:' || uri || ':Supplier ' || s, 'symbol:shop:' || uri || ':part_' || s || ':Function', uri FROM docs
 UNION ALL SELECT 'MENTIONS', 'document:shop:' || uri || ':Routes', 'api:shop:ANY:/suppliers/{{}}:' || module, uri FROM docs
 UNION ALL SELECT 'MENTIONS', 'document:shop:' || uri || ':Routes', 'config:shop:NATION_' || n, uri FROM docs))"""
_CHUNKS = f"""{_PARTS}, sizes AS (SELECT *, length('def part_' || k || '(x):') + length('    size = os.getenv("SIZE_' || p_size || '")') + length('    keep' || (k % 7) || '(size)') + length('    return fetch' || (k % 10) || '(x)') + 3 AS f,
   length('class Part' || k || 'Store:') + length('    def load(self):') + length('        return part_' || k || '(self)') + 2 AS c,
   length('import os') + length('from suppliers.s' || (k % 10) || ' import fetch' || (k % 10) || ', store as keep' || (k % 7)) + length('@router.get("/parts/{{item}}/v' || (k % 3) || '")') + 3 AS head FROM parts),
 chunks AS (SELECT uri, 5 AS start_line, 8 AS end_line, 'part_' || k AS context_path, CAST(f AS INTEGER) AS n_chars FROM sizes WHERE f >= 64
 UNION ALL SELECT uri, 10, 12, 'Part' || k || 'Store', CAST(c AS INTEGER) FROM sizes WHERE c >= 64
 UNION ALL SELECT uri, 1, 4, '<module>', CAST(head AS INTEGER) FROM sizes WHERE f >= 64 AND c >= 64
 UNION ALL SELECT uri, 1, 4, '<module>', CAST(head AS INTEGER) FROM sizes WHERE f >= 64 AND c < 64
 UNION ALL SELECT uri, 1, 9, '<module>', CAST(head + f + 1 AS INTEGER) FROM sizes WHERE f < 64 AND c >= 64
 UNION ALL SELECT uri, 1, 12, '<module>', CAST(head + f + c + 3 AS INTEGER) FROM sizes WHERE f < 64 AND c < 64)"""
_POLYGLOT = """ts AS (SELECT s_suppkey AS k, s_nationkey AS n, 'web/s' || s_suppkey || '.ts' AS uri FROM supplier), gos AS (SELECT n_nationkey AS k, 'svc/n' || n_nationkey || '.go' AS uri FROM nation), jvs AS (SELECT r_regionkey AS k, 'jv/R' || r_regionkey || '.java' AS uri FROM region),
 found AS (SELECT uri, 'Show' || k AS name, 'Function' AS label, 3 AS start_line, 6 AS end_line, 2 AS doc_line, 'Show' || k AS context, 'export const Show' || k || ' = async ({ id })' AS signature FROM ts
 UNION ALL SELECT uri, 'render' || k, 'Function', 7, 7, 7, 'render' || k, 'function render' || k || '(x)' FROM ts UNION ALL SELECT uri, 'Box' || k, 'Class', 8, 10, 8, 'Box' || k, 'class Box' || k || ' extends Base' FROM ts
 UNION ALL SELECT uri, 'open', 'Function', 9, 9, 9, 'Box' || k || '.open', 'open()' FROM ts
 UNION ALL SELECT uri, 'Run' || k, 'Function', 5, 7, 4, 'Run' || k, 'func (s *Nation' || k || ') Run' || k || '(x int) error' FROM gos UNION ALL SELECT uri, 'Nation' || k, 'Class', 8, 10, 8, 'Nation' || k, 'type Nation' || k || ' struct' FROM gos
 UNION ALL SELECT uri, 'help' || k, 'Function', 11, 11, 11, 'help' || k, 'func help' || k || '(x int) error' FROM gos
 UNION ALL SELECT uri, 'R' || k, 'Class', 6, 11, 3, 'R' || k, 'public class R' || k FROM jvs UNION ALL SELECT uri, 'get' || k, 'Function', 7, 9, 7, 'R' || k || '.get' || k, 'public int get' || k || '(int a)' FROM jvs
 UNION ALL SELECT uri, 'add', 'Function', 10, 10, 10, 'R' || k || '.add', 'private int add(int a)' FROM jvs)"""
ORACLE_SQL = {
    "polyglot_symbols": f"WITH {_POLYGLOT} SELECT * FROM found",
    "polyglot_edges": f"""WITH {_POLYGLOT} SELECT 'IMPORTS' AS edge_type, 'module:shop:web.s' || k AS from_id, 'module:shop:./nations' AS to_id, uri FROM ts UNION ALL SELECT 'IMPORTS', 'module:shop:svc.n' || k, 'module:shop:fmt', uri FROM gos
      UNION ALL SELECT 'IMPORTS', 'module:shop:jv.R' || k, 'module:shop:java.util.List', uri FROM jvs
      UNION ALL SELECT 'CALLS', 'symbol:shop:' || uri || ':Show' || k || ':Function', 'module:shop:./nations', uri FROM ts UNION ALL SELECT 'CALLS', 'symbol:shop:' || uri || ':Show' || k || ':Function', 'symbol:shop:' || uri || ':render' || k || ':Function', uri FROM ts
      UNION ALL SELECT 'CALLS', 'symbol:shop:' || uri || ':Box' || k || ':Class', 'symbol:shop:' || uri || ':render' || k || ':Function', uri FROM ts
      UNION ALL SELECT 'CALLS', 'symbol:shop:' || uri || ':Run' || k || ':Function', 'symbol:shop:' || uri || ':help' || k || ':Function', uri FROM gos
      UNION ALL SELECT 'CALLS', 'symbol:shop:' || uri || ':R' || k || ':Class', 'symbol:shop:' || uri || ':add:Function', uri FROM jvs""",
    "code_symbols": f"WITH {_SYMBOLS} SELECT * FROM symbols",
    "code_edges": f"WITH {_EDGES} SELECT edge_type, from_id, to_id, uri FROM edges",
    "code_nodes": """WITH p AS (SELECT count(*) AS n, count(DISTINCT p_size) AS z, count(DISTINCT p_partkey % 10) AS m FROM part), s AS (SELECT count(*) AS n, count(DISTINCT s_nationkey) AS z FROM supplier), t AS (SELECT count(*) AS n, count(DISTINCT n_regionkey) AS z FROM nation),
      r AS (SELECT count(*) AS n FROM region), gone AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part))
      SELECT labels, n, n_placed FROM (SELECT unnest([{'labels': 'CodeFile', 'n': p.n + gone.n, 'n_placed': 0}, {'labels': 'CodeFile,Test', 'n': r.n, 'n_placed': 0}, {'labels': 'Document,Migration', 'n': t.n, 'n_placed': 0}, {'labels': 'Module', 'n': p.n + r.n + 1 + p.m, 'n_placed': 0},
        {'labels': 'Function', 'n': 2 * p.n + s.n, 'n_placed': 2 * p.n}, {'labels': 'Class', 'n': p.n, 'n_placed': p.n}, {'labels': 'Function,Test', 'n': r.n, 'n_placed': r.n}, {'labels': 'Document', 'n': 3 * s.n, 'n_placed': 2 * s.n}, {'labels': 'APIEndpoint', 'n': p.n + 2 * s.n, 'n_placed': 0},
        {'labels': 'Config', 'n': p.z + s.z, 'n_placed': 0}, {'labels': 'DBTable', 'n': t.n + t.z, 'n_placed': 0}, {'labels': 'Source', 'n': 1, 'n_placed': 0}, {'labels': 'Repository', 'n': 1, 'n_placed': 0}], recursive := true) FROM p, s, t, r, gone)""",
    "code_chunks": f"WITH {_CHUNKS} SELECT * FROM chunks",
    "markdown_chunks": """SELECT 'docs/supplier' || s_suppkey || '.md' AS uri, 1 AS start_line, 3 AS end_line, 'Supplier ' || s_suppkey AS context_path,
      CAST(length('# Supplier ' || s_suppkey) + 1 + length('Read src/b' || (s_suppkey % 10) || '/part' || s_suppkey || '.py and `part_' || s_suppkey || '`.') AS INTEGER) AS n_chars FROM supplier
      UNION ALL SELECT 'docs/supplier' || s_suppkey || '.md', 4, 5, 'Supplier ' || s_suppkey || ' / Routes', CAST(10 + length('Call /suppliers/{id} with os.getenv("NATION_' || s_nationkey || '").') AS INTEGER) FROM supplier""",
    "chunk_graph_nodes": f"""WITH {_CHUNKS}, spans AS (SELECT uri, 'symbol:shop:' || uri || ':part_' || k || ':Function' AS node_id, 5 AS a, 8 AS b FROM parts UNION ALL SELECT uri, 'symbol:shop:' || uri || ':Part' || k || 'Store:Class', 10, 12 FROM parts
      UNION ALL SELECT uri, 'symbol:shop:' || uri || ':load:Function', 11, 12 FROM parts UNION ALL SELECT uri, 'file:shop:' || uri, 1, 99 FROM parts UNION ALL SELECT uri, 'module:shop:' || module, 1, 99 FROM parts)
      SELECT c.uri || ':' || c.start_line AS chunk_id, array_to_string(list_sort(list_distinct(list(node_id))), '|') AS node_ids FROM chunks c JOIN spans s ON s.uri = c.uri AND s.a <= c.end_line AND s.b >= c.start_line GROUP BY ALL""",
    "folder_summaries": f"""WITH {_SYMBOLS}, held AS (SELECT 'src/b' || (k % 10) AS folder, 'CodeFile' AS label, 'part' || k || '.py' AS name FROM parts UNION ALL SELECT 'src/b' || (k % 10), 'Module', module FROM parts
      UNION ALL SELECT regexp_extract(uri, '^(.*)/[^/]*$', 1), label, name FROM symbols UNION ALL SELECT 'tests', 'CodeFile', 'test_region' || r_regionkey || '.py' FROM region UNION ALL SELECT 'tests', 'Module', 'tests.test_region' || r_regionkey FROM region
      UNION ALL SELECT 'db', 'Document', 'migration_' || n_nationkey || '.sql' FROM nation UNION ALL SELECT 'docs', 'Document', unnest(['supplier' || s_suppkey || '.md', 'Supplier ' || s_suppkey, 'Routes']) FROM supplier),
      labels AS (SELECT folder, label, count(*) AS n, array_to_string(list_sort(list_distinct(list(name)))[1:5], ', ') AS names FROM held GROUP BY ALL)
      SELECT folder, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN label = 'CodeFile' THEN n ELSE 0 END) AS BIGINT) AS n_code, string_agg(label || ' (' || n || '): ' || names, '; ' ORDER BY label) AS summary FROM labels GROUP BY folder""",
    "community_sentences": f"""WITH {_EDGES}, said AS (SELECT uri, CASE WHEN edge_type IN ('CALLS', 'HANDLES') THEN 0 WHEN edge_type IN ('READS', 'WRITES') THEN 1 WHEN edge_type IN ('DOCUMENTS', 'MENTIONS', 'COVERS') THEN 2 END AS kind, edge_type, from_id, to_id,
        list_transform([from_id, to_id], lambda x: CASE split_part(x, ':', 1) WHEN 'symbol' THEN string_split(x, ':')[-2] WHEN 'api' THEN string_split(x, ':')[-2] WHEN 'file' THEN string_split(x, '/')[-1] ELSE string_split(x, ':')[-1] END) AS ends FROM edges),
      first_ AS (SELECT *, row_number() OVER (PARTITION BY uri, kind ORDER BY edge_type, from_id, to_id) AS r FROM said WHERE kind IS NOT NULL),
      told AS (SELECT uri, kind, ['Flows', 'Runtime/config/data', 'Docs/tests'][kind + 1] || ': ' || string_agg(ends[1] || ' -' || edge_type || '-> ' || ends[2], '; ' ORDER BY r) || '.' AS line FROM first_ WHERE r <= 16 GROUP BY uri, kind)
      SELECT uri, 'Graph community for ' || uri || '.' || chr(10) || string_agg(line, chr(10) ORDER BY kind) AS summary FROM told GROUP BY uri""",
}
