"""Evidence for questions about a product made of the driver's tables: documents, and pages of regions, nations and suppliers
with their graph, symbols and skills."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evidence, graph
from tessera.plans import retrieval
from tessera.plans.tables import table

K = 10


def _id(kind: str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), key.cast("string"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, items = (table(spark, sf_dir, t) for t in ("nation", "region", "benchmark"))
    return nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("What depends on "), "n_name", F.lit("?")).alias("query")).unionByName(
        region.select((100 + F.col("r_regionkey")).cast("long").alias("query_id"), F.concat(F.lit("Give an overview of "), "r_name").alias("query"))).unionByName(
        items.select((1000 + F.col("item_id")).cast("long").alias("query_id"), F.col("text").alias("query")))


def product(spark: SparkSession, sf_dir: str) -> evidence.Product:
    nation, region, supplier, part = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "part"))
    of_region = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    of_nation = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    held = region.join(of_region.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("names")), F.col("r_regionkey") == F.col("n_regionkey"))
    n_file, s_file = F.concat(F.lit("nations/"), "n_name", F.lit(".md")), F.concat(F.lit("suppliers/s"), "s_suppkey", F.lit(".py"))

    def chunk(rows: DataFrame, key: Column, file: Column, context: Column, content: Column, kind: str | None = None) -> DataFrame:
        return rows.select(key.cast("long").alias("chunk_id"), file.alias("file"), F.lit(1).alias("line"), context.alias("context_path"), content.alias("content"), F.lit(kind).cast("string").alias("artifact_type"))

    chunks = reduce(DataFrame.unionByName, (
        chunk(table(spark, sf_dir, "documents"), F.col("doc_id"), F.concat_ws("/", "source", "doc_id"), F.col("lang"), F.col("text")),
        chunk(of_region, -1 - F.col("n_nationkey"), n_file, F.col("n_name"), F.concat("n_name", F.lit(" lies in "), "r_name", F.lit("."))),
        chunk(held, -51 - F.col("r_regionkey"), F.concat(F.lit("regions/"), "r_name"), F.col("r_name"), F.concat("r_name", F.lit(" holds "), "names"), "graph_community_summary"),
        chunk(of_nation, -101 - F.col("s_suppkey"), s_file, F.col("s_name"), F.concat(F.lit("def located_"), "s_suppkey", F.lit('(): return "'), "n_name", F.lit('"')))))

    def node(rows: DataFrame, kind: str, key: str, name: str, label: str, confidence: float, uri: Column) -> DataFrame:
        return rows.select(_id(kind, F.col(key)).alias("node_id"), F.col(name).alias("name"), F.array(F.lit(label)).alias("labels"), F.lit(confidence).alias("confidence"), uri.alias("uri"))

    def edge(rows: DataFrame, kind: str, a: Column, b: Column, confidence: float, method: str = "deterministic") -> DataFrame:
        return rows.select(F.lit(kind).alias("edge_type"), a.alias("from_id"), b.alias("to_id"), F.lit("active").alias("status"), F.lit(confidence).alias("confidence"), F.lit(method).alias("extraction_method"))

    r, n, s = _id("region", F.col("r_regionkey")), _id("nation", F.col("n_nationkey")), _id("supplier", F.col("s_suppkey"))
    nodes = reduce(DataFrame.unionByName, (node(region, "region", "r_regionkey", "r_name", "Service", 1.0, F.concat(F.lit("regions/"), "r_name")), node(nation, "nation", "n_nationkey", "n_name", "APIEndpoint", 1.0, n_file), node(supplier, "supplier", "s_suppkey", "s_name", "Function", 0.9, s_file), node(part, "part", "p_partkey", "p_name", "DBTable", 0.5, F.lit(None).cast("string"))))
    supplied = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    edges = reduce(DataFrame.unionByName, (edge(of_region, "CONTAINS", r, n, 1.0), edge(of_nation, "DECLARES", n, s, 0.9), edge(supplied, "CALLS", _id("part", F.col("l_partkey")), _id("supplier", F.col("l_suppkey")), 0.8, "model")))
    attached = nation.select((-1 - F.col("n_nationkey")).cast("long").alias("chunk_id"), n.alias("node_id")).unionByName(
        region.select((-51 - F.col("r_regionkey")).cast("long").alias("chunk_id"), r.alias("node_id"))).unionByName(supplier.select((-101 - F.col("s_suppkey")).cast("long").alias("chunk_id"), s.alias("node_id")))
    symbols = nation.select(n_file.alias("uri"), F.col("n_name").alias("name"), F.lit("class").alias("kind"), F.lit(1).alias("line_no"), F.concat(F.lit("class "), "n_name").alias("signature")).unionByName(
        supplier.select(s_file.alias("uri"), F.concat(F.lit("located_"), "s_suppkey").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_no"), F.concat(F.lit("def located_"), "s_suppkey", F.lit("()")).alias("signature")))
    skills = region.select(F.concat(F.lower("r_name"), F.lit("_guide")).alias("name"), F.concat(F.lit("How "), "r_name", F.lit(" is supplied")).alias("description"), F.lit("").alias("body"),
                           F.when(F.col("r_regionkey") == 0, "product_master").otherwise("flow").alias("tier"), (0.5 + F.col("r_regionkey") / 10).alias("confidence"))
    return evidence.Product(chunks, nodes, edges, attached, symbols, skills)


def graph_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = product(spark, sf_dir)
    planned = evidence.query_plan(evidence.understand(questions(spark, sf_dir)))
    found = graph.ranks(held.nodes, held.edges, evidence.graph_seeds(held.nodes, planned), 2)
    return found.select("query_id", "node_id", "rank", "score", F.array_join("path", ">").alias("path"), F.array_join("edge_types", ">").alias("edge_types"), "n_edges")


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.gather(product(spark, sf_dir), questions(spark, sf_dir), K)[0]


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.gather(product(spark, sf_dir), questions(spark, sf_dir), K)[1]
    return found.select("query_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), "sufficient")


def query_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return evidence.understand(turns.filter("query is not null")).groupBy("shape").agg(F.count("*").alias("n"), F.sum(F.size("anchors")).alias("n_anchors"))


QUERIES = {f.__name__: f for f in (graph_ranks, evidence_merge, evidence_coverage, query_shapes)}


def _listed(form: str, group: int = 0) -> str:
    return f"list_distinct(regexp_extract_all(text, '{form}', {group}))"


# the SQL's pattern language has no looking ahead, so symbols that a parenthesis follows are found with it and cut
_WORDS = "regexp_extract_all(lower(text), '[a-z_][A-Za-z0-9_]*')"


def _understood(source: str) -> str:
    return rf"""found AS (SELECT *, {_listed(evidence.PATH)} AS paths, {_listed(evidence.ROUTE, 1)} AS routes, {_listed(evidence.CONFIG)} AS keys, {_WORDS} AS words,
      list_distinct(list_concat(regexp_extract_all(text, '\b(?:[A-Za-z]+_\w+|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*)'), regexp_extract_all(text, '\b([A-Za-z_]\w{{2,}})\s*\(', 1))) AS names FROM {source}),
      told AS (SELECT *, list_filter(names, lambda x: NOT list_contains(keys, x)) AS symbols FROM found),
      shaped AS MATERIALIZED (SELECT *, CASE WHEN list_has_any(words, {evidence.RELATIONAL}) THEN 'relational' WHEN list_has_any(words, {evidence.PROCEDURAL}) THEN 'procedural'
        WHEN len(paths) + len(routes) + len(symbols) > 0 OR list_has_any(words, {evidence.LOCAL}) THEN 'local' ELSE 'global' END AS shape,
        list_distinct(list_concat(list_concat(paths, routes), list_concat(symbols, keys))) AS anchors FROM told)"""


_HELD = f"""
 questions AS MATERIALIZED (SELECT n_nationkey::BIGINT AS query_id, 'What depends on ' || n_name || '?' AS text FROM nation UNION ALL SELECT 100 + r_regionkey, 'Give an overview of ' || r_name FROM region UNION ALL SELECT 1000 + item_id, text FROM benchmark),
 {_understood("questions")},
 planned AS MATERIALIZED (SELECT *, CASE WHEN shape IN ('local', 'relational') OR len(anchors) > 0 THEN 'local' ELSE 'global' END AS mode,
   CASE shape WHEN 'relational' THEN {evidence.EDGE_TYPES['relational']} WHEN 'global' THEN {evidence.EDGE_TYPES['global']} ELSE {evidence.LOCAL_EDGE_TYPES} END AS types FROM shaped),
 chunks AS MATERIALIZED (SELECT doc_id::BIGINT AS doc_id, source || '/' || doc_id AS file, lang AS context, text, NULL AS artifact FROM documents
   UNION ALL SELECT -1 - n_nationkey, 'nations/' || n_name || '.md', n_name, n_name || ' lies in ' || r_name || '.', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
   UNION ALL SELECT -51 - r_regionkey, 'regions/' || r_name, r_name, r_name || ' holds ' || names, 'graph_community_summary' FROM region JOIN (SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ' ') AS names FROM nation GROUP BY 1) ON n_regionkey = r_regionkey
   UNION ALL SELECT -101 - s_suppkey, 'suppliers/s' || s_suppkey || '.py', s_name, 'def located_' || s_suppkey || '(): return "' || n_name || '"', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 nodes AS MATERIALIZED (SELECT 'region:' || r_regionkey AS node_id, r_name AS name, 'Service' AS label, 1.0::DOUBLE AS confidence, 'regions/' || r_name AS uri FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'APIEndpoint', 1.0, 'nations/' || n_name || '.md' FROM nation
   UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'Function', 0.9, 'suppliers/s' || s_suppkey || '.py' FROM supplier UNION ALL SELECT 'part:' || p_partkey, p_name, 'DBTable', 0.5, NULL FROM part),
 edges AS MATERIALIZED (SELECT 'CONTAINS' AS edge_type, 'region:' || r_regionkey AS from_id, 'nation:' || n_nationkey AS to_id, 3.0::DOUBLE * 1.0 * 1.2::DOUBLE AS score FROM nation JOIN region ON n_regionkey = r_regionkey
   UNION ALL SELECT 'DECLARES', 'nation:' || n_nationkey, 'supplier:' || s_suppkey, 3.0::DOUBLE * 0.9::DOUBLE * 1.4::DOUBLE FROM supplier JOIN nation ON s_nationkey = n_nationkey
   UNION ALL SELECT DISTINCT 'CALLS', 'part:' || l_partkey, 'supplier:' || l_suppkey, 3.0::DOUBLE * 0.8::DOUBLE * 0.75::DOUBLE * 1.2::DOUBLE FROM lineitem),
 attached AS (SELECT -1 - n_nationkey AS chunk_id, 'nation:' || n_nationkey AS node_id FROM nation UNION ALL SELECT -51 - r_regionkey, 'region:' || r_regionkey FROM region UNION ALL SELECT -101 - s_suppkey, 'supplier:' || s_suppkey FROM supplier),
 anchored_ AS (SELECT query_id, types, unnest(anchors[1:8]) AS mention, unnest(range(1, least(len(anchors), 8) + 1)) AS place FROM planned WHERE len(anchors) > 0),
 resolved AS MATERIALIZED (SELECT mention, node_id, row_number() OVER (PARTITION BY mention ORDER BY score DESC, node_id) AS rank FROM (
   SELECT mention, node_id, round(CASE WHEN lower(name) = lower(mention) THEN 100 WHEN ends_with(lower(name), lower(mention)) THEN 80 ELSE 50 END * confidence, 6) AS score
   FROM (SELECT DISTINCT mention FROM anchored_ WHERE length(mention) >= 3) JOIN nodes ON contains(lower(name), lower(mention)))),
 seeds AS MATERIALIZED (SELECT query_id, node_id, types FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, rank, node_id) AS r FROM (
   SELECT query_id, node_id, min({{'place': place, 'rank': rank}}).place AS place, min({{'place': place, 'rank': rank}}).rank AS rank, any_value(types) AS types FROM anchored_ JOIN resolved USING (mention) WHERE rank <= 4 GROUP BY query_id, node_id)) WHERE r <= 8),
 arcs AS MATERIALIZED (SELECT here, there, edge_type, max(least(score / (3.0::DOUBLE * 1.4::DOUBLE), 1.0::DOUBLE)) AS strength FROM (SELECT from_id AS here, to_id AS there, edge_type, score FROM edges UNION ALL SELECT to_id, from_id, edge_type, score FROM edges) GROUP BY ALL),
 of_types AS (SELECT DISTINCT query_id, types FROM seeds),
 s0 AS MATERIALIZED (SELECT query_id, node_id, {{'less': -1.0::DOUBLE, 'hops': 1, 'path': [node_id], 'types': []::VARCHAR[]}} AS best FROM seeds),
 {", ".join(f'''s{k} AS MATERIALIZED (SELECT query_id, node_id, min(best) AS best FROM (SELECT * FROM s{k - 1} UNION ALL
   SELECT s.query_id, there, {{'less': best.less * strength, 'hops': best.hops + 1, 'path': list_append(best.path, there), 'types': list_append(best.types, edge_type)}} FROM s{k - 1} s JOIN of_types USING (query_id) JOIN arcs ON here = node_id AND list_contains(types, edge_type)) GROUP BY ALL)''' for k in (1, 2))},
 within_ AS MATERIALIZED (SELECT a.query_id, from_id, to_id, e.score FROM s2 a JOIN of_types USING (query_id) JOIN edges e ON e.from_id = a.node_id AND list_contains(types, edge_type) JOIN s2 b ON b.query_id = a.query_id AND b.node_id = e.to_id),
 by_edge AS (SELECT query_id, node_id, max(score) AS s FROM (SELECT query_id, from_id AS node_id, score FROM within_ UNION ALL SELECT query_id, to_id, score FROM within_) GROUP BY ALL),
 n_within AS (SELECT query_id, count(*) AS n_edges FROM within_ GROUP BY ALL),
 ranks AS MATERIALIZED (SELECT a.query_id, a.node_id, round(greatest(CASE WHEN a.best.hops = 1 THEN 10.0::DOUBLE END, 5.0::DOUBLE * confidence + CASE WHEN label IN ('APIEndpoint', 'Function') THEN 1.5 ELSE 1.0 END, s), 6) AS rank,
   round(-a.best.less, 6) AS score, array_to_string(a.best.path, '>') AS path, array_to_string(a.best.types, '>') AS edge_types, coalesce(n_edges, 0) AS n_edges
   FROM s2 a JOIN nodes USING (node_id) LEFT JOIN by_edge b ON b.query_id = a.query_id AND b.node_id = a.node_id LEFT JOIN n_within w ON w.query_id = a.query_id)"""


def _searched(sql: str, queries: str, suffix: str = "") -> str:
    """The SQL of a search over documents with benchmark passages, over chunks with other queries; with another suffix to its names."""
    sql = sql.replace("FROM documents", "FROM chunks").replace("item_id", "query_id").replace("FROM benchmark", f"FROM {queries}")
    for name in re.findall(r"^\s(\w+) AS ", sql, re.M) if suffix else []:
        sql = re.sub(rf"\b{name}\b", f"{name}{suffix}", sql)
    return sql


_HEAD = "lower(concat_ws(' ', file, context))"
_ROLE = """CASE WHEN channel = 'summary' THEN 'overview' WHEN channel = 'graph' THEN 'relationship' WHEN regexp_matches(lower(file), '\\.mdx?$') THEN 'overview'
   WHEN regexp_matches(lower(concat_ws(' ', file, context, text)), 'test|assert ') THEN 'validation' WHEN regexp_matches(lower(concat_ws(' ', file, context, text)), 'class |def |function |const ') THEN 'implementation' ELSE 'definition' END"""
_SAID = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}')"


def _weights(values: dict[str, float], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " ELSE 0.0::DOUBLE END"


def _merged(pool: str, out: str) -> str:
    """out: what merge() leaves of pool (query_id, channel, chunk_id, file, line, role, score). No file has more than two candidates here, so none is passed over."""
    quotas = (("channel = 'hybrid'", "5"), ("channel = 'grep'", "CASE WHEN len(anchors) > 0 THEN 2 ELSE 1 END"), ("channel = 'repo_map'", "CASE WHEN shape IN ('global', 'local') THEN 2 ELSE 1 END"),
              ("channel = 'graph'", "CASE WHEN shape = 'relational' THEN 3 ELSE 1 END"), ("channel = 'summary'", "CASE WHEN shape = 'global' THEN 2 ELSE 1 END"), ("role = 'overview'", "CASE WHEN shape = 'global' THEN 2 ELSE 1 END"),
              ("channel = 'skill'", "CASE WHEN shape IN ('procedural', 'global') THEN 1 ELSE 0 END"))
    phase = " ".join(f"WHEN {what} AND r{k} <= {n} THEN {k}" for k, (what, n) in enumerate(quotas))
    places = ", ".join(f"row_number() OVER (PARTITION BY query_id, {what} ORDER BY rank_score DESC, chunk_id) AS r{k}" for k, (what, _) in enumerate(quotas))
    return f"""once_{out} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file, chunk_id, line ORDER BY {_weights(evidence.CHANNELS, 'channel')} + score DESC, channel) AS c FROM {pool}) WHERE c = 1),
 valued_{out} AS (SELECT o.*, shape, anchors, round(score + CASE WHEN len(list_filter(anchors, lambda a: lower(a) = regexp_extract(lower(split_part(file, ':', 1)), '([^/]*?)(?:\\.[^./]*)?/*$', 1))) > 0 THEN 0.5 ELSE 0.0 END
   + {_weights(evidence.CHANNELS, 'channel')} + {_weights(evidence.ROLES, 'role')}, 6) AS rank_score FROM once_{out} o JOIN planned USING (query_id)),
 phased_{out} AS (SELECT *, CASE {phase} ELSE 99 END AS phase FROM (SELECT *, {places} FROM valued_{out})),
 {out} AS MATERIALIZED (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, chunk_id) AS INTEGER) AS slot, channel, chunk_id, file, line, role, score, rank_score FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, rank_score DESC, chunk_id) AS taken FROM phased_{out}) WHERE taken <= {K})"""


def _covered(shown: str, out: str) -> str:
    return f"""facts_{out} AS (SELECT s.query_id, bool_or(s.role = 'overview' OR regexp_matches(lower(s.file), '\\.mdx?$')) AS overview, bool_or(s.role = 'implementation') AS implementation, bool_or(s.channel = 'graph' OR s.role = 'relationship') AS relationship,
   bool_or(s.channel IN ('grep', 'repo_map') OR len(list_filter(anchors, lambda a: contains(lower(concat_ws(chr(10), s.file, t.excerpt)), lower(a)))) > 0) AS definition
   FROM {shown} s JOIN planned USING (query_id) LEFT JOIN (SELECT query_id, chunk_id, max(excerpt) AS excerpt FROM said GROUP BY ALL) t ON t.query_id = s.query_id AND t.chunk_id = s.chunk_id GROUP BY s.query_id),
 {out} AS MATERIALIZED (SELECT query_id, list_filter(facets, lambda x: x.met) AS yes, list_filter(facets, lambda x: NOT x.met) AS no FROM (SELECT p.query_id, list_filter([
   {{'name': 'source', 'asked': true, 'met': f.query_id IS NOT NULL}}, {{'name': 'overview', 'asked': shape = 'global', 'met': coalesce(overview, false)}}, {{'name': 'implementation', 'asked': shape = 'global', 'met': coalesce(implementation, false)}},
   {{'name': 'relationship', 'asked': shape = 'relational', 'met': coalesce(relationship, false)}}, {{'name': 'definition', 'asked': len(anchors) > 0, 'met': coalesce(definition, false)}}], lambda x: x.asked) AS facets FROM planned p LEFT JOIN facts_{out} f USING (query_id)))"""


_SCORE = """round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9_]+')), list_distinct(regexp_extract_all(lower(excerpt), '[a-z0-9_]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9_]+'))), 1)::DOUBLE, 6)"""
_GATHERED = f"""{_HELD}, {_searched(retrieval._BM25, 'questions')},
 named AS (SELECT query_id, concat_ws(' ', text, array_to_string(anchors, ' ')) AS text FROM planned), {_searched(retrieval._grep(_HEAD), 'named')},
 by_graph AS (SELECT query_id, chunk_id, round(1.0::DOUBLE + max(rank) + CASE WHEN chunk_id BETWEEN -100 AND -51 THEN 1.0 ELSE 0.0 END, 6) AS rank FROM ranks JOIN attached USING (node_id) GROUP BY query_id, chunk_id),
 summed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, CASE WHEN mode = 'global' THEN 6 ELSE 3 END AS most FROM bm25 JOIN planned USING (query_id) WHERE rank <= CASE WHEN mode = 'global' THEN 24 ELSE 12 END AND chunk_id BETWEEN -100 AND -51),
 found_by AS (SELECT query_id, 'hybrid' AS channel, chunk_id FROM bm25 WHERE rank <= 40 UNION ALL SELECT query_id, 'grep', chunk_id FROM grep WHERE rank <= 12 UNION ALL SELECT query_id, 'summary', chunk_id FROM summed WHERE r <= most
   UNION ALL SELECT query_id, 'graph', chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, chunk_id) AS r FROM by_graph) WHERE r <= 12),
 spoken AS (SELECT query_id, unnest(list_distinct({_SAID})) AS term FROM questions),
 symbols_ AS (SELECT 'nations/' || n_name || '.md' AS uri, n_name AS name, 2.0::DOUBLE AS more, 'class ' || n_name AS signature FROM nation UNION ALL SELECT 'suppliers/s' || s_suppkey || '.py', 'located_' || s_suppkey, 1.0, 'def located_' || s_suppkey || '()' FROM supplier),
 mapped AS (SELECT query_id, uri, name, signature, row_number() OVER (PARTITION BY query_id ORDER BY 5.0::DOUBLE * count(*) + more DESC, uri, name) AS r FROM symbols_ JOIN spoken ON contains(lower(concat_ws(' ', uri, name, signature)), term) GROUP BY query_id, uri, name, signature, more),
 skills_ AS (SELECT lower(r_name) || '_guide' AS name, 'How ' || r_name || ' is supplied' AS description, r_regionkey = 0 AS main, 0.5::DOUBLE + r_regionkey / 10::DOUBLE AS confidence FROM region),
 guided AS (SELECT query_id, name, description, row_number() OVER (PARTITION BY query_id ORDER BY n + 0.25::DOUBLE * confidence DESC, name) AS r FROM (
   SELECT q.query_id, name, description, main, confidence, (SELECT count(*) FROM spoken s WHERE s.query_id = q.query_id AND contains(lower(concat_ws(' ', name, description, '')), term)) AS n FROM questions q, skills_) WHERE n > 0 OR main),
 placed AS MATERIALIZED (SELECT query_id, channel, CAST(chunk_id AS VARCHAR) AS chunk_id, file, 1 AS line, {_ROLE} AS role, substr(trim(text), 1, 1600) AS excerpt FROM found_by JOIN chunks ON chunk_id = doc_id
   UNION ALL SELECT query_id, 'repo_map', concat_ws(':', 'repo_map', uri, 1, name), uri, 1, 'definition', signature FROM mapped WHERE r <= 8
   UNION ALL SELECT query_id, 'skill', 'skill:' || name, 'skills/' || name || '/SKILL.md', 1, 'skill_guidance', description FROM guided WHERE r <= 4),
 pool_a AS MATERIALIZED (SELECT p.*, {_SCORE} AS score FROM placed p JOIN questions q USING (query_id)),
 {_merged('pool_a', 'shown_a')}, said AS MATERIALIZED (SELECT query_id, chunk_id, excerpt FROM pool_a), {_covered('shown_a', 'covered_a')},
 lacking AS (SELECT p.query_id, concat_ws(' ', text, array_to_string(anchors, ' '), array_to_string(list_transform(no, lambda x: x.name), ' ')) AS text FROM planned p JOIN covered_a USING (query_id) WHERE len(no) > 0),
 {_searched(retrieval._grep(_HEAD), 'lacking', 'R')},
 more AS MATERIALIZED (SELECT m.query_id, m.channel, m.chunk_id, m.file, m.line, m.role, {_SCORE} AS score, excerpt FROM (
   SELECT query_id, channel, CAST(chunk_id AS VARCHAR) AS chunk_id, file, 1 AS line, {_ROLE} AS role, substr(trim(text), 1, 1600) AS excerpt FROM (SELECT query_id, 'grep' AS channel, chunk_id FROM grepR WHERE rank <= 8) JOIN chunks ON chunk_id = doc_id) m JOIN questions q USING (query_id)),
 new_ AS MATERIALIZED (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM shown_a s WHERE s.query_id = m.query_id AND s.chunk_id = m.chunk_id)),
 pool_b AS (SELECT query_id, channel, chunk_id, file, line, role, score FROM shown_a WHERE query_id IN (SELECT query_id FROM new_) UNION ALL SELECT query_id, channel, chunk_id, file, line, role, score FROM new_), {_merged('pool_b', 'shown_b')},
 shown AS MATERIALIZED (SELECT *, false AS repaired FROM shown_a WHERE query_id NOT IN (SELECT query_id FROM new_) UNION ALL SELECT *, true FROM shown_b)"""
_AFTER = _covered("shown", "covered_b").replace("FROM said", "FROM (SELECT * FROM said UNION ALL SELECT query_id, chunk_id, excerpt FROM more)")

ORACLE_SQL: dict[str, str] = {
    "graph_ranks": f"WITH {_HELD} SELECT * FROM ranks",
    "evidence_merge": f"WITH {_GATHERED} SELECT * FROM shown",
    "evidence_coverage": f"""WITH {_GATHERED}, {_AFTER} SELECT query_id, array_to_string(list_transform(yes, lambda x: x.name), ',') AS covered, array_to_string(list_transform(no, lambda x: x.name), ',') AS missing, len(no) = 0 AS sufficient FROM covered_b""",
    "query_shapes": f"WITH {_understood('(SELECT text FROM conversations WHERE text IS NOT NULL)')} SELECT shape, count(*) AS n, CAST(sum(len(anchors)) AS BIGINT) AS n_anchors FROM shaped GROUP BY shape",
}
