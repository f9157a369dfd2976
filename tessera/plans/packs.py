"""Context packs, dependencies and impact over the product that evidence.py makes of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, packs
from tessera.plans import evidence, retrieval
from tessera.plans.tables import table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation a question that names it, with the name of the supplier of its key, if there is one; and one that names nothing."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    named = nation.join(supplier, F.col("n_nationkey") == F.col("s_suppkey"), "left")
    asked = named.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("Who serves "), "n_name", F.lit("? zz")).alias("query"), F.when(F.col("s_name").isNotNull(), F.array("s_name")).alias("given"))
    return asked.unionByName(table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit(-1).cast("long").alias("query_id"), F.lit("zz qq").alias("query"), F.lit(None).cast("array<string>").alias("given")))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(packs.context(evidence.product(spark, sf_dir), _questions(spark, sf_dir)))


def change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(packs.impact(evidence.product(spark, sf_dir), _questions(spark, sf_dir)))


def dependency_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(packs.dependencies(evidence.product(spark, sf_dir), _questions(spark, sf_dir)))


def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's name among code chunks; of every third nation those of suppliers below ten, of the next those of round keys."""
    k = F.col("n_nationkey")
    glob = F.when(k % 3 == 0, "suppliers/s?.py").when(k % 3 == 1, "**/*0.py").otherwise("**/*")
    symbols = table(spark, sf_dir, "nation").select(k.cast("long").alias("query_id"), F.concat(F.lit("return "), "n_name").alias("query"), glob.alias("glob"))
    return packs.lookup(evidence.product(spark, sf_dir).chunks, symbols)


QUERIES = {f.__name__: f for f in (code_context, change_impact, dependency_packs, symbol_lookup)}


def _gathered(kind: packs.Kind) -> str:
    types = ", ".join(f"'{t}'" for t in kind.types)
    chunks = "code_chunks" if kind.code else "chunks"
    lexical = evidence._searched(retrieval._BM25, "worded", "_x").replace("FROM chunks", f"FROM {chunks}")
    hops = ", ".join(f"""g{k} AS MATERIALIZED (SELECT * FROM g{k - 1} UNION ALL SELECT query_id, there, {k} FROM (SELECT DISTINCT g.query_id, a.there FROM g{k - 1} g JOIN steps a ON a.here = g.node_id) n
   WHERE NOT EXISTS (SELECT 1 FROM g{k - 1} p WHERE p.query_id = n.query_id AND p.node_id = n.there))""" for k in range(1, kind.depth + 1))
    return f"""{evidence._HELD},
 posed AS MATERIALIZED (SELECT n_nationkey::BIGINT AS query_id, 'Who serves ' || n_name || '? zz' AS query, CASE WHEN s_name IS NULL THEN []::VARCHAR[] ELSE [s_name] END AS given FROM nation LEFT JOIN supplier ON s_suppkey = n_nationkey
   UNION ALL SELECT -1, 'zz qq', []::VARCHAR[] FROM region WHERE r_regionkey = 0),
 runs AS (SELECT query_id, list_concat(given, regexp_extract_all(query, '{packs.RUN}')) AS l FROM posed),
 first_runs AS (SELECT query_id, list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda t: length(t) >= 2)[1:{kind.mentions}] AS l FROM runs),
 mentions_ AS MATERIALIZED (SELECT query_id, unnest(l) AS mention, unnest(range(0, len(l))) AS place FROM first_runs),
 named_ AS MATERIALIZED (SELECT mention, node_id, row_number() OVER (PARTITION BY mention ORDER BY round(CASE WHEN lower(name) = lower(mention) THEN 100 WHEN ends_with(lower(name), lower(mention)) THEN 80 ELSE 50 END * confidence, 6) DESC, node_id) AS rank
   FROM (SELECT DISTINCT mention FROM mentions_ WHERE length(mention) >= 3) JOIN nodes ON contains(lower(name), lower(mention))),
 own AS MATERIALIZED (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY place_, node_id) AS rank FROM (SELECT query_id, node_id, min({{'place': place, 'rank': rank}}) AS place_ FROM mentions_ JOIN named_ USING (mention) WHERE rank <= {packs.OF_MENTION} GROUP BY ALL)),
 steps AS MATERIALIZED (SELECT from_id AS here, to_id AS there FROM edges WHERE edge_type IN ({types}) UNION SELECT to_id, from_id FROM edges WHERE edge_type IN ({types})),
 g0 AS (SELECT query_id, node_id, 0 AS depth FROM own WHERE rank <= {kind.seeds}), {hops},
 near AS MATERIALIZED (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY min(depth), node_id) AS rank FROM g{kind.depth} g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = g.query_id AND o.node_id = g.node_id) GROUP BY query_id, node_id) WHERE rank <= {kind.near}),
 called AS (SELECT query_id, list_filter(flatten(list([uri, name] ORDER BY part, rank)), lambda x: x IS NOT NULL) AS l FROM (SELECT query_id, node_id, 0 AS part, rank FROM own WHERE rank <= {kind.told[0]} UNION ALL SELECT query_id, node_id, 1, rank FROM near WHERE rank <= {kind.told[1]}) JOIN nodes USING (node_id) GROUP BY query_id),
 joined_ AS (SELECT query_id, query, list_concat(list_concat([query], given), coalesce(l, []::VARCHAR[])) AS l FROM posed LEFT JOIN called USING (query_id)),
 worded AS MATERIALIZED (SELECT query_id, query, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS text FROM joined_),
 code_chunks AS MATERIALIZED (SELECT * FROM chunks WHERE ends_with(file, '.py')), {lexical},
 linked AS (SELECT query_id, node_id, rank FROM own WHERE rank <= {packs.LINKED_SEEDS} UNION ALL SELECT query_id, node_id, {packs.LINKED_SEEDS} + rank FROM near WHERE rank <= {packs.LINKED_NEAR}),
 by_node AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), chunk_id) AS rank FROM linked JOIN attached USING (node_id) WHERE chunk_id IN (SELECT doc_id FROM {chunks}) GROUP BY query_id, chunk_id),
 both_ AS (SELECT query_id, 0 AS ranking, rank, chunk_id FROM bm25_x WHERE rank <= {packs.SEARCHED} UNION ALL SELECT query_id, 1, rank, chunk_id FROM by_node WHERE rank <= {packs.SEARCHED}),
 hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(ranking * 1000000 + rank) AS seen FROM both_ GROUP BY ALL)) WHERE rank <= {kind.hits}),
 packed AS MATERIALIZED (SELECT query_id, query, text AS widened, coalesce(s, '') AS seeds, coalesce(n, '') AS near, coalesce(e, '') AS evidence, CASE WHEN s IS NULL THEN '{packs.NO_SEED}' ELSE '' END AS unknowns, coalesce(n_own, 0) AS n_own, coalesce(n_near, 0) AS n_near FROM worded
   LEFT JOIN (SELECT query_id, string_agg(node_id, ';' ORDER BY rank) AS s, count(*) AS n_own FROM own GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, string_agg(node_id, ';' ORDER BY rank) AS n, count(*) AS n_near FROM near GROUP BY query_id) USING (query_id)
   LEFT JOIN (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ';' ORDER BY rank) AS e FROM hits GROUP BY query_id) USING (query_id))"""


_KINDS = "CASE label WHEN 'Service' THEN 'service' WHEN 'APIEndpoint' THEN 'api' WHEN 'Function' THEN 'code' ELSE 'runtime' END"
_DEPENDS = ", ".join(f"'{t}'" for t in packs.DEPENDENCIES.types)
ORACLE_SQL = {
    "code_context": f"""WITH {_gathered(packs.CODING)}, shown AS (SELECT query_id, node_id FROM own UNION ALL SELECT query_id, node_id FROM near),
      inner_ AS (SELECT a.query_id, count(*) AS n FROM shown a JOIN edges ON from_id = a.node_id JOIN shown b ON b.query_id = a.query_id AND b.node_id = to_id WHERE edge_type IN ({", ".join(f"'{t}'" for t in packs.CODING.types)}) GROUP BY a.query_id)
      SELECT query_id, query, widened, seeds, near, evidence, unknowns, coalesce(n, 0) AS n_edges FROM packed LEFT JOIN inner_ USING (query_id)""",
    "change_impact": f"""WITH {_gathered(packs.IMPACT)}, kinds AS (SELECT query_id, array_to_string(list_sort(list_distinct(list({_KINDS}))), ';') AS categories, bool_or(label = 'APIEndpoint') AS api, bool_or(label = 'DBTable') AS runtime FROM near JOIN nodes USING (node_id) GROUP BY query_id),
      sure AS (SELECT query_id, sum(confidence) AS c FROM (SELECT query_id, node_id FROM own UNION ALL SELECT query_id, node_id FROM near) JOIN nodes USING (node_id) GROUP BY query_id)
      SELECT query_id, query, widened, seeds, near, evidence, unknowns, coalesce(categories, '') AS categories, CASE WHEN api AND runtime THEN '{graph.CHECKS[1][1]};{graph.CHECKS[2][1]}' WHEN api THEN '{graph.CHECKS[1][1]}' WHEN runtime THEN '{graph.CHECKS[2][1]}' ELSE '{graph.NO_CHECK}' END AS checks,
        CASE WHEN n_own = 0 THEN CASE WHEN evidence = '' THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END ELSE round(least((0.55::DOUBLE + CASE WHEN n_near > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN evidence = '' THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END) * (c / (n_own + n_near)), 0.95), 3) END AS confidence
      FROM packed LEFT JOIN kinds USING (query_id) LEFT JOIN sure USING (query_id)""",
    "dependency_packs": f"""WITH {_gathered(packs.DEPENDENCIES)}, way AS (SELECT o.query_id, from_id AS node_id, 'up' AS way FROM own o JOIN edges ON to_id = o.node_id WHERE edge_type IN ({_DEPENDS}) UNION SELECT o.query_id, to_id, 'down' FROM own o JOIN edges ON from_id = o.node_id WHERE edge_type IN ({_DEPENDS})),
      ways AS (SELECT w.query_id, string_agg(w.node_id, ';' ORDER BY w.node_id) FILTER (WHERE way = 'up') AS up, string_agg(w.node_id, ';' ORDER BY w.node_id) FILTER (WHERE way = 'down') AS down FROM way w JOIN near n ON n.query_id = w.query_id AND n.node_id = w.node_id GROUP BY w.query_id)
      SELECT query_id, query, widened, seeds, near, evidence, unknowns, coalesce(up, '') AS upstream, coalesce(down, '') AS downstream FROM packed LEFT JOIN ways USING (query_id)""",
    "symbol_lookup": f"""WITH {evidence._HELD}, code_chunks AS (SELECT * FROM chunks WHERE ends_with(file, '.py')), posed AS (SELECT n_nationkey::BIGINT AS query_id, 'return ' || n_name AS text FROM nation),
      {evidence._searched(retrieval._BM25, "posed", "_x").replace("FROM chunks", "FROM code_chunks")}, {evidence._searched(retrieval._grep(evidence._HEAD), "posed", "_x").replace("FROM chunks", "FROM code_chunks")},
      both_ AS (SELECT query_id, 0 AS ranking, rank, chunk_id FROM bm25_x WHERE rank <= 50 UNION ALL SELECT query_id, 1, rank, chunk_id FROM grep_x WHERE rank <= 50),
      seeded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(ranking * 1000000 + rank) AS seen FROM both_ GROUP BY ALL)) WHERE rank <= 20),
      lapped AS (SELECT query_id, s.chunk_id, file, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9_]+')), list_distinct(regexp_extract_all(lower(concat_ws(chr(10), context, c.text)), '[a-z0-9_]+')))) / greatest(len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9_]+'))), 1)::DOUBLE, 6) AS score
        FROM seeded s JOIN posed q USING (query_id) JOIN code_chunks c ON c.doc_id = s.chunk_id)
      SELECT query_id, chunk_id, file, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lapped) WHERE rank <= 10
        AND CASE query_id % 3 WHEN 0 THEN regexp_matches(file, '^suppliers/s[^/][.]py$') WHEN 1 THEN ends_with(file, '0.py') ELSE true END""",
}
