"""Answers to questions about the product that evidence.py makes of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import answers
from tessera.plans import evidence


def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the names of all nodes stand in all chunks."""
    held = evidence.product(spark, sf_dir)
    return answers.matched(held.chunks, held.nodes.select("name"), "chunk_id", "content").select("chunk_id", "name", "start", "n_words")


def graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = answers.ask(evidence.product(spark, sf_dir), evidence.questions(spark, sf_dir), evidence.K, 1)
    lists = {c: F.array_join(c, "; ").alias(c) for c in ("options", "path_summaries", "unknowns")}
    return found.select(*(lists.get(c, F.col(c)) for c in found.columns))


QUERIES = {f.__name__: f for f in (name_mentions, graph_answers)}

_WORD = answers.WORD


def _matched(texts: str, key: str, out: str) -> str:
    return f"""texts_{out} AS (SELECT {key}, regexp_extract_all(lower(text), '{_WORD}') AS w FROM {texts}), names_{out} AS MATERIALIZED (SELECT DISTINCT regexp_extract_all(lower(name), '{_WORD}') AS nw FROM nodes),
      at_{out} AS (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS p FROM texts_{out}),
      spans_{out} AS MATERIALIZED (SELECT DISTINCT {key}, array_to_string(nw, ' ') AS name, CAST(p - 1 AS INTEGER) AS start, CAST(len(nw) AS INTEGER) AS n_words FROM at_{out} JOIN names_{out} ON w[p] = nw[1] WHERE w[p:p + len(nw) - 1] = nw),
      {out} AS MATERIALIZED (SELECT {key}, name, start, n_words FROM (SELECT *, max(start + n_words) OVER (PARTITION BY {key} ORDER BY start, n_words DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans_{out}) WHERE reach IS NULL OR reach < start + n_words)"""


_SAID = f"""
      tokens AS (SELECT query_id, list_concat(list_concat(regexp_extract_all(text, '{evidence.evidence.PATH}'), regexp_extract_all(text, '{answers.TICKET}')), list_concat(regexp_extract_all(text, '{evidence.evidence.ROUTE}', 1),
        list_filter(regexp_extract_all(text, '{answers.TOKEN}'), lambda t: regexp_matches(t, '[/.:{{}}\\-_]|[a-z][A-Z]') OR regexp_full_match(t, '[A-Z][A-Za-z0-9]{{3,}}')))) AS l FROM questions),
      distinct_ AS (SELECT query_id, list_filter(list_filter(l, lambda x, i: list_position(l, x) = i), lambda t: length(t) >= 2 AND lower(t) NOT IN ({", ".join(f"'{w}'" for w in answers.PLAIN)}))[1:{answers.MENTIONS}] AS l FROM tokens),
      mentions AS MATERIALIZED (SELECT query_id, unnest(l) AS mention, unnest(range(0, len(l))) AS place FROM distinct_ WHERE len(l) > 0),
      met AS (SELECT mention, node_id, row_number() OVER (PARTITION BY mention ORDER BY score DESC, node_id) AS rank FROM (SELECT mention, node_id, round(CASE WHEN lower(name) = lower(mention) THEN 100 WHEN ends_with(lower(name), lower(mention)) THEN 80 ELSE 50 END * confidence, 6) AS score
        FROM (SELECT DISTINCT mention FROM mentions WHERE length(mention) >= 3) JOIN nodes ON contains(lower(name), lower(mention)))),
      {_matched('questions', 'query_id', 'whole')},
      called AS (SELECT name, node_id, row_number() OVER (PARTITION BY name ORDER BY node_id) AS rank FROM (SELECT array_to_string(regexp_extract_all(lower(name), '{_WORD}'), ' ') AS name, node_id FROM nodes)),
      firsts AS (SELECT query_id, node_id, min({{'kind': kind, 'place': place, 'rank': rank}}) AS spot FROM (SELECT query_id, node_id, 0 AS kind, place, rank FROM mentions JOIN met USING (mention) WHERE rank <= {answers.OF_MENTION}
        UNION ALL SELECT query_id, node_id, 1, start, rank FROM whole JOIN called USING (name) WHERE rank <= {answers.OF_MENTION}) GROUP BY ALL),
      named_ AS MATERIALIZED (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, node_id) AS rank FROM firsts),
      unclear AS MATERIALIZED (SELECT query_id FROM named_ JOIN nodes USING (node_id) GROUP BY query_id HAVING count(*) >= 4 AND (count(DISTINCT CASE WHEN rank <= 6 THEN coalesce(uri, '') END) > 3
        OR count(DISTINCT CASE WHEN rank <= 6 THEN label END) > 1 AND count(DISTINCT CASE WHEN rank <= 6 THEN coalesce(uri, '') END) > 2)),
      plain AS (SELECT * FROM named_ WHERE query_id NOT IN (SELECT query_id FROM unclear)),
      lost AS (SELECT query_id FROM questions WHERE query_id NOT IN (SELECT query_id FROM unclear) AND query_id NOT IN (SELECT query_id FROM plain)),
      hits AS (SELECT query_id, node_id, min(rank) AS rank FROM bm25 JOIN attached USING (chunk_id) WHERE rank <= {evidence.K} AND query_id IN (SELECT query_id FROM lost) GROUP BY ALL),
      begun AS MATERIALIZED (SELECT * FROM plain UNION ALL SELECT query_id, node_id, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, node_id) AS r FROM hits) WHERE r <= {answers.SEED_HITS}),
      u0 AS MATERIALIZED (SELECT query_id, node_id, {{'less': -1.0::DOUBLE, 'hops': 1, 'path': [node_id], 'types': []::VARCHAR[]}} AS best FROM begun WHERE rank <= {answers.SEEDS}),
      u1 AS MATERIALIZED (SELECT query_id, node_id, min(best) AS best FROM (SELECT * FROM u0 UNION ALL
        SELECT query_id, there, {{'less': best.less * strength, 'hops': best.hops + 1, 'path': list_append(best.path, there), 'types': list_append(best.types, edge_type)}} FROM u0 JOIN arcs ON here = node_id) GROUP BY ALL),
      inner_ AS MATERIALIZED (SELECT a.query_id, from_id, to_id, e.score FROM u1 a JOIN edges e ON e.from_id = a.node_id JOIN u1 b ON b.query_id = a.query_id AND b.node_id = e.to_id),
      on_edge AS (SELECT query_id, node_id, max(score) AS s FROM (SELECT query_id, from_id AS node_id, score FROM inner_ UNION ALL SELECT query_id, to_id, score FROM inner_) GROUP BY ALL),
      n_inner AS (SELECT query_id, count(*) AS n_edges FROM inner_ GROUP BY ALL),
      valued AS MATERIALIZED (SELECT a.query_id, a.node_id, a.best.path AS path, a.best.types AS types, round(greatest(CASE WHEN a.best.hops = 1 THEN 10.0::DOUBLE END, 5.0::DOUBLE * confidence + CASE WHEN label IN ('APIEndpoint', 'Function') THEN 1.5 ELSE 1.0 END, s), 6) AS rank
        FROM u1 a JOIN nodes USING (node_id) LEFT JOIN on_edge b ON b.query_id = a.query_id AND b.node_id = a.node_id),
      of_seed AS (SELECT query_id, path[1] AS node_id, count(*) AS n_nodes, count(*) FILTER (WHERE len(path) > 1) AS n_steps, round(avg(CASE types[-1] WHEN 'CONTAINS' THEN 1.0::DOUBLE WHEN 'DECLARES' THEN 0.9 WHEN 'CALLS' THEN 0.8 END), 3) AS c FROM valued GROUP BY ALL),
      told_ AS (SELECT query_id, list(name || ' reached ' || n_nodes || ' node(s) through ' || n_steps || ' relationship(s) (' || printf('%.3f', c) || ')' ORDER BY rank) AS p FROM of_seed JOIN begun USING (query_id, node_id) JOIN nodes USING (node_id) WHERE n_steps > 0 AND rank <= 5 GROUP BY query_id),
      beyond AS (SELECT query_id, name, confidence, row_number() OVER (PARTITION BY query_id ORDER BY v.rank DESC, v.node_id) AS r FROM valued v JOIN nodes USING (node_id) WHERE NOT EXISTS (SELECT 1 FROM begun b WHERE b.query_id = v.query_id AND b.node_id = v.node_id)),
      near_ AS (SELECT query_id, count(*) AS n_near, sum(confidence) AS c_near, list(name ORDER BY r) FILTER (WHERE r <= {answers.CONTEXT}) AS near FROM beyond GROUP BY query_id),
      own_ AS (SELECT query_id, count(*) AS n_own, sum(confidence) AS c_own, list(name ORDER BY rank) FILTER (WHERE rank <= {answers.RESOLVED}) AS own FROM begun JOIN nodes USING (node_id) GROUP BY query_id),
      asked_back AS (SELECT query_id, list(name ORDER BY rank) FILTER (WHERE rank <= {answers.OPTIONS}) AS o FROM named_ JOIN nodes USING (node_id) WHERE query_id IN (SELECT query_id FROM unclear) GROUP BY query_id),
      cited_ AS (SELECT query_id, count(*) AS n_cited, list('[C' || slot || '] ' || file || ':' || line ORDER BY slot) FILTER (WHERE slot <= {answers.CITED}) AS cited FROM shown GROUP BY query_id),
      joined_ AS (SELECT q.query_id, text, o, coalesce(n_own, 0) AS n_own, own, coalesce(c_own, 0) AS c_own, coalesce(n_near, 0) AS n_near, near, coalesce(c_near, 0) AS c_near, coalesce(n_edges, 0) AS n_edges, p, coalesce(n_cited, 0) AS n_cited, cited,
        CASE WHEN coalesce(n_own, 0) = 0 THEN '{answers.NO_ENTITY}' WHEN coalesce(n_edges, 0) = 0 THEN '{answers.NO_EDGES}' END AS lacks FROM questions q LEFT JOIN own_ USING (query_id) LEFT JOIN near_ USING (query_id) LEFT JOIN n_inner USING (query_id)
        LEFT JOIN told_ USING (query_id) LEFT JOIN cited_ USING (query_id) LEFT JOIN asked_back USING (query_id))
      SELECT query_id, CASE WHEN o IS NOT NULL THEN '{answers.AMBIGUOUS}' ELSE concat_ws(chr(10), 'Question: ' || text, CASE WHEN n_own > 0 THEN 'Resolved: ' || array_to_string(own, ', ') END, CASE WHEN n_near > 0 THEN 'Graph context: ' || array_to_string(near, ', ') END,
        CASE WHEN n_edges > 0 THEN 'Graph paths include ' || n_edges || ' edge(s).' END, CASE WHEN n_cited > 0 THEN 'Evidence: ' || array_to_string(cited, ', ') END,
        CASE WHEN lacks IS NOT NULL OR n_cited = 0 THEN 'Unknowns: ' || concat_ws('; ', lacks, CASE WHEN n_cited = 0 THEN '{answers.NO_EVIDENCE}' END) END) END AS answer, o IS NOT NULL AS needs_clarification, coalesce(array_to_string(o, '; '), '') AS options,
        CASE WHEN o IS NULL THEN n_own + n_near ELSE 0 END AS n_entities, CASE WHEN o IS NULL THEN n_edges ELSE 0 END AS n_relationships, CASE WHEN o IS NULL THEN coalesce(array_to_string(p, '; '), '') ELSE '' END AS path_summaries,
        CASE WHEN o IS NULL THEN n_cited ELSE 0 END AS n_citations, CASE WHEN o IS NOT NULL THEN '{answers.UNCLEAR}' ELSE concat_ws('; ', lacks, CASE WHEN n_cited = 0 THEN '{answers.NO_EVIDENCE}' END) END AS unknowns,
        CASE WHEN o IS NOT NULL THEN 0.0::DOUBLE ELSE round(least((0.25::DOUBLE + CASE WHEN n_own > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n_near > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN n_cited > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
          * CASE WHEN n_own + n_near > 0 THEN (c_own + c_near) / (n_own + n_near) ELSE 1.0::DOUBLE END, 0.95), 3) END AS confidence FROM joined_"""
ORACLE_SQL = {
    "name_mentions": f"WITH {evidence._HELD}, {_matched('(SELECT doc_id AS chunk_id, text FROM chunks)', 'chunk_id', 'found_names')} SELECT * FROM found_names",
    "graph_answers": f"WITH {evidence._GATHERED}, {_SAID}",
}
