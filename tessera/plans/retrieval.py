"""Search and fusion over documents, with benchmark passages as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import cut, small
from tessera.operators import metrics, product, retrieval, vectors
from tessera.plans.tables import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_chunks(spark, sf_dir), _queries(spark, sf_dir), 10)


def grep_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.concat_ws("/", "source", "lang").alias("file"))
    return retrieval.grep(chunks, _queries(spark, sf_dir), 8).select("query_id", "chunk_id", "matched", "score", "line", "rank")


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical and the exact search, each run once for all that reads its ranks."""
    lexical = retrieval.bm25(_chunks(spark, sf_dir), _queries(spark, sf_dir), 50)
    exact = retrieval.grep_ranks(_chunks(spark, sf_dir), _queries(spark, sf_dir), 50)
    parts = [d.select("query_id", F.lit(k).alias("ranking"), "rank", "chunk_id", "score", F.lit(name).alias("source")) for k, (name, d) in enumerate((("bm25", lexical), ("grep", exact)))]
    return cut(parts[0].unionByName(parts[1]))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.fuse(_rankings(spark, sf_dir), limit=10).select("query_id", "chunk_id", "score", "sources", "rank")
    return _chunks(spark, sf_dir).select("chunk_id", "source", "lang").join(small(cut(fused)), "chunk_id").select("chunk_id", "query_id", "score", "sources", "rank", "source", "lang")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense_topk(vectors, queries, 10)


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense_topk, by an index of all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.search(vectors.build(rows), rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.gate_summary(retrieval.bm25(_chunks(spark, sf_dir), _queries(spark, sf_dir), 20), 20.0)


def hybrid_quota_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _rankings(spark, sf_dir).select("query_id", "chunk_id", F.col("source").alias("channel"), F.col("score").cast("double").alias("score"))
    return retrieval.quota_merge(candidates, {"bm25": 5, "grep": 2}, 10)


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = retrieval.fuse(_rankings(spark, sf_dir), limit=20).select("query_id", "chunk_id")
    documents = _chunks(spark, sf_dir).select("chunk_id", F.col("content").alias("document")).join(small(cut(seeds)), "chunk_id")  # so that texts aren't dealt anew
    return retrieval.rerank(documents.join(_queries(spark, sf_dir), "query_id")).select("query_id", "chunk_id", "score", "rank")


def eval_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score(*_judged(_rankings(spark, sf_dir)), k=10)


def _judged(rankings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lexical ranking, and as relevant what the exact search ranks best: documents with the most search terms of a query."""
    named = rankings.select("query_id", F.col("chunk_id").alias("label"), "rank", "source")
    return named.filter("source = 'bm25' and rank <= 10").drop("source"), named.filter("source = 'grep' and rank <= 3").select("query_id", "label")


def mode_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = _rankings(spark, sf_dir)
    found, relevant = _judged(rankings)
    fused = retrieval.fuse(rankings, limit=10).select("query_id", F.col("chunk_id").alias("label"), "rank")
    return metrics.delta(metrics.score(found, relevant, 10), metrics.score(fused, relevant, 10))


def skill_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts whose names share most words with each distinct part type, as skills are ranked for a question."""
    part = table(spark, sf_dir, "part")
    held = part.select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("description"), F.lit("flow").alias("tier"), (F.col("p_retailprice") / 10000).alias("confidence"))
    found = product.find_skills(held, part.select(F.col("p_type").alias("query_id"), F.col("p_type").alias("query")).distinct())
    return found.select(F.col("query_id").alias("p_type"), F.col("name").cast("long").alias("p_partkey"), "score", "rank")


QUERIES = {f.__name__: f for f in (bm25_topk, grep_topk, rrf_fusion, dense_topk, vector_index_topk, quality_gate, hybrid_quota_merge, rerank_overlap, eval_ir_metrics, mode_ablation, skill_rank)}

_BM25 = """
 words AS MATERIALIZED (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
 lengths AS MATERIALIZED (SELECT doc_id AS chunk_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS length FROM documents),
 size AS MATERIALIZED (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS mean_length FROM documents),
 asked AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark),
 counted AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
 rarity AS MATERIALIZED (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counted, size GROUP BY term, n),
 scored AS MATERIALIZED (SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score
   FROM counted JOIN lengths USING (chunk_id) JOIN rarity USING (term) JOIN asked USING (term), size GROUP BY ALL),
 bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
def _grep(head: str) -> str:
    """The exact search over documents, with what stands in front of each text and counts besides its best line."""
    return f"""
 terms AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, regexp_replace(w, '^[._/:-]+|[._/:-]+$', '', 'g') AS term
   FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) AS w FROM benchmark)),
 sought AS MATERIALIZED (SELECT * FROM terms WHERE length(term) >= 4 AND term NOT IN ({_STOP})),
 texts_ AS MATERIALIZED (SELECT doc_id AS chunk_id, {head} AS head, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
 found_ AS MATERIALIZED (SELECT query_id, chunk_id, list(term) AS terms FROM texts_ JOIN sought ON contains(text, term) OR contains(head, term) GROUP BY ALL),
 counted_ AS MATERIALIZED (SELECT query_id, chunk_id, terms, head, list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: len(list_filter(terms, lambda t: contains(l, t)))) AS counts FROM found_ JOIN texts_ USING (chunk_id)),
 grepped AS MATERIALIZED (SELECT query_id, chunk_id, len(terms) AS matched, 10 * len(terms) + list_max(counts) + len(list_filter(terms, lambda t: contains(head, t))) AS score,
   CAST(list_position(counts, list_max(counts)) AS INTEGER) AS line FROM counted_),
 grep AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM grepped)"""


_GREP = _grep("''")
_FUSED = """
 rankings AS MATERIALIZED (SELECT query_id, 0 AS ranking, rank, chunk_id, CAST(score AS DOUBLE) AS score, 'bm25' AS source FROM bm25 WHERE rank <= 50
   UNION ALL SELECT query_id, 1, rank, chunk_id, CAST(score AS DOUBLE), 'grep' FROM grep WHERE rank <= 50),
 fusing AS MATERIALIZED (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(source))), '+') AS sources,
   min(ranking * 1000000 + rank) AS first_seen FROM rankings GROUP BY ALL),
 fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, chunk_id) AS rank FROM fusing)"""


def _metrics(found: str, name: str) -> str:
    return f"""
 judged_{name} AS (SELECT f.query_id, f.rank, r.label IS NOT NULL AS hit FROM {found} f LEFT JOIN relevant r ON f.query_id = r.query_id AND f.label = r.label),
 sums_{name} AS (SELECT query_id, count(*) FILTER (WHERE hit) AS hits, min(rank) FILTER (WHERE hit) AS first_rank, sum(1 / log2(rank + 1)) FILTER (WHERE hit) AS dcg FROM judged_{name} GROUP BY query_id),
 wanted_{name} AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
 score_{name} AS (SELECT w.query_id, coalesce(s.hits, 0) AS hits, w.n AS n_relevant, round(coalesce(s.hits, 0) / 10.0::DOUBLE, 6) AS precision_at_k, round(coalesce(s.hits, 0) / w.n::DOUBLE, 6) AS recall_at_k,
   round(coalesce(1.0::DOUBLE / s.first_rank, 0), 6) AS reciprocal_rank,
   round(coalesce(s.dcg, 0) / list_sum(list_transform(range(1, least(w.n, 10) + 1), lambda x: 1 / log2(x + 1))), 6) AS ndcg
   FROM wanted_{name} w LEFT JOIN sums_{name} s USING (query_id))"""


_JUDGED = " found AS (SELECT query_id, chunk_id AS label, rank FROM bm25 WHERE rank <= 10), relevant AS (SELECT query_id, chunk_id AS label FROM grep WHERE rank <= 3)"
ORACLE_SQL = {
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm25 WHERE rank <= 10",
    "grep_topk": f"WITH {_grep('lower(concat_ws(chr(47), source, lang))')} SELECT query_id, chunk_id, matched, score, line, rank FROM grep WHERE rank <= 8",
    "rrf_fusion": f"WITH {_BM25}, {_GREP}, {_FUSED} SELECT f.query_id, f.chunk_id, f.score, f.sources, f.rank, d.source, d.lang FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE f.rank <= 10",
    "dense_topk": """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""",
    "quality_gate": f"""WITH {_BM25} SELECT query_id, count(*) FILTER (WHERE score >= 20) AS kept, count(*) FILTER (WHERE score < 20) AS filtered, max(score) AS best_before FROM bm25 WHERE rank <= 20 GROUP BY query_id""",
    "hybrid_quota_merge": f"""WITH {_BM25}, {_GREP}, {_FUSED},
      best AS (SELECT * FROM (SELECT query_id, chunk_id, source AS channel, score, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, source) AS c FROM rankings) WHERE c = 1),
      placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, chunk_id) AS r FROM best),
      phased AS (SELECT *, CASE WHEN channel = 'bm25' AND r <= 5 THEN 0 WHEN channel = 'grep' AND r <= 2 THEN 1 ELSE 2 END AS phase FROM placed)
      SELECT query_id, chunk_id, channel, score, slot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, score DESC, chunk_id) AS slot FROM phased) WHERE slot <= 10""",
    "rerank_overlap": f"""WITH {_BM25}, {_GREP}, {_FUSED},
      held AS MATERIALIZED (SELECT DISTINCT chunk_id, term FROM words), n_asked AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id),
      common AS (SELECT query_id, chunk_id, count(*) AS both_ FROM held JOIN asked USING (term) GROUP BY ALL),
      lapped AS (SELECT f.query_id, f.chunk_id, round(coalesce(c.both_, 0) / a.n::DOUBLE, 6) AS score FROM fused f JOIN n_asked a USING (query_id) LEFT JOIN common c ON c.query_id = f.query_id AND c.chunk_id = f.chunk_id WHERE f.rank <= 20)
      SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lapped) WHERE rank <= 10""",
    "eval_ir_metrics": f"WITH {_BM25}, {_GREP}, {_JUDGED}, {_metrics('found', 'a')} SELECT * FROM score_a",
    "mode_ablation": f"""WITH {_BM25}, {_GREP}, {_FUSED}, {_JUDGED}, fused10 AS (SELECT query_id, chunk_id AS label, rank FROM fused WHERE rank <= 10), {_metrics('found', 'a')}, {_metrics('fused10', 'b')}
      SELECT round(avg(b.recall_at_k) - avg(a.recall_at_k), 4) AS recall_delta, round(avg(b.reciprocal_rank) - avg(a.reciprocal_rank), 4) AS mrr_delta, round(avg(b.ndcg) - avg(a.ndcg), 4) AS ndcg_delta
      FROM score_a a JOIN score_b b USING (query_id)""",
    "skill_rank": """WITH asked AS (SELECT * FROM (SELECT DISTINCT p_type, unnest(regexp_split_to_array(lower(p_type), '[^a-z0-9]+')) AS term FROM part) WHERE length(term) >= 3),
      words AS MATERIALIZED (SELECT DISTINCT p_partkey, p_retailprice, unnest(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type)), '[^a-z0-9]+')) AS term FROM part),
      n AS (SELECT p_type, count(*) AS n FROM asked GROUP BY p_type),
      scored AS MATERIALIZED (SELECT a.p_type, p_partkey, round(count(*) / n.n::DOUBLE + 0.2 * p_retailprice / 10000, 6) AS score FROM words JOIN asked a USING (term) JOIN n ON n.p_type = a.p_type GROUP BY a.p_type, p_partkey, p_retailprice, n.n)
      SELECT p_type, p_partkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) AS rank FROM scored) WHERE rank <= 5""",
}
