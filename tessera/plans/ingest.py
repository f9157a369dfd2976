"""Incremental maintenance and chunking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import content_hash
from tessera.operators import chunking, ingest
from tessera.plans.tables import table

KEYS = ["source", "doc_id"]


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(*KEYS, content_hash(F.col("text")).alias("content_hash"), F.lit("e2").alias("embedding_version"), F.lit("g2").alias("graph_version"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the same documents: some absent, some changed since, some gone by now."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0")
    state = docs.select(
        "source", F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"),
        content_hash(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("content_hash"),
        F.when(F.col("doc_id") % 17 == 0, "e1").otherwise("e2").alias("embedding_version"), F.lit("g2").alias("graph_version"),
        F.when(F.col("doc_id") % 19 == 0, "failed").otherwise("done").alias("graph_status"))
    return state


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.manifest_diff(_current(spark, sf_dir), _manifest(spark, sf_dir), KEYS)


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counts(manifest_diff(spark, sf_dir))


def removed_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.removed(_current(spark, sf_dir), _manifest(spark, sf_dir), KEYS).select(*KEYS)


def stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    before = items.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("ids"))
    after = items.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") >= 10, F.col("l_linenumber"))).alias("ids"))
    return ingest.stale_ids(before, after, ["l_orderkey"], "ids")


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("version"))
    changes = orders.filter("o_orderkey % 5 = 0").select(
        F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 100_000_000).alias("o_orderkey"), F.lit("U").alias("o_orderstatus"),
        (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(2).alias("version"))
    return ingest.upsert(orders, changes, ["o_orderkey"], "version")


def payload_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    changes = customer.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "PATCHED").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return ingest.patch(customer, changes, ["c_custkey"])


def soft_delete_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.lit("active").alias("status"))
    items = table(spark, sf_dir, "lineitem")
    owned = items.filter("l_returnflag = 'N' and l_quantity > 45").select(F.col("l_partkey").alias("fact_id"))
    return ingest.retire(facts, owned, items.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("fact_id")))


def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ingest.delete(table(spark, sf_dir, "labels"), docs.filter("source = 'src0'"), ["doc_id"])


def delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")
    report = docs.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("documents").alias("table_name"), "n")
    return report.union(labels.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit("labels"), "n"))


def status_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    return ingest.status_counts(jobs, ["F", "O", "P", "failed"])


def job_queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.element_at(F.array(*map(F.lit, ("enqueue", "claim", "fail", "claim", "complete"))), (F.col("event_id") % 5 + 1).cast("int"))
    return ingest.job_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), ops.alias("op")))


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], [F.desc("event_id")])


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), 10, "doc_id", "text")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks(spark, sf_dir).select("doc_id", "start_line", "end_line", chunking.chunk_id("corpus", "doc_id").alias("chunk_id"))


def gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    spans = items.filter("l_quantity > 25").select("l_orderkey", F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"))
    return chunking.gaps(spans, items.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")), "l_orderkey")


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.lit("<h([1-6])[^>]*>(.*?)</h[1-6]>")
    found = F.arrays_zip(F.regexp_extract_all("html", form, F.lit(1)).alias("level"), F.regexp_extract_all("html", form, F.lit(2)).alias("title"))
    marked = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("at", "h")).select("page_id", "at", F.col("h.level").cast("int").alias("level"), F.col("h.title").alias("title"))
    return chunking.sections(marked, "page_id").select("page_id", "at", "level", "title", "parent")


def greedy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (
    manifest_diff, sync_counts, removed_resources, stale_ids, upsert_last_wins, payload_patch, soft_delete_facts, delete_by_source, delete_report, status_counts_zero_filled,
    job_queue_fold, latest_event, line_chunks, chunk_ids, gap_ranges, heading_sections, greedy_split)}

_STATE = """
 now AS (SELECT source, doc_id, sha256(text) AS h FROM documents),
 old AS (SELECT source, CASE WHEN doc_id % 13 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS h,
   CASE WHEN doc_id % 17 = 0 THEN 'e1' ELSE 'e2' END AS e, CASE WHEN doc_id % 19 = 0 THEN 'failed' ELSE 'done' END AS s FROM documents WHERE doc_id % 7 <> 0),
 diff AS (SELECT coalesce(n.source, o.source) AS source, coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN n.h IS NULL THEN 'unreadable' WHEN o.doc_id IS NULL THEN 'added'
   WHEN n.h IS DISTINCT FROM o.h OR o.e <> 'e2' THEN 'updated' WHEN o.s = 'failed' THEN 'graph_refresh' ELSE 'unchanged' END AS action
   FROM now n FULL OUTER JOIN old o ON n.source = o.source AND n.doc_id = o.doc_id)"""
_LINES = "lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents))"
_CHUNKS = f"""WITH {_LINES}, chunks AS (SELECT doc_id, CAST(min(line_no) AS INTEGER) AS start_line, CAST(max(line_no) AS INTEGER) AS end_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY doc_id, (line_no - 1) // 10)"""
ORACLE_SQL = {
    "manifest_diff": f"WITH {_STATE} SELECT * FROM diff",
    "sync_counts": f"WITH {_STATE} SELECT action, count(*) AS n FROM diff GROUP BY action",
    "removed_resources": f"WITH {_STATE} SELECT source, doc_id FROM diff WHERE action = 'removed'",
    "stale_ids": "SELECT l_orderkey, l_linenumber AS id FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10",
    "upsert_last_wins": """WITH both_ AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS version FROM orders UNION ALL
      SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey ELSE o_orderkey + 100000000 END, 'U', o_totalprice * 2, 2 FROM orders WHERE o_orderkey % 5 = 0)
      SELECT o_orderkey, o_orderstatus, o_totalprice, version FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) AS r FROM both_) WHERE r = 1""",
    "payload_patch": """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
      CASE WHEN c_custkey % 6 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "soft_delete_facts": """SELECT p_partkey AS fact_id, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
      AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45) THEN 'stale' ELSE 'active' END AS status FROM part""",
    "delete_by_source": "SELECT * FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')",
    "delete_report": """SELECT source, 'documents' AS table_name, count(*) AS n FROM documents GROUP BY source UNION ALL
      SELECT source, 'labels', count(*) FROM labels JOIN documents USING (doc_id) GROUP BY source""",
    "status_counts_zero_filled": "SELECT s.status, count(o.o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('failed')) s(status) LEFT JOIN orders o ON o.o_orderstatus = s.status GROUP BY s.status",
    "latest_event": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "line_chunks": f"{_CHUNKS} SELECT * FROM chunks",
    "chunk_ids": f"""{_CHUNKS}, d AS (SELECT *, sha1(unhex('{chunking.NAMESPACE.replace("-", "")}') || encode('corpus|' || doc_id || '|' || start_line || '-' || end_line)) AS h FROM chunks)
      SELECT doc_id, start_line, end_line, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INTEGER) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM d""",
    "gap_ranges": """WITH n AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey),
      open_ AS (SELECT l_orderkey, k FROM (SELECT l_orderkey, unnest(range(1, n + 1)) AS k FROM n) EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25),
      runs AS (SELECT l_orderkey, k, k - row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM open_)
      SELECT l_orderkey, CAST(min(k) AS INTEGER) AS start, CAST(max(k) AS INTEGER) AS "end" FROM runs GROUP BY l_orderkey, run""",
    "greedy_split": """WITH RECURSIVE texts AS (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
      long AS MATERIALIZED (SELECT doc_id, CASE WHEN rows[-1] = '' THEN rows[:-2] ELSE rows END AS rows, CASE WHEN rows[-1] = '' THEN list_transform(rows[:-2], lambda x: length(x) + 1) ELSE list_append(list_transform(rows[:-2], lambda x: length(x) + 1), length(rows[-1])) END AS sizes
        FROM (SELECT doc_id, string_split(t, chr(10)) AS rows FROM texts WHERE length(t) > 1200)),
      sums AS MATERIALIZED (SELECT *, list_prepend(0, list_transform(range(1, len(sizes) + 1), lambda k: list_sum(sizes[:k]))) AS p FROM long),
      walk AS (SELECT doc_id, 0 AS k, 0 AS first, NULL::BIGINT AS a, NULL::BIGINT AS b FROM sums UNION ALL
        SELECT doc_id, k + 1, CASE WHEN cut THEN greatest(len(list_filter(p[:k + 1], lambda x: x <= p[k + 1] - 70)) - 1, 0) ELSE first END, CASE WHEN cut THEN first END, CASE WHEN cut THEN k END
        FROM (SELECT w.doc_id, w.k, w.first, s.p, s.p[w.k + 2] - s.p[w.first + 1] > 700 AND w.k > w.first AS cut FROM walk w JOIN sums s ON s.doc_id = w.doc_id WHERE w.k < len(s.rows))),
      spans AS (SELECT doc_id, a, b FROM walk WHERE a IS NOT NULL UNION ALL SELECT w.doc_id, w.first, len(s.rows) FROM walk w JOIN sums s ON s.doc_id = w.doc_id WHERE w.k = len(s.rows)),
      parts AS (SELECT doc_id, CAST(a + 1 AS INTEGER) AS start_line, regexp_replace(array_to_string(rows[a + 1:b], chr(10)), '\\n+$', '') AS content FROM spans JOIN sums USING (doc_id)
        UNION ALL SELECT doc_id, 1, t FROM texts WHERE length(t) <= 1200)
      SELECT doc_id, start_line, content, CAST(start_line + length(content) - length(replace(content, chr(10), '')) AS INTEGER) AS end_line FROM parts WHERE length(content) >= 64""",
    "heading_sections": """WITH h AS (SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS at, CAST(unnest(l) AS INTEGER) AS level, unnest(t) AS title FROM (SELECT page_id,
      regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS l, regexp_extract_all(html, '<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS t FROM pages))
      SELECT a.page_id, a.at, a.level, a.title, arg_max(b.title, b.at) AS parent FROM h a LEFT JOIN h b ON a.page_id = b.page_id AND b.at < a.at AND b.level < a.level GROUP BY ALL""",
}
