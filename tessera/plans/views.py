"""Sessions, event windows, limits and summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import views
from tessera.plans.tables import table
from tessera.streaming import limits, windows


def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.session_text(table(spark, sf_dir, "conversations"))


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.recent(table(spark, sf_dir, "conversations"), 3)


def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.attempts_in_window(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 3600).select("event_id", "user_id", "n")


def rate_limit_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.accepted(table(spark, sf_dir, "events"), 3, 86400)


def stage_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.elapsed(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", ["ts", "event_id"]).select("event_id", "user_id", "elapsed")


def _text_time(df: DataFrame) -> DataFrame:
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f"{c}_at") if t == "timestamp" else F.col(c) for c, t in df.dtypes))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(windows.tumbling(table(spark, sf_dir, "events")))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(windows.sliding(table(spark, sf_dir, "events")))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sessions(table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts")))
    return _text_time(found.select("user_id", "start", "n"))


def watermark_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_of_each(table(spark, sf_dir, "events"), ["user_id", "event_type"]).select("user_id", "event_type")


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("label"), F.col("c_name").alias("name"))
    return views.label_summary(nodes, "nation", 5)


def first_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = docs.select(F.col("lang").alias("query_id"), F.col("source").alias("file"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("score"))
    return views.first_per_file(evidence, 50)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the pages link to each target."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<a href=\"([^\"]*)\""), F.lit(1))).alias("target"))
    return found.groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.bool_or(F.col("toxic") == 1).alias("any_toxic"))


QUERIES = {f.__name__: f for f in (
    session_replay, recent_history, rate_limit_window, rate_limit_accepted, stage_elapsed, tumbling, sliding, session_windows, watermark_dedup, label_summary, first_per_source, page_links, quality_by_source)}

_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ORACLE_SQL = {
    "session_replay": "SELECT conv_id, count(*) AS n_turns, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, concat_ws(': ', role, text)) AS transcript FROM conversations GROUP BY conv_id",
    "recent_history": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r FROM conversations) WHERE r <= 3",
    "rate_limit_window": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "rate_limit_accepted": """WITH RECURSIVE ev AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
      walk AS (SELECT user_id, r, event_id, true AS accepted, [t] AS held FROM ev WHERE r = 1 UNION ALL SELECT user_id, r, event_id, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
        FROM (SELECT e.*, list_filter(w.held, lambda x: x > e.t - 86400000000) AS live FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.r = w.r + 1))
      SELECT event_id, user_id, accepted FROM walk""",
    "stage_elapsed": "SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0::DOUBLE AS elapsed FROM events",
    "tumbling": f"SELECT event_type, {_AT.format('start')} AS start_at, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, date_trunc('hour', ts) AS start FROM events) GROUP BY event_type, start",
    "sliding": f"""SELECT event_type, {_AT.format('start')} AS start_at, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT *, make_timestamp(epoch_us(ts) // 7200000000 * 7200000000 - k * 7200000000) AS start FROM (SELECT event_type, value, ts, unnest(range(0, 3)) AS k FROM events)) GROUP BY event_type, start""",
    "session_windows": f"""WITH t AS (SELECT user_id, date_trunc('second', ts) AS ts FROM events),
      m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM t),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
      SELECT user_id, {_AT.format('min(ts)')} AS start_at, count(*) AS n FROM s GROUP BY user_id, session""",
    "watermark_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "label_summary": """SELECT nation, label, count(*) AS n, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 5) AS some_names FROM (
      SELECT c_nationkey AS nation, c_mktsegment AS label, c_name AS name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name) AS r FROM customer) GROUP BY nation, label""",
    "first_per_source": """WITH f AS (SELECT lang AS query_id, source AS file, doc_id AS chunk_id, n_chars AS score, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS f FROM documents)
      SELECT query_id, file, chunk_id, score, slot FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f > 1, score DESC, chunk_id) AS slot FROM f) WHERE slot <= 50""",
    "page_links": "SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY target",
    "quality_by_source": "SELECT source, count(*) AS n, count(quality) AS n_labelled, round(avg(quality), 6) AS mean_quality, bool_or(toxic = 1) AS any_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
}
