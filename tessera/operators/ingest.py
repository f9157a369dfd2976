"""Incremental maintenance: manifest diffs, keyed merges, soft deletes and payload patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REFRESH = ["", "pending", "partial", "failed"]  # graph states that make an unchanged resource be extracted again


def manifest_diff(current: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """keys and action for every resource on either side: added, updated, unchanged, graph_refresh, unreadable, removed.

    current has content_hash (null: it exists but couldn't be read), embedding_version and graph_version; manifest
    has the same and graph_status. Unchanged means equal hash and embedding version; what couldn't be read keeps
    its state, so it is never taken for removed.
    """
    cols = ["content_hash", "embedding_version", "graph_version"]
    new = current.select(*keys, F.lit(True).alias("_here"), *(F.col(c).alias(f"_new_{c}") for c in cols))
    old = manifest.select(*keys, F.lit(True).alias("_there"), *(F.col(c).alias(f"_old_{c}") for c in cols), F.coalesce("graph_status", F.lit("")).alias("_status"))
    same = F.col("_new_content_hash").eqNullSafe(F.col("_old_content_hash")) & F.col("_new_embedding_version").eqNullSafe(F.col("_old_embedding_version"))
    stale_graph = ~F.col("_new_graph_version").eqNullSafe(F.col("_old_graph_version")) | F.col("_status").isin(*REFRESH)
    action = (
        F.when(F.col("_here").isNull(), "removed").when(F.col("_new_content_hash").isNull(), "unreadable").when(F.col("_there").isNull(), "added")
        .when(~same, "updated").when(stale_graph, "graph_refresh").otherwise("unchanged")
    )
    return new.join(old, keys, "full_outer").select(*keys, action.alias("action"))


def counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count("*").alias("n"))


def removed(current: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return manifest.join(current.select(*keys), keys, "left_anti")


def stale_ids(before: DataFrame, after: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """One row for each id that a resource had and no longer has; resources that aren't in after keep theirs."""
    old = before.select(*keys, F.explode(F.array_distinct(ids)).alias("id"))
    new = after.select(*keys, F.explode_outer(ids).alias("id"))
    return old.join(after.select(*keys).distinct(), keys, "left_semi").join(new, [*keys, "id"], "left_anti")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Whole rows replaced by key; of several rows of a key the greatest version stays."""
    both = table.unionByName(changes, allowMissingColumns=True)
    names = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*names), version).alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in names))


def patch(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of changes that aren't null replace those of the rows with their keys; no row is added."""
    cols = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in cols))
    joined = table.join(new, keys, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in table.columns))


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def retire(facts: DataFrame, owned: DataFrame, candidates: DataFrame) -> DataFrame:
    """facts (fact_id, status, ...) with those of candidates (fact_id) made stale that no resource of owned (fact_id) still lists."""
    gone = candidates.select("fact_id").distinct().join(owned.select("fact_id").distinct(), "fact_id", "left_anti").withColumn("_gone", F.lit(True))
    return facts.join(gone, "fact_id", "left").withColumn("status", F.when(F.col("_gone"), "stale").otherwise(F.col("status"))).drop("_gone")


def job_states(log: DataFrame, most: int = 3) -> DataFrame:
    """(job_id, status, attempts) after an event log (job_id, seq, op): enqueue, claim, complete, fail, reset.

    A completed job is gone. Enqueuing starts the attempts anew; a failure queues the job again until its attempts
    are used up. A job's own events are folded in order; jobs are spread over all tasks.
    """
    start = F.struct(F.lit("").alias("status"), F.lit(0).alias("attempts"))

    def step(state: Column, event: Column) -> Column:
        status, attempts, op = state["status"], state["attempts"], event["op"]
        can = (status == "queued") & (attempts < most)
        return F.struct(
            F.when(op == "enqueue", "queued").when((op == "claim") & can, "running").when((op == "complete") & (status == "running"), "done")
            .when((op == "fail") & (status == "running"), F.when(attempts >= most, "failed").otherwise("queued")).when((op == "reset") & (status == "running"), "queued").otherwise(status).alias("status"),
            F.when(op == "enqueue", 0).when((op == "claim") & can, attempts + 1).otherwise(attempts).alias("attempts"))

    events = log.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op"))).alias("events"))
    folded = events.select("job_id", F.aggregate("events", start, step).alias("s"))
    return folded.select("job_id", "s.status", "s.attempts").filter("status not in ('', 'done')")


def status_counts(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """(status, n) with a row for each status, zero where no job has it."""
    fixed = jobs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return fixed.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
