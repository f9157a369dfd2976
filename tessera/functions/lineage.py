"""Cutting the lineage of a table that several later steps read, and dealing rows to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import broadcast


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder all executors share, where one is named; else kept, and computed again if lost."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        return df.persist()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have: a table may lie in a small file, and yet each row be much work or much text."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df, which is cut, for a join with a larger table: up to `most` rows are sent to all tasks, so that no key of the larger table, however
    frequent, is one task's work; more are dealt by key. df is counted for it."""
    return broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def by_key(df: DataFrame) -> DataFrame:
    """df for an equality join in which it is dealt by key and never sent whole to the driver and all tasks: Spark takes what is made of a
    small compressed file for small."""
    return df.hint("merge")
