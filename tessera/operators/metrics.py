"""Ranking metrics over labelled results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each(found: DataFrame) -> DataFrame:
    """(query_id, label, rank): each label once, at its first rank, ranked anew; repeated labels would count twice."""
    from pyspark.sql.window import Window

    once = found.groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def score(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per query of relevant (query_id, label): hits, precision, recall, reciprocal rank and nDCG of found at k.

    Precision divides by k, however few results there are. A query without results scores 0; of queries without
    relevant labels there is no row.
    """
    hits = found.filter(F.col("rank") <= k).join(relevant, ["query_id", "label"], "left_semi").groupBy("query_id").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    none = F.lit(0)
    return wanted.join(hits, "query_id", "left").select(
        "query_id", F.coalesce("hits", none).alias("hits"), "n_relevant", F.round(F.coalesce("hits", none) / k, 6).alias("precision_at_k"),
        F.round(F.coalesce("hits", none) / F.col("n_relevant"), 6).alias("recall_at_k"), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """How the means of two modes over the same queries differ."""
    both = before.alias("a").join(after.alias("b"), "query_id")
    return both.agg(*(F.round(F.avg(f"b.{c}") - F.avg(f"a.{c}"), 4).alias(name) for c, name in (
        ("recall_at_k", "recall_delta"), ("reciprocal_rank", "mrr_delta"), ("ndcg", "ndcg_delta"))))


def passes(scores: DataFrame, recall: float = 0.75, ndcg: float = 0.70, mrr: float = 0.60) -> DataFrame:
    """One row: the means and whether they reach the gates."""
    means = scores.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall_at_k", "ndcg", "reciprocal_rank")))
    return means.withColumn("passed", (F.col("recall_at_k") >= recall) & (F.col("ndcg") >= ndcg) & (F.col("reciprocal_rank") >= mrr))
