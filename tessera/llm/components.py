"""Connected components of an edge list, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, files_for, stage


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("least"))


def _are_stars(edges: DataFrame) -> bool:
    """No node is both a centre and a leaf, and no leaf has two centres."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf")))
    of = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return of.filter("leaves > 1 or (leaves = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node that can be reached.

    Each round sends every larger neighbour of a node, then every smaller one, to the least neighbour. The rounds
    end when the edges are stars around the least nodes. A node with many neighbours is only ever aggregated and
    joined, never gathered. Null ends and loops are ignored; no edges give no rows.
    """
    stars = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    files = files_for(stars.count())
    while not _are_stars(stars):
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least_neighbour(both), "u").withColumn("least", F.least("u", "least"))
            .filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        down = large.filter("u <> v").distinct()
        small = down.join(_least_neighbour(down), "u")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v")))
        old, stars = stars, stage(small.filter("u <> v").distinct(), name, files)
        discard(old, collect=False)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
