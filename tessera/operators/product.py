"""A product's index: one incremental run over its resources, summaries, skills, repo maps and labels of results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.lineage import cut
from tessera.functions.scalars import content_hash, tokens
from tessera.operators import chunking, ingest
from tessera.sources.commits import Commits

CHUNKS = "product_id string, uri string, chunk_id string, start_line int, end_line int, content string, embedding array<float>"
MANIFEST = "product_id string, uri string, content_hash string, embedding_version string, graph_version string, graph_status string, chunk_ids array<string>"


def hashed_embedding(dimension: int = 64) -> Callable[[Column], Column]:
    """An offline stand-in for a model: a bag of words hashed to `dimension` places. It claims no likeness to one."""
    def embed(text: Column) -> Column:
        places = F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("float"))

    return embed


def run_ingest(resources: DataFrame, product: str, state: str, embed: Callable[[Column], Column] | None = None, embedding_version: str = "e1", graph_version: str = "g1") -> DataFrame:
    """Bring the index of a product below `state` up to date with its resources (uri, content); returns (action, n).

    Only added and updated resources are cut and embedded. Index and manifest count from one commit on, so a run that ends
    early leaves the old state and the next one repeats the work; one that another run has overtaken raises Conflict.
    Resources that can't be read (null content) keep their chunks; removed ones lose them.
    """
    spark = resources.sparkSession
    commits = Commits(spark, state)
    number, at = commits.latest()
    index, manifest = commits.read("index", CHUNKS, at), commits.read("manifest", MANIFEST, at)
    mine = manifest.filter(F.col("product_id") == product)
    current = resources.select(F.lit(product).alias("product_id"), "uri", "content", content_hash(F.col("content")).alias("content_hash"), F.lit(embedding_version).alias("embedding_version"), F.lit(graph_version).alias("graph_version"))
    diff = ingest.manifest_diff(current, mine, ["product_id", "uri"])
    changed = diff.filter("action in ('added', 'updated')").select("product_id", "uri")
    parts = chunking.split_oversized(current.join(changed, ["product_id", "uri"], "left_semi"), "uri", "content", least=1).filter("length(content) > 0")
    fresh = parts.select(F.lit(product).alias("product_id"), "uri", chunking.chunk_id(product).alias("chunk_id"), "start_line", "end_line", "content", (embed or hashed_embedding())(F.col("content")).alias("embedding"))
    fresh = fresh.dropDuplicates(["product_id", "chunk_id"])
    gone = diff.filter("action in ('updated', 'removed')").select("product_id", "uri")
    kept = ingest.delete(index, gone, ["product_id", "uri"])
    whole = cut(kept.unionByName(fresh))
    ids = whole.filter(F.col("product_id") == product).groupBy("product_id", "uri").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    states = current.filter("content_hash is not null").select("product_id", "uri", "content_hash", "embedding_version", "graph_version", F.lit("done").alias("graph_status"))
    unread = mine.join(diff.filter("action = 'unreadable'").select("product_id", "uri"), ["product_id", "uri"], "left_semi").drop("chunk_ids")
    after = states.unionByName(unread).join(ids, ["product_id", "uri"], "left")
    counted = ingest.counts(diff).collect()  # one row an action
    others = manifest.filter(F.col("product_id") != product)
    commits.write({"index": whole, "manifest": others.unionByName(after.select(*others.columns))}, number)
    return spark.createDataFrame(counted, "action string, n long")


def delete_product(spark: SparkSession, product: str, state: str, dry_run: bool = False) -> DataFrame:
    """(table_name, n) of a product's rows in every table of the state that has a product_id: index, manifest, graph, skills and
    whatever else was committed; they are all gone from the next commit at once, unless dry_run."""
    commits = Commits(spark, state)
    number, at = commits.latest()
    held = {name: commits.read(name, "", at) for name in sorted(at)}
    held = {name: df for name, df in held.items() if "product_id" in df.columns}
    counts = [(name, df.filter(F.col("product_id") == product).count()) for name, df in held.items()]
    if not dry_run:
        commits.write({name: df.filter(~F.col("product_id").eqNullSafe(F.lit(product))) for (name, df), (_, n) in zip(held.items(), counts, strict=True) if n}, number)
    return spark.createDataFrame(counts, "table_name string, n long")


def summary_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uri, content): for each resource counts of labels and edge types, and the first 24 names."""
    labels = nodes.groupBy("uri", "label").agg(F.count("*").alias("n")).groupBy("uri").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "label", "n"))), ", ").alias("labels"))
    types = edges.groupBy("uri", "edge_type").agg(F.count("*").alias("n")).groupBy("uri").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "edge_type", "n"))), ", ").alias("types"))
    first = nodes.withColumn("_r", F.row_number().over(Window.partitionBy("uri").orderBy("name", "label"))).filter("_r <= 24")
    names = first.groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]), ", ").alias("names"))
    rows = labels.join(types, "uri", "left").join(names, "uri", "left")
    return rows.select("uri", F.concat_ws("\n", F.concat(F.lit("Nodes: "), "labels"), F.concat(F.lit("Edges: "), "types"), F.concat(F.lit("Names: "), "names")).alias("content"))


def find_skills(skills: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, name, score, rank): skills by the share of a query's words they hold and their confidence; the product's main one first."""
    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= 3))

    asked = queries.select("query_id", words(F.col("query")).alias("asked")).withColumn("term", F.explode_outer("asked"))
    held = skills.select("name", "tier", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.explode(words(F.concat_ws(" ", "name", "description"))).alias("term"))
    met = asked.join(held, "term").groupBy("query_id", "name", "tier", "confidence", F.size("asked").alias("n")).agg(F.count("*").alias("shared"))
    scored = met.withColumn("score", F.round(F.col("shared") / F.col("n") + 0.2 * F.col("confidence"), 6))
    order = [F.col("tier") != "product_master", F.desc("score"), F.col("name")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "name", "score", "rank")


def repo_map(symbols: DataFrame, budget: int, terms: list[str] | None = None) -> DataFrame:
    """(product_id, content): per product the files whose symbols rank best, as many as fit `budget` characters.

    A file that would overflow is passed over and later ones are tried, so each product's files are taken in order.
    Files are joined to lines before, and only the first files that could fill the budget reach that step.
    """
    hits = sum((F.contains(F.lower(F.concat_ws(" ", "name", "uri")), F.lit(t.lower())).cast("int") for t in terms or []), F.lit(0))
    ranked = symbols.withColumn("_w", F.when(F.col("kind") == "class", 3).otherwise(1) + 3 * hits)
    files = ranked.groupBy("product_id", "uri").agg(F.max("_w").alias("w"), F.sort_array(F.collect_list(F.struct("line_no", "signature"))).alias("said"))
    lines = F.array_join(F.transform("said", lambda s: F.concat(F.lit("  "), s["line_no"].cast("string"), F.lit(": "), s["signature"])), "\n")
    files = files.select("product_id", "uri", "w", F.concat_ws("\n", "uri", lines).alias("block"))
    most = max(1, budget // 2)  # a block has two characters at least
    files = files.withColumn("_r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("w"), "uri"))).filter((F.col("_r") <= most) & (F.length("block") <= budget))

    def render(part: pd.DataFrame) -> pd.DataFrame:
        taken, left = [], budget
        for block in part.sort_values("_r")["block"]:
            if len(block) + 1 <= left + (not taken):
                taken.append(block)
                left -= len(block) + 1
        return pd.DataFrame({"product_id": [part["product_id"].iloc[0]], "content": ["\n".join(taken)]})

    return files.groupBy("product_id").applyInPandas(render, "product_id string, content string")


def labels_of(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, label, rank): for each result (query_id, file, rank) the longest expected file (query_id, expected) that
    its path ends with, or its own; each label once, ranked anew."""
    met = found.join(expected, "query_id", "left").withColumn("_hit", F.endswith("file", "expected") | F.endswith("expected", "file"))
    best = met.groupBy("query_id", "file", "rank").agg(F.max_by(F.when(F.col("_hit"), F.col("expected")), F.when(F.col("_hit"), F.struct(F.length("expected"), "expected"))).alias("match"))
    named = best.select("query_id", F.coalesce("match", "file").alias("label"), "rank").groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "label")))
