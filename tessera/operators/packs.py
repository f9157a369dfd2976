"""What a question's names bring up together: context for coding, dependencies, and what a change may affect, with evidence.

Questions are rows (query_id, query, given), given being files or names that come with the question, or null.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.lineage import by_key, cut, small
from tessera.functions.scalars import glob_form
from tessera.operators import graph, retrieval
from tessera.operators.codegraph import CODE
from tessera.operators.evidence import Product


class Kind(NamedTuple):
    """What a pack follows and shows: limits of its report, not of what is searched."""
    types: list[str]
    depth: int
    near: int  # neighbours that are shown
    mentions: int
    seeds: int  # of which the graph is followed
    told: tuple[int, int]  # seeds and neighbours whose names widen the search
    hits: int
    code: bool = False


# Relationships that each kind of pack follows, and how much it shows.
CODING = Kind(["CONTAINS", "DECLARES", "IMPORTS", "HANDLES", "EXPOSES", "READS", "WRITES", "COVERS", "DOCUMENTS", "CONSTRAINS"], 2, 40, 8, 8, (6, 10), 10, True)
IMPACT = Kind(["IMPORTS", "CALLS", "DEPENDS_ON", "HANDLES", "EXPOSES", "READS", "WRITES", "COVERS", "DOCUMENTS", "CONSTRAINS", "OWNS", "CHANGED", "IMPLEMENTS", "RESOLVES"], 3, 80, 10, 10, (8, 16), 12)
DEPENDENCIES = Kind(["IMPORTS", "CALLS", "DEPENDS_ON", "HANDLES", "EXPOSES", "READS", "WRITES", "PRODUCES", "CONSUMES"], 3, 80, 10, 8, (8, 16), 10)
OF_MENTION, LINKED_SEEDS, LINKED_NEAR, SEARCHED = 5, 8, 24, 50
NO_SEED = "no graph entity resolved"
RUN = r"[\p{L}\p{N}_/.\-:{}]+"


class Gathered(NamedTuple):
    """found and near: query_id, node_id, rank; near also depth; asked: query_id, query, widened; hits: query_id, chunk_id, score, sources, rank."""
    found: DataFrame
    near: DataFrame
    asked: DataFrame
    hits: DataFrame


def _given() -> Column:
    return F.coalesce("given", F.array().cast("array<string>"))


def seeds(nodes: DataFrame, queries: DataFrame, kind: Kind) -> DataFrame:
    """(query_id, node_id, rank): the OF_MENTION best nodes of each of the first mentions, which are what is given and then the query's own runs of characters."""
    words = F.coalesce(F.regexp_extract_all("query", F.lit(RUN), F.lit(0)), F.array().cast("array<string>"))
    said = F.slice(F.filter(F.array_distinct(F.concat(_given(), words)), lambda m: F.length(m) >= 2), 1, kind.mentions)
    asked = queries.select("query_id", F.posexplode(said).alias("place", "mention"))
    met = asked.join(graph.resolve(nodes, asked.select("mention").distinct(), OF_MENTION), "mention")
    first = met.groupBy("query_id", "node_id").agg(F.min(F.struct("place", "rank")).alias("at"))
    return first.select("query_id", "node_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node_id")).alias("rank"))


def neighbours(edges: DataFrame, found: DataFrame, kind: Kind) -> DataFrame:
    """(query_id, node_id, depth, rank): the nearest nodes to a query's first seeds that aren't seeds themselves. A node that
    several queries start from is followed once for all."""
    first = cut(found.filter(F.col("rank") <= kind.seeds).select("query_id", F.col("node_id").alias("seed")))
    reached = graph.traverse(edges, first.select("seed").distinct(), kind.types, kind.depth).filter("depth > 0")
    near = reached.join(by_key(first), "seed").groupBy("query_id", "node_id").agg(F.min("depth").alias("depth")).join(by_key(found.select("query_id", "node_id")), ["query_id", "node_id"], "left_anti")
    return retrieval.top(near, ["query_id"], [F.col("depth"), F.col("node_id")], kind.near)


def widened(nodes: DataFrame, queries: DataFrame, found: DataFrame, near: DataFrame, kind: Kind) -> DataFrame:
    """(query_id, query, widened): each query with what is given, and the uris and names of its first seeds and neighbours, each once."""
    parts = [rows.filter(F.col("rank") <= most).select("query_id", "node_id", F.struct(F.lit(k).alias("part"), "rank").alias("at")) for k, (rows, most) in enumerate(zip((found, near), kind.told))]
    named = reduce(DataFrame.unionByName, parts).join(by_key(nodes.select("node_id", F.array_compact(F.array("uri", "name")).alias("names"))), "node_id")
    told = named.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "names"))), lambda x: x["names"])).alias("names"))
    every = F.concat(F.array(F.coalesce("query", F.lit(""))), _given(), F.coalesce("names", F.array().cast("array<string>")))
    return queries.join(told, "query_id", "left").select("query_id", "query", F.array_join(F.array_distinct(F.filter(every, lambda t: t != "")), " ").alias("widened"))


def gather(product: Product, queries: DataFrame, kind: Kind) -> Gathered:
    """The names, neighbours and evidence of queries. Evidence fuses the lexical ranking of the widened query with the chunks attached to
    the first seeds and neighbours, in their order; for coding only code counts."""
    nodes = product.nodes if "uri" in product.nodes.columns else product.nodes.withColumn("uri", F.lit(None).cast("string"))
    found = cut(seeds(nodes, queries, kind))
    near = cut(neighbours(product.edges, found, kind))
    asked = cut(widened(nodes, queries, found, near, kind))
    chunks = product.chunks.filter(F.col("file").rlike(CODE)) if kind.code else product.chunks
    lexical = retrieval.bm25(chunks, asked.select("query_id", F.col("widened").alias("query")), SEARCHED).select("query_id", F.lit(0).alias("ranking"), "rank", "chunk_id", F.lit("bm25").alias("source"))
    linked = found.filter(F.col("rank") <= LINKED_SEEDS).select("query_id", "node_id", "rank").unionByName(near.filter(F.col("rank") <= LINKED_NEAR).select("query_id", "node_id", (LINKED_SEEDS + F.col("rank")).alias("rank")))
    placed = linked.join(by_key(product.attached), "node_id").join(by_key(chunks.select("chunk_id")), "chunk_id", "left_semi").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("at"))
    by_graph = retrieval.top(placed, ["query_id"], [F.col("at"), F.col("chunk_id")], SEARCHED).select("query_id", F.lit(1).alias("ranking"), "rank", "chunk_id", F.lit("graph").alias("source"))
    return Gathered(found, near, asked, cut(retrieval.fuse(lexical.unionByName(by_graph), limit=kind.hits)))


def _listed(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(name))


def _told(queries: DataFrame, held: Gathered) -> DataFrame:
    out = held.asked.join(_listed(held.found, "node_id", "seeds"), "query_id", "left").join(_listed(held.near, "node_id", "near"), "query_id", "left").join(_listed(held.hits, "chunk_id", "evidence"), "query_id", "left")
    for name in ("seeds", "near", "evidence"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out.withColumn("unknowns", F.when(F.size("seeds") == 0, F.array(F.lit(NO_SEED))).otherwise(F.array().cast("array<string>")))


def context(product: Product, queries: DataFrame) -> DataFrame:
    """(query_id, query, widened, seeds, near, evidence, unknowns, n_edges): context for coding. n_edges counts the active edges of the
    followed types between what is shown."""
    held = gather(product, queries, CODING)
    shown = cut(held.found.select("query_id", "node_id").unionByName(held.near.select("query_id", "node_id")))
    kept = product.edges.filter((F.coalesce(F.col("status"), F.lit("active")) == "active") & F.col("edge_type").isin(CODING.types)).select("from_id", "to_id", "edge_type")
    ends = kept.join(small(shown), F.col("node_id") == F.col("from_id")).drop("node_id", "from_id")
    within = ends.join(shown.withColumnRenamed("node_id", "to_id"), ["query_id", "to_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_edges"))
    return _told(queries, held).join(within, "query_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def impact(product: Product, queries: DataFrame) -> DataFrame:
    """(query_id, query, widened, seeds, near, evidence, unknowns, categories, checks, confidence): what a change of what a query names
    may affect. Without a node it has confidence 0.2 with evidence and 0 without; else as graph.impact_report tells, over
    seeds and neighbours."""
    held = gather(product, queries, IMPACT)
    known = product.nodes.select("node_id", "labels", F.coalesce("confidence", F.lit(1.0)).alias("c"))
    near = held.near.join(by_key(known), "node_id").withColumn("category", graph.category(F.col("labels"))).groupBy("query_id").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.sum("c").alias("c_near"))
    own = held.found.join(by_key(known), "node_id").groupBy("query_id").agg(F.sum("c").alias("c_own"))
    rows = _told(queries, held).join(near, "query_id", "left").join(own, "query_id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    checks = F.array_compact(F.array(*(F.when(F.array_contains("categories", name), F.lit(said)) for name, said in graph.CHECKS)))
    shown = F.size("evidence") > 0
    base = 0.55 + F.when(F.size("near") > 0, 0.2).otherwise(0.0) + F.when(shown, 0.15).otherwise(0.0)
    mean = (F.coalesce("c_own", F.lit(0.0)) + F.coalesce("c_near", F.lit(0.0))) / F.greatest(F.size("seeds") + F.size("near"), F.lit(1))
    sure = F.when(F.size("seeds") == 0, F.when(shown, 0.2).otherwise(0.0)).otherwise(F.round(F.least(base * mean, F.lit(0.95)), 3))
    return rows.withColumn("checks", F.when(F.size(checks) > 0, checks).otherwise(F.array(F.lit(graph.NO_CHECK)))).withColumn("confidence", sure).drop("c_own", "c_near")


def dependencies(product: Product, queries: DataFrame) -> DataFrame:
    """(query_id, query, widened, seeds, near, evidence, unknowns, upstream, downstream): neighbours that seeds have an edge from, and
    those they have one to."""
    held = gather(product, queries, DEPENDENCIES)
    kept = product.edges.filter((F.coalesce(F.col("status"), F.lit("active")) == "active") & F.col("edge_type").isin(DEPENDENCIES.types)).select("from_id", "to_id")
    seed, near, out = small(held.found.select("query_id", F.col("node_id").alias("seed"))), held.near.select("query_id", F.col("node_id").alias("there")), _told(queries, held)
    for name, here, there in (("upstream", "to_id", "from_id"), ("downstream", "from_id", "to_id")):
        met = kept.select(F.col(here).alias("seed"), F.col(there).alias("there")).join(seed, "seed").join(by_key(near), ["query_id", "there"], "left_semi")
        out = out.join(met.groupBy("query_id").agg(F.array_sort(F.collect_set("there")).alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def lookup(chunks: DataFrame, symbols: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, file, score, rank): the k best code chunks for each symbol (query_id, query, glob); of these, those whose file
    fits the glob, where there is one."""
    found = retrieval.retrieve(chunks.filter(F.col("file").rlike(CODE)), symbols.select("query_id", "query"), k)
    rows = found.select("query_id", "chunk_id", "score", "rank").join(chunks.select("chunk_id", "file"), "chunk_id").join(symbols.select("query_id", "glob"), "query_id")
    fits = F.col("glob").isNull() | F.col("glob").isin("", "**/*") | F.rlike(F.col("file"), glob_form(F.col("glob")))
    return rows.filter(fits).select("query_id", "chunk_id", "file", "score", "rank")


def or_first(found: DataFrame, chunks: DataFrame, queries: DataFrame, n: int = 8, score: float = 0.01) -> DataFrame:
    """found (query_id, chunk_id, score), and for queries without any the first n chunks, code before all else, at a low score."""
    lost = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    first = chunks.orderBy(~F.col("file").rlike(CODE), "chunk_id").limit(n).select("chunk_id")  # n rows
    rows = lost.crossJoin(F.broadcast(first)).select("query_id", "chunk_id", F.lit(score).alias("score"))
    return found.select("query_id", "chunk_id", "score").unionByName(rows)
