"""A property graph as two tables: nodes (node_id, label, name, ...) and edges (edge_type, from_id, to_id, status, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import lineage
from tessera.functions.lineage import by_key, cut, small

MOST_HOPS = 5


def both_ways(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(here, there, edge_type) of active edges of the types, in both directions."""
    kept = edges.filter(F.coalesce(F.col("status"), F.lit("active")) == "active")
    kept = kept.filter(F.col("edge_type").isin(types)) if types else kept
    return kept.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), "edge_type").unionByName(
        kept.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"), "edge_type"))


def _arcs(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """both_ways of edges that are cut before, in one direction; equal ones stay, as steps drop them among the few that they reach."""
    kept = edges.filter(F.col("edge_type").isin(types)) if types else edges
    return both_ways(cut(kept.select("edge_type", "from_id", "to_id", "status")))


def traverse(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, depth: int = 2) -> DataFrame:
    """(seed, node_id, depth) of all nodes within depth hops (at most MOST_HOPS) of each seed (seed), itself at 0.

    Each hop drops what the seed has reached before, so the work follows nodes and not paths, whose number explodes
    at hubs.
    """
    arcs = _arcs(edges, types).select("here", "there")
    reached = seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth")).distinct()
    reached = cut(reached)
    frontier = reached
    for hop in range(1, min(depth, MOST_HOPS) + 1):
        step = arcs.join(small(frontier), F.col("node_id") == F.col("here")).select("seed", F.col("there").alias("node_id")).distinct()
        frontier = cut(step.join(by_key(reached.select("seed", "node_id")), ["seed", "node_id"], "left_anti").withColumn("depth", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, direction, edge_type) one hop around the seeds: upstream is what they point to, downstream what points to them; seeds left out."""
    kept = edges.filter(F.coalesce(F.col("status"), F.lit("active")) == "active")
    ids = seeds.select(F.col("seed").alias("_seed")).distinct()
    up = kept.join(ids, kept["from_id"] == ids["_seed"], "left_semi").select(F.col("to_id").alias("node_id"), F.lit("upstream").alias("direction"), "edge_type")
    down = kept.join(ids, kept["to_id"] == ids["_seed"], "left_semi").select(F.col("from_id").alias("node_id"), F.lit("downstream").alias("direction"), "edge_type")
    around = up.unionByName(down).distinct()
    return around.join(ids, around["node_id"] == ids["_seed"], "left_anti")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, depth: int = 3) -> DataFrame:
    """(label, depth, n) of the nodes that a change of the seeds may affect, each at its least distance from any."""
    arcs = _arcs(edges, types).select("here", "there")
    reached = cut(seeds.select(F.col("seed").alias("node_id"), F.lit(0).alias("depth")).distinct())
    frontier = reached
    for hop in range(1, min(depth, MOST_HOPS) + 1):  # all seeds at once: a node is reached at its least distance, whichever seed it is from
        step = arcs.join(small(frontier), F.col("node_id") == F.col("here")).select(F.col("there").alias("node_id")).distinct()
        frontier = cut(step.join(by_key(reached.select("node_id")), "node_id", "left_anti").withColumn("depth", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached.filter("depth > 0").join(by_key(nodes.select("node_id", "label")), "node_id").groupBy("label", "depth").agg(F.count("*").alias("n"))


def histogram(edges: DataFrame) -> DataFrame:
    """(edge_type, n, n_from, n_to): edges of each type and their different ends."""
    ends = edges.groupBy("edge_type", F.lit(0).alias("side"), F.col("from_id").alias("node_id")).agg(F.count("*").alias("n")).unionByName(
        edges.groupBy("edge_type", F.lit(1).alias("side"), F.col("to_id").alias("node_id")).agg(F.count("*").alias("n")))
    return ends.groupBy("edge_type").agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n"), F.count_if(F.col("side") == 0).alias("n_from"), F.count_if(F.col("side") == 1).alias("n_to"))


def resolve(nodes: DataFrame, mentions: DataFrame, limit: int = 10) -> DataFrame:
    """(mention, node_id, score, rank): nodes whose name holds the mention: 100 for equal, 80 for its end, 50 otherwise.

    A name that holds a mention holds its first three characters, so different names and mentions meet on three-character
    pieces and only then are compared; scores are taken before the limit. Mentions of fewer characters find nothing.
    """
    low = nodes.select("node_id", F.lower("name").alias("name"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")).filter("length(name) >= 3")
    pieces = low.select("name").distinct().withColumn("piece", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda k: F.substring(F.col("name"), k, F.lit(3))))))
    asked = mentions.select("mention", F.lower("mention").alias("_m")).distinct().filter("length(_m) >= 3").withColumn("piece", F.substring("_m", 1, 3))
    held = by_key(pieces).join(asked, "piece").filter(F.contains("name", "_m")).select("mention", "_m", "name")
    met = by_key(low).join(held, "name")
    score = F.when(F.col("name") == F.col("_m"), 100).when(F.endswith("name", "_m"), 80).otherwise(50) * F.col("confidence")
    ranked = met.select("mention", "node_id", F.round(score, 6).alias("score"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "node_id"))).filter(F.col("rank") <= limit)


def merge_nodes(nodes: list[DataFrame]) -> DataFrame:
    """One row per node_id of several extractions: labels united, the greatest confidence, the last name seen."""
    every = reduce(DataFrame.unionByName, nodes)
    return every.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("confidence").alias("confidence"), F.max_by("name", "last_seen").alias("name"))


def keep_connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")


def shortest_paths(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, depth: int = 2, fan_out: int | None = None) -> DataFrame:
    """(seed, node_id, depth, path, edge_types) of a shortest path from each seed to each node within depth hops.

    Of several the one that comes first by its nodes. With fan_out, each node passes on to that many neighbours at
    most, the first by edge type and id: a limit on what is shown of hubs.

    Seeds of equal first hops reach the same nodes by the same paths, but for themselves, so one of them is followed for
    all, and rows of a seed and a node are made at last and never shuffled or written between.
    """
    arcs = _arcs(edges, types)
    if fan_out is not None:
        order = F.row_number().over(Window.partitionBy("here").orderBy("edge_type", "there"))
        arcs = cut(arcs.distinct().withColumn("_r", order).filter(F.col("_r") <= fan_out).drop("_r"))
    begun = seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("depth"), F.array("seed").alias("path"), F.array().cast("array<string>").alias("edge_types")).distinct()
    begun = cut(begun)
    if depth < 1:
        return begun
    first = arcs.join(small(begun.select("seed")), F.col("seed") == F.col("here")).filter("there <> seed")
    first = cut(first.groupBy("seed", F.col("there").alias("node_id")).agg(F.min("edge_type").alias("edge_type")))
    alike = cut(_alike(first))
    reached = first.join(small(alike.filter("seed = start").select("seed", "start")), "seed").select("start", "node_id", F.lit(1).alias("depth"), F.array("node_id").alias("path"), F.array("edge_type").alias("edge_types"))
    reached = cut(reached)
    frontier = reached
    for hop in range(2, min(depth, MOST_HOPS) + 1):
        step = arcs.join(small(frontier), F.col("node_id") == F.col("here"))
        step = step.groupBy("start", F.col("there").alias("node_id")).agg(F.min(F.struct("path", "edge_type", "edge_types")).alias("p"))
        step = step.join(by_key(reached.select("start", "node_id")), ["start", "node_id"], "left_anti")
        frontier = cut(step.select("start", "node_id", F.lit(hop).alias("depth"), F.concat("p.path", F.array("node_id")).alias("path"), F.concat("p.edge_types", F.array("p.edge_type")).alias("edge_types")))
        reached = reached.unionByName(frontier)
    told = lineage.spread(reached, "start", "node_id").join(small(alike), "start").filter("node_id <> seed")  # few rows make many
    return begun.unionByName(told.select("seed", "node_id", "depth", F.concat(F.array("seed"), "path").alias("path"), "edge_types"))


def _alike(first: DataFrame) -> DataFrame:
    """(seed, start): the seed that stands for all that have the same first hops (seed, node_id, edge_type), which is one of them. They
    are met by a hash of their hops and then compared by all hops; those of an equal hash but other hops stand for themselves."""
    told = first.groupBy("seed").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node_id", "edge_type")).alias("_hash"))
    met = cut(told.join(by_key(told.groupBy("_n", "_hash").agg(F.min("seed").alias("start"))), ["_n", "_hash"]).select("seed", "start"))
    hops = first.select(F.col("seed").alias("start"), "node_id", "edge_type")
    other = first.join(by_key(met), "seed").join(by_key(hops), ["start", "node_id", "edge_type"], "left_anti").select("seed").distinct()
    marked = met.join(by_key(other.withColumn("_other", F.lit(True))), "seed", "left")
    return marked.select("seed", F.when(F.col("_other"), F.col("seed")).otherwise(F.col("start")).alias("start"))


# How much a relationship of each type counts, what a seed, a node and an edge count, and the labels that count more.
TYPE_WEIGHTS = {"DECLARES": 1.4, "CONTAINS": 1.2, "HANDLES": 1.3, "EXPOSES": 1.3, "CALLS": 1.2, "COVERS": 1.1, "DOCUMENTS": 1.1, "MENTIONS": 0.6, "RELATED_TO": 0.5}
SEED_RANK, NODE_RANK, EDGE_RANK = 10.0, 5.0, 3.0
TELLING_LABELS = ["APIEndpoint", "Function", "Class", "Document"]


def edge_score(edges: DataFrame) -> Column:
    """What an edge counts by its confidence, freshness, extraction method and type; columns that edges lack count fully."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1.0)) if name in edges.columns else F.lit(1.0)

    method = F.when(F.coalesce(F.col("extraction_method"), F.lit("deterministic")) == "deterministic", 1.0).otherwise(0.75) if "extraction_method" in edges.columns else F.lit(1.0)
    weights = F.create_map(*(F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair))
    return EDGE_RANK * known("confidence") * known("freshness") * method * F.coalesce(weights[F.col("edge_type")], F.lit(1.0))


def spread(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, node_id, score, path, edge_types): the strongest path of at most depth hops from the seeds of each query.

    seeds: (query_id, node_id, types); a query follows active edges of its types, both ways. A path is as strong as the
    product of its edges, each a share of the strongest edge there can be (so no edge adds strength); of equal ones the
    shortest, then the first by its nodes, is kept. Each hop passes on only what got a better path, so a node may be
    reached again by a longer but stronger one, and the work follows nodes and not paths.
    """
    most = EDGE_RANK * max(TYPE_WEIGHTS.values())
    kept = edges.filter(F.coalesce(F.col("status"), F.lit("active")) == "active").withColumn("strength", F.least(edge_score(edges) / most, F.lit(1.0)))
    arcs = kept.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), "edge_type", "strength").unionByName(
        kept.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"), "edge_type", "strength"))
    types = cut(seeds.groupBy("query_id").agg(F.first("types").alias("types")))
    place = F.struct((-F.col("score")).alias("less"), F.size("path").alias("hops"), "path", "edge_types")
    start = seeds.select("query_id", "node_id").distinct()
    start = start.select("query_id", "node_id", F.lit(1.0).alias("score"), F.array("node_id").alias("path"), F.array().cast("array<string>").alias("edge_types"))
    reached = start.select("query_id", "node_id", place.alias("best"))
    frontier = cut(reached)
    reached = frontier
    for _ in range(min(depth, MOST_HOPS)):
        step = arcs.join(small(cut(frontier.join(types, "query_id"))), (F.col("node_id") == F.col("here")) & F.array_contains("types", F.col("edge_type")))
        found = F.struct((F.col("best.less") * F.col("strength")).alias("less"), (F.col("best.hops") + 1).alias("hops"), F.concat("best.path", F.array("there")).alias("path"), F.concat("best.edge_types", F.array("edge_type")).alias("edge_types"))
        step = step.select("query_id", F.col("there").alias("node_id"), found.alias("new")).groupBy("query_id", "node_id").agg(F.min("new").alias("new"))
        both = reached.join(by_key(step), ["query_id", "node_id"], "full")
        both = cut(both.select("query_id", "node_id", F.least("best", "new").alias("best"), F.coalesce(F.col("new") < F.col("best"), F.col("best").isNull()).alias("better")))
        reached, frontier = both.drop("better"), both.filter("better").drop("better")
    return reached.select("query_id", "node_id", (-F.col("best.less")).alias("score"), F.col("best.path").alias("path"), F.col("best.edge_types").alias("edge_types"))


def ranks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(query_id, node_id, rank, score, path, edge_types, n_edges) of what spread() reaches from seeds (query_id, node_id, types).

    A seed counts 10; a node (node_id, labels, confidence) 5 times its confidence, and 1.5 with a telling label, else 1;
    and either at least what its best edge among the reached nodes counts. n_edges are the edges between reached nodes.
    """
    edges = cut(edges.filter(F.coalesce(F.col("status"), F.lit("active")) == "active"))  # every hop reads it
    near = cut(spread(edges, seeds, depth))
    known = near.join(by_key(nodes.select("node_id", "labels", F.coalesce("confidence", F.lit(1.0)).alias("_confidence"))), "node_id", "left")
    boost = F.when(F.arrays_overlap("labels", F.array(*map(F.lit, TELLING_LABELS))), 1.5).otherwise(1.0)
    own = F.greatest(F.when(F.size("path") == 1, F.lit(SEED_RANK)), F.when(F.col("labels").isNotNull(), NODE_RANK * F.col("_confidence") + boost))
    kept = edges.filter(F.coalesce(F.col("status"), F.lit("active")) == "active").select("from_id", "to_id", "edge_type", edge_score(edges).alias("_s"))
    types = seeds.groupBy("query_id").agg(F.first("types").alias("types"))
    ids = cut(near.select("query_id", "node_id").join(types, "query_id"))
    # an edge is told to the queries that reach the end that fewer reach, and looked up under the other
    n = cut(ids.groupBy("node_id").agg(F.count("*").alias("n")))
    for end in ("from", "to"):
        kept = kept.join(small(n.select(F.col("node_id").alias(f"{end}_id"), F.col("n").alias(f"_{end}"))), f"{end}_id")
    fewer = F.col("_to") < F.col("_from")
    kept = kept.withColumn("_rare", F.when(fewer, F.col("to_id")).otherwise(F.col("from_id"))).withColumn("_n", F.when(fewer, F.col("from_id")).otherwise(F.col("to_id")))
    within = kept.join(small(ids), (F.col("node_id") == F.col("_rare")) & F.array_contains("types", F.col("edge_type"))).select("query_id", "_n", "from_id", "to_id", "edge_type", "_s")
    within = cut(within.join(by_key(ids.select("query_id", F.col("node_id").alias("_n"))), ["query_id", "_n"]).select("query_id", "from_id", "to_id", "edge_type", "_s"))
    best = within.select("query_id", F.explode(F.array("from_id", "to_id")).alias("node_id"), "_s").groupBy("query_id", "node_id").agg(F.max("_s").alias("_s"))
    counted = within.groupBy("query_id").agg(F.count("*").alias("n_edges"))
    rows = known.select("query_id", "node_id", own.alias("_own"), "score", "path", "edge_types").join(best, ["query_id", "node_id"], "left").join(counted, "query_id", "left")
    return rows.select("query_id", "node_id", F.round(F.greatest("_own", "_s"), 6).alias("rank"), F.round("score", 6).alias("score"), "path", "edge_types", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


# The kinds of what a change may affect, by label, and what is to be checked for each.
CATEGORIES = (("service", ["Service", "UIApp", "UIScreen"]), ("api", ["APIEndpoint"]), ("test", ["Test"]), ("code", ["Function", "Class", "Module", "CodeFile"]), ("doc", ["Document", "ADR", "Runbook"]),
              ("runtime", ["DBTable", "Migration", "Config", "FeatureFlag", "EventTopic"]), ("owner", ["Owner", "Team"]), ("delivery", ["Actor", "JiraTicket", "PR", "Commit", "Epic"]))
CHECKS = (("test", "Run affected tests."), ("api", "Verify affected API handlers and contracts."), ("runtime", "Review affected config, migrations, or data access."), ("doc", "Review linked docs, ADRs, or runbooks."))
NO_CHECK = "Validate changed code paths with focused tests."


def category(labels: Column) -> Column:
    out = F.lit("other")
    for name, some in reversed(CATEGORIES):
        out = F.when(F.arrays_overlap(labels, F.array(*map(F.lit, some))), name).otherwise(out)
    return out


def impact_report(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, evidence: DataFrame, types: list[str] | None = None, depth: int = 2) -> DataFrame:
    """(seed, n_affected, categories, checks, confidence) of what a change of each seed may affect.

    nodes: node_id, labels, confidence; evidence: seed. A seed that is no node has confidence 0.2 with evidence and 0
    without; else 0.55, and 0.2 more with affected nodes and 0.15 with evidence, times the mean confidence of the nodes.
    """
    near = traverse(edges, seeds, types, depth).join(nodes.select("node_id", "labels", F.coalesce("confidence", F.lit(1.0)).alias("confidence")), "node_id")
    near = near.withColumn("category", F.when(F.col("depth") > 0, category(F.col("labels"))))
    of = near.groupBy("seed").agg(
        F.count_if(F.col("depth") > 0).alias("n_affected"), F.bool_or(F.col("depth") == 0).alias("known"), F.array_sort(F.collect_set("category")).alias("found"), F.avg("confidence").alias("mean"))
    rows = seeds.select("seed").distinct().join(of, "seed", "left").join(evidence.select("seed").distinct().withColumn("shown", F.lit(0.15)), "seed", "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    checks = F.array_compact(F.array(*(F.when(F.array_contains(found, name), F.lit(said)) for name, said in CHECKS)))
    n = F.coalesce("n_affected", F.lit(0))
    base = 0.55 + F.when(n > 0, 0.2).otherwise(0.0) + F.coalesce("shown", F.lit(0.0))
    confidence = F.when(F.coalesce("known", F.lit(False)), F.round(F.least(base * F.col("mean"), F.lit(0.95)), 3)).otherwise(F.when(F.col("shown").isNotNull(), 0.2).otherwise(0.0))
    return rows.select("seed", n.cast("long").alias("n_affected"), F.array_join(found, ",").alias("categories"), F.array_join(F.when(F.size(checks) > 0, checks).otherwise(F.array(F.lit(NO_CHECK))), " ").alias("checks"), confidence.alias("confidence"))


def ambiguous(resolved: DataFrame) -> DataFrame:
    """(mention, ambiguous) of resolved mentions (mention, rank, labels, uri): four nodes or more whose first six lie in more
    than three resources, or have several labels and more than two resources."""
    first = resolved.groupBy("mention").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("rank") <= 6, F.coalesce("uri", F.lit("")))).alias("uris"), F.count_distinct(F.when(F.col("rank") <= 6, F.col("labels"))).alias("kinds"))
    return first.select("mention", ((F.col("n") >= 4) & ((F.col("uris") > 3) | (F.col("kinds") > 1) & (F.col("uris") > 2))).alias("ambiguous"))


def merge_facts(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges (edge_type, from_id, to_id, confidence) with those of facts added: of equal ones the greatest confidence stays."""
    columns = ["edge_type", "from_id", "to_id"]
    every = lineage.spread(edges.select(*columns, "confidence").unionByName(facts.select(*columns, "confidence")), "from_id", "to_id")  # few are equal, so they are dealt before
    return every.groupBy(*columns).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_sources"))
