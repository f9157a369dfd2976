"""Answers to questions about a product from its graph and its evidence, without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.lineage import cut
from tessera.operators import evidence, graph, retrieval

# How many mentions, nodes of one, seeds, and names of each kind a question is given, and what is said.
MENTIONS, OF_MENTION, SEEDS, RESOLVED, CONTEXT, CITED, OPTIONS, SEED_HITS = 12, 6, 10, 5, 8, 5, 8, 12
AMBIGUOUS = "Multiple graph entities match this question. Pick a target and ask again."
NO_ENTITY, NO_EDGES, NO_EVIDENCE, UNCLEAR = "no graph entity resolved", "no graph relationships returned", "no cited evidence found", "ambiguous entity resolution"
NOTHING = "No product graph or evidence matched this question."
TICKET = r"\b[A-Z][A-Z0-9]+-\d+\b"
TOKEN = r"[A-Za-z][A-Za-z0-9_./:{}-]+"
# Words that begin questions and name nothing.
PLAIN = ["about", "after", "also", "does", "explain", "from", "give", "have", "how", "list", "make", "show", "tell", "that", "the", "them", "then", "there", "these", "this", "what", "when", "where", "which", "with", "would"]
WORD = r"[\p{L}\p{N}_]+"


def explicit(query: Column) -> Column:
    """What a question names outright: paths, tickets, routes, and tokens that look like code or a proper name, in order."""
    def every(form: str, group: int = 0) -> Column:
        return F.regexp_extract_all(query, F.lit(form), F.lit(group))

    named = F.filter(every(TOKEN), lambda t: t.rlike(r"[/.:{}\-_]|[a-z][A-Z]") | t.rlike(r"^[A-Z][A-Za-z0-9]{3,}$"))
    found = F.array_distinct(F.concat(every(evidence.PATH), every(TICKET), every(evidence.ROUTE, 1), named))
    return F.slice(F.filter(found, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(PLAIN)), 1, MENTIONS)


def matched(texts: DataFrame, names: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(key, name, start, n_words): where names (name) stand in texts, word for word and in any case, in one pass over both.

    A text's words meet names on the first word of each different name, and the words that follow are compared; a name
    that lies within a longer one found there isn't told.
    """
    words = texts.select(key, F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("words"))
    known = names.select(F.regexp_extract_all(F.lower("name"), F.lit(WORD), F.lit(0)).alias("name_words")).filter(F.size("name_words") > 0).distinct().withColumn("word", F.element_at("name_words", 1))
    each = words.select(key, "words", F.posexplode("words").alias("start", "word"))
    met = each.join(known, "word").filter(F.slice("words", F.col("start") + 1, F.size("name_words")) == F.col("name_words"))
    spans = met.select(key, F.array_join("name_words", " ").alias("name"), F.col("start"), F.size("name_words").alias("n_words")).distinct()
    before = Window.partitionBy(key).orderBy("start", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("start") + F.col("n_words")).over(before)
    return spans.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("start") + F.col("n_words"))).drop("_reach")


def mentioned(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, rank): the nodes a question names: for each explicit mention the OF_MENTION best, then those whose
    whole name stands in it."""
    said = queries.select("query_id", F.posexplode(explicit(F.col("query"))).alias("place", "mention"))
    found = graph.resolve(nodes, said.select("mention").distinct(), OF_MENTION)
    direct = said.join(found, "mention").select("query_id", "node_id", F.struct(F.lit(0).alias("kind"), "place", "rank").alias("at"))
    called = nodes.select("node_id", F.array_join(F.regexp_extract_all(F.lower("name"), F.lit(WORD), F.lit(0)), " ").alias("name"))
    called = retrieval.top(called, ["name"], [F.col("node_id")], OF_MENTION)
    whole = matched(queries, nodes.select("name")).join(called, "name").select("query_id", "node_id", F.struct(F.lit(1).alias("kind"), F.col("start").alias("place"), "rank").alias("at"))
    first = direct.unionByName(whole).groupBy("query_id", "node_id").agg(F.min("at").alias("at"))
    return first.select("query_id", "node_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node_id")).alias("rank"))


def paths(product: evidence.Product, reached: DataFrame) -> DataFrame:
    """(query_id, seed_id, n_nodes, n_edges, edge_types, anchors, confidence, summary) of what each seed reached best.

    The edges of a seed are the last ones of the strongest paths that begin with it; edges may have an anchor.
    """
    seed, hops = F.col("path")[0], F.size("path")
    steps = reached.select("query_id", seed.alias("seed_id"), F.when(hops > 1, F.element_at("path", -2)).alias("here"), F.col("node_id").alias("there"), F.when(hops > 1, F.element_at("edge_types", -1)).alias("edge_type"))
    anchor = F.col("anchor") if "anchor" in product.edges.columns else F.lit(None).cast("string")
    active = product.edges.filter(F.coalesce(F.col("status"), F.lit("active")) == "active")
    held = active.select("from_id", "to_id", "edge_type", F.coalesce("confidence", F.lit(1.0)).alias("c"), anchor.alias("anchor"))
    arcs = held.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), "edge_type", "c", "anchor").unionByName(held.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"), "edge_type", "c", "anchor"))
    arcs = arcs.groupBy("here", "there", "edge_type").agg(F.max("c").alias("c"), F.min("anchor").alias("anchor"))
    of = steps.join(arcs, ["here", "there", "edge_type"], "left").groupBy("query_id", "seed_id").agg(
        F.count("*").alias("n_nodes"), F.count("edge_type").alias("n_edges"), F.array_sort(F.collect_set("edge_type")).alias("edge_types"), F.slice(F.array_sort(F.collect_set("anchor")), 1, 5).alias("anchors"), F.round(F.avg("c"), 3).alias("confidence"))
    named = of.filter("n_edges > 0").join(product.nodes.select(F.col("node_id").alias("seed_id"), "name"), "seed_id")
    summary = F.concat("name", F.lit(" reached "), "n_nodes", F.lit(" node(s) through "), "n_edges", F.lit(" relationship(s)"))
    return named.select("query_id", "seed_id", "n_nodes", "n_edges", "edge_types", "anchors", "confidence", summary.alias("summary"))


def ask(product: evidence.Product, queries: DataFrame, k: int = 10, depth: int = 2, mode: str = "auto") -> DataFrame:
    """(query_id, answer, needs_clarification, options, n_entities, n_relationships, path_summaries, n_citations, unknowns, confidence) for
    each question (query_id, query).

    product.nodes have a uri, or count as lying nowhere. A question that names four nodes or more in several resources is
    asked back, but in a global or drift_lite mode its names are left aside. One that names none starts from the nodes of the
    chunks it finds. Then the graph is followed along all its relationships, and evidence is gathered and cited.
    """
    queries, nodes = queries.select("query_id", "query"), product.nodes
    place = F.col("uri") if "uri" in nodes.columns else F.lit(None).cast("string")
    known = nodes.select("node_id", "name", "labels", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), place.alias("uri"))
    said = cut(mentioned(nodes, queries).join(known, "node_id"))
    unclear = graph.ambiguous(said.select(F.col("query_id").alias("mention"), "rank", "labels", "uri")).filter("ambiguous").select(F.col("mention").alias("query_id"))
    unclear = cut(unclear)
    options = said.join(unclear, "query_id", "left_semi").filter(F.col("rank") <= OPTIONS).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("o"))
    stopped = unclear.limit(0) if mode in ("global", "drift_lite") else unclear
    plain = said.join(unclear, "query_id", "left_anti").select("query_id", "node_id", "rank")
    open_ = queries.join(stopped, "query_id", "left_anti")
    lost = open_.join(plain.select("query_id").distinct(), "query_id", "left_anti")
    hits = retrieval.bm25(product.chunks, lost, min(max(k, 5), 12)).join(product.attached, "chunk_id").groupBy("query_id", "node_id").agg(F.min("rank").alias("rank"))
    hits = retrieval.top(hits.join(nodes.select("node_id"), "node_id", "left_semi"), ["query_id"], [F.col("rank"), F.col("node_id")], SEED_HITS, "_r").select("query_id", "node_id", F.col("_r").alias("rank"))
    seeds = cut(plain.unionByName(hits))
    types = F.array_sort(F.collect_set("edge_type")).alias("types")
    every = product.edges.groupBy("edge_type").agg(F.lit(1).alias("one")).agg(types)  # one row
    start = seeds.filter(F.col("rank") <= SEEDS).select("query_id", "node_id").crossJoin(F.broadcast(every))
    reached = cut(graph.ranks(nodes, product.edges, start, min(max(depth, 1), 5)))
    told = paths(product, reached).join(seeds.filter(F.col("rank") <= 5).select("query_id", F.col("node_id").alias("seed_id"), F.col("rank").alias("_r")), ["query_id", "seed_id"])
    told = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", "summary", "confidence"))).alias("p"))

    beyond = reached.join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").join(known.select("node_id", "name", "confidence"), "node_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), "node_id")
    near = beyond.withColumn("_r", F.row_number().over(order)).groupBy("query_id").agg(
        F.count("*").alias("n_near"), F.sum("confidence").alias("c_near"), F.array_sort(F.collect_list(F.when(F.col("_r") <= CONTEXT, F.struct("_r", "name")))).alias("near"))
    own = seeds.join(known, "node_id").groupBy("query_id").agg(F.count("*").alias("n_own"), F.sum("confidence").alias("c_own"), F.array_sort(F.collect_list(F.when(F.col("rank") <= RESOLVED, F.struct("rank", "name")))).alias("own"))
    counted = reached.groupBy("query_id").agg(F.max("n_edges").alias("n_edges"))
    shown = evidence.gather(product, open_, k, depth, mode)[0]
    cited = shown.groupBy("query_id").agg(F.count("*").alias("n_cited"), F.array_sort(F.collect_list(F.when(F.col("slot") <= CITED, F.struct("slot", F.concat(F.lit("[C"), "slot", F.lit("] "), "file", F.lit(":"), "line").alias("said"))))).alias("cited"))
    rows = queries.join(stopped.withColumn("unclear", F.lit(True)), "query_id", "left").join(options, "query_id", "left")
    for part in (own, near, counted, told, cited):
        rows = rows.join(part, "query_id", "left")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def listed(column: str, field: str) -> Column:
        return F.array_join(F.transform(column, lambda x: x[field]), ", ")

    stop = F.coalesce("unclear", F.lit(False))
    unknowns = F.array_compact(F.array(F.when(number("n_own") == 0, NO_ENTITY).when(number("n_edges") == 0, NO_EDGES), F.when(number("n_cited") == 0, NO_EVIDENCE)))
    parts = F.concat_ws("\n", F.concat(F.lit("Question: "), "query"), F.when(number("n_own") > 0, F.concat(F.lit("Resolved: "), listed("own", "name"))), F.when(number("n_near") > 0, F.concat(F.lit("Graph context: "), listed("near", "name"))),
                        F.when(number("n_edges") > 0, F.concat(F.lit("Graph paths include "), "n_edges", F.lit(" edge(s)."))), F.when(number("n_cited") > 0, F.concat(F.lit("Evidence: "), listed("cited", "said"))),
                        F.when(F.size(unknowns) > 0, F.concat(F.lit("Unknowns: "), F.array_join(unknowns, "; "))))
    base = 0.25 + F.when(number("n_own") > 0, 0.25).otherwise(0.0) + F.when(number("n_near") > 0, 0.2).otherwise(0.0) + F.when(number("n_cited") > 0, 0.2).otherwise(0.0)
    n = number("n_own") + number("n_near")
    mean = F.when(n > 0, (number("c_own") + number("c_near")) / n).otherwise(1.0)
    empty = F.array().cast("array<string>")
    return rows.select(
        "query_id", F.when(stop, AMBIGUOUS).when(F.coalesce("query", F.lit("")) == "", NOTHING).otherwise(parts).alias("answer"), stop.alias("needs_clarification"), F.when(stop, F.transform("o", lambda x: x["name"])).otherwise(empty).alias("options"),
        F.when(stop, 0).otherwise(n).cast("long").alias("n_entities"), F.when(stop, 0).otherwise(number("n_edges")).cast("long").alias("n_relationships"),
        F.when(stop, empty).otherwise(F.coalesce(F.transform("p", lambda x: F.concat(x["summary"], F.lit(" ("), F.format_string("%.3f", x["confidence"]), F.lit(")"))), empty)).alias("path_summaries"),
        F.when(stop, 0).otherwise(number("n_cited")).cast("long").alias("n_citations"), F.when(stop, F.array(F.lit(UNCLEAR))).otherwise(unknowns).alias("unknowns"),
        F.when(stop, 0.0).otherwise(F.round(F.least(base * mean, F.lit(0.95)), 3)).alias("confidence"))
