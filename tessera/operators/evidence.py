"""Evidence for questions: understanding, channels, merging under quotas, coverage and repair.

Every step takes a table of queries (query_id, query) and gives rows by query_id.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.lineage import cut, small, spread
from tessera.functions.scalars import tokens
from tessera.operators import graph, retrieval

# Weights that break near ties of scores between 0 and 1, patterns and words that tell kinds of questions.
CHANNELS = {"grep": 0.16, "repo_map": 0.10, "graph": 0.08, "summary": 0.08, "hybrid": 0.06, "skill": 0.04}
ROLES = {"overview": 0.040, "definition": 0.040, "implementation": 0.036, "relationship": 0.030, "validation": 0.024, "skill_guidance": 0.020}
ANCHOR_BONUS = 0.5
PATH = r"\b[\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|md|mdx|sql|yaml|yml|toml|json)\b"
ROUTE = r"(?:^|\s)(/[A-Za-z0-9_./:{}-]+)"
CONFIG = r"\b[A-Z][A-Z0-9_]{2,}\b"
SYMBOL = r"\b(?:[A-Za-z]+_\w+|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|[A-Za-z_]\w{2,}(?=\s*\())"
RELATIONAL = ["call", "calls", "called", "caller", "callers", "depend", "depends", "dependency", "dependencies", "impact", "affect", "affects", "uses", "used", "imports"]
PROCEDURAL = ["add", "configure", "create", "debug", "deploy", "fix", "implement", "install", "run", "setup", "steps"]
LOCAL = ["class", "definition", "defined", "file", "function", "method", "module"]
SUMMARIES = ["summary", "graph_community_summary"]
EDGE_TYPES = {"relational": ["IMPORTS", "CALLS", "DEPENDS_ON", "HANDLES", "READS", "WRITES", "DECLARES", "CONTAINS"],
              "global": ["CONTAINS", "DECLARES", "DOCUMENTS", "COVERS", "IMPLEMENTS", "RELATED_TO"]}
LOCAL_EDGE_TYPES = ["CONTAINS", "DECLARES", "HANDLES", "READS", "WRITES", "DOCUMENTS"]
MAPPED, SKILLS, SEEDS, A_MENTION = 8, 4, 8, 4  # symbols and skills a query is shown, graph seeds it starts from, and nodes an anchor may name


class Product(NamedTuple):
    """What is known of a product. Only chunks are needed; a channel without its table finds nothing.

    chunks: chunk_id, file, line, context_path, content, artifact_type; nodes: node_id, name, labels, confidence; edges:
    edge_type, from_id, to_id, status and more that graph.edge_score reads; attached: chunk_id, node_id; symbols: uri, name,
    kind, line_no, signature; skills: name, description, body, tier, confidence.
    """
    chunks: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    attached: DataFrame | None = None
    symbols: DataFrame | None = None
    skills: DataFrame | None = None


def understand(queries: DataFrame) -> DataFrame:
    """queries with paths, routes, symbols, config_keys, anchors, facets and shape: relational, procedural, local or global."""
    q = F.col("query")

    def every(form: str, group: int = 0) -> Column:
        return F.array_distinct(F.regexp_extract_all(q, F.lit(form), F.lit(group)))

    out = queries.withColumn("paths", every(PATH)).withColumn("routes", every(ROUTE, 1)).withColumn("config_keys", every(CONFIG))
    out = out.withColumn("symbols", F.array_except(every(SYMBOL), "config_keys"))
    out = out.withColumn("anchors", F.array_distinct(F.concat("paths", "routes", "symbols", "config_keys")))
    words = F.regexp_extract_all(F.lower(q), F.lit(r"[a-z_]\w*"), F.lit(0))

    def has(some: list[str]) -> Column:
        return F.arrays_overlap(words, F.array(*map(F.lit, some)))

    located = F.size(F.concat("paths", "routes", "symbols")) > 0
    shape = F.when(has(RELATIONAL), "relational").when(has(PROCEDURAL), "procedural").when(located | has(LOCAL), "local").otherwise("global")
    out = out.withColumn("shape", shape)
    empty = F.array().cast("array<string>")
    facets = F.concat(
        F.array(F.lit("source")), F.when(F.col("shape") == "global", F.array(F.lit("overview"), F.lit("implementation"))).otherwise(empty),
        F.when(F.col("shape") == "relational", F.array(F.lit("relationship"), F.lit("implementation"))).otherwise(empty),
        F.when(F.size("anchors") > 0, F.array(F.lit("definition"))).otherwise(empty), F.when(F.lower(q).rlike("test|validate"), F.array(F.lit("validation"))).otherwise(empty))
    return out.withColumn("facets", F.array_distinct(facets))


def role(file: Column, context: Column, content: Column, channel: Column) -> Column:
    text = F.lower(F.concat_ws(" ", file, context, content))
    return (
        F.when(channel == "summary", "overview").when(channel == "graph", "relationship").when(channel == "skill", "skill_guidance")
        .when(F.lower(file).rlike(r"\.mdx?$"), "overview").when(text.rlike("test|assert "), "validation")
        .when(text.rlike("class |def |function |const "), "implementation").otherwise("definition")
    )


def stem(file: Column) -> Column:
    return F.regexp_extract(F.lower(F.split(file, ":")[0]), r"([^/]*?)(?:\.[^./]*)?/*$", 1)


def query_plan(understood: DataFrame, mode: str = "auto") -> DataFrame:
    """understood with mode (local or global, or the one that is asked for), strategy, seed_strategy and edge_types."""
    own = F.when(F.col("shape").isin("local", "relational") | (F.size("anchors") > 0), "local").otherwise("global")
    out = understood.withColumn("mode", own if mode == "auto" else F.lit(mode))
    strategy = F.when(F.col("mode") == "drift_lite", "drift_lite").when(F.col("mode") == "local", "local_graph").otherwise("global_community")
    seed = F.when(F.col("mode") == "drift_lite", "summary_repo_map_followups").when(F.col("mode") != "local", "structural_summary_repo_map").when(
        F.size("anchors") > 0, "explicit_anchor_graph_traversal").otherwise("hybrid_hit_graph_seed")
    types = F.array(*map(F.lit, LOCAL_EDGE_TYPES))
    for shape, some in EDGE_TYPES.items():
        types = F.when(F.col("shape") == shape, F.array(*map(F.lit, some))).otherwise(types)
    return out.withColumn("strategy", strategy).withColumn("seed_strategy", seed).withColumn("edge_types", types)


def _words(text: Column) -> Column:
    """Different words of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))


def holding(rows: DataFrame, key: list[str], text: str, asked: DataFrame, form: str = r"[\p{L}\p{N}_]{3,}") -> DataFrame:
    """(query_id, key, n): how many terms of each query (query_id, term) rows (key, text) hold anywhere, in lower case.

    A term lies within one run of characters of the form, so runs meet terms on the terms' first three characters and only
    then are compared; terms have three at least.
    """
    runs = rows.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(form), F.lit(0)))).alias("run"))
    pieces = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda p: F.substring(F.col("run"), p, F.lit(3)))))
    terms = asked.select("term").distinct().withColumn("piece", F.substring("term", 1, 3))
    met = runs.select("run").distinct().withColumn("piece", pieces).join(terms, "piece").filter(F.contains("run", "term")).select("run", "term").distinct()
    held = runs.join(met, "run").select(*key, "term").distinct()
    return held.join(asked, "term").groupBy("query_id", *key).agg(F.count("*").alias("n"))


def chunk_candidates(chunks: DataFrame, planned: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, channel, chunk_id) of the hybrid, grep and summary channels, each up to what a query for k may be shown."""
    asked = planned.select("query_id", "query")
    lexical = cut(retrieval.bm25(chunks, asked, max(4 * k, 24)).select("query_id", "chunk_id", "score", "rank"))
    hybrid = lexical.filter(F.col("rank") <= max(4 * k, 20)).select("query_id", F.lit("hybrid").alias("channel"), "chunk_id")
    wide = planned.select("query_id", F.when(F.col("mode").isin("global", "drift_lite"), 6).otherwise(3).alias("most"))
    summed = lexical.join(chunks.filter(F.col("artifact_type").isin(SUMMARIES)).select("chunk_id"), "chunk_id", "left_semi").join(wide, "query_id")
    summed = summed.filter(F.col("rank") <= F.greatest(4 * F.col("most"), F.lit(12)))
    summed = retrieval.top(summed, ["query_id"], [F.col("rank")], 6, "_r").filter(F.col("_r") <= F.col("most")).select("query_id", F.lit("summary").alias("channel"), "chunk_id")
    named = planned.select("query_id", F.concat_ws(" ", "query", F.array_join("anchors", " ")).alias("query"))
    exact = retrieval.grep(chunks, named, max(k, 12)).select("query_id", F.lit("grep").alias("channel"), "chunk_id")
    return hybrid.unionByName(exact).unionByName(summed)


def graph_seeds(nodes: DataFrame, planned: DataFrame) -> DataFrame:
    """(query_id, node_id, types): the nodes that the first anchors of each query name, SEEDS at most."""
    anchors = planned.select("query_id", "edge_types", F.posexplode(F.slice("anchors", 1, SEEDS)).alias("place", "mention"))
    found = graph.resolve(nodes, anchors.select("mention").distinct(), A_MENTION)
    first = anchors.join(found, "mention").groupBy("query_id", "node_id").agg(F.min(F.struct("place", "rank")).alias("at"), F.first("edge_types").alias("types"))
    return retrieval.top(first, ["query_id"], [F.col("at"), F.col("node_id")], SEEDS, "_r").select("query_id", "node_id", "types")


def graph_candidates(product: Product, planned: DataFrame, k: int = 10, depth: int = 2) -> DataFrame:
    """(query_id, chunk_id, rank, node_id, path, edge_types): chunks attached to what the graph reaches from a query's anchors.

    A chunk counts for its best node, by graph.ranks, and one more if it is the summary of a community.
    """
    reached = graph.ranks(product.nodes, product.edges, cut(graph_seeds(product.nodes, planned)), min(depth, 4))
    met = reached.join(product.attached, "node_id").join(product.chunks.select("chunk_id", "artifact_type"), "chunk_id")
    rank = 1.0 + F.col("rank") + F.when(F.col("artifact_type") == "graph_community_summary", 1.0).otherwise(0.0)
    best = met.withColumn("rank", F.round(rank, 6)).groupBy("query_id", "chunk_id").agg(F.min(F.struct((-F.col("rank")).alias("less"), "node_id", "path", "edge_types")).alias("b"))
    rows = best.select("query_id", "chunk_id", (-F.col("b.less")).alias("rank"), "b.node_id", "b.path", "b.edge_types")
    return retrieval.top(rows, ["query_id"], [F.desc("rank"), F.col("chunk_id")], max(k, 12), "_r").drop("_r")


def _asked(planned: DataFrame) -> DataFrame:
    return planned.select("query_id", F.explode(_words(F.col("query"))).alias("term"))


def repo_map_candidates(symbols: DataFrame, planned: DataFrame) -> DataFrame:
    """(query_id, chunk_id, file, line, excerpt, weight): the MAPPED symbols whose file, name and signature hold most words of a query."""
    key = ["uri", "name", "kind", "line_no", "signature"]
    held = symbols.select(*key, F.concat_ws(" ", "uri", "name", "signature").alias("_text"))
    met = holding(held, key, "_text", _asked(planned)).withColumn("weight", 5.0 * F.col("n") + F.when(F.col("kind").isin("class", "struct", "interface"), 2.0).otherwise(1.0))
    first = retrieval.top(met, ["query_id"], [F.desc("weight"), F.col("uri"), F.col("line_no"), F.col("name")], MAPPED, "_r")
    return first.select("query_id", F.concat_ws(":", F.lit("repo_map"), "uri", "line_no", "name").alias("chunk_id"), F.col("uri").alias("file"), F.col("line_no").alias("line"), F.col("signature").alias("excerpt"), "weight", F.col("name").alias("context_path"))


def skill_candidates(skills: DataFrame, planned: DataFrame) -> DataFrame:
    """(query_id, chunk_id, file, line, excerpt, weight): the SKILLS that hold most words of a query; a product's main one is always among those compared."""
    held = skills.select("name", "description", "tier", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.concat_ws(" ", "name", "description", "body").alias("_text"))
    met = holding(held, ["name"], "_text", _asked(planned))
    main = planned.select("query_id").crossJoin(F.broadcast(skills.filter("tier = 'product_master'").select("name").limit(SKILLS)))  # a product has one
    every = met.join(main, ["query_id", "name"], "full").join(held.drop("_text"), "name").withColumn("weight", F.coalesce("n", F.lit(0)) + 0.25 * F.col("confidence"))
    first = retrieval.top(every, ["query_id"], [F.desc("weight"), F.col("name")], SKILLS, "_r")
    return first.select("query_id", F.concat(F.lit("skill:"), "name").alias("chunk_id"), F.concat(F.lit("skills/"), "name", F.lit("/SKILL.md")).alias("file"), F.lit(1).alias("line"), F.col("description").alias("excerpt"), "weight", F.lit(None).cast("string").alias("context_path"))


def scored(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows with score: the share of a query's words that the excerpt holds, one scale for all channels."""
    asked = F.array_distinct(tokens(F.col("query")))
    share = F.round(F.size(F.array_intersect(asked, tokens(F.col("excerpt")))) / F.greatest(F.size(asked), F.lit(1)), 6)
    return rows.join(queries.select("query_id", "query"), "query_id").withColumn("score", share).drop("query")


CANDIDATE = ["query_id", "channel", "chunk_id", "file", "line", "role", "excerpt", "context_path"]


def _placed(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """found (query_id, channel, chunk_id) with what their chunks say. Roles are read off whole texts, so the rows are dealt to all tasks before."""
    rows = spread(chunks.join(small(cut(found)), "chunk_id"), "query_id", "chunk_id").withColumn("excerpt", F.substring(F.trim("content"), 1, 1600))
    return rows.withColumn("role", role(F.col("file"), F.col("context_path"), F.col("content"), F.col("channel"))).withColumn("chunk_id", F.col("chunk_id").cast("string")).select(*CANDIDATE)


def candidates(product: Product, planned: DataFrame, k: int = 10, depth: int = 2) -> DataFrame:
    """(query_id, channel, chunk_id, file, line, role, score, excerpt, context_path) of all six channels; chunk ids are text.

    Queries whose mode is drift_lite ask again with what their summaries and symbols bring up.
    """
    parts = [_placed(chunk_candidates(product.chunks, planned, k), product.chunks)]
    if product.nodes is not None and product.edges is not None and product.attached is not None:
        near = graph_candidates(product, planned, k, depth).select("query_id", F.lit("graph").alias("channel"), "chunk_id")
        parts.append(_placed(near, product.chunks))
    for channel, of_role, table, find in (("repo_map", "definition", product.symbols, repo_map_candidates), ("skill", "skill_guidance", product.skills, skill_candidates)):
        if table is not None:
            parts.append(find(table, planned).withColumn("channel", F.lit(channel)).withColumn("role", F.lit(of_role)).select(*CANDIDATE))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = cut(every)
    if not planned.filter("mode = 'drift_lite'").isEmpty():
        again = follow_ups(every, planned.filter("mode = 'drift_lite'"))
        found = retrieval.bm25(product.chunks, again.select(F.struct("query_id", "place").alias("query_id"), "query"), max(4, min(max(k, 8), 12)))
        every = every.unionByName(_placed(found.select("query_id.query_id", F.lit("hybrid").alias("channel"), "chunk_id").distinct(), product.chunks))
    return scored(every, planned)


def follow_ups(found: DataFrame, planned: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, place, query): up to four further queries, from the contexts, symbols and files that summaries and the repository's
    map bring up, or general ones where there are none."""
    named = found.filter(F.col("channel").isin("summary", "repo_map")).withColumn("fragment", F.concat_ws(" ", "context_path", "file"))
    named = named.groupBy("query_id", "fragment").agg(F.min(F.struct("channel", "chunk_id")).alias("at"))
    named = retrieval.top(named, ["query_id"], [F.desc("at.channel"), F.col("at.chunk_id")], most, "place").select("query_id", "place", "fragment")
    general = F.posexplode(F.array(*map(F.lit, ("implementation", "data flow", "tests", "configuration"))))
    bare = planned.join(named.select("query_id").distinct(), "query_id", "left_anti").select("query_id", general.alias("place", "fragment"))
    return named.unionByName(bare).join(planned.select("query_id", "query"), "query_id").select("query_id", "place", F.concat_ws(" ", "query", "fragment").alias("query"))


def gather(product: Product, queries: DataFrame, k: int = 10, depth: int = 2, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(shown, covered): evidence of all channels for queries (query_id, query), merged to k a query, and what it covers.

    Queries whose facets aren't all covered search again by words, anchors and missing facets, and are merged anew with
    what that adds; shown has a column repaired for these.
    """
    planned = cut(query_plan(understand(queries), mode))
    found = cut(candidates(product, planned, k, depth))
    first = cut(merge(found, planned, k))
    covered = cut(coverage(first, planned, found))
    short = covered.filter("not sufficient").select("query_id", "missing")
    lacking = planned.join(short, "query_id")
    more = cut(scored(_placed(repair(product.chunks, lacking, k), product.chunks), planned))
    again = first.join(found.select("query_id", "channel", "chunk_id", "file", "line", "excerpt", "context_path").distinct(), ["query_id", "channel", "chunk_id", "file", "line"])
    new = more.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    pool = again.select(*more.columns).join(new.select("query_id").distinct(), "query_id", "left_semi").unionByName(new)
    second = merge(pool, planned, k)
    kept = first.join(new.select("query_id").distinct(), "query_id", "left_anti").withColumn("repaired", F.lit(False))
    shown = cut(kept.unionByName(second.withColumn("repaired", F.lit(True))))
    return shown, coverage(shown, planned, found.unionByName(more))


def _quota(shape: str, anchored: bool, k: int) -> list[tuple[str, str, int]]:
    wide = shape == "global"
    return [
        ("channel", "hybrid", max(3, k // 2)), ("channel", "grep", 2 if anchored else 1), ("channel", "repo_map", 2 if shape in ("global", "local") else 1),
        ("channel", "graph", 3 if shape == "relational" else 1), ("channel", "summary", 2 if wide else 1), ("role", "overview", 2 if wide else 1),
        ("channel", "skill", 1 if shape in ("procedural", "global") else 0)]


def choose(ordered: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one query's candidates, best first: quotas in turn, then the rest, passing over a file used twice while
    fewer than four files are in; the first k chosen stay."""
    shape, anchored = ordered["shape"].iloc[0], bool(ordered["anchored"].iloc[0])
    order: list[int] = []
    for column, value, n in _quota(shape, anchored, k):
        order += [i for i in ordered.index[ordered[column] == value][:n] if i not in order]
    files = ordered["file"]
    used = files.loc[order].value_counts().to_dict()
    for i in ordered.index:
        if len(order) >= k:
            break
        if i in order or used.get(files[i], 0) >= 2 and len(used) < 4:
            continue
        order.append(i)
        used[files[i]] = used.get(files[i], 0) + 1
    return ordered.loc[order[:k]]


def merge(found: DataFrame, understood: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, slot, channel, chunk_id, file, line, role, score, rank_score): what is shown for each query.

    A chunk that several channels found counts once, by channel weight and score. The order-dependent choice is made
    query by query, over the candidates that the channels' own limits leave.
    """
    def weight(values: dict[str, float], column: str) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col(column)], F.lit(0.0))

    once = retrieval.top(found, ["query_id", "file", "chunk_id", "line"], [F.desc(weight(CHANNELS, "channel") + F.col("score")), F.col("channel")], 1, "_copy").drop("_copy")
    rows = once.join(understood.select("query_id", "shape", "anchors"), "query_id")
    anchored = F.exists("anchors", lambda a: F.lower(a) == stem(F.col("file")))
    rows = rows.withColumn("rank_score", F.round(F.col("score") + F.when(anchored, ANCHOR_BONUS).otherwise(0.0) + weight(CHANNELS, "channel") + weight(ROLES, "role"), 6))
    rows = rows.withColumn("anchored", F.size("anchors") > 0).drop("anchors", "excerpt", "context_path")

    def of_query(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["rank_score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        return choose(ordered, k)

    chosen = rows.groupBy("query_id").applyInPandas(of_query, rows.schema)
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "chunk_id"))
    return chosen.withColumn("slot", slot).select("query_id", "slot", "channel", "chunk_id", "file", "line", "role", "score", "rank_score")


def coverage(shown: DataFrame, understood: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, covered, missing, sufficient): which facets of each query the evidence covers.

    The facets are those that understand() tells, but for validation, which nothing asks of evidence. A definition is covered
    by what exact search or the repository's map found, and by evidence whose file, or excerpt where texts (query_id,
    chunk_id, excerpt) are given, holds an anchor of the query.
    """
    rows = shown.withColumn("_text", F.lower("file"))
    if texts is not None:
        said = texts.groupBy("query_id", "chunk_id").agg(F.max("excerpt").alias("_excerpt"))
        rows = shown.join(said, ["query_id", "chunk_id"], "left").withColumn("_text", F.lower(F.concat_ws("\n", "file", "_excerpt")))
    held = rows.join(understood.select("query_id", "anchors"), "query_id").withColumn("_anchored", F.exists("anchors", lambda a: F.contains(F.col("_text"), F.lower(a))))
    seen = held.groupBy("query_id").agg(
        F.lit(True).alias("source"), F.bool_or((F.col("role") == "overview") | F.lower("file").rlike(r"\.mdx?$")).alias("overview"), F.bool_or(F.col("role") == "implementation").alias("implementation"),
        F.bool_or((F.col("channel") == "graph") | (F.col("role") == "relationship")).alias("relationship"), F.bool_or(F.col("channel").isin("grep", "repo_map") | F.col("_anchored")).alias("definition"))
    rows = understood.select("query_id", "shape", "facets").join(seen, "query_id", "left")
    wanted = [(name, F.array_contains("facets", name) & (F.lit(True) if name != "implementation" else F.col("shape") == "global")) for name in ("source", "overview", "implementation", "relationship", "definition")]

    def those(met: bool) -> Column:
        return F.array_compact(F.array(*(F.when(asked & (F.coalesce(F.col(name), F.lit(False)) == F.lit(met)), F.lit(name)) for name, asked in wanted)))

    return rows.select("query_id", those(True).alias("covered"), those(False).alias("missing")).withColumn("sufficient", F.size("missing") == 0)


def repair(chunks: DataFrame, lacking: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, channel, chunk_id) that an exact search by words, anchors and missing facets of queries (query_id, query, anchors,
    missing) finds."""
    again = lacking.select("query_id", F.concat_ws(" ", "query", F.array_join("anchors", " "), F.array_join("missing", " ")).alias("query"))
    return retrieval.grep(chunks, again, max(4, min(k, 8))).select("query_id", F.lit("grep").alias("channel"), "chunk_id")


def cited(shown: DataFrame, chunks: DataFrame, limit: int = 700) -> DataFrame:
    """(query_id, citation, file, line, excerpt), citations named C1, C2, ... in the order shown."""
    rows = shown.join(chunks.select("chunk_id", "content"), "chunk_id")
    return rows.select("query_id", F.concat(F.lit("C"), "slot").alias("citation"), "file", "line", F.substring("content", 1, limit).alias("excerpt"))


def answers(shown: DataFrame, chunks: DataFrame, covered: DataFrame) -> DataFrame:
    """(query_id, answer, confidence) without a language model: the evidence by name, and how much of the question it covers."""
    lines = cited(shown, chunks, 200).withColumn("_at", F.substring("citation", 2, 9).cast("int"))
    text = lines.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_at", F.concat(F.lit("["), "citation", F.lit("] "), "file", F.lit(":"), "line").alias("said")))).alias("said"))
    share = F.size("covered") / F.greatest(F.size("covered") + F.size("missing"), F.lit(1))
    rows = covered.join(text, "query_id", "left").join(shown.groupBy("query_id").agg(F.avg(F.least("score", F.lit(1.0))).alias("mean")), "query_id", "left")
    return rows.select(
        "query_id", F.coalesce(F.array_join(F.transform("said", lambda s: s["said"]), "\n"), F.lit("No evidence was found.")).alias("answer"),
        F.round(F.least(F.lit(1.0), 0.5 * share + 0.5 * F.coalesce("mean", F.lit(0.0))), 3).alias("confidence"))
