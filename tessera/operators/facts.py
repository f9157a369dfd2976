"""Facts that a model extracted: decoded from its replies, resolved to known entities by their names, and merged."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import by_key, cut

# What entities and relationships may be, and how sure a node is that facts name.
LABELS = ["APIEndpoint", "ADR", "Class", "CodeFile", "Config", "DBTable", "Document", "EventTopic", "FeatureFlag", "Function", "Migration", "Module", "Repository", "Runbook", "Service", "Test", "UIApp", "UIScreen"]
PREDICATES = ["AFFECTS", "CALLS", "CHANGED", "CONSTRAINS", "CONSUMES", "CONTAINS", "COVERS", "DECLARES", "DEPENDS_ON", "DOCUMENTS", "EXPOSES", "HANDLES", "IMPLEMENTS", "IMPORTS", "MENTIONS", "PART_OF_FLOW", "PRODUCES", "READS", "RELATED_TO", "RESOLVES", "WRITES"]
NAMED = 0.8
CODE, TEXT = r"(?i)\.(?:py|tsx?|jsx?|go|rs)$", r"(?i)\.mdx?$"
FACTS = "place int, subject string, subject_label string, predicate string, object string, object_label string, confidence double, evidence string, start_line int, end_line int"


def _items(text: str) -> list:
    """The objects of the list `facts`; of a list that is cut off, those that are whole."""
    at = text.find('"facts"')
    at = text.find("[", at) + 1 if at >= 0 else 0
    decoder, found = json.JSONDecoder(), []
    while 0 < at < len(text):
        while at < len(text) and text[at] in " \n\r\t,":
            at += 1
        try:
            item, at = decoder.raw_decode(text, at)
        except ValueError:  # the end of the list, or of what there is of it
            break
        found.append(item)
    return found


def decoded(replies: DataFrame) -> DataFrame:
    """(reply_id, FACTS) of the facts in replies (reply_id, text): subject and object are names, or objects with a name and a
    label. Text around the list is passed over; what is no object, or lacks a name or predicate, is left out."""
    names = [c.split()[0] for c in FACTS.split(", ")]
    types = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in FACTS.split(", ")]

    def entity(x) -> tuple[str | None, str | None]:
        x = x if isinstance(x, dict) else {"name": x}
        return tuple(v.strip() or None if isinstance(v := x.get(k), str) else None for k in ("name", "label"))

    def number(x, kind):
        try:
            return kind(x) if x is not None and not isinstance(x, bool) else None
        except (TypeError, ValueError, OverflowError):
            return None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for place, x in enumerate(_items(text or "")):
                    if isinstance(x, dict):
                        said = x.get("evidence")
                        row = (place, *entity(x.get("subject")), x.get("predicate") if isinstance(x.get("predicate"), str) else None, *entity(x.get("object")), number(x.get("confidence"), float), said if isinstance(said, str) else None, number(x.get("start_line"), int), number(x.get("end_line"), int))
                        if row[1] and row[3] and row[4]:
                            index.append(i)
                            rows.append(row)
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["reply_id", *names])

    kind = replies.schema["reply_id"].dataType.simpleString()
    return replies.select("reply_id", F.col("text").cast("string").alias("text")).mapInArrow(each, f"reply_id {kind}, {FACTS}")


def label_of(name: Column) -> Column:
    """What an entity is by its name, where nothing else tells."""
    return (
        F.when(name.rlike(CODE), "CodeFile").when(name.rlike(TEXT), "Document").when((F.upper(name) == name) & name.contains("_"), "Config")
        .when(name.rlike("[/.]"), "Module").otherwise("Function")
    )


def valid(facts: DataFrame, least: float, most: int) -> DataFrame:
    """facts with a known predicate and labels, at least so sure, with lines in order; the first `most` of each reply. A label
    that is missing or unknown is told from the name."""
    def label(name: str, given: str) -> Column:
        return F.when(F.col(given).isin(LABELS), F.col(given)).otherwise(label_of(F.col(name)))

    lines = F.coalesce(F.col("end_line") >= F.col("start_line"), F.lit(True)) & F.coalesce(F.col("start_line") >= 1, F.lit(True))
    kept = facts.filter(F.upper("predicate").isin(PREDICATES) & (F.coalesce("confidence", F.lit(0.0)) >= least) & lines)
    kept = kept.withColumn("predicate", F.upper("predicate")).withColumn("subject_label", label("subject", "subject_label")).withColumn("object_label", label("object", "object_label"))
    kept = cut(kept)  # replies are decoded once
    first = kept.groupBy("reply_id").agg(F.slice(F.array_sort(F.collect_list("place")), 1, most).alias("_first"))
    return kept.join(by_key(first), "reply_id").filter(F.array_contains("_first", F.col("place"))).drop("_first")


def norm(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit("\\"), F.lit("/"))


def classes(pairs: DataFrame) -> DataFrame:
    """(name, class) over names that pairs (a, b) say are one: the least name that can be reached; null pairs are left out.

    Every round each name takes the least class beside it, and then that class's own, so long chains halve.
    """
    both = cut(pairs.filter("a is not null and b is not null").select("a", "b").unionByName(pairs.filter("a is not null and b is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("class")).select(F.col("a").alias("name"), "class"))
    while True:
        beside = both.join(known.select(F.col("name").alias("b"), F.col("class").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = known.join(beside.withColumnRenamed("a", "name"), "name").select("name", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = known.select(F.col("name").alias("class"), F.col("class").alias("further"))
        new = cut(step.join(jump, "class", "left").select("name", "was", F.least("class", "further").alias("class")))
        known = new.select("name", "class")
        if new.filter("class <> was").isEmpty():
            return known


def resolved(facts: DataFrame, nodes: DataFrame, product: str, aliases: DataFrame | None = None) -> DataFrame:
    """(reply_id, place, side, node_id, name, label, uri, is_new) of both ends of facts (reply_id, uri, ..).

    An end is the node (node_id, names, uri) that one of its names, in any case, is the same as, if that node lies in no
    resource or in that of the fact; of several, one of its resource first, then the least id. So functions of one name in
    two files aren't taken for each other. aliases (a, b, label) join names of entities of that label into one class. An
    end that names no such node becomes a node of its resource.
    """
    ends = facts.select("reply_id", "uri", "place", F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("subject").alias("name"), F.col("subject_label").alias("label")), F.struct(F.lit("to").alias("side"), F.col("object").alias("name"), F.col("object_label").alias("label")))).alias("e"))
    ends = ends.select("reply_id", "uri", "place", "e.*").withColumn("key", norm(F.col("name")))
    known = nodes.select("node_id", F.col("uri").alias("node_uri"), F.explode(F.array_distinct(F.transform(F.array_compact(F.concat(F.array("node_id"), "names")), norm))).alias("key"))
    if aliases is not None:
        same = classes(aliases.select(F.concat_ws("|", "label", norm(F.col("a"))).alias("a"), F.concat_ws("|", "label", norm(F.col("b"))).alias("b"))).select(F.col("name").alias("_k"), F.expr("substring(class, instr(class, '|') + 1)").alias("_class"))
        ends = ends.join(same, F.concat_ws("|", "label", "key") == F.col("_k"), "left").withColumn("key", F.coalesce("_class", "key")).drop("_k", "_class")
        again = known.join(same, F.substring_index("_k", "|", -1) == F.col("key")).select("node_id", "node_uri", F.col("_class").alias("key"))
        known = known.unionByName(again).distinct()
    met = ends.join(by_key(known), "key", "left").filter(F.col("node_uri").isNull() | (F.col("node_uri") == F.col("uri")))
    best = met.groupBy("reply_id", "uri", "place", "side").agg(F.min(F.when(F.col("node_id").isNotNull(), F.struct(F.col("node_uri").isNull().alias("anywhere"), "node_id"))).alias("b"))
    rows = ends.join(by_key(best), ["reply_id", "uri", "place", "side"], "left")
    own = F.concat_ws(":", F.lower("label"), F.lit(product), "uri", "key")
    return rows.select("reply_id", "place", "side", F.coalesce("b.node_id", own).alias("node_id"), "name", "label", "uri", F.col("b").isNull().alias("is_new"))


def merge(edges: DataFrame, facts: DataFrame, ends: DataFrame) -> DataFrame:
    """(edge_type, from_id, to_id, confidence, n_sources, anchors, evidence): edges (edge_type, from_id, to_id, confidence, anchor)
    with those of facts between resolved ends; of equal ones the greatest confidence, each source anchor once, and what
    the first fact quotes."""
    sides = [ends.filter(F.col("side") == s).select("reply_id", "place", F.col("node_id").alias(f"{s}_id")) for s in ("from", "to")]
    line = F.coalesce("start_line", F.lit(1))
    told = facts.join(sides[0], ["reply_id", "place"]).join(sides[1], ["reply_id", "place"]).select(
        F.col("predicate").alias("edge_type"), "from_id", "to_id", "confidence", F.concat_ws(":", "uri", line).alias("anchor"), F.struct("reply_id", "place", "evidence").alias("said"))
    every = edges.select("edge_type", "from_id", "to_id", "confidence", "anchor", F.lit(None).cast(told.schema["said"].dataType).alias("said")).unionByName(told)
    return every.groupBy("edge_type", "from_id", "to_id").agg(
        F.max("confidence").alias("confidence"), F.count_distinct("anchor").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("anchor")), ",").alias("anchors"), F.min("said")["evidence"].alias("evidence"))


def new_nodes(ends: DataFrame) -> DataFrame:
    """(node_id, label, name, uri, confidence) of ends that named no known node."""
    return ends.filter("is_new").groupBy("node_id").agg(F.min("label").alias("label"), F.min("name").alias("name"), F.min("uri").alias("uri"), F.lit(NAMED).alias("confidence"))
