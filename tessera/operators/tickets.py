"""A graph of tickets: what each says of itself, its parents, its people and the tickets it speaks of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.codegraph import sid

TICKET = "jira"  # the kind of a ticket's id, and the key of what a resource's text says of it
FORM = (f"{TICKET} struct<key string, issue_type string, summary string, status string, url string, created string, updated string, parent string, assignee string, reporter string, "
        "labels string, components string, linked_keys array<string>, mentioned_keys array<string>>")


def _listed(raw: Column) -> Column:
    """Texts of a list, or of a text with commas."""
    return F.filter(F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")).otherwise(F.transform(F.split(raw, ","), F.trim)), lambda x: x != "")


def tickets(resources: DataFrame) -> DataFrame:
    """(uri, site, key, label, summary, status, parent, assignee, reporter, labels, components, related) of resources (uri, content)
    whose text holds an object with what is known of a ticket; the object may stand anywhere and nest.

    site is the second part of a uri of three or more, else unknown; a ticket without a key takes the last part. What
    isn't JSON gives a ticket of its uri alone.
    """
    text = F.regexp_extract("content", r'(?s)(\{\s*"%s"\s*:.*\})' % TICKET, 1)
    j = F.from_json(text, FORM)[TICKET]
    rows = resources.withColumn("_j", j).withColumn("_parts", F.split("uri", ":"))
    key = F.coalesce(F.nullif(F.col("_j.key"), F.lit("")), F.element_at("_parts", -1))
    site = F.when(F.size("_parts") >= 3, F.col("_parts")[1]).otherwise("unknown")
    empty = F.array().cast("array<string>")
    related = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("_j.linked_keys", empty), F.coalesce("_j.mentioned_keys", empty)), lambda x: x.isNotNull() & (x != "") & (x != key))))
    label = F.when(F.lower("_j.issue_type") == "epic", "Epic").otherwise("JiraTicket")

    def said(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"_j.{name}")), F.lit(""))

    return rows.select("uri", site.alias("site"), key.alias("key"), label.alias("label"), F.coalesce("_j.summary", F.lit("")).alias("summary"), F.coalesce("_j.status", F.lit("")).alias("status"), said("parent").alias("parent"),
                       said("assignee").alias("assignee"), said("reporter").alias("reporter"), F.coalesce(_listed(F.col("_j.labels")), empty).alias("labels"), F.coalesce(_listed(F.col("_j.components")), empty).alias("components"), related.alias("related"))


def edges(found: DataFrame, product: str) -> DataFrame:
    """(edge_type, from_id, to_id, relationship, uri): tickets to their parents, their people and the tickets they speak of."""
    here = sid(TICKET, product, F.col("site"), F.col("key"))

    def of(kind: str, to: Column, said: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(kind).alias("edge_type"), here.alias("from_id"), to.alias("to_id"), F.lit(said).alias("relationship"), "uri")

    out = of("PART_OF_FLOW", sid(TICKET, product, F.col("site"), F.col("parent")), "parent", found.filter("parent is not null"))
    for person in ("assignee", "reporter"):
        out = out.unionByName(of("ASSIGNED_TO", sid("actor", product, F.lower(person)), person, found.filter(F.col(person).isNotNull())))
    other = found.withColumn("other", F.explode("related"))
    return out.unionByName(of("RELATED_TO", sid(TICKET, product, F.col("site"), F.col("other")), "mentions", other))


def nodes(found: DataFrame, product: str) -> DataFrame:
    """(node_id, label, name): tickets as they say, and parents, people and tickets that are only spoken of."""
    def ticket(key: str) -> Column:
        return sid(TICKET, product, F.col("site"), F.col(key))

    every = found.select(ticket("key").alias("node_id"), F.lit(0).alias("order"), "label", F.col("key").alias("name")).unionByName(
        found.filter("parent is not null").select(ticket("parent").alias("node_id"), F.lit(1).alias("order"), F.lit("Epic").alias("label"), F.col("parent").alias("name"))).unionByName(
        found.withColumn("other", F.explode("related")).select(ticket("other").alias("node_id"), F.lit(2).alias("order"), F.lit("JiraTicket").alias("label"), F.col("other").alias("name"))).unionByName(
        found.select(F.explode(F.array_compact(F.array("assignee", "reporter"))).alias("name")).select(sid("actor", product, F.lower("name")).alias("node_id"), F.lit(0).alias("order"), F.lit("Actor").alias("label"), "name"))
    return every.groupBy("node_id").agg(F.min(F.struct("order", "label", "name")).alias("b")).select("node_id", "b.label", "b.name")


def rolled_up(found: DataFrame) -> DataFrame:
    """(site, key, root, depth, in_cycle): the ticket at the end of each ticket's parents, and how many steps away it is.

    Every round doubles the steps: a ticket takes the root of its root. Tickets whose parents lead round in a circle, or
    into one, have the least key of the circle as their root and no depth. A ticket with several parents in the
    table follows the least.
    """
    start = found.groupBy("site", "key").agg(F.min("parent").alias("up"))
    known = cut(start.select("site", "key", F.coalesce("up", "key").alias("root"), F.when(F.col("up").isNull() | (F.col("up") == F.col("key")), 0).otherwise(1).alias("depth"), F.least("key", F.coalesce("up", "key")).alias("least"), (F.coalesce(F.col("up"), F.lit("")) == F.col("key")).alias("own")))
    bound = max(1, known.count()).bit_length() + 1  # rounds after which a path that hasn't ended goes round
    for _ in range(bound):
        above = known.select("site", F.col("key").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"), F.col("least").alias("under"), F.col("own").alias("round"))
        step = known.join(above, ["site", "root"], "left")
        moved = F.coalesce(F.col("more"), F.lit(0)) > 0
        known = cut(step.select("site", "key", F.when(moved, F.col("further")).otherwise(F.col("root")).alias("root"), (F.col("depth") + F.when(moved, F.col("more")).otherwise(0)).cast("long").alias("depth"),
                                F.when(moved, F.least("least", "under")).otherwise(F.col("least")).alias("least"), (F.col("own") | F.coalesce("round", F.lit(False))).alias("own")))
        if known.join(known.select("site", F.col("key").alias("root"), F.col("depth").alias("_m")), ["site", "root"]).filter("_m > 0").isEmpty():
            break
    ends = known.select("site", F.col("key").alias("root"), F.col("depth").alias("_m"), F.col("least").alias("_circle"))
    rows = known.join(ends, ["site", "root"], "left")
    circle = (F.coalesce("_m", F.lit(0)) > 0) | F.col("own")
    return rows.select("site", "key", F.when(F.coalesce("_m", F.lit(0)) > 0, F.col("_circle")).otherwise(F.col("root")).alias("root"), F.when(~circle, F.col("depth")).alias("depth"), circle.alias("in_cycle"))
