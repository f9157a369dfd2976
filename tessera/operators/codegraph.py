"""A product's graph from its resources: files, modules, declarations, calls, routes, settings, tables, headings and mentions.

Resources are rows (uri, content, source_key, source_id). Code is read by scan.facts, all else by patterns over lines; both
are cut once for all that reads them.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.lineage import by_key, cut, spread
from tessera.functions.scalars import base_name, uuid5
from tessera.operators import chunking, scan
from tessera.operators.chunking import lines

# The namespace of edge ids, and the forms of facts.
NAMESPACE = "1a41a1f2-a486-4aa7-bad5-a1a263ad91c2"
CODE = r"(?i)\.(?:pyi?|jsx?|tsx?|go|rs|java|kts?|c|h|cc|cpp|hpp|sol)$"
MARKDOWN = r"(?i)\.mdx?$"
TEST_PATH = r"(?i)(^|/)(tests?|__tests__)/|(^|/|_)(test|spec)[_.-]"
ROUTE = r"""(?i)@[\w.]+\.(get|post|put|patch|delete|options|head)\(\s*['"]([^'"]+)['"]"""
CONFIG = r"""os\.environ(?:\.get)?\(\s*['"]([A-Z0-9_]+)['"]|os\.getenv\(\s*['"]([A-Z0-9_]+)['"]|process\.env\.([A-Z0-9_]+)"""
TABLE = r"""(?i)\b(?:CREATE|ALTER|DROP)\s+TABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([A-Za-z_][\w.]*|"[^"]+")"""
DOC_PATH = r"\b[\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|java|md|mdx|sql|yaml|yml|toml|json)\b"
DOC_ROUTE = r"/[A-Za-z0-9_./:{}-]+"
DOC_SYMBOL = r"`([A-Za-z_][A-Za-z0-9_]{2,})`"


def sid(kind: str, product: str, *parts: Column | str) -> Column:
    """The stable id of an entity: kind, product and what names it, joined by colons."""
    return F.concat_ws(":", F.lit(kind), F.lit(product), *(F.trim(F.lit(p) if isinstance(p, str) else p) for p in parts))


def module_name(uri: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(uri, r"\.[^./]+$", ""), r"^[./]+|[./]+$", ""), F.lit("/"), F.lit("."))


def normal_route(path: Column) -> Column:
    bare = F.regexp_replace(path, "/+$", "")
    return F.regexp_replace(F.when(bare == "", "/").otherwise(bare), r"\{[^}]+\}|:[A-Za-z_]\w*", "{}")


def file_labels(uri: Column) -> Column:
    kinds = [
        F.when(uri.rlike(CODE), "CodeFile").otherwise("Document"), F.when(uri.rlike(TEST_PATH), "Test"),
        F.when(F.lower(uri).contains("migration") | F.lower(uri).endswith(".sql"), "Migration"), F.when(uri.rlike(r"(?i)\.(?:env|ini|toml|ya?ml|json)$"), "Config")]
    return F.array_sort(F.array_compact(F.array(*kinds)))


class Read(NamedTuple):
    """Resources with their lines and the facts of their code, each cut once."""
    resources: DataFrame
    lines: DataFrame
    facts: DataFrame


def read(resources: DataFrame | Read) -> Read:
    return resources if isinstance(resources, Read) else Read(resources, cut(lines(spread(resources.select("uri", "content"), "uri"))), cut(scan.facts(resources)))


def declarations(resources: DataFrame | Read) -> DataFrame:
    """(uri, name, kind, label, is_test, start_line, end_line, doc_line, signature, context) of the declarations in code files.

    context names the declarations around it and itself, outermost first; doc_line is where the comments above it begin.
    """
    found = resources.facts if isinstance(resources, Read) else scan.facts(resources)
    test = F.col("uri").rlike(TEST_PATH) | F.col("name").rlike("^(?:test_|it_|spec_)")
    return found.filter("fact = 'declaration'").select("uri", "name", "kind", "label", test.alias("is_test"), "start_line", "end_line", "doc_line", "signature", "context")


def imports(resources: DataFrame | Read) -> DataFrame:
    """(uri, module, external): what code files import; what begins with a dot, or with a folder above the file, is their own."""
    found = resources.facts if isinstance(resources, Read) else scan.facts(resources)
    folders = F.filter(F.slice(F.split("uri", "/"), 1, F.size(F.split("uri", "/")) - 1), lambda x: ~x.isin("", "."))
    own = F.col("module").startswith(".") | F.array_contains(folders, F.regexp_extract("module", r"^[^./]*", 0))
    return found.filter("fact = 'import'").select("uri", "module", (~own).alias("external")).distinct()


def _calls(held: Read, product: str) -> DataFrame:
    """CALLS between declarations of a file, and from one to a module from which the name is imported; a local name hides an
    imported one. The caller is the outermost declaration around the line: as these don't overlap, the last one that
    begins before it, if it reaches that far."""
    declared = declarations(held)
    called = held.facts.filter("fact = 'call'").select("uri", "name", F.col("start_line").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<caller:string,caller_label:string,end_line:int>").alias("c"))
    outer = declared.filter(~F.contains("context", F.lit("."))).select("uri", F.lit(None).cast("string").alias("name"), F.col("start_line").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("name").alias("caller"), F.col("label").alias("caller_label"), "end_line").alias("c"))
    before = Window.partitionBy("uri").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = outer.unionByName(called).withColumn("c", F.last("c", ignorenulls=True).over(before)).filter("kind = 1 and at <= c.end_line").select("uri", "name", "c.caller", "c.caller_label").distinct()
    local = declared.groupBy("uri", "name").agg(F.max_by("label", "start_line").alias("label"))
    bound = held.facts.filter("fact = 'import' and name is not null").groupBy("uri", "name").agg(F.max("module").alias("module"))
    met = inside.join(by_key(local), ["uri", "name"], "left").join(by_key(bound), ["uri", "name"], "left")
    to = F.when(F.col("label").isNotNull(), sid("symbol", product, F.col("uri"), F.col("name"), F.col("label"))).when(F.col("module").isNotNull(), sid("module", product, F.col("module")))
    edges = met.select(F.lit("CALLS").alias("edge_type"), sid("symbol", product, F.col("uri"), F.col("caller"), F.col("caller_label")).alias("from_id"), to.alias("to_id"), "uri")
    return edges.filter("to_id is not null and to_id <> from_id")


def _headings(each: DataFrame) -> DataFrame:
    """(uri, at, level, title, parent) of the headings of markdown files; parent is the title of the nearest one above."""
    found = each.filter(F.col("uri").rlike(MARKDOWN)).withColumn("marks", F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)).filter("marks <> ''")
    found = found.select("uri", F.col("line_no").alias("at"), F.length("marks").alias("level"), F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("title"))
    before = Window.partitionBy("uri").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("at", "title"))).over(before) for k in range(1, 7)]
    above = F.greatest(*(F.when(F.col("level") > k, x) for k, x in enumerate(last, 1)))
    return found.withColumn("parent", above["title"])


def _document_edges(each: DataFrame, product: str) -> list[DataFrame]:
    heads = _headings(each)
    uri, title = F.col("uri"), F.col("title")
    here = sid("document", product, uri, title)
    inside = heads.select(F.lit("CONTAINS").alias("edge_type"), F.coalesce(F.when(F.col("parent").isNotNull(), sid("document", product, uri, F.col("parent"))), sid("file", product, uri)).alias("from_id"), here.alias("to_id"), "uri")
    rows = each.filter(uri.rlike(MARKDOWN)).join(by_key(heads.select("uri", F.col("at").alias("line_no"), "title")), ["uri", "line_no"], "left")
    section = F.last("title", ignorenulls=True).over(Window.partitionBy("uri").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(title.isNotNull(), F.col("line_no"))).over(Window.partitionBy("uri"))
    body = rows.withColumn("section", section).withColumn("first", first).filter(title.isNull() & (F.col("first").isNull() | (F.col("line_no") > F.col("first"))))
    owner = F.when(F.col("section").isNull(), sid("file", product, uri)).otherwise(sid("document", product, uri, F.col("section")))
    name = F.col("name")

    def those(form: str, group: int, kind: str, to: Column) -> DataFrame:
        some = body.select("uri", owner.alias("from_id"), F.explode(F.regexp_extract_all("line", F.lit(form), F.lit(group))).alias("name")).filter("name <> ''")
        return some.select(F.lit(kind).alias("edge_type"), "from_id", to.alias("to_id"), "uri")

    return [
        inside, those(DOC_PATH, 0, "DOCUMENTS", sid("file", product, F.regexp_replace(name, r"^[./]+|[./]+$", ""))), those(DOC_ROUTE, 0, "MENTIONS", sid("api", product, "ANY", normal_route(name), module_name(uri))),
        *(those(CONFIG, k, "MENTIONS", sid("config", product, name)) for k in (1, 2, 3)), those(DOC_SYMBOL, 1, "MENTIONS", sid("symbol", product, uri, name, "Function"))]


def edges(resources: DataFrame | Read, product: str) -> DataFrame:
    """(edge_id, edge_type, from_id, to_id, uri): each distinct fact of each resource."""
    uri = F.col("uri")
    held = read(resources)
    resources, each, declared = held.resources, held.lines, declarations(held)
    file, module = sid("file", product, uri), sid("module", product, module_name(uri))
    code = resources.filter(uri.rlike(CODE))
    symbol = sid("symbol", product, uri, F.col("name"), F.col("label"))

    def edge(df: DataFrame, kind: str, a: Column, b: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("edge_type"), a.alias("from_id"), b.alias("to_id"), "uri")

    route = each.filter(uri.rlike(CODE)).withColumn("method", F.upper(F.regexp_extract("line", ROUTE, 1))).withColumn("path", F.regexp_extract("line", ROUTE, 2)).filter("method <> ''")
    api = sid("api", product, F.col("method"), normal_route(F.col("path")), module_name(uri))
    after = route.join(by_key(declared.select("uri", "start_line", symbol.alias("symbol"))), "uri", "left").groupBy("uri", "line_no", "method", "path").agg(
        F.min_by(F.when(F.col("start_line") >= F.col("line_no"), F.col("symbol")), F.when(F.col("start_line") >= F.col("line_no"), F.col("start_line"))).alias("symbol"))
    config = each.filter(uri.rlike(CODE)).select("uri", F.explode(F.array(*(F.regexp_extract_all("line", F.lit(CONFIG), F.lit(k)) for k in (1, 2, 3)))).alias("keys")).select("uri", F.explode("keys").alias("key")).filter("key <> ''")
    table = each.filter(F.array_contains(file_labels(uri), "Migration")).select("uri", F.explode(F.regexp_extract_all("line", F.lit(TABLE), F.lit(1))).alias("name"))
    parts = [
        edge(resources, "CONTAINS", sid("source", product, F.col("source_key")), sid("repo", product, F.col("source_id"))), edge(resources, "CONTAINS", sid("repo", product, F.col("source_id")), file),
        edge(code, "CONTAINS", file, module), edge(declared, "DECLARES", module, symbol), edge(declared.filter("is_test"), "COVERS", symbol, module),
        edge(imports(held), "IMPORTS", module, sid("module", product, F.col("module"))), _calls(held, product),
        edge(after, "HANDLES", F.coalesce("symbol", file), api), edge(route, "EXPOSES", file, api), edge(config, "READS", file, sid("config", product, F.col("key"))),
        edge(table, "WRITES", file, sid("dbtable", product, "default", F.regexp_replace("name", '^"|"$', ""))), *_document_edges(each, product)]
    facts = reduce(DataFrame.unionByName, parts).distinct()
    return facts.withColumn("edge_id", F.concat(F.lit("edge:"), uuid5(NAMESPACE, F.concat_ws("|", F.lit(product), "from_id", "edge_type", "to_id", "uri"))))


def nodes(resources: DataFrame | Read, product: str) -> DataFrame:
    """(node_id, labels, name, uri, start_line, end_line): files, modules, declarations, headings, and what edges name besides."""
    uri = F.col("uri")
    none = F.lit(None).cast("int")
    held = read(resources)
    resources, declared, heads = held.resources, declarations(held), _headings(held.lines)
    labels = F.array_sort(F.array_compact(F.array("label", F.when(F.col("is_test"), "Test"))))
    own = [
        resources.select(sid("file", product, uri).alias("node_id"), file_labels(uri).alias("labels"), base_name(uri).alias("name"), "uri", none.alias("start_line"), none.alias("end_line")),
        resources.filter(uri.rlike(CODE)).select(sid("module", product, module_name(uri)).alias("node_id"), F.array(F.lit("Module")).alias("labels"), module_name(uri).alias("name"), "uri", none.alias("start_line"), none.alias("end_line")),
        declared.select(sid("symbol", product, uri, F.col("name"), F.col("label")).alias("node_id"), labels.alias("labels"), "name", "uri", "start_line", "end_line"),
        heads.select(sid("document", product, uri, F.col("title")).alias("node_id"), F.array(F.lit("Document")).alias("labels"), F.col("title").alias("name"), "uri", F.col("at").alias("start_line"), F.col("at").alias("end_line"))]
    known = reduce(DataFrame.unionByName, own)
    kind = F.regexp_extract("node_id", "^([a-z]+):", 1)
    label = F.create_map(*(F.lit(x) for pair in (("source", "Source"), ("repo", "Repository"), ("module", "Module"), ("file", "CodeFile"), ("api", "APIEndpoint"), ("config", "Config"), ("dbtable", "DBTable"), ("symbol", "Function")) for x in pair))
    ends = edges(held, product).select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct().join(by_key(known.select("node_id")), "node_id", "left_anti")
    rest = ends.select("node_id", F.array(label[kind]).alias("labels"), F.element_at(F.split("node_id", ":"), F.when(kind.isin("api", "symbol"), -2).otherwise(-1)).alias("name"), F.lit(None).cast("string").alias("uri"), none.alias("start_line"), none.alias("end_line"))
    every = known.unionByName(rest)
    return every.groupBy("node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), F.max("name").alias("name"), F.max("uri").alias("uri"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def chunks(resources: DataFrame | Read) -> DataFrame:
    """(uri, kind, start_line, end_line, context_path, content): code by its declarations with the comments above them, markdown
    by its headings, and all else in runs of lines. Contents without any text have none."""
    held = read(resources)
    uri, some = F.col("uri"), held.resources.filter(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")
    declared = declarations(held).select("uri", F.col("doc_line").alias("start_line"), "end_line", "context")
    code, text = some.filter(uri.rlike(CODE)), some.filter(uri.rlike(MARKDOWN))
    plain = chunking.split_oversized(some.filter(~uri.rlike(CODE) & ~uri.rlike(MARKDOWN)).select("uri", "content")).select("uri", "start_line", "end_line", F.lit(None).cast("string").alias("context_path"), "content")
    parts = [("code", chunking.code_chunks(code, declared)), ("doc", chunking.markdown_chunks(text, _headings(held.lines).select("uri", "at", "level", "title"))), ("doc", plain)]
    return reduce(DataFrame.unionByName, (p.select("uri", F.lit(kind).alias("kind"), "start_line", "end_line", "context_path", "content") for kind, p in parts))


def chunk_nodes(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_id, node_ids) of chunks (chunk_id, uri, start_line, end_line): the declarations and headings a chunk overlaps, and its file's own nodes."""
    at = found.filter("uri is not null").select("uri", "node_id", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    met = chunks.join(by_key(at), "uri").filter(F.col("a").isNull() | (F.col("a") <= F.col("end_line")) & (F.col("b") >= F.col("start_line")))
    return met.groupBy("chunk_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def communities(found: DataFrame) -> DataFrame:
    """(folder, n, n_code, summary): what each folder of a product holds, with its first names by label."""
    folder = F.coalesce(F.nullif(F.regexp_extract("uri", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    rows = found.filter("uri is not null").select(folder.alias("folder"), F.element_at("labels", 1).alias("label"), "name", F.array_contains("labels", "CodeFile").alias("code"))
    by_label = rows.groupBy("folder", "label").agg(F.count("*").alias("n"), F.count_if("code").alias("n_code"), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 5), ", ").alias("names"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n", "names"))), lambda x: F.concat(x["label"], F.lit(" ("), x["n"].cast("string"), F.lit("): "), x["names"])), "; ")
    return by_label.groupBy("folder").agg(F.sum("n").alias("n"), F.sum("n_code").alias("n_code"), said.alias("summary"))


# The relationships that each sentence about a file tells.
SENTENCES = (("Flows", ["CALLS", "DEPENDS_ON", "HANDLES", "IMPLEMENTS", "PART_OF_FLOW"]), ("Runtime/config/data", ["READS", "WRITES", "CONSTRAINS"]), ("Docs/tests", ["DOCUMENTS", "MENTIONS", "COVERS"]))


def community_sentences(found: DataFrame, related: DataFrame, most: int = 16) -> DataFrame:
    """(uri, summary): for each resource what its edges (edge_type, from_id, to_id, uri) say of its flows, its runtime and its documents,
    the first `most` of each by type and ends; resources without such edges have none. Ends that are no node go by their id."""
    kind = F.lit(None).cast("int")
    for k, (_, types) in enumerate(SENTENCES):
        kind = F.when(F.col("edge_type").isin(types), k).otherwise(kind)
    order = Window.partitionBy("uri", "kind").orderBy("edge_type", "from_id", "to_id")
    rows = related.select("uri", "edge_type", "from_id", "to_id", kind.alias("kind")).filter("kind is not null").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    names = found.select("node_id", F.nullif("name", F.lit("")).alias("name"))
    for end in ("from", "to"):
        rows = rows.join(by_key(names.select(F.col("node_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))), f"{end}_id", "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", f"{end}_id"))
    said = F.concat("from_name", F.lit(" -"), "edge_type", F.lit("-> "), "to_name")
    by_kind = rows.groupBy("uri", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", said.alias("said")))), lambda x: x["said"]), "; ").alias("said"))
    title = F.element_at(F.array(*(F.lit(name) for name, _ in SENTENCES)), F.col("kind") + 1)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", F.concat(title, F.lit(": "), "said", F.lit(".")).alias("line")))), lambda x: x["line"]), "\n")
    return by_kind.groupBy("uri").agg(lines.alias("said")).select("uri", F.concat(F.lit("Graph community for "), "uri", F.lit(".\n"), "said").alias("summary"))
