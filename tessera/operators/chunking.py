"""Cutting resources into spans of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from tessera.functions.lineage import by_key, cut
from tessera.functions.scalars import uuid5

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # RFC 4122's namespace for URLs
# Fixed values, in characters: what is too short for a chunk of code or plain text and of a document's section, what
# is left whole, and of parts of longer texts the size and the overlap.
LEAST, LEAST_SECTION, MOST, TARGET, OVERLAP = 64, 20, 1200, 700, 70


def lines(resources: DataFrame, key: str = "uri", text: str = "content") -> DataFrame:
    """(key, line_no from 1, line)"""
    normal = F.regexp_replace(F.col(text), "\r\n?", "\n")
    return resources.select(key, F.posexplode(F.split(normal, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def chunk_id(product: str, key: str = "uri") -> Column:
    return uuid5(NAMESPACE, F.concat_ws("|", F.lit(product), F.col(key).cast("string"), F.concat_ws("-", "start_line", "end_line")))


def fixed_chunks(resources: DataFrame, size: int, key: str = "uri", text: str = "content") -> DataFrame:
    """(key, start_line, end_line, n_chars) of runs of `size` lines."""
    each = lines(resources, key, text).withColumn("_run", F.floor((F.col("line_no") - 1) / size))
    return each.groupBy(key, "_run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.sum(F.length("line")).alias("n_chars")).drop("_run")


def sections(marked: DataFrame, key: str) -> DataFrame:
    """(key, at, level, title, parent, path): headings (key, at, level, title) under the headings above them.

    The parent of a heading is the last one before it of a lower level, and its path the titles from the top, joined
    by " / "; for each level the last title that no heading of that level or above has ended.
    """
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = marked
    for level in range(1, 7):
        here = F.when(F.col("level") == level, F.col("at"))
        out = out.withColumn(f"_at{level}", F.last(here, ignorenulls=True).over(before)).withColumn(f"_title{level}", F.last(F.when(F.col("level") == level, F.col("title")), ignorenulls=True).over(before))
    for level in range(1, 7):
        ended = F.lit(False)
        for above in range(1, level):
            ended = ended | (F.coalesce(f"_at{above}", F.lit(-1)) > F.col(f"_at{level}"))
        live = (F.col("level") >= level) & F.col(f"_at{level}").isNotNull() & ~ended
        out = out.withColumn(f"_live{level}", F.when(live, F.col(f"_title{level}")))
    path = F.array_compact(F.array(*(f"_live{k}" for k in range(1, 7))))
    return out.withColumn("_path", path).select(key, "at", "level", "title", F.when(F.size("_path") > 1, F.element_at("_path", -2)).alias("parent"), F.array_join("_path", " / ").alias("path"))


def gaps(spans: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of the ranges of 1..n (sizes: key, n) that no span (key, start, end) covers."""
    edge = spans.select(key, "start", "end").unionByName(sizes.select(key, (F.col("n") + 1).alias("start"), (F.col("n") + 1).alias("end")))
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = edge.withColumn("_covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    return after.filter("start > _covered + 1").select(key, (F.col("_covered") + 1).alias("start"), (F.col("start") - 1).alias("end"))


def pack_lines(text: str, start: int = 1, most: int = MOST, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of a text's parts: itself up to `most` characters, else runs of lines of about
    `target`, each beginning with the last lines of the one before that reach `overlap`."""
    if len(text) <= most:
        return [(start, start + text.count("\n"), text)]
    rows = [x + "\n" for x in text.split("\n")]
    rows[-1] = rows[-1][:-1]
    out: list[tuple[int, int, str]] = []
    first, size = 0, 0
    for k, row in enumerate(rows if rows[-1] else rows[:-1]):
        if size + len(row) > target and k > first:
            part = "".join(rows[first:k]).rstrip("\n")
            out.append((start + first, start + first + part.count("\n"), part))
            kept, first = 0, k
            while first > 0 and kept < overlap:
                first -= 1
                kept += len(rows[first])
            size = kept
        size += len(row)
    part = "".join(rows[first:]).rstrip("\n")
    return [*out, (start + first, start + first + part.count("\n"), part)]


def split_spans(spans: DataFrame, least: int, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Rows with start_line and content, cut where they are too long and without parts of fewer than `least` characters,
    and end_line of each part. Packing is sequential within a text, so rows go through Arrow batches."""
    schema = spans.drop("end_line").schema.add("end_line", IntegerType())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, bodies = batch.column(batch.schema.get_field_index("start_line")).to_pylist(), batch.column(batch.schema.get_field_index("content")).to_pylist()
            cut = [(i, *part) for i, (at, body) in enumerate(zip(starts, bodies, strict=True)) for part in pack_lines(body or "", at, MOST, target, overlap) if len(part[2]) >= least]
            columns = {"start_line": pa.array([c[1] for c in cut], pa.int32()), "end_line": pa.array([c[2] for c in cut], pa.int32()), "content": pa.array([c[3] for c in cut], pa.string())}
            rows = pa.array([c[0] for c in cut], pa.int64())
            yield pa.RecordBatch.from_pydict({n: columns[n] if n in columns else batch.column(batch.schema.get_field_index(n)).take(rows) for n in schema.names})

    return spans.drop("end_line").mapInArrow(split, schema)


def _cut_out(resources: DataFrame, spans: DataFrame, key: str = "uri", text: str = "content") -> DataFrame:
    """spans (key, start_line, end_line, ..) with content: those lines of their resource, a row of which meets all its spans at once."""
    rows = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n", -1)
    others = [c for c in spans.columns if c != key]
    grouped = spans.groupBy(key).agg(F.collect_list(F.struct(*others)).alias("_spans"))
    held = by_key(resources.select(key, rows.alias("_rows"))).join(grouped, key)
    said = F.transform("_spans", lambda x: F.struct(*(x[c].alias(c) for c in others), F.array_join(F.slice("_rows", x["start_line"], x["end_line"] - x["start_line"] + 1), "\n").alias("content")))
    return held.select(key, F.explode(said).alias("_s")).select(key, *(f"_s.{c}" for c in others), "_s.content")


def code_chunks(resources: DataFrame, declared: DataFrame) -> DataFrame:
    """(uri, start_line, end_line, context_path, content) of code files (uri, content): their declarations (uri,
    start_line, end_line, context), and what lies between those that are kept; nothing shorter than LEAST."""
    kept = _cut_out(resources, declared.select("uri", "start_line", "end_line", F.col("context").alias("context_path"))).filter(F.length("content") >= LEAST)
    kept = cut(kept)  # read for itself and for what lies between
    sizes = resources.select("uri", F.size(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)).alias("n"))
    between = gaps(kept.select("uri", F.col("start_line").alias("start"), F.col("end_line").alias("end")), sizes, "uri")
    rest = _cut_out(resources, between.select("uri", F.col("start").cast("int").alias("start_line"), F.col("end").cast("int").alias("end_line"), F.lit("<module>").alias("context_path")))
    rest = rest.withColumn("content", F.regexp_replace("content", r"\A\s+|\s+\z", "")).filter(F.length("content") >= LEAST)
    whole = cut(kept.unionByName(rest))
    fits = F.length("content") <= MOST
    return whole.filter(fits).unionByName(split_spans(whole.filter(~fits), 0))


def markdown_chunks(resources: DataFrame, headings: DataFrame) -> DataFrame:
    """(uri, start_line, end_line, context_path, content) of markdown files (uri, content): a chunk for each heading (uri,
    at, level, title) with the titles above it as its path, and one for what stands before the first."""
    each = lines(resources)
    titled = sections(headings, "uri").select("uri", F.col("at").alias("line_no"), "path")
    here = Window.partitionBy("uri").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = each.join(by_key(titled), ["uri", "line_no"], "left").withColumn("start_line", F.coalesce(F.max(F.when(F.col("path").isNotNull(), F.col("line_no"))).over(here), F.lit(1)))
    whole = rows.groupBy("uri", "start_line").agg(
        F.max("line_no").alias("end_line"), F.max("path").alias("context_path"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    text = F.regexp_replace(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), r"\A\s+|\s+\z", "")
    whole = whole.select("uri", "start_line", "end_line", "context_path", text.alias("content")).filter(F.length("content") >= LEAST_SECTION)
    fits = F.length("content") <= MOST
    return whole.filter(fits).unionByName(split_spans(whole.filter(~fits), 0))


def split_oversized(resources: DataFrame, key: str = "uri", text: str = "content", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(key, start_line, content, end_line) of plain texts: whole up to MOST characters, else in overlapping runs of lines."""
    normal = F.regexp_replace(F.col(text).cast("string"), "\r\n?", "\n")
    return split_spans(resources.select(key, F.lit(1).alias("start_line"), normal.alias("content")), least, target, overlap)
