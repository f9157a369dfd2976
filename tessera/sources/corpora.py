"""Resources of a corpus as rows: files, issues, pages, golden questions and skill documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import matches_any

LARGEST = 1_000_000  # bytes of a file
EXCLUDED = ["**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/.venv/**", "**/*.lock", "**/*.min.js"]
CODE = "py pyi js jsx ts tsx go rs java kt c h cc cpp hpp cs rb php swift scala sh sql".split()


def local_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, largest: int = LARGEST, prefix: str = "") -> DataFrame:
    """(uri, size_bytes, last_modified, kind, content) of the UTF-8 files below root; excluding globs go first.

    Size and time are tested before a file's bytes are decoded. Bytes that aren't UTF-8 leave a null content: such a
    file exists, but can't be read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = re.sub("^[a-z0-9]+:/+", "/", path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= largest)
    at = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    rows = files.withColumn("uri", F.substring(at, F.lit(len(base) + 1), F.length(at))).filter(~matches_any(F.col("uri"), EXCLUDED if exclude is None else exclude))
    rows = rows.filter(matches_any(F.col("uri"), include)) if include else rows
    text = F.try_validate_utf8(F.col("content").cast("string"))
    kind = F.when(F.lower(F.regexp_extract("uri", r"\.([^./]+)$", 1)).isin(CODE), "code").otherwise("doc")
    return rows.select(F.concat(F.lit(prefix), "uri").alias("uri"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), kind.alias("kind"), text.alias("content"))


def all_of(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from JSON lines; blank lines and lines that start with # are left out."""
    schema = "id string, query string, expected_files array<string>, expected_answer string, category string, complexity string"
    lines = spark.read.text(path).filter(F.trim("value") != "").filter(~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _adf(value: Column) -> Column:
    """The text of a rich-text document: its text nodes in order, a line each; plain strings stay."""
    return F.when(value.rlike(r"^\s*\{"), F.array_join(F.transform(
        F.regexp_extract_all(value, F.lit(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda x: F.get_json_object(F.concat(F.lit('{"t":"'), x, F.lit('"}')), "$.t")), "\n")).otherwise(value)


def issues(raw: DataFrame, site: str) -> DataFrame:
    """(uri, content) of tracker issues (value: one JSON object a row)."""
    form = "key string, fields struct<summary string, description string, status struct<name string>, issuetype struct<name string>, labels array<string>, parent struct<key string>, assignee struct<displayName string>>"
    j = raw.select(F.from_json("value", form).alias("j")).filter("j.key is not null").select("j.*")
    meta = F.to_json(F.struct(F.col("key"), F.col("fields.issuetype.name").alias("type"), F.col("fields.status.name").alias("status"), F.array_sort("fields.labels").alias("labels"), F.col("fields.parent.key").alias("parent")))
    text = F.concat_ws("\n\n", meta, F.concat_ws(" ", F.lit("#"), "key", "fields.summary"), _adf(F.col("fields.description")))
    return j.select(F.concat(F.lit(site.rstrip("/") + "/browse/"), "key").alias("uri"), text.alias("content"))


def wiki_pages(raw: DataFrame, site: str) -> DataFrame:
    """(uri, content) of wiki pages (value: one JSON object a row), with markup taken out of the body."""
    form = "id string, title string, spaceId string, body struct<storage struct<value string>>"
    j = raw.select(F.from_json("value", form).alias("j")).filter("j.id is not null").select("j.*")
    plain = F.regexp_replace(F.regexp_replace(F.col("body.storage.value"), r"(?i)<(?:br|/p|/h[1-6]|/li|/tr)[^>]*>", "\n"), r"<[^>]+>", "")
    plain = F.replace(F.replace(F.replace(plain, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return j.select(F.concat(F.lit(site.rstrip("/") + "/wiki/"), "id").alias("uri"), F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), _stripped(plain)).alias("content"))


def skills(spark: SparkSession, path: str) -> DataFrame:
    """(uri, name, description, product, tier, confidence, globs, body) of documents with a header between --- lines.

    Scalars and lists in brackets or with dashes are read; documents without a name are left out.
    """
    files = spark.read.text(path, wholetext=True).withColumn("uri", F.col("_metadata.file_path"))
    head = files.withColumn("head", F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)).withColumn("body", _stripped(F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")))

    def field(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.regexp_extract("head", rf"(?m)^\s*{name}:[ \t]*(.*)$", 1), r"""^['"]|['"]$""", "")), F.lit(""))

    def listed(name: str) -> Column:
        inline = F.split(F.regexp_replace(field(name), r"""[\[\]'"]""", ""), r"\s*,\s*")
        dashed = F.regexp_extract_all(F.regexp_extract("head", rf"(?m)^\s*{name}:[ \t]*\n((?:\s*-[^\n]*\n?)+)", 1), F.lit(r"""-\s*['"]?([^'"\n]+)"""), F.lit(1))
        return F.when(field(name).isNotNull(), F.filter(inline, lambda x: x != "")).otherwise(F.transform(dashed, F.trim))

    rows = head.select("uri", field("name").alias("name"), field("description").alias("description"), field("product").alias("product"), field("tier").alias("tier"),
                       F.col("head"), "body", listed("files").alias("globs"), F.expr("try_cast(nullif(regexp_extract(head, '(?m)^\\\\s*confidence:\\\\s*([0-9.]+)', 1), '') as double)").alias("confidence"))
    return rows.filter("name is not null").drop("head")


def snapshot(df: DataFrame, path: str, version: int) -> str:
    """Write a state as a new version beside the old ones, which readers keep using until they are told of it."""
    target = f"{path.rstrip('/')}/v={version:010d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The complete version with the greatest number; one that was cut off in writing has no _SUCCESS file and doesn't count."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in files.listStatus(where) if s.getPath().getName().startswith("v=") and files.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(done, key=lambda p: p.getName()).toString())
