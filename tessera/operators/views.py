"""Sessions, histories, summaries and checks of documents that cite evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session_text(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, transcript): a session's turns in order, as lines "role: text"."""
    said = F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))
    whole = turns.groupBy(key).agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(said)).alias("said"))
    return whole.select(key, "n_turns", F.array_join(F.transform("said", lambda s: s["line"]), "\n").alias("transcript"))


def recent(turns: DataFrame, most: int = 8, key: str = "conv_id") -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn"), F.desc("text")))
    return turns.withColumn("_r", newest).filter(F.col("_r") <= most).drop("_r")


def first_per_file(evidence: DataFrame, limit: int) -> DataFrame:
    """(query_id, file, chunk_id, score, slot): the best chunk of each file first, then the rest by score."""
    in_file = F.row_number().over(Window.partitionBy("query_id", "file").orderBy(F.desc("score"), "chunk_id"))
    slot = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_f") > 1, F.desc("score"), "chunk_id"))
    return evidence.withColumn("_f", in_file).withColumn("slot", slot).filter(F.col("slot") <= limit).drop("_f")


def elapsed(events: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """events with elapsed: seconds since the key's event before, null for the first."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("elapsed", (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1e6)


def label_summary(nodes: DataFrame, key: str, names: int = 24) -> DataFrame:
    """(key, label, n, some_names): counts of labels, with the first names in alphabetic order."""
    ranked = nodes.withColumn("_r", F.row_number().over(Window.partitionBy(key, "label").orderBy("name")))
    return ranked.groupBy(key, "label").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= names, F.struct("_r", "name")))), lambda x: x["name"]), ", ").alias("some_names"))


def citations(documents: DataFrame, key: str = "name", text: str = "body") -> DataFrame:
    """(key, file, line) of each distinct [file: path:line] in a document."""
    found = documents.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\[file:\s*([^\]\s:]+:\d+)\]"), F.lit(1))).alias("c")).distinct()
    return found.select(key, F.regexp_extract("c", r"^(.*):\d+$", 1).alias("file"), F.regexp_extract("c", r":(\d+)$", 1).cast("int").alias("line"))


def fabricated(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (file, line) that no evidence (file, start_line, end_line) covers."""
    spans = evidence.select(F.col("file").alias("_f"), "start_line", "end_line").distinct()
    return cited.join(spans, (cited["file"] == spans["_f"]) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_anti")
