"""A training-corpus pipeline: each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from tessera.llm.storage import stage, with_key, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row_id"]  # decisions are about rows, since several may have a doc_id or none
SHINGLE, PERCENT = 5, 80  # of the near-duplicate stage; the query op7 has its own


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text the models call toxic. Null and empty texts are scored as texts without words;
    rows with one text go or stay together."""
    return toxicity.clean_documents(with_key(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with repeated lines and passages cut from text and n_chars counted anew where something was. Null texts
    stay null; a text of which all is cut becomes empty, and its row stays."""
    found = line_dedup.dedup_lines(with_key(docs))
    return found.withColumn("n_chars", F.when(F.col("n_removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that of the least doc_id, null being the last. Null, empty and blank
    texts are near nothing, so their rows stay."""
    return jaccard_join.one_of_each(with_key(docs), SHINGLE, PERCENT).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows at least one in twenty of whose words lies in a window of a benchmark item. Null and empty
    texts stay, and so do all rows where the benchmark is empty."""
    docs = with_key(docs)
    found = decontamination.decontaminate(docs.select(F.col("row_id").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter("contaminated").select(F.col("doc_id").alias("row_id")), "row_id").select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in bins, as packing.pack tells; rows without words have one piece without a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


ORACLE_SQL = None  # no stage but packing's sizes can be told in SQL; tests compare the stages with brute force
