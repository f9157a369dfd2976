"""Intermediate tables and bounded bitmaps shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset, and gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)  # a path without a scheme is one of the default file system
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


ROWS = 250_000  # of narrow tables, that one file holds


def files_for(rows: int) -> int:
    """How many files a narrow table of so many rows is worth: what follows has a task for each."""
    return max(1, -(-rows // ROWS))


def stage(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage at a copy that outlives executors.

    With files, so many tasks write it, where its size is known to be worth no more than that.
    """
    path = new_dir(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame, collect: bool = True) -> None:
    """Remove the files of staged tables that nothing reads any more: all that came of them is written elsewhere.

    With collect, the driver's JVM is asked to collect its garbage, as Spark removes the shuffle files of a finished query
    only then; loops over small tables leave that to what follows them.
    """
    for df in staged:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if collect:
        staged[0].sparkSession._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Texts reach Python in batches of so many rows while this holds, so that long ones don't fill its memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bitmap(df: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """A bitmap of 2**bits places that has a one at the low bits of each 64-bit hash.

    Its size is fixed, whatever df holds: 2**bits / 8 bytes reach the driver. A place may stand for several
    hashes, so whoever filters by it must join with the exact hashes afterwards.
    """
    place = hashed.bitwiseAND(F.lit((1 << bits) - 1))
    parts = df.select(place.alias("place")).groupBy(F.expr("place div 32768").alias("part")).agg(
        F.bitmap_construct_agg(F.expr("place % 32768")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.collect():  # at once: an iterator runs a job for each partition
        at = row["part"] * 4096
        out[at:at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def likely(texts: DataFrame, wanted: DataFrame, bits: int = 25) -> DataFrame:
    """The rows of texts (doc_id, text) that may be among wanted (doc_id), by a bitmap of fixed size.

    It spares a join on doc_id the shuffle of most texts while few are wanted; the join itself decides.
    """
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, F.col("doc_id"), bits))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(in_bitmap(sent.value, ids)))

    return texts.select("doc_id", "text").mapInArrow(each, "doc_id long, text string")


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    """rows (doc_id, text) in ranges of ascending doc_id and text, sorted within each. Ranges are told by the ids and the first
    characters of texts, so that many rows of one id, or of none, aren't the work of one task."""
    return rows.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 256)).sortWithinPartitions("doc_id", "text")


def with_key(docs: DataFrame, key: str = "row_id") -> DataFrame:
    """docs with a key of its own for each row; where they have one they stay as they are."""
    return docs if key in docs.columns else stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key isn't among ids (key); null is a key like others."""
    gone = ids.select(F.col(key).alias("gone_id")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["gone_id"]), "left_anti")
