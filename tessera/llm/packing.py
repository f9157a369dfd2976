"""Best-fit packing of documents into fixed-length sequences, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import stage
from tessera.llm.textbytes import ALNUM, mix, slices

CAPACITY = 2048  # words of a bin
PIECES = 2048  # documents' pieces that one task packs together, on average
EQUAL = 4096  # equal rows that are numbered together


class Bins:
    """Open bins ordered by residual room. Each carries bitmaps of its sources and of its duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[tuple[int, int]] = []  # (residual, bin), in order
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset): the tightest bin with room for size whose bitmaps have neither bit; else a new one."""
        at = bisect_left(self.rooms, (size, -1))
        while at < len(self.rooms):
            residual, k = self.rooms[at]
            if not self.sources[k] & source and not self.clusters[k] & cluster:
                del self.rooms[at]
                break
            at += 1  # the successor: the next larger residual
        else:
            residual, k = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[k] |= source
        self.clusters[k] |= cluster
        if residual > size:
            insort(self.rooms, (residual - size, k))
        return k, self.capacity - residual


def best_fit(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack pieces (row_id, part, size, source, cluster), the largest first."""
    pieces = pieces.sort_values(["size", "row_id", "part"], ascending=[False, True, True])
    bits = [{v: 1 << k for k, v in enumerate(pieces[c].unique())} for c in ("source", "cluster")]
    bins = Bins(capacity)
    placed = [bins.put(n, bits[0][s], bits[1][c]) for n, s, c in zip(pieces["size"].tolist(), pieces["source"], pieces["cluster"], strict=True)]
    return pieces.assign(bin=[k for k, _ in placed], offset=[o for _, o in placed])


def pack(docs: DataFrame, capacity: int = CAPACITY, pieces_a_task: int = PIECES, cluster: str | None = None) -> DataFrame:
    """doc_id, part, first_word, n_words, bin_id, offset: where each piece of each row's text goes.

    A text of more than `capacity` words is cut into full bins and a rest; a full piece has a bin alone. Two pieces
    in one bin never have the same source nor the same duplicate cluster: that of the column `cluster`, such as the
    component_id of near copies, or else texts with equal words in lower case. A null source or cluster conflicts with
    null ones as any other does. Null texts and texts without words take no room: they give one row without bin_id.
    Rows with equal doc_ids are packed as separate documents.

    Documents are dealt to shards by a hash of what they are, equal ones by their number, as many as keep a shard
    near `pieces_a_task` rests however large or skewed the input is, and each shard is packed by itself: a hot source
    is spread over all of them, and the bins don't depend on how the input is partitioned. What that costs is less
    than one open bin a source and shard.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words = texts.words(ALNUM)
                total = words.hashes()
                sums = [0, *(total * mix(total + 1)).cumsum().tolist()]
                digest = [(sums[b] - sums[a]) % (1 << 64) - (1 << 63) for a, b in zip(words.of[:-1].tolist(), words.of[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(words.counts()), pa.array(digest, pa.int64())], ["doc_id", "source", "known", "n", "digest"])

    known = F.lit(None) if cluster is None else F.coalesce(F.xxhash64(F.col(cluster)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), known.cast("long").alias("known"), F.col("text").cast("string").alias("text"))
    measured = rows.mapInArrow(measure, "doc_id long, source string, known long, n long, digest long")
    # rows that are equal in all this are told apart by a number, in runs of EQUAL so that a third of all rows may be equal
    sizes = measured.groupBy("doc_id", "source", "known", "n", "digest").agg(F.count("*").alias("equal"))
    runs = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(equal - 1) div {EQUAL}"))).alias("run")).repartition("doc_id", "digest", "run")
    number = F.explode(F.sequence(F.col("run") * EQUAL, F.least((F.col("run") + 1) * EQUAL, F.col("equal")) - 1))
    sizes = stage(runs.select("doc_id", "source", F.coalesce("known", "digest").alias("cluster"), "n", number.alias("copy"))
                  .withColumn("row_id", F.xxhash64("doc_id", "source", "cluster", "n", "copy")), "sizes")
    full = F.floor(F.col("n") / capacity).cast("long")
    shards = max(1, -(-sizes.filter(F.col("n") % capacity > 0).count() // pieces_a_task))
    shard = F.pmod(F.col("row_id"), F.lit(shards))
    place = F.concat_ws("-", shard, F.lit("full"), F.hex("row_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy", "part")
    wholes = sizes.filter(full > 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), full - 1))).select(
        "doc_id", "part", (F.col("part") * capacity).alias("first_word"), F.lit(capacity).cast("long").alias("n_words"), place.alias("bin_id"), F.lit(0).cast("long").alias("offset"))
    rests = sizes.withColumn("size", F.col("n") % capacity).filter("size > 0")
    rests = rests.select("doc_id", "row_id", full.alias("part"), "size", F.coalesce("source", F.lit("\0")).alias("source"), "cluster", shard.alias("shard"))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        out = best_fit(shard, capacity)
        out["bin_id"] = out["shard"].astype(str) + "-" + out["bin"].astype(str)
        out["first_word"] = out["part"] * capacity
        return out[["doc_id", "part", "first_word", "size", "bin_id", "offset"]].rename(columns={"size": "n_words"}).astype({"doc_id": "Int64"})

    columns = "doc_id long, part long, first_word long, n_words long, bin_id string, offset long"
    none = sizes.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_words"),
                                        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("offset"))
    return wholes.union(rests.groupBy("shard").applyInPandas(packed, columns)).union(none)
