"""Language identification by partial matching: code lengths of texts under byte context trees of each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, small_batches, stage
from tessera.llm.textbytes import Texts, signed, slices
from tessera.llm.toxicity import fold
from tessera.llm.weights import SENT, Held, grouped, weigh

ORDER = 4  # bytes of the longest context
COMBINED = 1 << 20  # distinct grams that a task counts together before the shuffle
STEPS = 1 << 16  # code lengths are told in 1 / STEPS bits, so that sums of them are exact in any order
UNKNOWN = "und"


def grams(texts: Texts) -> np.ndarray:
    """For each byte the name of it and the ORDER bytes before it; before the start of a text stands 255, which is no byte of UTF-8."""
    n = len(texts.bytes)
    place = np.arange(n) - np.repeat(texts.offsets[:-1], np.diff(texts.offsets))
    padded = np.concatenate([np.full(ORDER, 255, np.uint8), texts.bytes])
    name = np.zeros(n, np.uint64)
    for back in range(ORDER, -1, -1):
        name = name << np.uint64(8) | np.where(place >= back, padded[ORDER - back:ORDER - back + n], 255).astype(np.uint64)
    return name


def _counted(rows: DataFrame, kinds: int) -> DataFrame:
    """gram, n, c0, c1, ..: how often each stands in rows (kind, text), and in those of each kind; kind is null where nothing is learned."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def combined() -> tuple[np.ndarray, np.ndarray]:
            return grouped(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

        def rows_of(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([signed(key >> np.uint64(16)), pa.array((key & np.uint64(0xFFFF)).astype(np.int32)), pa.array(n)], ["gram", "kind", "n"])

        for batch in batches:
            for part, texts in slices(batch):
                kind = part.column(0).fill_null(kinds).to_numpy(zero_copy_only=False).astype(np.uint64)
                waiting.append(np.unique(grams(texts) << np.uint64(16) | np.repeat(kind, np.diff(texts.offsets)), return_counts=True))
                if sum(len(x) for x, _ in waiting) > 4 * COMBINED:
                    waiting = [combined()]
                    if len(waiting[0][0]) > COMBINED:
                        yield rows_of(*waiting.pop())
        if waiting:
            yield rows_of(*combined())

    # tasks have combined their own counts, so no gram has many rows
    with small_batches(rows.sparkSession):
        found = rows.mapInArrow(count, "gram long, kind int, n long").repartition("gram")
        of_kind = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(kinds)]
        return stage(found.groupBy("gram").agg(F.sum("n").alias("n"), *of_kind), "grams")


def _code_lengths(counted: DataFrame, kinds: int) -> DataFrame:
    """name, n, weight: the bits that each kind's tree takes for the last byte of each gram after the bytes before it.

    A context that a kind has seen T times, followed by D different bytes, gives a byte seen c times after it
    c / (T + D), and D / (T + D) to the escape to the context that is one byte shorter. Contexts that a kind never saw
    are passed by without cost; below the empty context all 256 bytes are alike. Bytes that a longer context has ruled
    out keep their share in the shorter ones (no exclusion).
    """
    levels = [counted.select(F.col("gram").alias("name"), "n", *(f"c{k}" for k in range(kinds)))]
    for order in range(ORDER - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("name").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("name"))
        levels.append(stage(shorter.agg(F.sum("n").alias("n"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(kinds))), "grams"))
    lower, old = None, None
    for order, level in enumerate(reversed(levels)):
        context = F.expr("name div 256").alias("context")
        seen = level.groupBy(context).agg(*(F.sum(f"c{k}").alias(f"t{k}") for k in range(kinds)), *(F.count_if(F.col(f"c{k}") > 0).alias(f"d{k}") for k in range(kinds)))
        both = level.withColumn("context", context).join(seen, "context")
        if lower is None:
            both = both.withColumn("below", F.array(*[F.lit(8.0)] * kinds))
        else:
            below = lower.select(F.col("name").alias("shorter"), F.col("weight").alias("below"))
            both = both.join(below, F.col("name").bitwiseAND(F.lit((1 << 8 * order) - 1)) == F.col("shorter"))

        def bits(k: int) -> Column:
            whole, fewer = F.col(f"t{k}") + F.col(f"d{k}"), F.col("below")[k]
            coded = F.when(F.col(f"t{k}") == 0, fewer).when(F.col(f"c{k}") > 0, F.log2(whole / F.col(f"c{k}"))).otherwise(F.log2(whole / F.col(f"d{k}")) + fewer)
            return F.round(coded * STEPS) / STEPS

        old, lower = lower, stage(both.select("name", "n", F.array(*(bits(k) for k in range(kinds))).alias("weight")), "code-lengths")
        if old is not None:
            discard(old)
    discard(*levels[1:])
    return lower


def _held(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Held]]:
    for part, texts in slices(batch):
        name = grams(texts)
        yield part.select(["doc_id", "lettered"]), Held(np.repeat(np.arange(texts.n), np.diff(texts.offsets)), name, np.ones(len(name), np.int64))


def languages(docs: DataFrame, held_out: int = 2, sent: int = SENT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for each row of docs (doc_id, text, lang).

    Trees of bytes are counted over all rows that have a lang and aren't in fold held_out (crc32 of the doc_id as text,
    mod 4; a null doc_id is in no fold and is learned). The tree that codes the whole text in the fewest bits names
    its language, of equal ones the first by name; score is the share of 2^-bits that it has among all trees, and
    bits maps each language to its code length. A text that is null or has no letter is `und`, with score 0, and so is
    every row where no language was learned. Rows that share a doc_id are judged each by its text; other columns are
    ignored. The languages are the classes, of which there are few; grams are never gathered but the most frequent.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang"))
    out_of = F.coalesce(fold(F.col("doc_id")) == held_out, F.lit(False))
    learned = rows.filter("text is not null and lang is not null").filter(~out_of)
    names = sorted(r[0] for r in learned.select("lang").distinct().collect())
    if not names:
        return rows.select("doc_id", out_of.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,double>").alias("bits"))
    kind = F.when(~out_of, F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).cast("int")
    counted = _counted(rows.select(kind.alias("kind"), "text"), len(names))
    entries = _code_lengths(counted, len(names))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    summed = weigh(rows.select("doc_id", lettered.alias("lettered"), "text"), _held, "doc_id long, lettered boolean", entries, len(names), sent)
    discard(counted, entries)
    best = F.array_min("sums")
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda total, x: total + F.pow(F.lit(2.0), best - x))
    pred = F.element_at(F.array(*map(F.lit, names)), F.array_position("sums", best).cast("int"))
    return summed.select("doc_id", out_of.alias("held_out"), F.when(F.col("lettered"), pred).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("lettered"), share).otherwise(0.0).alias("score"),
                         F.map_from_arrays(F.array(*map(F.lit, names)), "sums").alias("bits"))
