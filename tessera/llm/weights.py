"""Sums over the names that rows hold, of values from a table that may be larger than what tasks can be sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, small_batches, stage
from tessera.llm.textbytes import signed

SENT = 1 << 20  # how many of the most frequent entries are sent to all tasks; rows are joined with the others


class Held(NamedTuple):
    """The names that the rows of a batch hold: the row of each within the batch, the name, and how often it stands there."""
    row: np.ndarray
    name: np.ndarray
    times: np.ndarray


def _least_sent(entries: DataFrame, most: int) -> int:
    """The least n so that no more than `most` entries have it or more, in steps of an eighth of a doubling."""
    sizes = entries.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()  # at most 8 * 63 rows
    least, seen = 1 << 62, 0
    for step, count in sizes:
        if (seen := seen + count) > most:
            break
        least = int(np.ceil(2 ** (step / 8)))
    return least


def grouped(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of times of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times[order], first) if len(key) else times[:0]


def weigh(rows: DataFrame, held: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, Held]]], kept: str, entries: DataFrame, width: int, most: int = SENT) -> DataFrame:
    """The columns `kept` that held() gives for each row, and sums: for each of width values the sum, over the names the
    row holds, of times * weight.

    entries are (name long, n long, weight array<double>), one for each name that stands in any row; n >= 1 is how often
    it does. The most frequent are sent to the tasks, at most `most` of them; names that aren't among these go to the
    other entries by a join on the name, none of which is then a frequent one, and their sums come back to the row.
    How many are sent changes no sum. Rows that hold no name have sums of 0.
    """
    least = _least_sent(entries, most)
    found = entries.filter(F.col("n") >= least).select("name", *(F.col("weight")[k].alias(f"w{k}") for k in range(width))).toArrow()
    names = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(names)
    weights = [found.column(k + 1).to_numpy()[order] for k in range(width)]
    sent = rows.sparkSession.sparkContext.broadcast((names[order], weights))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = sent.value
        number = TaskContext.get().partitionId() << 40  # rows are numbered for the joined sums to come back to them
        for batch in batches:
            for part, (row, name, times) in held(batch):
                n = part.num_rows
                distinct, back = np.unique(name, return_inverse=True)
                at = np.minimum(np.searchsorted(names, distinct), max(len(names) - 1, 0))
                there = names[at] == distinct if len(names) else np.zeros(len(distinct), bool)
                sums = np.zeros((n, width))
                for k in range(width if there.any() else 0):
                    sums[:, k] = np.bincount(row, np.where(there, weights[k][at], 0)[back] * times, n)
                other = ~there[back]
                key, many = grouped(row[other].astype(np.int64) << 32 | back[other], times[other])
                lists = pa.array(np.searchsorted(key >> 32, np.arange(n + 1)).astype(np.int32))
                columns = [pa.array(np.arange(number, number + n)), *part.columns, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(sums.ravel())),
                           pa.ListArray.from_arrays(lists, signed(distinct[key & 0xFFFFFFFF])), pa.ListArray.from_arrays(lists, pa.array(many.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["row", *part.schema.names, "sums", "names", "times"])
                number += n

    with small_batches(rows.sparkSession):
        looked = stage(rows.mapInArrow(look, f"row long, {kept}, sums array<double>, names array<long>, times array<long>"), "looked-up")
    others = entries.filter(F.col("n") < least).select("name", "weight")
    asked = looked.select("row", F.explode(F.arrays_zip("names", "times")).alias("x")).select("row", F.col("x.names").alias("name"), F.col("x.times").alias("times"))
    joined = asked.join(others, "name").groupBy("row").agg(*(F.sum(F.col("times") * F.col("weight")[k]).alias(f"j{k}") for k in range(width)))
    both = looked.drop("names", "times").join(joined, "row", "left")
    total = F.array(*(F.col("sums")[k] + F.coalesce(f"j{k}", F.lit(0.0)) for k in range(width)))
    out = stage(both.select(*(c for c in looked.columns if c not in ("row", "sums", "names", "times")), total.alias("sums")), "weighed")
    discard(looked)
    return out
