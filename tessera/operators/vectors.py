"""A vector index: rows in cells around centroids, kept as residual codes, searched in the nearest cells and ranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.operators.retrieval import top

SAMPLE = 65_536  # rows on which centroids are fitted, whatever the table holds
BLOCK = 2048  # rows of a cell, and queries of one, that one task multiplies at once
CODES = "cell int, vec_id long, scale float, code binary"


class Index(NamedTuple):
    """centroids: (cells, dimension), unit length; rows: cell, vec_id, scale, code, every row of the table in one cell."""
    centroids: np.ndarray
    rows: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The rows of a list column as a matrix; null rows, and those of another dimension, are zero."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dimension))
    right = sizes == dimension
    if right.any():
        out[right] = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.nan_to_num(out)


def fit(vectors: DataFrame, cells: int, rounds: int = 12, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of `cells` groups of at most `sample` rows (the first by a hash of vec_id), by spherical k-means."""
    held = vectors.filter("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    dimension = int(pc.max(pc.list_value_length(held)).as_py() or 1) if len(held) else 1
    x = _unit(_matrix(held, dimension))
    if not len(x):
        return np.zeros((1, dimension))
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        full = np.bincount(nearest, minlength=len(centres)) > 0
        centres = np.where(full[:, None], _unit(sums), centres)
    return centres


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of vectors (vec_id, embedding): each row goes to its nearest centroid, and what it differs from it is kept
    in a byte a place. Without cells there are about as many as the root of the number of rows, at most 4,096."""
    if cells is None:
        cells = int(min(4096, max(1, round(vectors.count() ** 0.5))))
    centroids = fit(vectors, cells, sample=sample)
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most 4,096 rows

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            x = _unit(_matrix(batch.column(1), centres.shape[1]))
            cell = np.argmax(x @ centres.T, axis=1)
            rest = x - centres[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "vec_id", "scale", "code"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(code, CODES)
    return Index(centroids, cut(rows))


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 8, wide: int = 4) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest rows by cosine that lie in the `probes` cells nearest to each query.

    queries: (query_id long, embedding). In a cell all its queries meet all its rows, both in blocks of BLOCK, so a large
    cell is the work of many tasks; scores of codes leave wide * k rows a query, which are compared exactly with their
    own vectors. With as many probes as cells only the codes can lose a row.
    """
    sent, dimension = queries.sparkSession.sparkContext.broadcast(index.centroids), index.centroids.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            q = _unit(_matrix(batch.column(1), centres.shape[1]))
            most = min(probes, len(centres))
            cells = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :most]
            rows = np.repeat(np.arange(len(q)), most)
            wanted = pa.array([x.astype(np.float32).tobytes() for x in q], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(rows)), wanted.take(pa.array(rows))], ["cell", "query_id", "wanted"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(near, "cell int, query_id long, wanted binary")
    sizes = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK)).alias("block")
    held = index.rows.join(sizes, "cell").groupBy("cell", block).agg(F.collect_list(F.struct("vec_id", "scale", "code")).alias("held"))
    counted = asked.groupBy("cell").agg(F.count("*").alias("m"))
    part = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("m") / BLOCK)).alias("part")
    wanted = asked.join(counted, "cell").groupBy("cell", part).agg(F.collect_list(F.struct("query_id", "wanted")).alias("asked"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            for cell, some, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                asked_, held_ = some.values, rows.values
                q = np.stack([np.frombuffer(x, np.float32) for x in asked_.field(1).to_pylist()])
                codes = np.stack([np.frombuffer(x, np.int8) for x in held_.field(2).to_pylist()]).astype(np.float32)
                scores = (q @ centres[cell].astype(np.float32))[:, None] + (q @ codes.T) * held_.field(1).to_numpy(zero_copy_only=False)[None]
                ids = held_.field(0).to_numpy(zero_copy_only=False)
                for i, name in enumerate(asked_.field(0).to_pylist()):
                    best = np.lexsort((ids, -scores[i]))[:wide * k]
                    yield pa.RecordBatch.from_pydict({"query_id": [name] * len(best), "vec_id": ids[best], "near": scores[i][best].astype(np.float64)})

    found = wanted.join(held, "cell").select("cell", "asked", "held").mapInArrow(multiply, "query_id long, vec_id long, near double")
    short = top(found, ["query_id"], [F.desc("near"), F.col("vec_id")], wide * k, "_r").select("query_id", "vec_id")
    both = short.join(vectors.select("vec_id", F.col("embedding").alias("v")), "vec_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(c), dimension) for c in (2, 3))
            score = (a * b).sum(axis=1) / np.maximum(np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)), 1e-30)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 6))], ["query_id", "vec_id", "score"])

    scored = both.select("query_id", "vec_id", "v", "q").mapInArrow(exact, "query_id long, vec_id long, score double")
    return top(scored, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
