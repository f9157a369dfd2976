"""Benchmark decontamination: a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import bitmap, in_bitmap, stage
from tessera.llm.textbytes import ALNUM, LOWER, Texts, Words, signed, slices

WINDOW = 13
SHINGLE = 5
FILTER_BITS = 23  # the bitmaps sent to tasks hold 1 MB each, whatever the benchmark's size


def _lower_words(texts: Texts, words: Words, first: int, last: int) -> str:
    at = [LOWER[texts.bytes[a:b]].tobytes() for a, b in zip(words.starts[first:last], words.ends[first:last], strict=True)]
    return b" ".join(at).decode("utf-8")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """One row per distinct window of an item: item_id, n_window, words (joined by spaces), shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                words = texts.words(ALNUM)
                hashes, counts = words.hashes(), words.counts()
                by_size = {}
                rows = {"item_id": [], "n_window": [], "words": [], "shingles": []}
                for i, item in enumerate(part.column(0).to_pylist()):
                    n = min(window, int(counts[i]))
                    if not n:
                        continue
                    size = min(SHINGLE, n)
                    if size not in by_size:
                        got, first = words.shingles(hashes, size)
                        by_size[size] = dict(zip(first.tolist(), got.view(np.int64).tolist(), strict=True))
                    for at in range(int(words.of[i]), int(words.of[i + 1]) - n + 1):
                        rows["item_id"].append(item)
                        rows["n_window"].append(n)
                        rows["words"].append(_lower_words(texts, words, at, at + n))
                        rows["shingles"].append([by_size[size][k] for k in range(at, at + n - size + 1)])
                yield pa.RecordBatch.from_pydict(rows, pa.schema([
                    ("item_id", pa.int64()), ("n_window", pa.int32()), ("words", pa.string()), ("shingles", pa.list_(pa.int64()))]))

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(cut, "item_id long, n_window int, words string, shingles array<long>").dropDuplicates(["item_id", "words"])


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_words) of each document, and (doc_id, digest, item_id, first, last) of each window found in
    it, where digest tells the texts of one doc_id apart.

    The shingles of a window are ordered by rarity in the documents. A document can hold the whole window only if
    it holds its rarest shingle, so that one shingle is its prefix; documents are joined with windows on it. The
    place of the shingle fixes where the window would stand: it must lie within the document (length and position
    bounds), and then all words of that item-sized window are compared.
    """
    windows = stage(item_windows(benchmark, window), "item-windows")
    tokens = windows.select(F.explode("shingles").alias("token")).distinct()
    sizes = sorted({min(SHINGLE, r[0]) for r in windows.select("n_window").distinct().collect()})  # at most `window` rows
    everything = bitmap(tokens, F.col("token"), FILTER_BITS)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("digest"), text.alias("text"))

    def found(words: Words, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = words.hashes()
        got = [words.shingles(hashes, size) for size in sizes]
        if not got:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        token, first = (np.concatenate(x) for x in zip(*got, strict=True))
        keep = in_bitmap(bits, token)
        return token[keep], first[keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch):
                token, n = np.unique(found(part.words(ALNUM), everything)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(token), pa.array(n)], ["token", "n"])

    rarity = texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    place = F.posexplode("shingles").alias("offset", "token")
    prefixes = stage(
        windows.select("item_id", "n_window", "words", place)
        .join(rarity, "token", "left")
        .groupBy("item_id", "n_window", "words")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"))
        .filter("rarest.n > 0")  # a shingle that no document holds: nor does any hold the window
        .select("item_id", "n_window", "words", "rarest.token", "rarest.offset"), "prefixes")
    rare = bitmap(prefixes, F.col("token"), FILTER_BITS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one for each place in it where a prefix may stand, with the words around."""
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("token", pa.int64()), ("at", pa.int64()), ("from_word", pa.int64()), ("around", pa.string())])
        for batch in batches:
            for part, texts in slices(batch):
                words = texts.words(ALNUM)
                counts = words.counts()
                n = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), n, n, n, pa.nulls(part.num_rows, pa.string())], schema=schema)
                token, first = found(words, rare)
                if not len(token):
                    continue
                text = np.searchsorted(words.of, first, "right") - 1
                low = np.maximum(first - (window - 1), words.of[text])
                high = np.minimum(first + window, words.of[text + 1])
                around = [_lower_words(texts, words, a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                start = words.of[text]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(counts[text]), signed(token), pa.array(first - start), pa.array(low - start), pa.array(around, pa.string())], schema=schema)

    probed = stage(texts.mapInArrow(probe, "doc_id long, digest long, n_words long, token long, at long, from_word long, around string"), "probed")
    start = F.col("at") - F.col("offset")
    hits = (
        probed.filter("token is not null").join(prefixes.withColumnRenamed("words", "wanted"), "token")
        .withColumn("first", start)
        .filter((F.col("first") >= 0) & (F.col("first") + F.col("n_window") <= F.col("n_words")))
        .filter(F.expr("array_join(slice(split(around, ' '), int(first - from_word) + 1, n_window), ' ') = wanted"))
        .select("doc_id", "digest", "item_id", "first", (F.col("first") + F.col("n_window")).alias("last"))
        .distinct()
    )
    return probed.filter("token is null").select("doc_id", "digest", "n_words"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    Null and empty texts have no words and no hits. Items without words have no window. Rows that share a doc_id,
    null included, are judged each by its own text. A document is contaminated when hit words make up at least one in
    `share` of its words. Columns beyond doc_id, text and item_id are ignored.
    """
    sizes, hits = occurrences(docs, benchmark, window)
    spans = hits.select("doc_id", "digest", "first", "last").distinct()
    before = Window.partitionBy("doc_id", "digest").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        spans.withColumn("seen", F.coalesce(F.max("last").over(before), F.lit(0)))
        .groupBy("doc_id", "digest").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", "seen"))).alias("hit"))
    )
    items = hits.groupBy("doc_id", "digest").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return (a["digest"] == b["digest"]) & a["doc_id"].eqNullSafe(b["doc_id"])

    per_doc = covered.join(items, same(covered, items)).select(covered["doc_id"], covered["digest"], "hit", "items")
    joined = sizes.join(per_doc, same(sizes, per_doc), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        sizes["doc_id"], "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.coalesce("items", none)), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
