"""Line dedup: globally repeated content-defined chunks of lines are removed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import bitmap, in_bitmap, stage
from tessera.llm.textbytes import BYTE_VALUE, NOT_SPACE, Texts, mix, signed, slices, span_hashes

WRAP = 4  # a sentence is wrapped into lines after each word whose hash is a multiple of this
LEAST_WORDS = 8  # unrelated texts share shorter sentences by chance; whole lines of the source may be shorter
FILTER_BITS = 25  # 4 MB sent to tasks, whatever the number of repeated chunks


class Chunks(NamedTuple):
    text: np.ndarray  # index of the text
    place: np.ndarray  # 0 for the first chunk of a text
    start: np.ndarray  # byte in the text
    end: np.ndarray  # byte after the last word
    stop: np.ndarray  # byte where the next chunk starts, or the text's length
    lines: np.ndarray
    words: np.ndarray
    hash: np.ndarray
    opens: np.ndarray  # it starts where a line of the source starts
    closes: np.ndarray  # it ends where one ends


_STOP, _QUOTE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[*b".!?"]] = True
_QUOTE[[*b"\"')]"]] = True


def _sentence_ends(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last, before = b[ends - 1], b[np.maximum(ends - 2, starts)]
    return _STOP[last] | _QUOTE[last] & _STOP[before]


def _capitalised(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that start with a capital letter, Latin or Cyrillic, and aren't in capitals."""
    one, two = b[starts], b[np.minimum(starts + 1, ends - 1)]
    ascii_capital = (one >= 65) & (one <= 90) & ((two >= 97) & (two <= 122) | (two >= 128))
    return ascii_capital | (one == 0xC3) & (two >= 0x80) & (two <= 0x9E) | (one == 0xD0) & (two >= 0x90) & (two <= 0xAF)


def chunks(texts: Texts) -> Chunks:
    """Cut each text into chunks of lines at boundaries that depend on the lines around them alone.

    A paragraph often is one line of the source, so sentences are lines too, as is what starts with a capital within
    one (the passage that was set into it); sentences of one word go together, and long ones wrap at words chosen by
    their hashes. A chunk ends with each line of the source and each sentence. Within a long sentence a rolling hash
    covers each line and the one before it, and a chunk of at least two lines ends where it is less than at both
    neighbours. So the same passage is cut alike wherever it stands.
    """
    words = texts.words(NOT_SPACE)
    n = len(words.starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Chunks(none, none, none, none, none, none, none, np.zeros(0, np.uint64), none > 0, none > 0)
    b = texts.bytes
    newlines = np.append(0, np.cumsum(b == 10))
    name = words.hashes(BYTE_VALUE)
    text = words.text_of()
    closes = np.append(text[1:] != text[:-1], True)
    closes[:-1] |= newlines[words.starts[1:]] > newlines[words.ends[:-1]]
    opens = np.append(True, closes[:-1])
    full_stop, capital = _sentence_ends(b, words.starts, words.ends), _capitalised(b, words.starts, words.ends)
    hard = closes.copy()
    hard[:-1] |= full_stop[:-1] & (~full_stop[1:] | (name[:-1] % np.uint64(WRAP) == 0)) | capital[1:]
    line_last = np.flatnonzero(hard | (name % np.uint64(WRAP) == 0))
    line_first = np.append(0, line_last[:-1] + 1)
    rolled = np.append(np.uint64(0), np.cumsum(mix(name + np.uint64(7)) * (name | np.uint64(1))))
    line = mix(rolled[line_last + 1] - rolled[line_first])
    ends = hard[line_last]
    first = np.append(True, ends[:-1])
    before = np.append(np.uint64(0), line[:-1])
    before[first] = 0
    rolling = mix(line * np.uint64(0x9E3779B97F4A7C15) + before)
    inner = ends.copy()
    inner[1:-1] |= (rolling[1:-1] < rolling[:-2]) & (rolling[1:-1] < rolling[2:]) & ~first[1:-1] & ~ends[2:]
    at = np.flatnonzero(inner)
    from_line = np.append(0, at[:-1] + 1)
    from_word, to_word = line_first[from_line], line_last[at]
    owner = text[from_word]
    place = np.arange(len(at)) - np.searchsorted(owner, np.arange(texts.n))[owner]
    start, end = words.starts[from_word], words.ends[to_word]
    stop = np.append(start[1:], len(b))
    stop = np.minimum(stop, texts.offsets[owner + 1])
    base = texts.offsets[owner]
    return Chunks(owner, place, start - base, end - base, stop - base, at - from_line + 1, to_word - from_word + 1, span_hashes(b, start, end), opens[from_word], closes[to_word])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, digest, first, stop, chunks): byte spans to cut from the text with that doc_id and xxhash64.

    The first occurrence of a chunk, by doc_id and then by place, stays; null doc_ids come first. Chunks are known
    to repeat by 64-bit hashes at first, and then by comparing their bytes.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch):
                found = chunks(part)
                hashed, n = np.unique(found.hash[found.lines > 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(hashed), pa.array(n)], ["hash", "n"])

    counts = texts.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(counts.filter("n > 1"), F.col("hash"), FILTER_BITS))

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of several lines whose hash may repeat, and those of one line beside them."""
        for batch in batches:
            for part, text in slices(batch):
                found = chunks(text)
                hit = (found.lines > 1) & in_bitmap(bits.value, found.hash)
                beside = np.zeros(len(hit), bool)
                same = found.text[1:] == found.text[:-1]
                beside[1:] |= hit[:-1] & same
                beside[:-1] |= hit[1:] & same
                keep = np.flatnonzero(hit | beside & (found.lines == 1))
                own = pa.array(found.text[keep])
                base = text.offsets[found.text[keep]]
                at = zip((base + found.start[keep]).tolist(), (base + found.end[keep]).tolist(), strict=True)
                yield pa.RecordBatch.from_pydict({
                    "key": part.column(0).take(own), "digest": part.column(1).take(own), "hash": signed(found.hash[keep]), "place": pa.array(found.place[keep].astype(np.int32)),
                    "first": pa.array(found.start[keep].astype(np.int32)), "stop": pa.array(found.stop[keep].astype(np.int32)), "words": pa.array(found.words[keep].astype(np.int32)),
                    "multi": pa.array(found.lines[keep] > 1), "opens": pa.array(found.opens[keep]), "closes": pa.array(found.closes[keep]),
                    "bytes": pa.array([text.bytes[a:b].tobytes() for a, b in at], pa.binary())})

    shown = stage(texts.mapInArrow(show, "key long, digest long, hash long, place int, first int, stop int, words int, multi boolean, opens boolean, closes boolean, bytes binary"), "chunks")
    here = F.struct("key", "digest", "place")
    told = ["key", "digest", "place", "first", "stop", "words", "multi", "opens", "closes"]
    # all bytes of a hash are compared by way of the least and the greatest; where they differ, chunks are told apart by bytes
    kept = shown.groupBy("hash").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"), F.min(here).alias("kept"), F.count("*").alias("n"))
    kept = stage(kept.filter("n > 1").select("hash", "kept", (F.col("low") == F.col("high")).alias("same")), "first-chunks")
    again = shown.select("hash", *told).join(kept.filter("same").select("hash", "kept"), "hash").filter(here != F.col("kept")).select(*told)
    mixed = kept.filter("not same").select("hash")
    if not mixed.isEmpty():
        apart = shown.join(mixed, "hash")
        firsts = apart.groupBy("hash", "bytes").agg(F.min(here).alias("kept"))
        again = again.union(apart.join(firsts, ["hash", "bytes"]).filter(here != F.col("kept")).select(*told))
    run = F.col("place") - F.row_number().over(Window.partitionBy("key", "digest").orderBy("place"))
    return (
        again.distinct().withColumn("run", run).groupBy("key", "digest", "run")
        .agg(F.min("first").alias("first"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.count("*").alias("chunks"), F.bool_or("multi").alias("multi"),
             (F.min_by("opens", "place") & F.max_by("closes", "place")).alias("whole"))
        .filter(F.col("multi") & (F.col("whole") | (F.col("words") >= LEAST_WORDS))).select("key", "digest", "first", "stop", "chunks")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks of lines cut from text, and n_removed_chunks (long) added.

    A run of repeated chunks goes if one of them has several lines, and it is made of whole lines of the source or has
    LEAST_WORDS words; so a sentence goes whole or stays, but for the wrapped parts of long ones. Null texts stay
    null, texts of which everything is cut become empty. Rows with equal doc_id and text are one document: what one
    keeps all keep. If docs has a column n_removed_chunks, it is replaced; all other columns stay as they are.
    """
    spans = repeated_spans(docs).groupBy("key", "digest").agg(
        F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("spans"), F.sum("chunks").alias("n"))
    spans = spans.select(F.struct("key", "digest").alias("span_of"), "spans", "n")
    names = [c for c in docs.columns if c != "n_removed_chunks"]
    here = docs.select(F.struct(*names).alias("doc"))
    text = F.col("doc.text").cast("string")
    found = here.withColumn("at", F.struct(F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("digest")))
    found = found.join(spans, (found["at"]["key"] == spans["span_of"]["key"]) & (found["at"]["digest"] == spans["span_of"]["digest"]), "left")
    raw = text.cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["stop"]))
    ends = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.octet_length(text).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(pieces, ""))
    others = [F.col("doc")[c].alias(c) for c in names if c != "text"]
    return found.select(*others, cut.alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_removed_chunks")).select(*names, "n_removed_chunks")
