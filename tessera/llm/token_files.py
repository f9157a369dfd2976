"""Token-ID output: shuffled planes of fixed-size id blocks, each compressed, with a chunk index.

A file holds the ids of some documents, one after another, in chunks of BLOCK ids (the last may be shorter):

    b"TESSTOK1" | chunk | chunk | ... | zstd(footer) | footer bytes (u32) | b"TESSTOK1"
    chunk  = one zstd frame for each plane
    footer = JSON: kind, block, n_ids, planes [[offset, bytes] of each plane of each chunk]; then, after a newline,
             the doc_ids (i64) and the id counts (i64) of the documents, little-endian

Byte planes hold byte k of every id of the chunk; bit planes hold bit k of every id. All but the lowest two byte
planes of a small vocabulary are zero, and compress to nothing.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import files
from tessera.llm.storage import in_order, new_dir, stage
from tessera.llm.textbytes import BYTE_LOWER_VALUE, LOWER, Texts, slices, span_hashes

MAGIC = b"TESSTOK1"
BLOCK = 1 << 16
FILE_IDS = 1 << 26  # from which another file begins; the index of a file is held until it is closed
CACHED_WORDS = 1 << 20  # of a task's cache of encoded words, which starts anew beyond that


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.column_stack([np.frombuffer(p, np.uint8) for p in planes]).reshape(-1).view("<u4")
    bits = np.column_stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    def __init__(self, out, kind: str = "byte", block: int = BLOCK):
        self.out, self.kind, self.block = out, kind, block
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.index: list[list[list[int]]] = []
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int], counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts += counts.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            whole = np.concatenate(self.waiting)
            full = len(whole) // self.block * self.block
            for k in range(0, full, self.block):
                self._chunk(whole[k:k + self.block])
            self.waiting, self.n_waiting = [whole[full:]], len(whole) - full

    def _chunk(self, ids: np.ndarray) -> None:
        places = []
        for plane in planes_of(ids, self.kind):
            packed = self.compress(plane)
            self.out.write(packed)
            places.append([self.at, len(packed)])
            self.at += len(packed)
        self.index.append(places)

    def close(self) -> int:
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        head = json.dumps({"kind": self.kind, "block": self.block, "n_ids": self.n_ids, "n_docs": len(self.docs), "planes": self.index}).encode()
        footer = self.compress(head + b"\n" + np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        self.out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        self.out.close()
        return self.n_ids


class Reader:
    """Reads the footer first; then any range of chunks, one at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if bytes(tail[4:]) != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:4], "little")
        self.decompress = zstandard.ZstdDecompressor().decompress
        footer = self.decompress(source.read_at(n, size - 4 - len(MAGIC) - n))
        head, _, rest = footer.partition(b"\n")
        self.head = json.loads(head)
        k = self.head["n_docs"]
        self.doc_ids = np.frombuffer(rest, "<i8", k)
        self.counts = np.frombuffer(rest, "<i8", k, 8 * k)

    def chunk(self, k: int) -> np.ndarray:
        places = self.head["planes"][k]
        first, last = places[0][0], places[-1][0] + places[-1][1]
        data = self.source.read_at(last - first, first)
        n = min(self.head["block"], self.head["n_ids"] - k * self.head["block"])
        return ids_of([self.decompress(data[at - first:at - first + size]) for at, size in places], n, self.head["kind"])

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(index of the document, parts of its ids) in order; no more than one chunk is held beside them."""
        k, have, at = 0, np.zeros(0, "<u4"), 0
        for i, count in enumerate(self.counts.tolist()):
            parts = []
            while count:
                if at == len(have):
                    have, at, k = self.chunk(k), 0, k + 1
                take = min(count, len(have) - at)
                parts.append(have[at:at + take])
                at, count = at + take, count - take
            yield i, parts


KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 ASCII letters and digits, 2 other ASCII but ', 3 ' and beyond ASCII
KIND[:128] = 2
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[[32, *range(9, 14)]] = 0
KIND[39] = 3


class Encoder:
    """Encodes whole texts by the words in them, each only once, with the ids that the tokenizer gives whole texts.

    The tokenizer cuts words at white space and between letters and punctuation, and ignores case, so a piece
    between such places has the same ids wherever it stands. Texts in which that may not hold, with combining marks
    or names of special tokens, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.n_flat = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self, hashes: list[int], pieces: list[str]) -> None:
        got = self.tokenizer.encode("\n".join(pieces), add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        lengths = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(lengths)
        first = np.array([a for a, _ in got.offsets], np.int64)
        sizes = np.bincount(np.searchsorted(ends, first, "right"), minlength=len(pieces))
        old = len(self.known)
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while old + len(pieces) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.n_flat:self.n_flat + len(ids)] = ids
        self.starts[old:old + len(pieces)] = self.n_flat + np.cumsum(sizes) - sizes
        self.sizes[old:old + len(pieces)] = sizes
        self.n_flat += len(ids)
        self.known.update(zip(hashes, range(old, old + len(pieces)), strict=True))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        b = texts.bytes
        if not len(b):
            return np.zeros(0, np.uint32), np.zeros(texts.n, np.int64)
        kind = np.append(np.uint8(0), np.append(KIND[b], np.uint8(0)))
        first = np.zeros(len(b) + 1, bool)
        first[texts.offsets] = True
        here, before = kind[1:-1], kind[:-2]
        cut = first[:-1] | (before == 0) | (before + here == 3) & (before > 0) & (here > 0) & (before != 3) & (here != 3)
        starts = np.flatnonzero(cut & (here > 0))
        after = kind[2:]
        stop = first[1:] | (after == 0)
        stop[:-1] |= cut[1:]
        ends = np.flatnonzero(stop & (here > 0)) + 1
        distinct, at, back = np.unique(span_hashes(b, starts, ends, BYTE_LOWER_VALUE), return_index=True, return_inverse=True)
        names = distinct.tolist()
        if len(self.known) + len(names) > CACHED_WORDS:
            self.forget()
        new = [k for k, name in enumerate(names) if name not in self.known]
        if new:
            low = LOWER[b].tobytes()
            self.learn([names[k] for k in new], [low[starts[at[k]]:ends[at[k]]].decode("utf-8") for k in new])
        place = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[back]
        sizes = self.sizes[place]
        total = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(self.starts[place] - total[:-1], sizes) + np.arange(total[-1])]
        counts = np.diff(total[np.searchsorted(starts, texts.offsets)])
        odd = (b == 0xCC) | (b == 0xCD)
        odd[:-1] |= (b[:-1] == 60) & (b[1:] == 124)
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.unique(np.searchsorted(texts.offsets, np.flatnonzero(odd), "right") - 1).tolist():
                text = b[texts.offsets[i]:texts.offsets[i + 1]].tobytes().decode("utf-8")
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, kind: str = "byte", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs and write their ids in ascending doc_id order; returns (part, file, path, n_ids) of the files.

    Ranges of doc_ids and texts are sorted and written while the rows pass, in files of about file_ids ids: a task holds a slice
    of texts, a chunk of ids and a file's index. A task that is run again writes another file; the table has those of the attempts that counted.
    Null texts are empty; null doc_ids come first, as the least id; rows with equal ids are ordered by text.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        writer, done = None, {"part": [], "file": [], "path": [], "n_ids": []}

        def close() -> None:
            done["part"].append(TaskContext.get().partitionId())
            done["file"].append(len(done["file"]))
            done["path"].append(path)
            done["n_ids"].append(writer.close())

        for batch in batches:
            for part, texts in slices(batch):
                if writer is None or writer.n_ids >= file_ids:
                    if writer is not None:
                        close()
                    path, out = files.create(folder, ".tok")
                    writer = Writer(out, kind)
                ids, counts = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
                writer.add(part.column(0).to_pylist(), counts + 1, ids)
        if writer is not None:
            close()
            yield pa.RecordBatch.from_pydict(done, pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64())]))

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(in_order(rows, parts).mapInArrow(write, "part long, file long, path string, n_ids long"), "token-files")


def read_token_files(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files that write_token_files tells of."""
    # one row a file
    placed = written.withColumn("start", F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input(path) as source:
                    reader = Reader(source)
                    sums = np.zeros(len(reader.counts), np.int64)
                    for i, parts in reader.documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(np.ascontiguousarray(part, "<u4"), crc)
                        sums[i] = crc
                    starts = start + np.cumsum(reader.counts) - reader.counts
                    whole = pa.RecordBatch.from_arrays([pa.array(reader.doc_ids), pa.array(starts), pa.array(reader.counts), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    for k in range(0, whole.num_rows, 10_000):
                        yield whole.slice(k, 10_000)

    parts = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.select("path", F.coalesce("start", F.lit(0)).alias("start")).repartition(parts, "path")
    found = rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Write docs as token files in a new folder of the shared ones and read them back; see the two functions above."""
    folder = new_dir(docs.sparkSession, "ids")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder, kind))
