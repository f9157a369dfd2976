"""Fill-in-middle: texts cut at two unit boundaries, found by a Fenwick tree over fixed blocks of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import NOT_SPACE, Texts, slices

BLOCK = 256  # bytes
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM = 50, 80  # percent of texts that are cut, and of these that put the suffix first


class Fenwick:
    """Counts of units that end, and of code points that begin, in each block of some bytes, as a Fenwick tree.

    Node k (from 1) holds the counts of the blocks k - lowbit(k) .. k - 1; that is all that is kept of the bytes' units.
    """

    def __init__(self, units: np.ndarray, points: np.ndarray):
        counts = np.stack([self._of_blocks(units), self._of_blocks(points)])
        self.units, self.points, self.n = units, points, counts.shape[1]
        before = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        node = np.arange(self.n + 1)
        self.tree = before - before[:, node - (node & -node)]

    @staticmethod
    def _of_blocks(marks: np.ndarray) -> np.ndarray:
        return np.add.reduceat(marks, np.arange(0, len(marks), BLOCK), dtype=np.int64) if len(marks) else np.zeros(0, np.int64)

    def before(self, byte: np.ndarray) -> np.ndarray:
        """(units that end, code points that begin) before each byte: a walk up the tree, then the block's own bytes."""
        block = byte // BLOCK
        total, node = np.zeros((2, len(byte)), np.int64), block.copy()
        while (node > 0).any():
            total += self.tree[:, node]  # node 0 holds nothing
            node -= node & -node
        for k, marks in enumerate((self.units, self.points)):
            total[k] += self._local(marks, block, byte - block * BLOCK)
        return total

    def _window(self, marks: np.ndarray, block: np.ndarray) -> np.ndarray:
        at = block[:, None] * BLOCK + np.arange(BLOCK)
        return np.where(at < len(marks), marks[np.minimum(at, max(len(marks) - 1, 0))], False) if len(marks) else np.zeros((len(block), BLOCK), bool)

    def _local(self, marks: np.ndarray, block: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self._window(marks, block) & (np.arange(BLOCK) < length[:, None])).sum(axis=1)

    def end_of(self, rank: np.ndarray) -> np.ndarray:
        """The byte after the rank-th unit (from 1) of all: binary lifting to the last block before which fewer units end,
        then the unit's place within that block."""
        node, left = np.zeros(len(rank), np.int64), rank.astype(np.int64)
        step = 1 << max(self.n.bit_length() - 1, 0)
        while step:
            to = np.minimum(node + step, self.n)
            go = (node + step <= self.n) & (self.tree[0, to] < left)
            left -= np.where(go, self.tree[0, to], 0)
            node = np.where(go, to, node)
            step >>= 1
        seen = np.cumsum(self._window(self.units, node), axis=1)
        return node * BLOCK + np.argmax(seen >= left[:, None], axis=1) + 1


def _unit_ends(texts: Texts) -> np.ndarray:
    """Which bytes end a unit: the last byte of a run that isn't white space, and white space that ends a text."""
    b, at = texts.bytes, texts.offsets
    inside = NOT_SPACE[b]
    last = np.zeros(len(b), bool)
    last[at[1:][np.diff(at) > 0] - 1] = True
    following = np.ones(len(b), bool)
    following[:-1] = ~inside[1:]
    return last | inside & following


def cuts(texts: Texts, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text: its units n, the bytes from its start to the lower and the higher of first % (n + 1) and
    second % (n + 1) units, and the code points up to these."""
    tree = Fenwick(_unit_ends(texts), texts.bytes & 0xC0 != 0x80)
    before = tree.before(texts.offsets)
    n = np.diff(before[0])
    ends = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    found = []
    for k in ends:
        start = texts.offsets[:-1]
        found.append(np.where(k > 0, tree.end_of(before[0][:-1] + k) if texts.n else start, start))
    points = [tree.before(x)[1] - before[1][:-1] for x in found]
    return n, found[0] - texts.offsets[:-1], found[1] - texts.offsets[:-1], points[0], points[1]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for each row of docs (doc_id, text).

    Units are words with the white space before them, and white space at the end; two draws from the sha256 of seed and
    doc_id say after how many of them the prefix and the middle end, a third whether the text is cut at all (rate in
    a hundred), a fourth whether the suffix comes first (spm) or the prefix (psm). Empty and null texts and those that
    hold a sentinel stay plain, and their two sizes are null. A null doc_id draws as an empty one; rows that share a
    doc_id share its draws. Other columns are ignored.
    """
    draws = _draws(F.col("doc_id").cast("long"), seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(h.alias(f"h{k + 1}") for k, h in enumerate(draws)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                h1, h2, h3, h4 = (part.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
                n, a, b, before, upto = cuts(texts, h1, h2)
                form, out = [], []
                for i in range(texts.n):
                    raw = texts.bytes[texts.offsets[i]:texts.offsets[i + 1]].tobytes()
                    if not raw or h3[i] % 100 >= rate or PREFIX in raw or SUFFIX in raw or MIDDLE in raw:
                        form.append("plain")
                        out.append(raw)
                        continue
                    prefix, middle, suffix = raw[:a[i]], raw[a[i]:b[i]], raw[b[i]:]
                    form.append("spm" if h4[i] % 100 < spm else "psm")
                    heads = (SUFFIX, suffix, PREFIX, prefix) if form[-1] == "spm" else (PREFIX, prefix, SUFFIX, suffix)
                    out.append(b"".join((*heads, MIDDLE, middle)))
                plain = np.array([x == "plain" for x in form], bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(before, mask=plain), pa.array(upto - before, mask=plain),
                                                  pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(each, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle made output of."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, (1 << 31) - 1), f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}", -1)
    return F.when(form == "spm", F.concat(parts[1], parts[2], parts[0])).when(form == "psm", F.concat(parts[0], parts[2], parts[1])).otherwise(output)
