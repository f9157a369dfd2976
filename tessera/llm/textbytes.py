"""Words, word hashes and shingle hashes of whole Arrow string columns, on their UTF-8 bytes.

All word classes used here are unions of single ASCII bytes and of everything beyond ASCII, so words can be
cut on bytes: a byte of a longer UTF-8 sequence is never an ASCII byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text handled at once; one longer text is handled alone
_MUL = 0x9E3779B97F4A7C15


def _mix_int(x: int) -> int:
    x = (x + _MUL) & (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
    return x ^ x >> 31


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each hash over all 64 bits."""
    x = x + np.uint64(_MUL)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = np.array([_mix_int(i) for i in range(256)], np.uint64)
BYTE_LOWER_VALUE = BYTE_VALUE[LOWER]
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = np.ones(256, bool)  # [^\x20\x09-\x0D]
NOT_SPACE[[32, *range(9, 14)]] = False

_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_INV = np.uint64(pow(int(_Q), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, q in enumerate((_Q, _Q_INV)):
            x = np.full(max(n, SLICE + 1), q, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hashes of the bytes starts[i]:ends[i], from running sums of a polynomial over all bytes."""
    q, q_inv = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * q[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * q_inv[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """A run of texts as one byte array; offsets[i]:offsets[i + 1] are the bytes of text i. Null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        first, last = int(offsets[0]), int(offsets[-1])
        self.bytes = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
        self.offsets = offsets - first
        self.n = len(column)

    def words(self, kind: np.ndarray) -> Words:
        return Words(self, kind)


class Words:
    """starts, ends: bytes of each word; of[i]:of[i + 1] are the words of text i."""

    def __init__(self, texts: Texts, kind: np.ndarray):
        b, at = texts.bytes, texts.offsets
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = kind[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[at] = True
        self.starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
        self.ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
        self.of = np.searchsorted(self.starts, at)
        self.texts = texts

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts())

    def hashes(self, value: np.ndarray = BYTE_LOWER_VALUE) -> np.ndarray:
        """64-bit hashes of the words, by default with A-Z in lower case."""
        return span_hashes(self.texts.bytes, self.starts, self.ends, value)

    def shingles(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of size words within one text, and the place of the first word of each."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(0xA24BAED4963EE407) + hashes[k:n + k]
        text = self.text_of()
        first = np.flatnonzero(text[:n] == text[size - 1:])
        return mix(out[first] + np.uint64(size)), first


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of a batch with about SLICE bytes of text each, so that memory stays bounded."""
    if not batch.num_rows:
        return
    whole = Texts(batch.column(batch.schema.get_field_index(text)))
    k = 0
    while k < batch.num_rows:
        to = max(k + 1, int(np.searchsorted(whole.offsets, whole.offsets[k] + SLICE, "right")) - 1)
        part = batch.slice(k, to - k)
        yield part, Texts(part.column(part.schema.get_field_index(text)))
        k = to


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def distinct_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes text by text, and their offsets; a text of fewer words has its whole run as one."""
    hashes = words.hashes()
    counts = words.counts()
    parts, owner = [], []
    text = words.text_of()
    got, first = words.shingles(hashes, size)
    parts.append(got)
    owner.append(text[first])
    for short in range(1, size):
        if (counts == short).any():
            got, first = words.shingles(hashes, short)
            keep = counts[text[first]] == short
            parts.append(got[keep])
            owner.append(text[first[keep]])
    if len(parts) > 1:
        hashed, own = np.concatenate(parts), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        hashed, own = hashed[order], own[order]
    else:
        hashed, own = parts[0], owner[0]
    at = np.searchsorted(own, np.arange(words.texts.n + 1))
    for i in np.flatnonzero(np.diff(at) > 1):
        hashed[at[i]:at[i + 1]].sort()
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (own[1:] != own[:-1])
    return hashed[new], np.searchsorted(own[new], np.arange(words.texts.n + 1))
