"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.storage import in_order, stage
from tessera.llm.textbytes import Texts, mix, slices

LEVELS = (2, 3, 4)  # of the hierarchy; phrases of these levels are signed (about 3**level bytes each)
KEPT = 24  # least phrase names kept for each level
BITS = 24  # of a phrase name that are kept, shown and compared
NONE = np.iinfo(np.uint64).max
_EMPTY = "0" * 16


def _coins(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A round of deterministic coin tossing: twice the lowest bit in which neighbours differ, plus that bit."""
    apart = now ^ before
    bit = np.bitwise_count((apart & -apart) - np.uint64(1)).astype(np.uint64)
    return bit << np.uint64(1) | (now >> bit) & np.uint64(1)


def _coin_table(values: int) -> np.ndarray:
    now, before = np.meshgrid(np.arange(values, dtype=np.uint64), np.arange(values, dtype=np.uint64), indexing="ij")
    table = _coins(now, before)
    table[now == before] = 0
    return table.astype(np.uint8)


_BYTES, _SMALL = _coin_table(256), _coin_table(128)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 in which neighbours of one text that aren't equal symbols differ; they depend on a few symbols to the left."""
    if symbols.dtype == np.uint8:
        label = _BYTES[symbols, np.append(np.uint8(0), symbols[:-1])]
        label[first] = symbols[first] & 7
    else:
        label = _coins(symbols, np.append(np.uint64(0), symbols[:-1])).astype(np.uint8)
        label[first] = (symbols[first] & np.uint64(7)).astype(np.uint8)
    for _ in range(2):
        again = _SMALL[label, np.append(np.uint8(0), label[:-1])]
        again[first] = label[first] & 7
        label = again
    return label


def parse(symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of the hierarchy: names of the phrases of each text (texts are symbols[of[i]:of[i + 1]]), and their offsets.

    First each run of one symbol becomes one symbol. Then a phrase starts at each label that is greater than both
    its neighbours. Coin tossing makes neighbours' labels differ, so phrases are short, and where they start depends
    on a few symbols around: equal substrings are cut and named alike, but for their ends, wherever they stand.
    """
    n = len(of) - 1
    if not len(symbols):
        return np.zeros(0, np.uint64), of
    starts = np.zeros(len(symbols) + 1, bool)
    starts[of] = True
    run = starts[:-1].copy()
    run[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(run)  # starts[at[k]]: run k is the first of its text
    length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    first = starts[at]
    value = symbols[at]
    name = mix(value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length)
    label = _labels(value, first)
    cut = first.copy()
    cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~starts[at[2:]]
    phrase = np.flatnonzero(cut)
    rolled = np.append(np.uint64(0), np.cumsum(name * _powers(len(name))))
    ends = np.append(phrase[1:], len(name))
    names = mix((rolled[ends] - rolled[phrase]) * _inverse(len(name))[phrase] + (ends - phrase).astype(np.uint64))
    return names, np.searchsorted(at[phrase], of)


_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_tables: dict[str, np.ndarray] = {}


def _power_table(name: str, q: np.uint64, n: int) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        x = np.full(max(n, 1 << 20), q, np.uint64)
        x[0] = 1
        _tables[name] = np.multiply.accumulate(x)
    return _tables[name][:n]


def _powers(n: int) -> np.ndarray:
    return _power_table("powers", _Q, n)


def _inverse(n: int) -> np.ndarray:
    return _power_table("inverse", np.uint64(pow(int(_Q), -1, 1 << 64)), n)


def sketches(texts: Texts) -> np.ndarray:
    """For each text, per level the KEPT least phrase names, in order; NONE fills up."""
    out = np.full((texts.n, len(LEVELS), KEPT), NONE)
    symbols, of = texts.bytes, texts.offsets
    for level in range(1, max(LEVELS) + 1):
        symbols, of = parse(symbols, of)
        if level in LEVELS:
            k = LEVELS.index(level)
            names = mix(symbols ^ np.uint64(level)) >> np.uint64(64 - BITS)
            for i in np.flatnonzero(np.diff(of)).tolist():
                own = names[of[i]:of[i + 1]]
                least = np.unique(own if len(own) <= 4 * KEPT else np.partition(own, 4 * KEPT - 1)[:4 * KEPT])
                if len(least) < KEPT and len(own) > 4 * KEPT:
                    least = np.unique(own)
                least = least[:KEPT]
                out[i, k, :len(least)] = least
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of common phrases that two sketches tell, as the mean over the levels that both texts reach with
    several phrases (fewer than four tell nothing beside a lower level); two empty texts are alike, an empty one and
    another are not."""
    total, used = 0.0, 0
    for x, y in zip(a, b, strict=True):
        x, y = x[x != NONE], y[y != NONE]
        if not len(x) and not len(y):
            continue
        size = KEPT if len(x) == KEPT and len(y) == KEPT else max(len(x) + len(y), 1)
        union = np.union1d(x, y)[:size]
        if len(union) < 4 and used:
            continue
        both = len(np.intersect1d(np.intersect1d(x, union, True), y, True))
        total, used = total + both / len(union), used + 1
    return total / used if used else float(np.array_equal(a, b))


def _hex(sketch: np.ndarray) -> str:
    """The kept names, level by level; equal sketches give equal strings."""
    return "-".join("".join(f"{int(x):06x}" for x in level if x != NONE) for level in sketch)


class _Pair:
    """What is kept of the document that waits for the next one."""

    def __init__(self, doc_id: int, text: str, sketch: np.ndarray):
        self.doc_id, self.text, self.sketch = doc_id, text, sketch


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge int, text string"


def _compared(pairs: list[tuple[int, str, np.ndarray, str, np.ndarray]], **more) -> pa.RecordBatch:
    """Rows of documents (doc_id, text, sketch) with the next one's text and sketch."""
    edited = []
    for _, text, _, following, _ in pairs:
        k = len(text) // 4
        edited.append(text[:len(text) - k] + following[:k])
    rows = {f.name: [] for f in _SCHEMA}
    for (doc_id, text, sketch, _, beside), changed, own in zip(pairs, edited, sketches(Texts(pa.array(edited, pa.large_string()))), strict=True):
        for name, value in (("doc_id", doc_id), ("n_chars", len(text)), ("edited_sha256", hashlib.sha256(changed.encode()).hexdigest()), ("fingerprint", _hex(sketch)),
                            ("edited_fingerprint", _hex(own)), ("near_edited", likeness(sketch, own)), ("near_next", likeness(sketch, beside)),
                            ("part", None), ("edge", None), ("text", None)):
            rows[name].append(value)
    return pa.RecordBatch.from_pydict(rows, _SCHEMA)


def _edge(doc_id: int, text: str, part: int, edge: int) -> pa.RecordBatch:
    row = {f.name: [None] for f in _SCHEMA} | {"doc_id": [doc_id], "part": [part], "edge": [edge], "text": [text]}
    return pa.RecordBatch.from_pydict(row, _SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many of the
    next document's, in ascending doc_id (after the last comes the first; a null doc_id is the least; rows with
    equal ids are ordered by text). Null and empty texts have the fingerprint of no phrases; they are like each
    other (1) and unlike all others (0). A single document is its own next one. Other columns are ignored.

    Documents are sorted by ranges of doc_id and text, and compared with the next one while they pass; the first and the
    last of each range come out with their texts, and meet their neighbours in a second step over two rows a range.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Pair | None = None
        part_id = TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in slices(batch):
                ids, text, sketch = part.column(0).to_pylist(), part.column(1).to_pylist(), sketches(texts)
                if last is None:
                    yield _edge(ids[0], text[0], part_id, 0)
                else:
                    ids, text, sketch = [last.doc_id, *ids], [last.text, *text], np.concatenate([last.sketch[None], sketch])
                last = _Pair(ids[-1], text[-1], sketch[-1])
                if len(ids) > 1:
                    yield _compared([(ids[i], text[i], sketch[i], text[i + 1], sketch[i + 1]) for i in range(len(ids) - 1)])
        if last is not None:
            yield _edge(last.doc_id, last.text, part_id, 1)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(in_order(rows, parts).mapInArrow(along, _COLUMNS), "fingerprints")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, following = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                sketch = sketches(Texts(pa.array([text, following], pa.large_string())))
                yield _compared([(batch.column(0)[i].as_py(), text, sketch[0], following, sketch[1])])

    # two numbers a range are ordered; texts are joined to their neighbours afterwards
    edges = found.filter("edge is not null")
    by_place = Window.orderBy("part", "edge")
    after = edges.select("part", "edge").withColumn("next", F.coalesce(F.lead("part").over(by_place), F.first("part").over(by_place))).filter("edge = 1")
    firsts = edges.filter("edge = 0").select(F.col("part").alias("next"), F.col("text").alias("following"))
    edges = edges.filter("edge = 1").select("part", "edge", "doc_id", "text").join(after.select("part", "next"), "part").join(firsts, "next")
    ends = edges.filter("edge = 1").select("doc_id", "text", "following").mapInArrow(across, _COLUMNS)
    both = found.filter("edge is null").union(ends).drop("part", "edge", "text")
    return both.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))
