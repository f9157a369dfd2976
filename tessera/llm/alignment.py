"""Cross-tokenizer alignment: groups of two tokenizers' tokens over the same bytes, as a monoid of fragments."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, small_batches, stage
from tessera.llm.textbytes import BYTE_VALUE, NOT_SPACE, Texts, signed, slices, span_hashes
from tessera.llm.weights import SENT, Held, grouped, weigh

RANGE = 1 << 15  # bytes of a text that make a fragment of their own
FAN = 8  # fragments that one task composes
KNOWN = 700_000  # different segments whose fragments a worker remembers; forgetting them only costs time
TOGETHER = 1 << 16  # bytes of segments that are encoded at once


# ---- tokenizers --------------------------------------------------------------------------------------------------

def _byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder(NamedTuple):
    """encode(text) -> ids of a text that begins with a space; size: of the vocabulary; token: bytes of each id."""
    encode: Callable[[str], list[int]]
    size: int
    token: list[bytes]


@functools.cache
def byte_level(path: str) -> Encoder:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    symbol, size = _byte_symbols(), model.get_vocab_size()
    token = [b"".join(bytes([symbol[c]]) if c in symbol else c.encode() for c in model.id_to_token(k) or "") for k in range(size)]
    return Encoder(lambda text: model.encode(text, add_special_tokens=False).ids, size, token)


@functools.cache
def pieces(path: str) -> Encoder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size, space = model.get_piece_size(), model.encode("a ")[-1]

    def token(k: int) -> bytes:
        piece = model.id_to_piece(k)
        hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()

    def encode(text: str) -> list[int]:  # the model adds the space itself, but not to an empty text
        return model.encode(text[1:]) if len(text) > 1 else [space]

    return Encoder(encode, size, [token(k) for k in range(size)])


class Pair:
    """Two encoders as arrays: the bytes that each id stands for, its length and its decimal form."""

    def __init__(self, a: Encoder, b: Encoder):
        self.encoders = a, b
        self.length = [np.array([len(t) for t in e.token], np.int64) for e in self.encoders]
        self.written = [[str(k) for k in range(e.size)] for e in self.encoders]

    def name(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for each pair of ids."""
        return a.astype(np.uint64) * np.uint64(self.encoders[1].size) + b.astype(np.uint64)

    def tokens(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids of A, where they end, ids of B, where they end), or None if the bytes of either differ from raw."""
        out = []
        for encoder, length in zip(self.encoders, self.length, strict=True):
            ids = encoder.encode(raw.decode())
            if b"".join([encoder.token[k] for k in ids]) != raw:
                return None
            ids = np.array(ids, np.int64)
            out += [ids, np.cumsum(length[ids])]
        return tuple(out)


@functools.cache
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(byte_level(path_a), pieces(path_b))


# ---- fragments ---------------------------------------------------------------------------------------------------

class Open(NamedTuple):
    """Tokens of an unfinished group: ids and the bytes where they end, of both tokenizers."""
    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate(x) for x in zip(self, other, strict=True)))


NOTHING = Open(*[np.zeros(0, np.int64)] * 4)


def groups_of(tokens: Open, pair: Pair) -> tuple[list[str], np.ndarray]:
    """The written form of each group of tokens that begin and end together, and where the groups end."""
    ends = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    upto = [np.searchsorted(x, ends, "right").tolist() for x in (tokens.a_ends, tokens.b_ends)]
    a, b = ([table[k] for k in ids.tolist()] for table, ids in zip(pair.written, (tokens.a, tokens.b), strict=True))
    said, i, j = [], 0, 0
    for x, y in zip(*upto, strict=True):
        said.append(f"{a[i]}|{b[j]}" if x - i == 1 and y - j == 1 else f"{','.join(a[i:x])}|{','.join(b[j:y])}")
        i, j = x, y
    return said, ends


def links_of(tokens: Open, pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    """The name of each pair of overlapping tokens, in order of A, and how many pairs each token of A has."""
    first = np.searchsorted(tokens.b_ends, tokens.a_ends - pair.length[0][tokens.a], "right")
    many = np.searchsorted(tokens.b_ends - pair.length[1][tokens.b], tokens.a_ends, "left") - first
    at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    return pair.name(np.repeat(tokens.a, many), tokens.b[at]), many


def closed(tokens: Open, pair: Pair) -> tuple[str, int, np.ndarray]:
    """What whole groups hold: their written form, their number, and the name of each link in them."""
    if not len(tokens.a):
        return "", 0, np.zeros(0, np.uint64)
    said = groups_of(tokens, pair)[0]
    return ";".join(said), len(said), links_of(tokens, pair)[0]


class Fragment(NamedTuple):
    """A byte range of a text: tokens up to its first common end, the groups between common ends, tokens after the last.

    Without a common end (cut is False) all tokens are in prefix. Composition is associative, NOTHING without a cut is
    its unit, and a whole text leaves an empty suffix.
    """
    cut: bool
    prefix: Open
    groups: str
    n_groups: int
    names: np.ndarray  # of links in the groups, in order
    times: np.ndarray
    suffix: Open

    @classmethod
    def of(cls, tokens: Open, pair: Pair) -> Fragment:
        ends = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
        if not len(ends):
            return cls(False, tokens, "", 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), NOTHING)

        def between(low: int, high: int) -> Open:  # tokens that end after low and not after high
            return Open(*(x for ids, at in ((tokens.a, tokens.a_ends), (tokens.b, tokens.b_ends)) for held in [(at > low) & (at <= high)] for x in (ids[held], at[held])))

        groups, n, links = closed(between(ends[0], ends[-1]), pair)
        names, times = np.unique(links, return_counts=True)
        return cls(True, between(-1, ends[0]), groups, n, names, times, between(ends[-1], 1 << 62))

    def then(self, other: Fragment, pair: Pair) -> Fragment:
        if not other.cut:
            if not self.cut:
                return self._replace(prefix=self.prefix + other.prefix)
            return self._replace(suffix=self.suffix + other.prefix)
        if not self.cut:
            return other._replace(prefix=self.prefix + other.prefix)
        groups, n, links = closed(self.suffix + other.prefix, pair)
        said = ";".join(x for x in (self.groups, groups, other.groups) if x)
        names, times = grouped(np.concatenate([self.names, links, other.names]), np.concatenate([self.times, np.ones(len(links), np.int64), other.times]))
        return Fragment(True, self.prefix, said, self.n_groups + n + other.n_groups, names, times, other.suffix)

    def whole(self, pair: Pair) -> Fragment:
        """With the first group closed; what is left of suffix belongs to no group."""
        return Fragment(True, NOTHING, "", 0, self.names[:0], self.times[:0], NOTHING).then(self, pair)


# ---- texts of one range ------------------------------------------------------------------------------------------

def _closed_before(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte (1 and up) is surely no white space for either tokenizer."""
    last, two, three = b[at - 1], b[np.maximum(at - 2, 0)].astype(np.int64), b[np.maximum(at - 3, 0)].astype(np.int64)
    wide = (two == 0xC2) | np.isin(three << 8 | two, (0xE19A, 0xE280, 0xE281, 0xE380))  # all that begin like white space beyond ASCII
    return NOT_SPACE[last] & ~((last >= 28) & (last < 32)) & ~((last >= 128) & wide)


def segment_starts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts (which begin at starts) can be cut so that either tokenizer treats the parts alike: before a space
    that follows what is surely no white space. No token of either holds a space after another character."""
    space = np.flatnonzero(b[1:] == 32) + 1
    return np.union1d(starts, space[_closed_before(b, space)])


class Segments:
    """Fragments of different segments, each encoded once: numbers, written groups and link names by place."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.written: list[str | None] = []  # None: bytes that a tokenizer changes
        self.numbers = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.links = np.zeros(0, np.uint64)  # of all segments, in order of their places
        self.begin = np.zeros(1, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []

    def places(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        names, first, back = np.unique(span_hashes(b, starts, ends, BYTE_VALUE), return_index=True, return_inverse=True)
        if len(self.place) + len(names) > KNOWN:
            self.forget()
        get = self.place.get
        found = np.fromiter((get(x, -1) for x in names.tolist()), np.int64, len(names))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(self.written), len(self.written) + len(new))
            self.place.update(zip(names[new].tolist(), found[new].tolist(), strict=True))
            waiting, size = [], 0
            for start, end, apart in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), (~_closed_before(b, ends[first[new]])).tolist(), strict=True):
                waiting.append(b[start:end].tobytes())
                size += end - start
                if size > TOGETHER or apart:  # white space at its end may join what comes after it
                    self._add(waiting)
                    waiting, size = [], 0
            self._add(waiting)
            self.numbers = np.concatenate([self.numbers, *(n for n, _ in self._new)])
            self.links = np.concatenate([self.links, *(x for _, x in self._new)])
            self.begin = np.r_[0, np.cumsum(self.numbers[:, 3])]
            self._new = []
        return found[back]

    def _add(self, raw: list[bytes]) -> None:
        if not raw:
            return
        if (tokens := self.pair.tokens(b"".join(raw))) is None:
            if len(raw) > 1:
                self._add(raw[:len(raw) // 2])
                self._add(raw[len(raw) // 2:])
                return
            self.written.append(None)
            self._new.append((np.zeros((1, 4), np.int64), np.zeros(0, np.uint64)))
            return
        tokens, stops = Open(*tokens), np.cumsum([len(x) for x in raw])
        said, ends = groups_of(tokens, self.pair)
        names, many = links_of(tokens, self.pair)
        upto = [np.searchsorted(x, stops, "right") for x in (tokens.a_ends, tokens.b_ends, ends)]
        groups = [0, *upto[2].tolist()]
        self.written += [";".join(said[i:j]) for i, j in zip(groups, groups[1:])]
        upto.append(np.r_[0, np.cumsum(many)][upto[0]])
        self._new.append((np.diff(np.stack(upto, axis=1), axis=0, prepend=0), names))


@functools.cache
def _known(path_a: str, path_b: str) -> Segments:
    """One for each Python worker: tasks that follow each other in it need not encode the same segments again."""
    return Segments(pair_of(path_a, path_b))


COLUMNS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("names", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups string, names array<long>, times array<int>"


def _aligned(texts: Texts, known: Segments) -> list[pa.Array]:
    """The columns of texts that begin with the added space."""
    starts = segment_starts(texts.bytes, texts.offsets[:-1])
    ends = np.r_[starts[1:], len(texts.bytes)].astype(np.int64)
    place = known.places(texts.bytes, starts, ends)
    of = np.searchsorted(starts, texts.offsets)
    text = np.repeat(np.arange(texts.n), np.diff(of))
    numbers = known.numbers[place]
    table = known.written
    written = [table[k] for k in place.tolist()]
    said = []
    for i in range(texts.n):
        part = written[of[i]:of[i + 1]]
        said.append("" if None in part or texts.offsets[i + 1] - texts.offsets[i] < 2 else ";".join(part))
    whole = np.array([bool(x) for x in said], bool)
    sums = [np.bincount(text, numbers[:, k], texts.n).astype(np.int64) * whole for k in range(4)]
    # links: a segment's, as often as the text holds it
    key, times = np.unique(text.astype(np.int64) << 32 | place, return_counts=True)
    keep = whole[key >> 32]
    key, times = key[keep], times[keep]
    held = key & 0xFFFFFFFF
    many = known.numbers[held, 3]
    at = np.repeat(known.begin[held] - np.cumsum(many) + many, many) + np.arange(many.sum())
    distinct, inverse = np.unique(known.links[at], return_inverse=True)
    pairs, count = grouped(np.repeat(key >> 32, many) << 32 | inverse, np.repeat(times, many))
    offsets = pa.array(np.searchsorted(pairs >> 32, np.arange(texts.n + 1)).astype(np.int32))
    return [*map(pa.array, sums), pa.array(said, pa.string()), pa.ListArray.from_arrays(offsets, signed(distinct[pairs & 0xFFFFFFFF])), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))]


def _of_short(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(*paths)
        for batch in batches:
            for part, _ in slices(batch):
                spaced = pc.binary_join_element_wise("", part.column(1).fill_null(""), " ")
                yield pa.RecordBatch.from_arrays([part.column(0), *_aligned(Texts(spaced), known)], ["doc_id", *(n for n, _ in COLUMNS)])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id long, {SCHEMA}")


# ---- texts of many ranges ----------------------------------------------------------------------------------------

_OPEN = [f"{side}_{x}" for side in ("prefix", "suffix") for x in Open._fields]
_FRAGMENT = ["ok", "cut", "n_a", "n_b", *_OPEN, "groups", "n_groups", "names", "times"]
_FRAGMENT_DDL = "ok boolean, cut boolean, n_a long, n_b long, " + ", ".join(f"{x} array<long>" for x in _OPEN) + ", groups string, n_groups long, names array<long>, times array<long>"


def _ranges(docs: DataFrame, size: int) -> DataFrame:
    """row, doc_id, part, low, high, begin, text: the bytes low < end <= high of a text with its space, and the text from
    byte begin on that a task needs to find the tokens that end there."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = b" " + text.encode()
                b = np.frombuffer(raw, np.uint8)
                safe = np.r_[segment_starts(b, np.zeros(1, np.int64)), len(b)]
                for part, low in enumerate(range(0, len(raw), size)):
                    high = min(low + size, len(raw))
                    begin = safe[np.searchsorted(safe, low, "right") - 1]
                    stop = safe[np.searchsorted(safe, high, "left")]
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": [doc], "part": [part], "low": [low], "high": [high], "begin": [int(begin)], "text": [raw[begin:stop].decode()]})

    return docs.select("row", "doc_id", "text").mapInArrow(each, "row long, doc_id long, part long, low long, high long, begin long, text string")


def _row_of(fragment: Fragment | None, n_a: int = 0, n_b: int = 0) -> list:
    if fragment is None:
        return [False, False, 0, 0, *[[]] * 8, "", 0, [], []]
    return [True, fragment.cut, n_a, n_b, *map(np.ndarray.tolist, (*fragment.prefix, *fragment.suffix)), fragment.groups, fragment.n_groups, fragment.names.view(np.int64).tolist(), fragment.times.tolist()]


def _fragment_of(row) -> Fragment:
    opens = [Open(*(np.asarray(getattr(row, f"{side}_{x}"), np.int64) for x in Open._fields)) for side in ("prefix", "suffix")]
    return Fragment(row.cut, opens[0], row.groups, row.n_groups, np.asarray(row.names, np.int64).view(np.uint64), np.asarray(row.times, np.int64), opens[1])


def _of_long(docs: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """As _of_short: ranges are encoded where Spark deals them, and fragments composed FAN at a time up a tree."""
    ranges = stage(_ranges(docs.withColumn("row", F.monotonically_increasing_id()), size), "ranges")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*paths)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                tokens = pair.tokens(x["text"].encode())
                if tokens is None:
                    out.append([x["row"], x["doc_id"], x["part"], *_row_of(None)])
                    continue
                held = []
                for ids, ends in (tokens[:2], tokens[2:]):
                    ends = ends + x["begin"]
                    inside = (ends > x["low"]) & (ends <= x["high"])
                    held += [ids[inside], ends[inside]]
                fragment = Fragment.of(Open(*held), pair)
                out.append([x["row"], x["doc_id"], x["part"], *_row_of(fragment, len(held[0]), len(held[2]))])
            yield from pa.Table.from_pylist([dict(zip(keys, r, strict=True)) for r in out], schema=arrow).to_batches()

    keys = ["row", "doc_id", "part", *_FRAGMENT]
    ddl = f"row long, doc_id long, part long, {_FRAGMENT_DDL}"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    fragments = ranges.repartition("row", "part").mapInArrow(encode, ddl)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        pair, frame = pair_of(*paths), frame.sort_values("part")
        first, made = frame.iloc[0], None
        if frame["ok"].all():
            for row in frame.itertuples():
                made = _fragment_of(row) if made is None else made.then(_fragment_of(row), pair)
        return pd.DataFrame([[first["row"], first["doc_id"], first["part"] // FAN, *_row_of(made, int(frame["n_a"].sum()), int(frame["n_b"].sum()))]], columns=keys)

    fragments = stage(fragments, "fragments")
    most = fragments.agg(F.max("part")).first()[0] or 0
    while most > 0:
        up = fragments.groupBy("row", F.expr(f"part div {FAN}").alias("above")).applyInPandas(lambda frame: compose(frame), ddl)
        fragments, old = stage(up, "fragments"), fragments
        discard(old)
        most //= FAN

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*paths)
        for batch in batches:
            for row in pd.DataFrame(batch.to_pylist(), columns=keys).itertuples():
                done = _fragment_of(row).whole(pair) if row.ok else Fragment(True, NOTHING, "", 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), NOTHING)
                values = [row.n_a * row.ok, row.n_b * row.ok, done.n_groups, int(done.times.sum()), done.groups, done.names.view(np.int64).tolist(), done.times.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([None if pd.isna(row.doc_id) else int(row.doc_id)], pa.int64()), *(pa.array([v], t) for v, (_, t) in zip(values, COLUMNS, strict=True))], ["doc_id", *(n for n, _ in COLUMNS)])

    return fragments.mapInArrow(finish, f"doc_id long, {SCHEMA}")


# ---- corpus ------------------------------------------------------------------------------------------------------

def _held(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Held]]:
    names, times = batch.column(batch.schema.get_field_index("names")), batch.column(batch.schema.get_field_index("times"))
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(names).fill_null(0).to_numpy(zero_copy_only=False))
    kept = batch.select([c for c in batch.schema.names if c not in ("names", "times")])
    yield kept, Held(row, names.flatten().to_numpy().view(np.uint64), times.flatten().to_numpy().astype(np.int64))


def align(docs: DataFrame, path_a: str, path_b: str, keep: Callable[[Column], Column] = lambda groups: groups, size: int = RANGE, sent: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for each row of docs (doc_id, text).

    path_a is a byte-level vocabulary of the tokenizers library, path_b a sentencepiece model. A text with a space before
    it is cut by both; where tokens of both end at one byte a group ends, written `a1,a2|b1`, groups parted by `;`.
    Texts of up to `size` bytes are fragments put together from those of their segments; of longer ones each range of
    so many bytes becomes a fragment in a task of its own choosing, and a tree of FAN at a time composes them, so no
    task encodes more than a range and the segment at each of its ends. A link is a pair of overlapping tokens; the
    count of a pair of ids is the number of rows that hold it linked, n_best counts links whose count is the highest
    of their id of A, and count_sum adds the counts of all links. Texts that are null, empty, or changed by a tokenizer have no
    tokens: zeros and empty groups. `keep` tells what is kept of groups, such as a digest. Rows that share a doc_id
    count each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paths, is_long = (path_a, path_b), F.octet_length("text") >= size
    with small_batches(docs.sparkSession):
        both = _of_short(rows.filter(~is_long), paths).union(_of_long(rows.filter(is_long), paths, size))
        aligned = stage(both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", keep(F.col("groups")).alias("groups"), "names", "times"), "aligned")
    size_b = len(pieces(path_b).token)
    counts = stage(aligned.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")), "links")
    id_a = F.expr(f"name div {size_b}")
    best = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("best"))  # a row for each id of A at most
    entries = stage(counts.join(best, id_a == F.col("a")).select("name", "n", F.array(F.col("n").cast("double"), (F.col("n") == F.col("best")).cast("double")).alias("weight")), "link-weights")
    kept = ", ".join(f"{c} {t}" for c, t in aligned.dtypes if c not in ("names", "times"))
    summed = weigh(aligned, _held, kept, entries, 2, sent)
    discard(aligned, counts, entries)
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("sums")[1].cast("long").alias("n_best"), F.col("sums")[0].cast("long").alias("count_sum"), "groups")
