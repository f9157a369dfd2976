"""Toxicity: class-conditional Kneser-Ney bigram models compared by length-normalised log-likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import bitmap, discard, in_bitmap, likely, small_batches, stage
from tessera.llm.textbytes import ALNUM, Texts, signed, slices

DISCOUNT = 0.75
ONCE = 1.0  # the discount of a pair that a class holds once: it counts in its backoff mass and continuations alone
COMBINED = 1 << 20  # words whose pairs a task counts together before the shuffle
SENT = 1 << 18, 1 << 22  # how many of the most frequent words and pairs are sent to all tasks; texts are joined with the others
BITS = 26  # the bitmap of the other entries, which spares the join names that stand in none, has 2**BITS places
CALIBRATION_ROWS = 20_000  # labelled rows on which the weights of the features are fitted
FEATURES = 3
WORD = (1 << 32) - 1  # stands as the left word in the name of a single word
THRESHOLD = 0.3
STEPS = 256  # what a pair adds to a log ratio is told in steps of 1 / STEPS, two bytes each in the tasks
MODELS = ("", "_n")  # of all counts, and without those of the fold on which the weights are fitted


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _word_ids(texts: Texts) -> tuple:
    """32-bit word names, and the pairs (left word, word) as one 64-bit name; the left of a first word is 0."""
    words = texts.words(ALNUM)
    name = np.clip(words.hashes() >> np.uint64(32), np.uint64(1), np.uint64(WORD - 1))
    left = np.zeros(len(name), np.uint64)
    left[1:] = name[:-1]
    left[words.of[:-1][words.of[:-1] < len(name)]] = 0
    return words, name, left << np.uint64(32) | name


def _pair_counts(rows: DataFrame) -> DataFrame:
    """name, n0, n1, m0, m1: how often each pair stands in ordinary (0) and toxic (1) rows, held apart (m) or not (n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = [[] for _ in range(4)]

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            if waiting[kind]:
                name, n = np.unique(np.concatenate(waiting[kind]), return_counts=True)
                waiting[kind] = []
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.full(len(n), kind, np.int32)), pa.array(n)], ["name", "kind", "n"])

        for batch in batches:
            for kind in range(4):
                for _, texts in slices(batch.filter(pa.compute.equal(batch.column(1), kind))):
                    waiting[kind].append(_word_ids(texts)[2])
                    if sum(map(len, waiting[kind])) > COMBINED:
                        yield from flush(kind)
        for kind in range(4):
            yield from flush(kind)

    kinds = rows.select("text", F.expr("toxic + if(apart, 2, 0)").cast("int").alias("kind"))
    # tasks have combined their own counts, so no name has many rows
    found = kinds.mapInArrow(count, "name long, kind int, n long").repartition("name")
    return found.groupBy("name").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("n0", "n1", "m0", "m1"))))


def _of_class(c: int, model: str) -> Column:
    return F.col(f"n{c}") if model else F.col(f"n{c}") + F.col(f"m{c}")


def _discount(count: Column) -> Column:
    return F.when(count > 1, DISCOUNT).when(count == 1, ONCE).otherwise(0.0)


def _left() -> Column:
    return F.expr("shiftrightunsigned(name, 32)")


def _right() -> Column:
    return F.expr("name & 4294967295")


class Totals(NamedTuple):
    """Sums over all words of a model."""
    n0: float  # ordinary and toxic words
    n1: float
    rest0: float  # the share of them that discounts leave to the continuation counts
    rest1: float
    lefts: float

    @classmethod
    def of(cls, n0, n1, types0, types1, lefts) -> Totals:
        n0, n1, lefts = (max(float(x or 0), 1.0) for x in (n0, n1, lefts))
        return cls(n0, n1, DISCOUNT * (types0 or 0) / n0, DISCOUNT * (types1 or 0) / n1, lefts)

    @property
    def unseen(self) -> float:
        """The log ratio of a word that no counted row holds."""
        return float(np.log(self.rest1 / self.rest0)) if self.rest0 and self.rest1 else 0.0


def _words(counts: DataFrame) -> DataFrame:
    """word and, for each model: w0, w1 (how often it stands), lefts (different left contexts), begun0, begun1 (how
    often a word follows it), k0, k1 (what discounts take from that)."""
    right, left = [], []
    for model in MODELS:
        both = [_of_class(c, model) for c in (0, 1)]
        right += [F.sum(both[c]).alias(f"w{c}{model}") for c in (0, 1)] + [F.count_if(both[0] + both[1] > 0).alias(f"lefts{model}")]
        left += [F.sum(both[c]).alias(f"begun{c}{model}") for c in (0, 1)] + [F.sum(_discount(both[c])).alias(f"k{c}{model}") for c in (0, 1)]
    of_right = counts.groupBy(_right().alias("word")).agg(*right)
    of_left = counts.filter(_left() != 0).groupBy(_left().alias("word")).agg(*left)
    return of_right.join(of_left, "word", "left").fillna(0)  # each word stands at the right of a pair


def _model(words: DataFrame, model: str, whole: Totals) -> DataFrame:
    """words with p0, p1 (probabilities of the word alone, from discounted counts and the shared continuations), more
    (its log ratio, less that of unseen words) and backoff (the log ratio of what is left to the word after it)."""
    for c, n, rest in ((0, whole.n0, whole.rest0), (1, whole.n1, whole.rest1)):
        alone = F.greatest(F.col(f"w{c}{model}") - DISCOUNT, F.lit(0.0)) / n + (rest or 1.0) * F.col(f"lefts{model}") / whole.lefts
        words = words.withColumn(f"p{c}{model}", alone)
    known = F.col(f"lefts{model}") > 0
    words = words.withColumn(f"more{model}", F.when(known, F.log(F.col(f"p1{model}") / F.col(f"p0{model}")) - whole.unseen).cast("float"))
    # of the counts that begin with a word discounts take a share; where a class has none, all is left
    begun = [F.col(f"begun{c}{model}") for c in (0, 1)]
    left = [F.when(begun[c] > 0, F.col(f"k{c}{model}") / begun[c]).otherwise(1.0) for c in (0, 1)]
    return words.withColumn(f"backoff{model}", F.log(left[1] / left[0]).cast("float"))


def _entries(counts: DataFrame) -> tuple[DataFrame, dict[str, Totals]]:
    """name, n, word, and for each model more and backoff, of all words and of the pairs whose counts say more than
    their words do; and the totals.

    The log ratio of a pair is that of its word plus the backoff of its left word plus what is in more:
    log(1 + d1 / (k1 p1)) - log(1 + d0 / (k0 p0)), where d are its discounted counts.
    """
    words = stage(_words(counts), "words")
    totals = {}
    for m in MODELS:
        totals[m] = Totals.of(*words.agg(F.sum(f"w0{m}"), F.sum(f"w1{m}"), F.count_if(F.col(f"w0{m}") > 0), F.count_if(F.col(f"w1{m}") > 0), F.sum(f"lefts{m}")).first())
    known = words
    for m in MODELS:
        known = _model(known, m, totals[m])
    known = stage(known, "word-models")

    both = [(c, m) for m in MODELS for c in (0, 1)]
    telling = counts.filter((_left() != 0) & (F.greatest(*(_of_class(c, "") for c in (0, 1))) > 1))
    taken = [(_of_class(c, m) - _discount(_of_class(c, m))).cast("float").alias(f"d{c}{m}") for c, m in both]
    telling = telling.select("name", F.expr("n0 + n1 + m0 + m1").alias("n"), *taken)
    of_left = known.select(F.col("word").alias("left"), *(f"k{c}{m}" for c, m in both))
    shares = [F.when(F.col(f"d{c}{m}") > 0, F.col(f"d{c}{m}") / F.col(f"k{c}{m}")).otherwise(0.0).cast("float").alias(f"d{c}{m}") for c, m in both]
    telling = telling.join(of_left, _left() == F.col("left")).select("name", "n", *shares)
    of_right = known.select(F.col("word").alias("right"), *(f"p{c}{m}" for c, m in both))
    telling = telling.join(of_right, _right() == F.col("right"))

    def more(m: str) -> Column:
        gain = [F.when(F.col(f"d{c}{m}") > 0, F.log1p(F.col(f"d{c}{m}") / F.col(f"p{c}{m}"))).otherwise(0.0) for c in (0, 1)]
        return (F.round((gain[1] - gain[0]) * STEPS) / STEPS).cast("float").alias(f"more{m}")

    none = F.lit(0).cast("float")
    pairs = telling.select("name", "n", F.lit(False).alias("word"), *(more(m) for m in MODELS), *(none.alias(f"backoff{m}") for m in MODELS))
    singles = known.select(F.expr(f"shiftleft({WORD}L, 32) | word").alias("name"), F.expr("w0 + w1").alias("n"), F.lit(True).alias("word"),
                           *(F.col(f"more{m}") for m in MODELS), *(F.col(f"backoff{m}") for m in MODELS))
    entries = stage(singles.union(pairs), "entries")
    discard(words, known)
    return entries, totals


def _cut(entries: DataFrame, most: int) -> int:
    """The least count from which no more than `most` entries are left, in steps of an eighth of a doubling."""
    steps = sorted(entries.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().collect(), reverse=True)  # at most 8 * 63 rows
    seen, cut = 0, 1 << 62
    for step, n in steps:
        seen += n
        if seen > most:
            break
        cut = int(np.ceil(2 ** (step / 8)))
    return cut


class Sent(NamedTuple):
    """Frequent entries by name in order: arrays of names, of more (of pairs in steps) and of words' backoff, by model."""
    names: np.ndarray
    more: list[np.ndarray]
    backoff: list[np.ndarray]

    @classmethod
    def of(cls, entries: DataFrame, *values: str) -> Sent:
        found = entries.select("name", *(f"{x}{m}" for x in values for m in MODELS)).toArrow()
        names = found.column(0).to_numpy().view(np.uint64)
        order = np.argsort(names)
        arrays = [x.to_numpy(zero_copy_only=False).astype(np.float32)[order] for x in found.columns[1:]]
        more = arrays[:2] if len(values) > 1 else [np.clip(np.rint(x * STEPS), -32768, 32767).astype(np.int16) for x in arrays]
        return cls(names[order], more, arrays[2:])

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of names, and which of them are there."""
        at = np.searchsorted(self.names, names)
        if not len(self.names):
            return at, np.zeros(len(names), bool)
        at = np.minimum(at, len(self.names) - 1)
        return at, self.names[at] == names


class Lookup(NamedTuple):
    words: Sent
    pairs: Sent
    others: np.ndarray  # a bitmap of the names of all other entries
    unseen: list[float]


def _maybe(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The names both of whose places are taken."""
    return in_bitmap(bits, names ^ names >> np.uint64(32)) & in_bitmap(bits, names >> np.uint64(24))


def _top_two(value: np.ndarray, name: np.ndarray, words) -> list[np.ndarray]:
    """For each text the largest value of its words and the largest of another word; -inf where there is none."""
    out = [np.full(words.texts.n, -np.inf, np.float32) for _ in range(2)]
    full = np.flatnonzero(words.counts())
    if len(full):
        at, text = words.of[full], words.text_of()
        out[0][full] = np.maximum.reduceat(value, at)
        held, first = np.unique(text[best := np.flatnonzero(value == out[0][text])], return_index=True)
        of_best = np.zeros(words.texts.n, np.uint64)
        of_best[held] = name[best[first]]
        out[1][full] = np.maximum.reduceat(np.where(name == of_best[text], np.float32(-np.inf), value), at)
    return out


def _local(texts: Texts, lookup: Lookup, models: range) -> tuple[np.ndarray, list[dict[str, np.ndarray]], tuple[np.ndarray, ...]]:
    """Word counts; for each model the sums and the two largest ratios that frequent entries give; and what is to be
    joined: the text, the name, how often it stands, and how often a word follows it."""
    words, name, pair = _word_ids(texts)
    n, text = words.counts(), words.text_of()
    followed = np.ones(len(name), bool)
    followed[words.of[1:][n > 0] - 1] = False
    later = []
    sums = [np.outer(n, [lookup.unseen[m]])[:, 0] for m in models]
    tops = [[np.full(texts.n, -np.inf, np.float32)] * 2 for _ in models]
    for kind, sent, names in (("word", lookup.words, name | np.uint64(WORD << 32)), ("pair", lookup.pairs, pair)):
        if not len(names):
            continue
        distinct, back = np.unique(names, return_inverse=True)
        at, there = sent.find(distinct)
        maybe = ~there & _maybe(lookup.others, distinct)
        if kind == "pair":
            maybe &= distinct >> np.uint64(32) > 0
        for k, m in enumerate(models):
            if there.any():
                more = np.where(there, np.nan_to_num(sent.more[m][at]), 0)[back].astype(np.float64)
                if kind == "pair":
                    more /= STEPS
                else:
                    more += np.where(there, np.nan_to_num(sent.backoff[m][at]), 0)[back] * followed
                    value = np.where(there & ~np.isnan(sent.more[m][at]), sent.more[m][at] + np.float32(lookup.unseen[m]), np.float32(-np.inf))[back]
                    tops[k] = _top_two(value.astype(np.float32), name, words)
                sums[k] = sums[k] + np.bincount(text, more, texts.n)
        places = np.flatnonzero(maybe[back])
        if len(places):
            key, inverse = np.unique(text[places].astype(np.int64) << 32 | back[places], return_inverse=True)
            later.append((key >> 32, distinct[key & 0xFFFFFFFF], np.bincount(inverse), np.bincount(inverse, followed[places] if kind == "word" else np.zeros(len(places))).astype(np.int64)))
    joined = tuple(np.concatenate(x) for x in zip(*later, strict=True)) if later else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return n, [{"sum": s, "first": t[0], "second": t[1]} for s, t in zip(sums, tops, strict=True)], joined


_NUMBERS = [f"{x}{m}" for m in MODELS for x in ("sum", "first", "second")]
_SCHEMA = pa.schema([("row", pa.int64()), ("text_id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), *((x, pa.float64()) for x in _NUMBERS),
                     ("names", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("followed", pa.list_(pa.int32()))])


def _features(rows: DataFrame, entries: DataFrame, totals: dict[str, Totals], sample: np.ndarray, most: tuple[int, int]) -> DataFrame:
    """doc_id, text_id, features by the model of all counts, and for rows whose doc_id is in sample (sorted) trial, the
    features by the model without the rows held apart.

    Features are the mean log ratio of a text's words, and the two largest ratios of its different words. What the
    frequent entries give is found in the task that reads the text; the other names it holds go to the other entries
    by a join, and their sums and largest ratios come back to the text.
    """
    cuts = _cut(entries.filter("word"), most[0]), _cut(entries.filter("not word"), most[1])
    frequent = F.col("n") >= F.when(F.col("word"), F.lit(cuts[0])).otherwise(F.lit(cuts[1]))
    others = entries.filter(~frequent)
    places = others.select(F.explode(F.expr("array(name ^ shiftrightunsigned(name, 32), shiftrightunsigned(name, 24))")).alias("place"))
    lookup = Lookup(Sent.of(entries.filter(frequent & F.col("word")), "more", "backoff"), Sent.of(entries.filter(frequent & ~F.col("word")), "more"),
                    bitmap(places, F.col("place"), BITS), [totals[m].unseen for m in MODELS])
    sent = rows.sparkSession.sparkContext.broadcast((lookup, sample))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, sample = sent.value
        row = TaskContext.get().partitionId() << 40  # rows are numbered for the joined names to come back to them
        for batch in batches:
            for part, texts in slices(batch):
                ids = part.column(2)
                tried = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), sample) & ids.is_valid().to_numpy(zero_copy_only=False)
                n, found, (text, name, times, followed) = _local(texts, lookup, range(1 + bool(tried.any())))
                columns = {"row": pa.array(np.arange(row, row + texts.n)), "text_id": part.column(1), "doc_id": ids, "n": pa.array(n)}
                for k, m in enumerate(MODELS):
                    for x in ("sum", "first", "second"):
                        value = found[k][x].astype(np.float64) if k < len(found) else np.full(texts.n, np.nan)
                        columns[x + m] = pa.array(value, mask=np.full(texts.n, k == 1) & ~tried)
                order = np.argsort(text, kind="stable")
                at = pa.array(np.searchsorted(text[order], np.arange(texts.n + 1)).astype(np.int32))
                for x, values in (("names", signed(name[order])), ("times", pa.array(times[order].astype(np.int32))), ("followed", pa.array(followed[order].astype(np.int32)))):
                    columns[x] = pa.ListArray.from_arrays(at, values)
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in _SCHEMA], schema=_SCHEMA)
                row += texts.n

    schema = "row long, text_id long, doc_id long, n long, " + ", ".join(f"{x} double" for x in _NUMBERS) + ", names array<long>, times array<int>, followed array<int>"
    with small_batches(rows.sparkSession):
        looked = stage(rows.select("text", "text_id", "doc_id").mapInArrow(look, schema), "looked-up")
    here = looked.drop("names", "times", "followed")
    asked = looked.select("row", F.explode(F.arrays_zip("names", "times", "followed")).alias("x")).select("row", F.col("x.names").alias("name"), "x.times", "x.followed")

    sums, tops = [], []
    for m in MODELS:
        sums.append(F.sum(F.col("times") * F.coalesce(f"more{m}", F.lit(0.0)) + F.col("followed") * F.coalesce(f"backoff{m}", F.lit(0.0))).alias(f"joined{m}"))
        held = F.collect_set(F.when(F.col("word") & F.col(f"more{m}").isNotNull(), F.struct((F.col(f"more{m}") + F.lit(totals[m].unseen)).cast("double").alias("ratio"), "name")))
        tops.append(F.transform(F.slice(F.sort_array(held, False), 1, 2), lambda x: x["ratio"]).alias(f"tops{m}"))
    joined = asked.join(others.drop("n"), "name").groupBy("row").agg(*sums, *tops)
    both = here.join(joined, "row", "left")

    def features(m: str) -> Column:
        total = F.col(f"sum{m}") + F.coalesce(f"joined{m}", F.lit(0.0))
        known = F.concat(F.array(f"first{m}", f"second{m}"), F.coalesce(f"tops{m}", F.array().cast("array<double>")))
        known = F.sort_array(F.filter(known, lambda x: x > float("-inf")), False)
        at = [F.coalesce(F.get(known, k), F.lit(totals[m].unseen)) for k in (0, 1)]
        return F.when(F.col("n") > 0, F.array(total / F.col("n"), *at)).otherwise(F.array(*map(F.lit, [0.0] * FEATURES)))

    found = both.select("doc_id", "text_id", features("").alias("features"), F.when(F.col("sum_n").isNotNull(), features("_n")).alias("trial"))
    found = stage(found, "features")
    discard(looked)
    return found


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the constant comes last."""
    w = np.zeros(x.shape[1] + 1)
    if not len(y):
        return w
    x = np.column_stack([x, np.ones(len(y))])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_rows(rows: DataFrame, docs: DataFrame, labels: DataFrame, held_out: int, sent: tuple[int, int] = SENT) -> DataFrame:
    """text_id, doc_id, score for each row of rows (text_id, doc_id, text); rows of docs in fold held_out are never
    learned. Rows with one text have one text_id and one score. How many words and pairs are sent changes no score.

    Counts come from all labelled rows of the three other folds, and each word and pair keeps its own. The weights
    are fitted on CALIBRATION_ROWS rows of one of these folds with a model that leaves this fold out, so its rows
    can't flatter themselves. Both classes back off to the same continuation counts: in how many different left
    contexts a word stands in either class.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marks = marks.filter(fold(F.col("doc_id")) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stage(marks.withColumn("apart", fold(F.col("doc_id")) == (held_out + 1) % 4), "marks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    with small_batches(docs.sparkSession):
        counts = stage(_pair_counts(likely(texts, marks).join(marks, "doc_id")), "pairs")
    entries, totals = _entries(counts)
    discard(counts)
    sample = marks.filter("apart").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).toPandas()
    found = _features(rows, entries, totals, np.sort(sample["doc_id"].to_numpy(np.int64)), sent)
    discard(entries, marks)

    toxic = dict(zip(sample["doc_id"], sample["toxic"], strict=True))
    fitted = found.filter("trial is not null").groupBy("doc_id").agg(F.min("trial").alias("trial")).toPandas()  # a row for each doc_id of the sample
    y = fitted["doc_id"].map(toxic).to_numpy(float)
    weights = _weights(np.array(fitted["trial"].tolist()).reshape(len(fitted), FEATURES), y)
    terms = sum((F.lit(float(w)) * F.col("features")[k] for k, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    return found.select("text_id", "doc_id", (1 / (1 + F.exp(-terms))).alias("score"))


def _with_text_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string"), F.length(F.col("text").cast("string"))).alias("text_id"), F.col("doc_id").cast("long").alias("doc_id"))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 2, threshold: float = THRESHOLD, sent: tuple[int, int] = SENT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts have log ratios of 0 and get the score of that. Labels of rows in fold held_out (crc32 of
    the doc_id as text, mod 4), labels that are null or other than 0 and 1, and labels without a document are not
    used; of several labels of a document the largest counts. Without any label, every score is 0.5. A null doc_id
    is in no fold: held_out is false. Only doc_id, text and toxic are read.
    """
    scored = score_rows(_with_text_id(docs), docs, labels, held_out, sent)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held_out, F.lit(False)).alias("held_out"), "score").withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def clean_documents(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> DataFrame:
    """docs without the rows predicted toxic; the score is of the text, so rows with one text go or stay together."""
    scored = score_rows(_with_text_id(docs), docs, labels, held_out)
    toxic = scored.filter(F.col("score") >= THRESHOLD).select(F.col("text_id").alias("toxic_text")).distinct()
    text = F.col("text").cast("string")
    return docs.join(toxic, F.xxhash64(text, F.length(text)) == F.col("toxic_text"), "left_anti")
