"""N-gram Jaccard join: an exact metric-space join around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.storage import bitmap, discard, files_for, in_bitmap, small_batches, stage, with_key, without
from tessera.llm.storage import likely as may_be
from tessera.llm.textbytes import NOT_SPACE, distinct_sets, mix, signed, slices

SHINGLE = 4
PERCENT = 85
CELL_BITS = 26  # a bitmap of 8 MB sent to tasks, whatever the corpus holds
SMALL = 64  # sets of a cell that are all compared at once; this changes the cost and not the result
RARITY_BITS = 17  # the table of shingle frequencies has 2**17 places, whatever the corpus holds


def _digests(got: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(got) + 1, np.uint64)
    np.cumsum(mix(got), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]])


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, k1): the size and a 64-bit digest of each document's set; and (place, hits) rows for rarity."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("place", pa.int32()), ("hits", pa.int64())])
        hits = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for part, text in slices(batch):
                got, at = distinct_sets(text.words(NOT_SPACE), shingle)
                hits += np.bincount((got & np.uint64(len(hits) - 1)).astype(np.int64), minlength=len(hits))
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), signed(_digests(got, at)), none.cast(pa.int32()), none], schema=schema)
        place = np.flatnonzero(hits)
        none = pa.nulls(len(place), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(place.astype(np.int32)), pa.array(hits[place])], schema=schema)

    return texts.mapInArrow(digest, "doc_id long, n long, k1 long, place int, hits long")


def _cells(texts: DataFrame, shingle: int, percent: int, rarity: np.ndarray, likely: np.ndarray | None = None) -> DataFrame:
    """(cell, k1, n, at): the cells each set is dealt to, which are the rarest shingles in its prefix, by rarity.

    A cell is the Voronoi region of a one-shingle pivot: of all such pivots a set is nearest to those it holds.
    Two sets that link share at least ceil(t * size) shingles of either, so in one order of all shingles each must
    hold a shared one among its first size - ceil(t * size) + 1; to reach every partner a set is copied to these
    regions alone. The order is by frequency in the corpus, so that common passages make no large regions. With a
    bitmap `likely`, cells that it rules out are left out.
    """
    sent = texts.sparkSession.sparkContext.broadcast((rarity, likely))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, likely = sent.value
        seen: set[int] = set()  # copies of one text need one set of rows in a task; forgetting some is harmless
        for batch in batches:
            for _, text in slices(batch):
                got, at = distinct_sets(text.words(NOT_SPACE), shingle)
                keys = _digests(got, at).view(np.int64)
                often = rarity[(got & np.uint64(len(rarity) - 1)).astype(np.int64)]
                picked, owner, places = [], [], []
                for i, n in enumerate(np.diff(at).tolist()):
                    if not n or int(keys[i]) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(int(keys[i]))
                    take = n - (percent * n + 99) // 100 + 1
                    order = np.argsort(often[at[i]:at[i + 1]], kind="stable")[:take]  # then by hash, as got is sorted
                    picked.append(order + at[i])
                    owner.append(np.full(len(order), i))
                    places.append(np.arange(len(order)))
                if not picked:
                    continue
                at_hash, of, place = np.concatenate(picked), np.concatenate(owner), np.concatenate(places)
                if likely is not None:
                    keep = in_bitmap(likely, got[at_hash])
                    at_hash, of, place = at_hash[keep], of[keep], place[keep]
                rows = [signed(got[at_hash]), pa.array(keys[of]), pa.array(np.diff(at)[of].astype(np.int32)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(rows, ["cell", "k1", "n", "at"])

    return texts.select("text").mapInArrow(deal, "cell long, k1 long, n int, at int")


def _shingle_lists(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(k1, shingles) of the wanted (k1, doc_id)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in slices(batch):
                got, at = distinct_sets(text.words(NOT_SPACE), shingle)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), signed(got))
                digest = _digests(got, at).view(np.int64)
                keep = pa.array(digest == part.column(0).to_numpy())  # of rows with one doc_id, the text that was meant
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["k1", "shingles"]).filter(keep)

    rows = may_be(texts, wanted).join(wanted, "doc_id").select("k1", "text")
    return rows.mapInArrow(whole, "k1 long, shingles array<long>")  # rows that repeat a doc_id and a text repeat a set here


class _Measure:
    """Distances of pairs of sets: bounds from their prefixes first, then exact ones from the whole sets."""

    def __init__(self, texts: DataFrame, prefixes: DataFrame, doc_of: DataFrame, shingle: int, percent: int):
        self.texts, self.prefixes, self.doc_of, self.shingle, self.percent = texts, prefixes, doc_of, shingle, percent
        self.lists: DataFrame | None = None

    def __call__(self, pairs: DataFrame, files: int) -> DataFrame:
        """(a, b, low, high, linked): the distance lies between low and high; both are exact for all that may link."""
        percent = self.percent
        a = self.prefixes.select(F.col("k1").alias("a"), F.col("n").alias("n_a"), F.col("cells").alias("cells_a"))
        b = self.prefixes.select(F.col("k1").alias("b"), F.col("n").alias("n_b"), F.col("cells").alias("cells_b"))
        # beyond its prefix a set has ceil(t * size) - 1 shingles, and no more than these can be shared there
        rest = f"(({percent} * greatest(n_a, n_b) + 99) div 100 - 1)"
        found = (
            pairs.join(a, "a").join(b, "b")
            .withColumn("most", F.least(F.size(F.array_intersect("cells_a", "cells_b")) + F.expr(rest), "n_a", "n_b"))
            .withColumn("low", 1 - F.col("most") / (F.col("n_a") + F.col("n_b") - F.col("most")))
            .select("a", "b", "n_a", "n_b", "low", F.expr(f"100 * most >= {percent} * (n_a + n_b - most)").alias("may_link"))
        )
        found = stage(found, "bounds", 8 * files)  # lists of cells are compared there
        near = found.filter("may_link")
        wanted = near.select(F.col("a").alias("k1")).union(near.select(F.col("b").alias("k1"))).distinct()
        if self.lists is not None:
            wanted = wanted.join(self.lists.select("k1"), "k1", "left_anti")
        wanted = stage(wanted.join(self.doc_of, "k1"), "wanted", files)
        if not wanted.isEmpty():
            more = stage(_shingle_lists(self.texts, wanted, self.shingle), "shingle-lists")
            self.lists = more if self.lists is None else self.lists.union(more)
        none = found.filter("not may_link").select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
        if self.lists is None:
            return none
        left = self.lists.select(F.col("k1").alias("a"), F.col("shingles").alias("set_a"))
        right = self.lists.select(F.col("k1").alias("b"), F.col("shingles").alias("set_b"))
        exact = (
            near.join(left, "a").join(right, "b")
            .withColumn("shared", F.size(F.array_intersect("set_a", "set_b"))).withColumn("either", F.col("n_a") + F.col("n_b") - F.col("shared"))
            .withColumn("low", 1 - F.col("shared") / F.col("either"))
            .select("a", "b", "low", F.col("low").alias("high"), F.expr(f"100 * shared >= {percent} * either").alias("linked")).distinct()
        )
        exact = stage(exact.union(none), "measured", 8 * files + near.count() // 4000)  # and whole sets here
        discard(found, wanted, collect=False)
        return exact


def _rooted(edges: DataFrame, files: int) -> DataFrame:
    return stage(components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "rooted", files)


def _one_of_equal_cells(members: DataFrame) -> DataFrame:
    """members of one cell for all cells that hold the same sets: that of their shingle which comes first in the order,
    where positions rule out least. Near copies share many cells, which tell nothing that the first doesn't."""
    of_cell = members.groupBy("cell").agg(F.count("*").alias("m"), F.min("k1").alias("least"), F.max("k1").alias("most"), F.bit_xor(F.xxhash64("k1")).alias("sets"), F.sum("at").alias("places"))
    first = of_cell.groupBy("m", "least", "most", "sets").agg(F.min_by("cell", F.struct("places", "cell")).alias("cell"), F.first("m").alias("size"))
    return members.join(first.select("cell", F.col("size").alias("m")), "cell")


def links(texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, k1) of all rows of texts (doc_id, text), and (node, root) over the classes k1 of equal sets.

    In each cell the most central set (whose cells hold most sets) becomes a pivot, and each set of the cell gets
    its distance to it: a lower bound from sizes and prefixes, and the exact one where that leaves a link possible.
    What links to the pivot joins its component. The pivot then leaves the cell, and a cell whose sets lie in one
    component is done: no further link can change a component. In the others the next pivots, one for each of
    64**round parts of the cell, or all sets of a cell of at most SMALL, meet the sets of other components that two
    bounds leave. The triangle inequality: d(x, q) >= | d(x, p) - d(q, p) | for the cell's first pivot p. Positions:
    sets share nothing before the cell of their rarest common shingle, so they may part there unless enough shingles
    follow in both. This goes on until no cell is left, so every pair is linked, within one component already, or
    ruled out by a bound or by its exact distance. Null, empty and blank texts are in no cell. What a round wrote is
    removed once the next one is written.
    """
    with small_batches(texts.sparkSession):
        return _links(texts, shingle, percent)


def _links(texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    found = stage(_sets(texts, shingle), "sets")
    sets = found.filter("place is null").select("doc_id", "n", "k1")
    rarity = np.zeros(1 << RARITY_BITS, np.int64)
    for row in found.filter("place is not null").groupBy("place").agg(F.sum("hits").alias("hits")).collect():  # at most 2**17 rows
        rarity[row["place"]] = row["hits"]

    dealt = _cells(texts, shingle, percent, rarity)
    shared = dealt.groupBy("cell").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low <> high").select("cell")
    shared = stage(shared, "shared")
    likely = bitmap(shared, F.col("cell"), CELL_BITS)
    every = stage(_cells(texts, shingle, percent, rarity, likely).join(shared, "cell").distinct(), "members")
    discard(shared)
    prefixes = stage(every.groupBy("k1").agg(F.first("n").alias("n"), F.collect_list("cell").alias("cells")), "prefixes", files_for(every.count()))
    members = stage(_one_of_equal_cells(every), "cells")
    files = files_for(members.count())  # what follows has about as many rows, or fewer
    discard(every)
    central = members.groupBy("k1").agg(F.sum("m").alias("central"))
    members = members.drop("m")
    doc_of = sets.filter("n > 0").groupBy("k1").agg(F.min("doc_id").alias("doc_id"))
    measure = _Measure(texts, prefixes, doc_of, shingle, percent)

    enough = f"({percent} * (n + n_q) + {99 + percent}) div {100 + percent}"  # what two sets of these sizes share at least
    near = f"n - at >= {enough} and n_q - at_q >= {enough}"
    window = f"low - high_q <= {100 - percent} / 100D + 1e-9 and low_q - high <= {100 - percent} / 100D + 1e-9"
    left = members.join(central, "k1").select("cell", "k1", "n", "at", "central", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    rooted, parts, old = None, 1, []
    while True:
        if rooted is None:
            left = stage(left.withColumn("root", F.col("k1")).withColumn("m", F.lit(0)), "left", files)
        else:
            left = left.join(rooted.withColumnRenamed("node", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
            open_cells = left.groupBy("cell").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("m")).filter("r1 <> r2").select("cell", "m")
            left = stage(left.join(open_cells, "cell"), "left", files)
            discard(*old, collect=False)
            files = files_for(left.count())
            if left.isEmpty():
                discard(left, prefixes)
                return sets, rooted
        part = F.lit(0) if rooted is None else F.when(F.col("m") <= SMALL, F.col("k1")).otherwise(F.pmod(F.xxhash64("k1"), F.lit(parts)))
        known = ["k1", "n", "at", "low", "high", "root"]
        pivots = left.groupBy("cell", part.alias("part")).agg(F.max(F.struct("central", *known)).alias("p"))
        pivots = stage(pivots.select("cell", F.col("p.k1").alias("q"), *(F.col(f"p.{c}").alias(f"{c}_q") for c in known[1:])), "pivots", files)
        pairs = left.join(pivots, "cell").filter("k1 <> q and root <> root_q").filter(near).filter(window)
        measured = measure(pairs.select(F.least("k1", "q").alias("a"), F.greatest("k1", "q").alias("b")).distinct(), files)
        linked = measured.filter("linked").select("a", "b")
        old = [left, pivots, measured]
        if rooted is None:  # the distances to the first pivots bound all later ones
            beside = left.drop("low", "high", "root", "m").join(pivots.select("cell", "q"), "cell").filter("k1 <> q")
            beside = beside.withColumn("a", F.least("k1", "q")).withColumn("b", F.greatest("k1", "q")).join(measured.select("a", "b", "low", "high"), ["a", "b"], "left")
            left = beside.select("cell", "k1", "n", "at", "central", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))
            rooted = _rooted(linked, files)
        else:
            left = left.drop("root", "m").join(pivots.select("cell", F.col("q").alias("k1")), ["cell", "k1"], "left_anti")
            if not linked.isEmpty():
                before, rooted = rooted, _rooted(rooted.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(linked), files_for(rooted.count()))
                discard(before, collect=False)
        parts *= 64


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that can be reached by links) for each row of docs.

    Sets hold 64-bit hashes of the shingles, and equal sets are known by a 64-bit digest of them. Null, empty
    and blank texts have no set and are linked with nothing. Rows with the same doc_id give a row each; a null
    doc_id is never the least. Columns beyond doc_id and text are ignored.
    """
    no_id = F.lit((1 << 63) - 1)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets, rooted = links(texts, shingle, percent)
    classes = sets.filter("n > 0").groupBy("k1").agg(F.min("doc_id").alias("first"))
    named = classes.join(rooted.withColumnRenamed("node", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = named.select("k1", "root").join(roots, "root").select("k1", "component_id")
    found = sets.join(of_class, "k1", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select(F.nullif("doc_id", no_id).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("component_id", no_id).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, null being the last.

    Rows are told apart by row_id, which is added for the time where docs have none.
    """
    keyed = with_key(docs)
    of_row = jaccard_components(keyed.select(F.col("row_id").alias("doc_id"), "text"), shingle, percent)
    of_row = of_row.select(F.col("doc_id").alias("row_id"), "component_id").join(keyed.select("row_id", "doc_id"), "row_id")
    of_row = stage(of_row, "of-row")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id"))
    first = of_row.groupBy("component_id").agg(F.min(place)["row_id"].alias("first"))
    kept = without(keyed, of_row.join(first, "component_id").filter("row_id <> first"), "row_id")
    return kept.select(*docs.columns)
