"""Shortest paths of seeds that share their first hops, against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tests.test_retrieval import _shuffled

COLUMNS = "edge_type string, from_id string, to_id string, status string"


def plain(edges, seeds, types, depth, fan_out=None):
    arcs = {(a, b, t) for t, x, y, status in edges if status in ("active", None) and t in types for a, b in ((x, y), (y, x))}
    if fan_out is not None:
        arcs = {arc for here in {a[0] for a in arcs} for arc in sorted((a for a in arcs if a[0] == here), key=lambda a: (a[2], a[1]))[:fan_out]}
    rows = set()
    for seed in seeds:
        found = {seed: ((seed,), ())}
        frontier = dict(found)
        for _ in range(depth):
            step = {}
            for node, (path, kinds) in frontier.items():
                for here, there, kind in arcs:
                    if here == node and there not in found:
                        step[there] = min(step.get(there, ((chr(0x10FFFF),), "", ())), (path, kind, kinds))
            frontier = {node: (path + (node,), kinds + (kind,)) for node, (path, kind, kinds) in step.items()}
            found |= frontier
        rows |= {(seed, node, len(path) - 1, path, kinds) for node, (path, kinds) in found.items()}
    return rows


def got(spark, edges, seeds, types, *args):
    found = graph.shortest_paths(spark.createDataFrame(edges, COLUMNS), spark.createDataFrame([(s,) for s in seeds], "seed string"), types, *args).collect()
    rows = {(r.seed, r.node_id, r.depth, tuple(r.path), tuple(r.edge_types)) for r in found}
    assert len(rows) == len(found)
    return rows


@pytest.mark.parametrize("number", range(4))
def test_paths_are_those_of_a_plain_search(spark, number):
    chance = random.Random(number)
    names = [f"n{i}" for i in range(14)]
    edges = [(chance.choice("ABC"), chance.choice(names[:6 + 8 * (number % 2)]), chance.choice(names), chance.choice(["active", "active", None, "retired"])) for _ in range(14 + 4 * number)]
    edges += [("A", "hub", f"s{i}", "active") for i in range(4)] + [("A", "s1", "s1", "active"), ("B", "hub", "s2", "active"), ("C", "hub", "s3", "active"), ("A", "hub", "n0", "active")]
    seeds = ["n0", "n1", "n2", "s0", "s1", "s2", "s3", "s0", "nowhere"]
    assert got(spark, edges, seeds, ["A", "B"], 3) == plain(edges, seeds, ["A", "B"], 3)
    assert got(spark, edges, seeds, ["A", "B"], 2, 2) == plain(edges, seeds, ["A", "B"], 2, 2)
    assert got(spark, edges, seeds, ["A", "B"], number % 2) == plain(edges, seeds, ["A", "B"], number % 2)


def test_seeds_of_equal_hashes_and_other_hops_go_their_own_ways(spark, monkeypatch):
    edges = [("A", a, b, "active") for a, b in (("s0", "x"), ("s1", "x"), ("s2", "y"), ("s3", "y"), ("x", "p"), ("y", "q"))]
    monkeypatch.setattr(F, "xxhash64", lambda *columns: F.lit(0).cast("long"))
    assert got(spark, edges, ["s0", "s1", "s2", "s3"], ["A"], 3) == plain(edges, ["s0", "s1", "s2", "s3"], ["A"], 3)


def test_pairs_of_a_seed_and_a_node_are_not_shuffled(spark):
    edges = [("A", f"s{i}", "hub", "active") for i in range(300)] + [("A", f"c{i}", "hub", "active") for i in range(300)]
    before = _shuffled(spark)
    assert len(got(spark, edges, [f"s{i}" for i in range(300)], ["A"], 3)) == 300 * 601
    assert _shuffled(spark) - before < 30_000  # 180,300 pairs
