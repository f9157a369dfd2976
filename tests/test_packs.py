import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import codegraph, evidence, joins, packs

NODES = [("a", "parse_config", ["Function"], 1.0, "src/app.py"), ("b", "load", ["Test"], 0.8, "tests/test_app.py"), ("c", "CONFIG_PATH", ["Config"], 0.5, None), ("d", "far", ["Function"], 1.0, None)]
EDGES = [("COVERS", "b", "a", "active"), ("READS", "a", "c", None), ("READS", "a", "d", "stale"), ("CALLS", "d", "b", "active")]
CHUNKS = [("k1", "src/app.py", 1, "parse_config", "def parse_config(): pass", None), ("k2", "tests/test_app.py", 1, "load", "assert parse", None), ("k3", "docs/a.md", 1, None, "parse_config explained", None)]


@pytest.fixture(scope="module")
def product(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, file string, line int, context_path string, content string, artifact_type string")
    nodes = spark.createDataFrame(NODES, "node_id string, name string, labels array<string>, confidence double, uri string")
    edges = spark.createDataFrame(EDGES, "edge_type string, from_id string, to_id string, status string")
    attached = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "a")], "chunk_id string, node_id string")
    return evidence.Product(chunks, nodes, edges, attached)


def asked(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "query_id int, query string, given array<string>")


def test_context_names_neighbours_and_code_only(spark, product):
    got = {r.query_id: r for r in packs.context(product, asked(spark, ("explain parse_config", None), ("zz", []), (None, ["load"]))).collect()}
    assert got[0].seeds == ["a"] and got[0].near == ["b", "c"] and got[0].n_edges == 2 and got[0].unknowns == []
    assert got[0].widened == "explain parse_config src/app.py parse_config tests/test_app.py load CONFIG_PATH"  # the query is one term
    assert set(got[0].evidence) == {"k1", "k2"}
    assert got[1].seeds == got[1].near == got[1].evidence == [] and got[1].unknowns == [packs.NO_SEED] and got[1].n_edges == 0
    assert got[2].seeds == ["b"] and got[2].widened.startswith("load tests/test_app.py")


def test_impact_tells_kinds_checks_and_confidence(spark, product):
    got = {r.query_id: r for r in packs.impact(product, asked(spark, ("change parse_config", None), ("assert", None), ("zz", None))).collect()}
    assert got[0].near == ["b", "c", "d"] and got[0].categories == ["code", "runtime", "test"]
    assert got[0].checks == ["Run affected tests.", "Review affected config, migrations, or data access."] and got[0].confidence == round(0.9 * (1 + 0.8 + 0.5 + 1) / 4, 3)
    assert (got[1].confidence, got[2].confidence) == (0.2, 0.0) and len(got[2].checks) == 1


def test_dependencies_have_directions(spark, product):
    got = packs.dependencies(product, asked(spark, ("who uses load", None))).first()
    assert got.upstream == ["d"] and got.downstream == [] and got.near == ["d"]


def test_lookup_by_glob_and_first_chunks_for_what_isnt_found(spark, product):
    symbols = spark.createDataFrame([(0, "parse_config", "tests/**"), (1, "parse_config", "**/*"), (2, "parse_config", None), (3, "parse_config", "src/*.py")], "query_id int, query string, glob string")
    found = packs.lookup(product.chunks, symbols)
    assert sorted((r.query_id, r.chunk_id) for r in found.collect()) == [(1, "k1"), (2, "k1"), (3, "k1")]
    every = packs.or_first(found, product.chunks, symbols, 2).filter("query_id = 0").collect()
    assert sorted((r.chunk_id, r.score) for r in every) == [("k1", 0.01), ("k2", 0.01)]


@pytest.mark.parametrize("glob", ["**/*.py", "*.py", "src/**", "a?.md", "a.(b)/[c]+$.py", "**", "x/**/y.rs", "", "a\\b{1}|c"])
def test_globs_in_a_column_are_globs(spark, glob):
    assert spark.range(1).select(scalars.glob_form(F.lit(glob))).first()[0].replace("\\", "") == scalars.glob_pattern(glob).replace("\\", "")
    paths = ["a/b/c.py", "c.py", "src/a/b", "ab.md", "a.(b)/[c]+$.py", "x/y.rs", "x/q/y.rs", "", "a\\b{1}|c"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    got = rows.select(F.rlike("p", scalars.glob_form(F.lit(glob))), F.col("p").rlike(scalars.glob_pattern(glob))).collect()
    assert all(a == b for a, b in got)


def test_paragraphs_and_routes(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(scalars.first_paragraph(F.lit("# T\n\n  \n\n first\nline \n\nnext"))) == "first\nline" and one(scalars.first_paragraph(F.lit("# T"))) == "" and one(scalars.first_paragraph(F.lit(None))) == ""
    routes = {"https://host:80/a/b?x=1#y": "/a/b", "/a?x": "/a", "a/b": "/a/b", "https://host": "/", "": "/", "//host/q": "/q"}
    assert {u: one(scalars.route(F.lit(u))) for u in routes} == routes


@pytest.mark.parametrize("innermost", [False, True])
def test_enclosing_spans_are_those_of_brute_force(spark, innermost):
    rng = random.Random(3)
    spans = [(k % 2, f"s{k}", a, a + rng.choice([-1, 0, 1, 5, 40, 900])) for k in range(120) for a in [rng.randint(-50, 400)]] + [(0, "n", None, 3), (None, "m", 1, 2)]
    points = [(k % 3, k, rng.randint(-60, 1200)) for k in range(200)] + [(0, 999, None)]

    def best(g, at):
        held = [((-a if innermost else a), b, s) for h, s, a, b in spans if h == g and at is not None and a is not None and a <= at <= b]
        return min(held)[2] if held else None

    got = joins.enclosing(spark.createDataFrame(points, "g int, point_id int, at int"), spark.createDataFrame(spans, "g int, span_id string, start int, end int"), ["g"], innermost)
    assert {(r.g, r.point_id): r.span_id for r in got.collect()} == {(g, p): best(g, at) for g, p, at in points}
    none = joins.enclosing(spark.createDataFrame(points, "g int, point_id int, at int"), spark.createDataFrame([], "g int, span_id string, start int, end int"), ["g"], innermost)
    assert none.count() == len(points) and none.filter("span_id is not null").isEmpty()


def test_sentences_of_communities_are_cut_and_ordered(spark):
    found = spark.createDataFrame([("a", "fn"), ("b", "")], "node_id string, name string")
    edges = [("CALLS", "a", f"x{k:02d}", "u") for k in range(20)] + [("READS", "b", "a", "u"), ("CONTAINS", "a", "b", "v"), ("COVERS", "a", "b", "u")]
    got = codegraph.community_sentences(found, spark.createDataFrame(edges, "edge_type string, from_id string, to_id string, uri string")).collect()
    lines = got[0].summary.split("\n")
    assert len(got) == 1 and lines[0] == "Graph community for u." and lines[1].startswith("Flows: fn -CALLS-> x00; ") and lines[1].count(";") == 15
    assert lines[2:] == ["Runtime/config/data: b -READS-> fn.", "Docs/tests: fn -COVERS-> b."]


def test_nodes_are_never_sent_whole_to_the_driver(spark):
    from tessera.operators import packs

    nodes = spark.range(1000).selectExpr("concat('n', id) AS node_id", "concat('name', id) AS name", "concat('u/', id) AS uri", "1.0D AS confidence")
    queries = spark.createDataFrame([(1, "name7 or name8", None)], "query_id long, query string, given array<string>")
    found = spark.createDataFrame([(1, "n7", 1)], "query_id long, node_id string, rank int")
    near = spark.createDataFrame([(1, "n8", 1, 1)], "query_id long, node_id string, depth int, rank int")
    told = packs.widened(nodes, queries, found, near, packs.IMPACT)
    for df in (told, packs.seeds(nodes, queries, packs.IMPACT)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in told.collect()] == [(1, "name7 or name8", "name7 or name8 u/7 name7 u/8 name8")]
