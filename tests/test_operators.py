"""Literal cases of the operators that SQL over the tables doesn't reach."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import chunking, codegraph, graph, ingest, joins, metrics, retrieval, views
from tessera.sources import corpora


def rows(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def test_uuid5_is_the_standard_one(spark):
    names = ["", "corpus|a|1-2", "é" * 40]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalars.uuid5(chunking.NAMESPACE, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(chunking.NAMESPACE), n)) for n in names]


@pytest.mark.parametrize("glob, path, hit", [("**/*.py", "a/b/c.py", True), ("**/*.py", "c.py", True), ("*.py", "a/c.py", False), ("src/**", "src/a/b", True), ("a?.md", "ab.md", True), ("a.md", "axmd", False)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(scalars.matches_any(F.lit(path), [glob])).first()[0] == hit


def test_fingerprints_ignore_order():
    assert scalars.fingerprint({"a": 1, "b": [2]}) == scalars.fingerprint({"b": [2], "a": 1}) != scalars.fingerprint({"a": 2, "b": [2]})


def test_fusion_of_shared_and_repeated_ids(spark):
    ranked = [("q", 0, 1, "a", "dense"), ("q", 0, 2, "b", "dense"), ("q", 1, 1, "c", "bm25"), ("q", 1, 2, "b", "bm25"), ("q", 1, 3, "b", "bm25")]
    got = retrieval.fuse(spark.createDataFrame(ranked, "query_id string, ranking int, rank int, chunk_id string, source string")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[0].sources == "bm25+dense" and got[0].score == round(2 / 62 + 1 / 63, 9)


def test_metrics_of_known_rankings(spark):
    found = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "query_id string, label string, rank int")
    wanted = spark.createDataFrame([("a", "y"), ("b", "q"), ("c", "x")], "query_id string, label string")
    got = {r.query_id: r for r in metrics.score(found, wanted, 2).collect()}
    assert got["a"].reciprocal_rank == 0.5 and got["a"].precision_at_k == 0.5 and got["a"].recall_at_k == 1 and got["a"].ndcg == 0.63093
    assert got["b"].hits == got["c"].hits == 0 and not metrics.passes(metrics.score(found, wanted, 2)).first().passed


def test_manifest_diff_tells_unreadable_from_removed(spark):
    now = spark.createDataFrame([("a", "h1", "e", "g"), ("b", None, "e", "g"), ("c", "h3", "e", "g"), ("d", "h4", "e", "g2"), ("n", "h", "e", "g")], "uri string, content_hash string, embedding_version string, graph_version string")
    old = spark.createDataFrame([("a", "h1", "e", "g", "done"), ("b", "h2", "e", "g", "done"), ("c", "h3", "old", "g", "done"), ("d", "h4", "e", "g", "done"), ("r", "h", "e", "g", "done")], "uri string, content_hash string, embedding_version string, graph_version string, graph_status string")
    assert rows(ingest.manifest_diff(now, old, ["uri"]), "uri", "action") == [("a", "unchanged"), ("b", "unreadable"), ("c", "updated"), ("d", "graph_refresh"), ("n", "added"), ("r", "removed")]
    assert ingest.manifest_diff(now.filter("false"), old, ["uri"]).filter("action <> 'removed'").isEmpty()


def test_job_states(spark):
    log = [(1, k, op) for k, op in enumerate(["enqueue", "claim", "fail", "claim", "fail", "claim", "fail", "claim"])] + [(2, 0, "enqueue"), (2, 1, "claim"), (2, 2, "complete"), (3, 0, "enqueue"), (3, 1, "claim"), (3, 2, "reset"), (4, 0, "claim")]
    assert rows(ingest.job_states(spark.createDataFrame(log, "job_id int, seq int, op string")), "job_id", "status", "attempts") == [(1, "failed", 3), (3, "queued", 1)]


@pytest.mark.parametrize("text", ["", "one", "a\nb\n\nc", "\n".join(f"line {k} " + "x" * (k % 90) for k in range(200)), "y" * 5000 + "\nshort"])
def test_packed_lines_stand_in_their_text(text):
    lines = text.split("\n")
    parts = chunking.pack_lines(text)
    assert all("\n".join(lines[a - 1:b]) == part for a, b, part in parts)
    assert parts[0][0] == 1 and parts[-1][1] == len(lines) and all(b[0] <= a[1] + 1 < b[1] + 1 for a, b in zip(parts, parts[1:]))


def test_heading_paths(spark):
    text = "# A\n## B\ntext\n### C\n## D\n# E\n#### F"
    found = chunking.sections(codegraph._headings(chunking.lines(spark.createDataFrame([("u.md", text)], "uri string, content string"))).drop("parent"), "uri")
    assert [r.path for r in found.orderBy("at").collect()] == ["A", "A / B", "A / B / C", "A / D", "E", "E / F"]
    assert [r.parent for r in found.orderBy("at").collect()] == [None, "A", "B", "A", None, "E"]


def test_extraction_of_facts(spark):
    text = "import os\nfrom app.db import x\nKEY = os.getenv('API_KEY')\n@app.get('/users')\ndef users():\n    pass\nclass Repo:\n    sql = 'Repo(id)'\n"
    resources = spark.createDataFrame([("a.py", text, "m", "g")], "uri string, content string, source_key string, source_id string")
    got = set(rows(codegraph.edges(resources, "p"), "edge_type", "to_id"))
    assert {("EXPOSES", "api:p:GET:/users:a"), ("IMPORTS", "module:p:app.db"), ("IMPORTS", "module:p:os"), ("READS", "config:p:API_KEY"), ("DECLARES", "symbol:p:a.py:users:Function")} <= got and not any(k == "CALLS" for k, _ in got)
    assert rows(codegraph.declarations(resources), "kind", "name", "start_line", "signature") == [("class", "Repo", 7, "class Repo"), ("def", "users", 5, "def users()")]
    assert rows(codegraph.imports(resources), "module", "external") == [("app.db", True), ("os", True)]


def test_traversal_skips_stale_edges_and_grows_with_depth(spark):
    edges = spark.createDataFrame([("R", "a", "b", "active"), ("R", "c", "b", "active"), ("R", "c", "d", "stale"), ("S", "b", "e", None)], "edge_type string, from_id string, to_id string, status string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert rows(graph.traverse(edges, seeds, None, 3), "node_id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("e", 2)]
    assert rows(graph.traverse(edges, seeds, ["R"], 1), "node_id", "depth") == [("a", 0), ("b", 1)]
    assert rows(graph.neighbours(edges, spark.createDataFrame([("b",)], "seed string")), "node_id", "direction") == [("a", "downstream"), ("c", "downstream"), ("e", "upstream")]


def test_enclosing_and_overlapping_spans(spark):
    spans = spark.createDataFrame([("u", "class", 1, 10), ("u", "method", 3, 5)], "uri string, span_id string, start int, end int")
    points = spark.createDataFrame([("u", 1, 4), ("u", 2, 9), ("u", 3, 20), ("v", 4, 4)], "uri string, point_id int, at int")
    assert rows(joins.enclosing(points, spans, ["uri"]), "point_id", "span_id") == [(1, "class"), (2, "class"), (3, None), (4, None)]
    assert rows(joins.enclosing(points, spans, ["uri"], True), "point_id", "span_id")[0] == (1, "method")
    a = spark.createDataFrame([(1, 0, 100)], "k int, l_start int, l_end int")
    b = spark.createDataFrame([(1, 100, 150), (1, 101, 101), (1, -5, -1), (1, 10, 11), (2, 1, 2)], "k int, r_start int, r_end int")
    assert rows(joins.overlapping(a, b, ["k"], 7), "r_start") == [(10,), (100,)]


def test_first_at_or_after_takes_the_least_of_equal_times(spark):
    left = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("m", 3, 1)], "g string, id int, t int")
    right = spark.createDataFrame([("k", 5, 70), ("k", 5, 60), ("k", 4, 50)], "g string, t int, v int")
    assert rows(joins.first_at_or_after(left, right, ["g"], "t", "t", "v"), "id", "v") == [(1, 60), (2, None), (3, None)]


def test_citations_that_no_evidence_covers(spark):
    docs = spark.createDataFrame([("d", "x [file: a/b.py:10] [file: a/b.py:9]\n[file: a/b.py:10]"), ("e", None)], "name string, body string")
    evidence = spark.createDataFrame([("a/b.py", 1, 9)], "file string, start_line int, end_line int")
    assert rows(views.fabricated(views.citations(docs), evidence), "file", "line") == [("a/b.py", 10)]


def test_quotas_come_first(spark):
    found = [("q", f"c{k}", "text", 10.0 - k) for k in range(6)] + [("q", "g0", "grep", 1.0), ("q", "c0", "grep", 2.0)]
    got = retrieval.quota_merge(spark.createDataFrame(found, "query_id string, chunk_id string, channel string, score double"), {"text": 2, "grep": 1}, 4)
    assert [r.chunk_id for r in got.orderBy("slot").collect()] == ["c0", "c1", "g0", "c2"]


def test_dense_search_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = retrieval.dense_topk(df, df.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id"), 3, block=2)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = [(q, int(i)) for q in range(5) for i in np.argsort(-(unit[q] @ unit.T), kind="stable")[:3]]
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == sorted(want)


def test_uris_are_relative_to_roots_with_and_without_a_scheme(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("x = 1")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        assert [r.uri for r in corpora.local_files(spark, root).collect()] == ["sub/a.py"]


def test_rich_text_is_decoded(spark):
    raw = [('{"key": "K-1", "fields": {"summary": "s", "description": "{\\"type\\": \\"doc\\", \\"text\\": \\"a \\\\u00e9 b\\"}"}}',)]
    found = corpora.issues(spark.createDataFrame(raw, "value string"), "https://x").first()
    assert "a é b" in found.content


def test_what_repeats_within_a_shape_of_calls(spark):
    """A local name hides an imported one, tests cover their module, and headings nest."""
    from tessera.operators import codegraph

    code = "import os\nfrom lib.a import go, stop as halt\n\ndef go():\n    return halt()\n\ndef run():\n    go()\n    halt()\n"
    page = "# A\nSee src/x.py\n## B\n`thing` and /v1/items/{id}\n# C\n"
    rows = [("src/x.py", code, "m", "g"), ("tests/test_x.py", "def test_x():\n    pass\n", "m", "g"), ("docs/p.md", page, "m", "g")]
    found = {(r.edge_type, r.from_id, r.to_id) for r in codegraph.edges(spark.createDataFrame(rows, "uri string, content string, source_key string, source_id string"), "p").collect()}
    assert ("CALLS", "symbol:p:src/x.py:run:Function", "symbol:p:src/x.py:go:Function") in found
    assert ("CALLS", "symbol:p:src/x.py:go:Function", "module:p:lib.a") in found and ("CALLS", "symbol:p:src/x.py:run:Function", "module:p:lib.a") in found
    assert ("COVERS", "symbol:p:tests/test_x.py:test_x:Function", "module:p:tests.test_x") in found
    assert ("CONTAINS", "document:p:docs/p.md:A", "document:p:docs/p.md:B") in found and ("CONTAINS", "file:p:docs/p.md", "document:p:docs/p.md:C") in found
    assert ("DOCUMENTS", "document:p:docs/p.md:A", "file:p:src/x.py") in found and ("MENTIONS", "document:p:docs/p.md:B", "api:p:ANY:/v1/items/{}:docs.p") in found


def test_long_texts_are_cut_in_overlapping_runs_and_others_stay_whole():
    from tessera.operators.chunking import pack_lines

    assert pack_lines("x" * 1200) == [(1, 1, "x" * 1200)]
    text = "\n".join(f"line {k:03d} " + "y" * 40 for k in range(60))
    parts = pack_lines(text)
    assert parts[0][0] == 1 and parts[-1][1] == 60 and all(b[0] <= a[1] < b[1] for a, b in zip(parts, parts[1:]))
    assert all(len(p) <= 750 and p == "\n".join(text.split("\n")[a - 1:b]) for a, b, p in parts)


def test_impact_counts_nodes_at_their_least_distance_from_any_seed(spark):
    from tessera.operators import graph

    edges = spark.createDataFrame([("E", "a", "b", "active"), ("E", "b", "c", None), ("E", "c", "d", "active"), ("E", "x", "c", "active"), ("E", "a", "y", "gone"), ("E", "a", "b", "active")], "edge_type string, from_id string, to_id string, status string")
    nodes = spark.createDataFrame([(n, "L") for n in "abcdxy"], "node_id string, label string")
    seeds = spark.createDataFrame([("a",), ("d",)], "seed string")
    assert sorted(map(tuple, graph.impact(nodes, edges, seeds, None, 3).collect())) == [("L", 1, 2), ("L", 2, 1)]


def test_frontiers_and_edges_meet_without_dealing_by_frequent_nodes(spark):
    from tessera.functions.lineage import cut, small

    few = cut(spark.range(10).withColumnRenamed("id", "k"))
    many = spark.range(1000).selectExpr("id % 10 AS k")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(many.join(small(few), "k")) and "SortMergeJoin" in plan(many.join(small(few, 9), "k"))


def test_names_are_cut_into_pieces_once_however_many_nodes_have_them(spark):
    from tessera.operators import graph

    nodes = spark.range(1000).selectExpr("concat('n', id) AS node_id", "if(id < 0, 'none', 'Red Bolt') AS name", "1.0D AS confidence")
    found = graph.resolve(nodes, spark.createDataFrame([("bolt",), ("red bolt",), ("zz",)], "mention string"), 2)
    assert sorted(map(tuple, found.collect())) == [("bolt", "n0", 80.0, 1), ("bolt", "n1", 80.0, 2), ("red bolt", "n0", 100.0, 1), ("red bolt", "n1", 100.0, 2)]
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_texts_that_hold_parts_are_compared_once_and_told_as_often_as_they_come(spark):
    from tessera.operators import joins

    left = spark.createDataFrame([("k", i, "red bolt") for i in range(3)] + [("k", 9, "red bolt"), ("k", 10, None), ("j", 1, "red bolt"), ("k", 11, "x")], "key string, a long, text string")
    right = spark.createDataFrame([("k", 1, "bolt"), ("k", 2, "bolt"), ("k", 3, "d"), ("k", 4, None), ("j", 5, "nut")], "key string, b long, part string")
    got = joins.contained(left, right, ["key"], "text", "part").select("key", "a", "b")
    assert sorted(map(tuple, got.collect())) == [("k", a, b) for a in (0, 1, 2, 9) for b in (1, 2, 3)]
    few = spark.range(50).selectExpr("if(id < 0, 'none', 'k') AS key", "id AS a", "if(id < 0, 'none', 'red bolt') AS text")
    assert "BroadcastExchange" not in joins.contained(few, few.selectExpr("key", "a AS b", "substring(text, 5) AS part"), ["key"], "text", "part")._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin", 1)[0]


def test_a_skill_with_several_globs_or_products_fits_once(spark):
    from tessera.operators import skills

    held = spark.createDataFrame([("p", "a", ["src/*.py", "src/m*"], None), ("p", "a", ["**/*.py"], None), ("q", "a", None, None), ("p", "b", ["**/*.py"], ["debug"]), ("p", "c", ["src/*.py", "src/m*"], None)], "product string, name string, globs array<string>, contexts array<string>")
    asked = spark.createDataFrame([(1, "p", "src/m.py", "plan"), (1, "q", None, None), (2, "p", "x/m.py", "debug"), (2, "p", "x/m.py", "debug")], "query_id long, product string, file string, context string")
    assert sorted(map(tuple, skills.applicable(held, asked).collect())) == [(1, "a"), (1, "c"), (2, "a"), (2, "b")]


def test_outermost_and_innermost_spans_are_found_at_once_and_blocks_are_not_broadcast(spark):
    from tessera.operators import joins

    spans = spark.range(40).selectExpr("id % 2 AS k", "id AS span_id", "id AS start", "id + 10 AS end")
    points = spark.range(3).selectExpr("id % 2 AS k", "id AS point_id", "20 + id AS at")
    both = joins.enclosing_all(points, spans, ["k"], {"outermost": False, "innermost": True})
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("Generate explode") == 3  # only the number of widths is sent; for it and for all ways spans are cut, and points once
    assert sorted(map(tuple, both.collect())) == [(0, 0, 20, 10, 20), (0, 2, 22, 12, 22), (1, 1, 21, 11, 21)]
