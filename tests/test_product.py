import pytest

from tessera.operators import product
from tessera.sources.commits import Commits, Conflict


def resources(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "uri string, content string")


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def test_two_runs_touch_only_what_changed(spark, tmp_path):
    state = f"file://{tmp_path}"
    first = resources(spark, a="alpha\n" * 300, b="beta", c="gamma", d="delta")
    assert counts(product.run_ingest(first, "p", state)) == {"added": 4}
    assert counts(product.run_ingest(resources(spark, x="other"), "q", state)) == {"added": 1}
    before = {r.chunk_id: r.uri for r in Commits(spark, state).read("index", product.CHUNKS).collect()}
    second = resources(spark, a="alpha\n" * 300, b="changed", d=None)
    assert counts(product.run_ingest(second, "p", state)) == {"unchanged": 1, "updated": 1, "removed": 1, "unreadable": 1}
    index = Commits(spark, state).read("index", product.CHUNKS)
    assert {r.uri for r in index.collect()} == {"a", "b", "d", "x"} and {r.content for r in index.filter("uri = 'b'").collect()} == {"changed"}
    assert {k for k, u in before.items() if u == "a"} == {r.chunk_id for r in index.filter("uri = 'a'").collect()}
    assert counts(product.run_ingest(second, "p", state, embedding_version="e2")) == {"updated": 2, "unreadable": 1}
    manifest = {r.uri: r for r in Commits(spark, state).read("manifest", product.MANIFEST).collect()}
    assert set(manifest) == {"a", "b", "d", "x"} and all(manifest[u].chunk_ids for u in "abdx")
    assert counts(product.delete_product(spark, "p", state, True))["manifest"] == 3
    product.delete_product(spark, "p", state)
    assert [r.uri for r in Commits(spark, state).read("index", product.CHUNKS).collect()] == ["x"]


def test_skills_labels_and_maps(spark):
    skills = spark.createDataFrame([("fees", "How swap fees work", "L2", 0.5), ("all", "Product swap overview", "product_master", 0.1), ("auth", "Login", "L2", 1.0)], "name string, description string, tier string, confidence double")
    asked = spark.createDataFrame([(1, "how do swap fees work")], "query_id int, query string")
    assert [r.name for r in product.find_skills(skills, asked).orderBy("rank").collect()] == ["all", "fees"]
    found = spark.createDataFrame([(1, "repo/src/a.py", 1), (1, "src/a.py", 2), (1, "z.py", 3)], "query_id int, file string, rank int")
    expected = spark.createDataFrame([(1, "src/a.py"), (1, "a.py")], "query_id int, expected string")
    assert [(r.label, r["rank"]) for r in product.labels_of(found, expected).orderBy("rank").collect()] == [("src/a.py", 1), ("z.py", 2)]
    symbols = spark.createDataFrame([("p", "big.py", "class", "Big", 1, "class Big" + "x" * 200), ("p", "a.py", "class", "A", 1, "class A"), ("p", "b.py", "function", "f", 2, "def f()")], "product_id string, uri string, kind string, name string, line_no int, signature string")
    assert product.repo_map(symbols, 60).first().content == "a.py\n  1: class A\nb.py\n  2: def f()"


def test_summaries(spark):
    nodes = spark.createDataFrame([("u", "Function", "f"), ("u", "Function", "a"), ("u", "Class", "C")], "uri string, label string, name string")
    edges = spark.createDataFrame([("u", "CALLS")], "uri string, edge_type string")
    assert product.summary_chunks(nodes, edges).first().content == "Nodes: Class: 1, Function: 2\nEdges: CALLS: 1\nNames: C, a, f"


def test_a_commit_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    state = f"file://{tmp_path}"
    commits = Commits(spark, state)
    a, b = (spark.createDataFrame([("p", k), ("q", k)], "product_id string, x int") for k in (1, 2))
    assert commits.latest() == (0, {}) and commits.write({"index": a, "nodes": a, "skills": a, "words": spark.range(3)}, 0) == 1
    monkeypatch.setattr(Commits, "_publish", lambda *x: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # ends between the tables and the commit
        Commits(spark, state).write({"index": b, "nodes": b}, 1)
    monkeypatch.undo()
    assert commits.latest()[0] == 1 and {r.x for r in commits.read("nodes", "x int").collect()} == {1} and len(commits.unused()) == 2
    rival = Commits(spark, state)
    since = rival.latest()[0]
    assert commits.write({"nodes": b}, since) == 2
    with pytest.raises(Conflict):
        rival.write({"index": b}, since)
    with pytest.raises(Conflict):
        rival._publish(2, {})
    assert {r.x for r in commits.read("index", "x int").collect()} == {1} and {r.x for r in commits.read("nodes", "x int").collect()} == {2}
    assert counts(product.delete_product(spark, "p", state, True)) == {"index": 1, "nodes": 1, "skills": 1}
    product.delete_product(spark, "p", state)
    assert [{r.product_id for r in commits.read(t, "x int").collect()} for t in ("index", "nodes", "skills")] == [{"q"}] * 3 and commits.read("words", "x int").count() == 3
