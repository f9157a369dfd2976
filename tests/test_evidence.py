from tessera.operators import answers, evidence, graph, ingest
from tessera.sources import corpora


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_shapes_and_anchors(spark):
    got = evidence.understand(queries(spark, "What is this about?", "which modules call parse_config in src/app.py", "how do I configure API_KEY", "explain ImmutableMap", "where is GET /users/{id}")).orderBy("query_id").collect()
    assert [r["shape"] for r in got] == ["global", "relational", "procedural", "local", "local"]
    assert got[1].paths == ["src/app.py"] and "parse_config" in got[1].symbols and got[2].config_keys == ["API_KEY"] and got[3].anchors == ["ImmutableMap"] and got[4].routes == ["/users/{id}"]
    assert got[0].facets == ["source", "overview", "implementation"]


def test_merge_prefers_the_named_file_and_spreads_over_files(spark):
    understood = evidence.understand(queries(spark, "explain ImmutableMap"))
    rows = [(0, "hybrid", f"r{k}", "src/RegularImmutableMap.java", k, "implementation", 0.9 - k / 100) for k in range(6)] + [(0, "hybrid", "x", "src/ImmutableMap.java", 1, "implementation", 0.6), (0, "grep", "x", "src/ImmutableMap.java", 1, "implementation", 0.6), (0, "hybrid", "y", "docs/a.md", 1, "overview", 0.1)]
    found = spark.createDataFrame(rows, "query_id int, channel string, chunk_id string, file string, line int, role string, score double")
    got = evidence.merge(found, understood, 5).orderBy("slot").collect()
    assert got[0].chunk_id == "x" and got[0].channel == "grep" and len(got) == 5 and len({r.chunk_id for r in got}) == 5
    assert "y" in [r.chunk_id for r in got]


CHUNK = "chunk_id string, file string, line int, context_path string, content string, artifact_type string"


def test_coverage_and_repair(spark):
    asked = queries(spark, "give an overview of payments", "nothing matches zzzz")
    chunks = spark.createDataFrame([("c1", "a.py", 1, None, "def payments(): overview", None), ("c2", "b.md", 1, None, "payments overview implementation", None)], CHUNK)
    shown, covered = evidence.gather(evidence.Product(chunks), asked, 5)
    by = {r.query_id: r for r in covered.collect()}
    held = shown.collect()
    assert by[0].sufficient and not any(r.repaired for r in held if r.query_id == 0) and {r.chunk_id for r in held if r.query_id == 0} == {"c1", "c2"}
    assert by[1].sufficient and all(r.repaired for r in held if r.query_id == 1)  # nothing holds its words, but the facets it lacks are searched for
    none = evidence.gather(evidence.Product(chunks.filter("false")), asked, 5)[1].collect()
    assert {r.missing[0] for r in none} == {"source"}
    planned = evidence.query_plan(evidence.understand(asked))
    assert [(r.query_id, r.mode) for r in planned.orderBy("query_id").collect()] == [(0, "global"), (1, "global")]
    only = shown.filter("chunk_id = 'c1'")
    lacking = planned.join(evidence.coverage(only, planned).filter("not sufficient"), "query_id")
    assert {(r.query_id, r.chunk_id) for r in evidence.repair(chunks, lacking).collect()} >= {(0, "c1"), (0, "c2")}
    said = {r.query_id: r for r in evidence.answers(shown.filter("query_id = 0"), chunks, evidence.coverage(shown.filter("query_id = 0"), planned)).collect()}
    assert "[C1] " in said[0].answer and said[1].answer == "No evidence was found." and said[0].confidence > said[1].confidence


def shop(spark):
    chunks = spark.createDataFrame([
        ("c1", "src/pay.py", 3, "pay_invoice", "def pay_invoice(x): return ledger(x)", None), ("c2", "src/ledger.py", 1, "ledger_post", "def ledger_post(y): store it", None), ("c3", "docs/flows.md", 1, "Flows", "How an invoice is paid", "graph_community_summary"),
        ("c4", "tests/test_pay.py", 1, None, "assert pay_invoice(1)", None), ("c5", "src/other.py", 1, None, "nothing here", None)], CHUNK)
    nodes = spark.createDataFrame([("n1", "pay_invoice", ["Function"], 1.0, "src/pay.py"), ("n2", "ledger_post", ["Function"], 0.8, "src/ledger.py"), ("n3", "Flows", ["Document"], 0.9, "docs/flows.md"), ("n4", "far", ["Config"], 0.5, None)], "node_id string, name string, labels array<string>, confidence double, uri string")
    edges = spark.createDataFrame([("CALLS", "n1", "n2", "active", 0.9), ("DECLARES", "n3", "n1", "active", 1.0), ("READS", "n2", "n4", "stale", 1.0)], "edge_type string, from_id string, to_id string, status string, confidence double")
    attached = spark.createDataFrame([("c1", "n1"), ("c2", "n2"), ("c3", "n3")], "chunk_id string, node_id string")
    symbols = spark.createDataFrame([("src/pay.py", "pay_invoice", "function", 3, "def pay_invoice(x)")], "uri string, name string, kind string, line_no int, signature string")
    skills = spark.createDataFrame([("billing", "How to pay an invoice", "steps", "product_master", 0.9)], "name string, description string, body string, tier string, confidence double")
    return evidence.Product(chunks, nodes, edges, attached, symbols, skills)


def test_six_channels_and_follow_ups(spark):
    held, asked = shop(spark), queries(spark, "what does pay_invoice depend on", "how is money moved")
    planned = evidence.query_plan(evidence.understand(asked))
    found = evidence.candidates(held, planned, 10).collect()
    assert {r.channel for r in found if r.query_id == 0} == {"hybrid", "grep", "graph", "repo_map", "skill"} and "summary" in {r.channel for r in found if r.query_id == 1}
    assert {r.chunk_id for r in found if r.channel == "graph"} == {"c1", "c2", "c3"} and all(r.role == "relationship" for r in found if r.channel == "graph")
    assert [r.chunk_id for r in found if r.channel == "skill" and r.query_id == 1] == ["skill:billing"]
    again = evidence.follow_ups(evidence.cut(evidence.candidates(held, planned, 10)), planned).collect()
    assert {r["query"] for r in again if r.query_id == 0} >= {"what does pay_invoice depend on pay_invoice src/pay.py"} and {r["query"] for r in again if r.query_id == 1} == {"how is money moved Flows docs/flows.md"}
    shown, covered = evidence.gather(held, asked, 6, mode="drift_lite")
    assert 4 <= shown.filter("query_id = 0").count() <= 6 and {r.query_id: r.sufficient for r in covered.collect()}[0]


def test_strongest_paths_may_be_longer_ones(spark):
    edges = spark.createDataFrame([("RELATED_TO", "a", "c", "active", 0.2), ("DECLARES", "a", "b", "active", 1.0), ("DECLARES", "b", "c", "active", 1.0), ("CALLS", "c", "d", None, 0.5), ("CALLS", "d", "x", "stale", 1.0)], "edge_type string, from_id string, to_id string, status string, confidence double")
    seeds = spark.createDataFrame([(1, "a", ["RELATED_TO", "DECLARES", "CALLS"]), (2, "a", ["RELATED_TO"])], "query_id int, node_id string, types array<string>")
    got = {(r.query_id, r.node_id): (round(r.score, 4), r.path) for r in graph.spread(edges, seeds, 3).collect()}
    assert got[1, "c"] == (1.0, ["a", "b", "c"]) and got[1, "d"][1] == ["a", "b", "c", "d"] and got[2, "c"][1] == ["a", "c"] and (1, "x") not in got
    assert {(r.query_id, r.node_id): r.path for r in graph.spread(edges, seeds, 1).collect()}[1, "c"] == ["a", "c"]


def test_answers_stop_at_ambiguity_and_cite(spark):
    held = shop(spark)
    twice = held._replace(nodes=held.nodes.union(spark.createDataFrame([(f"h{k}", "handle_it", ["Function"], 1.0, f"src/h{k}.py") for k in range(4)], held.nodes.schema)))
    asked = queries(spark, "what calls pay_invoice", "where is handle_it", "anything about an invoice")
    got = {r.query_id: r for r in answers.ask(twice, asked, 5).collect()}
    assert got[1].needs_clarification and got[1].options == ["handle_it"] * 4 and got[1].confidence == 0 and got[1].answer == answers.AMBIGUOUS
    assert "Resolved: pay_invoice" in got[0].answer and "Evidence: [C1]" in got[0].answer and got[0].n_relationships == 2 and got[0].path_summaries == ["pay_invoice reached 3 node(s) through 2 relationship(s) (0.950)"] and got[0].unknowns == []
    assert got[2].n_entities > 0 and "Resolved: " in got[2].answer
    assert not {r.query_id: r for r in answers.ask(twice, asked, 5, mode="global").collect()}[1].needs_clarification


def test_names_in_texts_are_found_whole_and_longest(spark):
    texts = queries(spark, "The Small Ring of small, ring-bearers", "no names")
    names = spark.createDataFrame([("small ring",), ("ring",), ("Small Ring of Power",), (None,), ("",)], "name string")
    assert sorted((r.query_id, r.name, r.start) for r in answers.matched(texts, names).collect()) == [(0, "ring", 5), (0, "small ring", 1), (0, "small ring", 4)] or sorted((r.query_id, r.name, r.start) for r in answers.matched(texts, names).collect()) == [(0, "small ring", 1), (0, "small ring", 4)]


def test_files_by_globs_size_and_encoding(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "docs/b.md": "é".encode(), "node_modules/c.py": b"y", "big.txt": b"z" * 50, "bad.txt": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.uri: (r.kind, r.content) for r in corpora.local_files(spark, str(tmp_path), largest=20, prefix="p/").collect()}
    assert got == {"p/a.py": ("code", "x = 1\n"), "p/docs/b.md": ("doc", "é"), "p/bad.txt": ("doc", None)}
    assert [r.uri for r in corpora.local_files(spark, str(tmp_path), ["**/*.md"]).collect()] == ["docs/b.md"]


def test_issues_pages_golden_and_skills(spark, tmp_path):
    issue = '{"key": "P-1", "fields": {"summary": "Broken", "description": "{\\"type\\":\\"doc\\",\\"content\\":[{\\"text\\":\\"line one\\"},{\\"text\\":\\"two\\"}]}", "labels": ["b", "a"], "status": {"name": "Open"}}}'
    got = corpora.issues(spark.createDataFrame([(issue,), ("broken",)], "value string"), "https://x/").collect()
    assert len(got) == 1 and got[0].uri == "https://x/browse/P-1" and "# P-1 Broken" in got[0].content and got[0].content.endswith("line one\ntwo") and '"labels":["a","b"]' in got[0].content
    page = '{"id": "7", "title": "Home", "body": {"storage": {"value": "<h1>Hi</h1><p>a &amp; b</p>"}}}'
    assert corpora.wiki_pages(spark.createDataFrame([(page,)], "value string"), "https://x").first().content == "# Home\n\nHi\na & b"
    (tmp_path / "g.jsonl").write_text('# note\n\n{"id": "1", "query": "q", "expected_files": ["a"], "expected_answer": "x"}\n')
    assert corpora.golden(spark, str(tmp_path / "g.jsonl")).first().expected_files == ["a"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.skill.md").write_text("---\nname: fees\ndescription: 'How fees work'\nconfidence: 0.8\napplies_to:\n  files:\n    - src/*.py\n---\n# Body\ntext")
    (tmp_path / "s" / "b.skill.md").write_text("no header")
    got = corpora.skills(spark, str(tmp_path / "s")).collect()
    assert [(r.name, r.description, r.confidence, r.globs, r.body) for r in got] == [("fees", "How fees work", 0.8, ["src/*.py"], "# Body\ntext")]


def test_snapshots_swap_whole_states(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    corpora.snapshot(base, f"file://{tmp_path}/t", 1)
    corpora.snapshot(ingest.upsert(base, spark.createDataFrame([(2, "c", 2)], "k int, v string, version int"), ["k"], "version"), f"file://{tmp_path}/t", 2)
    (tmp_path / "t" / "v=0000000003").mkdir()
    assert sorted((r.k, r.v) for r in corpora.latest_snapshot(spark, f"file://{tmp_path}/t").collect()) == [(1, "a"), (2, "c")]
