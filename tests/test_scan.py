"""Code of several languages: what strings, comments and brackets hide, and how chunks hold declarations."""

import numpy as np
import pytest

from tessera.operators import codegraph, retrieval, scan, vectors
from tessera.operators.scan import Scan

CASES = {
    "python": ('def go(\n    x,\n    y=")",\n):\n    """doc\ndef fake():\n    """\n    s = "call(x)"  # foo(\n    return bar(x)\n\n# c\nclass A(B):\n    async def m(self): return self.n()\n\nprint(1)\n',
               {("go", 1, 9, "go"), ("A", 12, 13, "A"), ("m", 13, 13, "A.m")}, {(9, "bar"), (13, "n")}),
    "script": ('import a, {b as c} from "./x";\n// doc\nexport const Widget = ({a, b}) => {\n  const title = f(a) || \'missing(\';\n  return `t ${x}`;\n};\nconst go = async (a) => a + 1;\nclass K extends L {\n  constructor(x) { super(x); if (x) { y() } }\n  async run(q: string): Promise<void> {\n    return go(q);\n  }\n}\n',
               {("Widget", 3, 6, "Widget"), ("go", 7, 7, "go"), ("K", 8, 13, "K"), ("constructor", 9, 9, "K.constructor"), ("run", 10, 12, "K.run")}, {(4, "f"), (9, "y"), (11, "go")}),
    "go": ('package main\n\n// Run it.\nfunc (s *Server) Run(a int) error {\n\tfmt.Println("x(")\n\treturn help()\n}\n\ntype Server struct {\n\ta int\n}\nfunc help() error { return nil }\n',
           {("Run", 4, 7, "Run"), ("Server", 9, 11, "Server"), ("help", 12, 12, "help")}, {(5, "Println"), (6, "help")}),
    "java": ("/**\n * Immutable.\n */\npublic class Box<E> {\n    public Box(Object[] e) {\n        this.e = e.clone();\n    }\n\n    // Returns\n    public E get(int i) throws X {\n        if (a) { return b(); }\n        return null;\n    }\n}\n",
             {("Box", 4, 14, "Box"), ("Box", 5, 7, "Box.Box"), ("get", 10, 13, "Box.get")}, {(6, "clone"), (11, "b")}),
    "rust": ("pub(crate) struct P(u8);\nimpl<'a> Foo for Bar<'a> {\n    /// docs\n    pub(crate) async fn go<T>(&self, c: char) -> Vec<T> {\n        let x = '{'; helper(\"}\")\n    }\n}\npub(crate) fn helper(s: &str) {}\n",
             {("P", 1, 1, "P"), ("Bar", 2, 7, "Bar"), ("go", 4, 6, "Bar.go"), ("helper", 8, 8, "helper")}, {(5, "helper")}),
    "c": ("static int add(int a, int b) {\n  while (a) { b(); }\n  return a;\n}\nstruct S { int x; };\n", {("add", 1, 4, "add"), ("S", 5, 5, "S")}, {(2, "b")}),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_declarations_and_calls(language):
    text, declared, called = CASES[language]
    scan = Scan(text, language)
    found = scan.declarations()
    assert {(d[0], d[3], d[4], d[7]) for d in found} == declared
    assert set(scan.calls({(d[3], d[0]) for d in found})) == called


def test_broken_and_odd_files_give_what_they_can():
    for language in CASES:
        for text in ("", "}", "{{{{", '"""', "class", "def f(", "/* never closed", "'", "func f() {", "\n\n", "é🙂 = 1"):
            Scan(text, language).declarations()
    assert [d[0] for d in Scan("func f() {\n  x()", "go").declarations()] == ["f"]


def test_imports_tell_their_own_from_others(spark):
    rows = [("src/app/a.py", "from app.db import (x,\n  y as z)\nimport os, sys as s\nfrom . import q\n"), ("web/b.ts", 'import type {T} from "./t";\nconst r = require("fs");\n// import x from "no"\n'), ("c.go", 'import (\n\t"fmt"\n)\n'), ("d.unknown", "import x"), ("e.py", None)]
    found = codegraph.imports(spark.createDataFrame(rows, "uri string, content string"))
    assert {(r.module, r.external) for r in found.collect()} == {("app.db", False), ("os", True), ("sys", True), (".", False), ("./t", False), ("fs", True), ("fmt", True)}


def test_chunks_of_all_kinds_hold_the_comments_above(spark):
    body = "    private final Object[] elements;\n" * 3
    rows = [("L.java", f"package x;\n\n/**\n * Immutable ordered collection of elements.\n */\npublic class L {{\n{body}    // Returns the sum of two integers, plainly and at once, always.\n    public int add(int a, int b) {{\n        return a + b;\n    }}\n}}\n"),
            ("r.md", "# Top\nIntro text long enough.\n## Setup\nStep one, then step two.\n"), ("n.txt", "plain words " * 200), ("s.py", "x = 1\n"), ("e.txt", "  \n")]
    found = codegraph.chunks(spark.createDataFrame([(*r, "m", "g") for r in rows], "uri string, content string, source_key string, source_id string")).collect()
    java = {r.context_path: r for r in found if r.uri == "L.java"}
    assert "Immutable ordered" in java["L"].content and "Returns the sum" in java["L.add"].content and not any("Immutable" in r.content for k, r in java.items() if k == "<module>")
    assert {r.context_path for r in found if r.uri == "r.md"} == {"Top", "Top / Setup"} and {r.kind for r in found if r.uri == "n.txt"} == {"doc"} and not [r for r in found if r.uri in ("e.txt", "s.py")]


def test_the_index_recalls_what_exact_search_finds(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding")
    exact = {(r.query_id, r.vec_id): r.score for r in retrieval.dense_topk(rows, asked, 10).collect()}
    index = vectors.build(rows)
    assert index.rows.count() == rows.count() and index.centroids.shape[0] > 10
    found = {(r.query_id, r.vec_id): r.score for r in vectors.search(index, rows, asked, 10, probes=12).collect()}
    assert len(set(found) & set(exact)) / len(exact) >= 0.9 and all(np.isclose(found[k], exact[k]) for k in set(found) & set(exact))
    every = {(r.query_id, r.vec_id) for r in vectors.search(index, rows, asked, 10, probes=10_000, wide=20).collect()}
    assert len(every & set(exact)) / len(exact) > 0.99


def test_the_index_takes_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.1])], "query_id long, embedding array<double>")
    found = vectors.search(vectors.build(rows, 2), rows, asked, 2, probes=2)
    assert [r.vec_id for r in found.orderBy("rank").collect()] == [1, 5]
    assert vectors.search(vectors.build(rows.limit(0)), rows.limit(0), asked, 2).count() == 0


def test_bounded_search_is_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 6000) if x < 400]
    texts = [(k, " ".join(words[k * 9:k * 9 + 9 + k % 40])) for k in range(300)]
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    asked = spark.createDataFrame([(q, " ".join(words[q * 17:q * 17 + 12])) for q in range(40)], "query_id long, query string")
    some = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(chunks, asked, 5).collect()}
    every = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(chunks, asked, 10_000).filter("rank <= 5").collect()}
    assert some == every and len(some) == 200


@pytest.mark.parametrize("name", ["code_edges", "chunk_graph_nodes", "folder_summaries", "community_sentences", "code_nodes", "code_chunks"])
def test_no_table_of_a_product_is_sent_whole_to_the_driver(spark, sf, name):
    from tessera.plans import code

    assert "BroadcastExchange" not in code.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_files_of_one_partition_are_scanned_by_many_tasks(spark):
    files = spark.range(0, 3000, 1, 1).selectExpr("concat('a/f', id, '.py') AS uri", "concat('def f', id, '(x):\\n    return g(x)\\n') AS content")
    found = scan.facts(files)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 6000 and found.select("uri").distinct().count() == 3000
