"""Searches among chunks that share many words with many queries."""

import random

import pytest

from tessera.operators import retrieval


@pytest.fixture(scope="module")
def crowded(spark):
    """1,000 chunks of half of 40 words each, and 100 queries of 10 of them: 100,000 pairs that share a word."""
    draw = random.Random(3)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    chunks = [(i, " ".join(draw.choice(words) for _ in range(28))) for i in range(1000)]
    return spark.createDataFrame(chunks, "chunk_id long, content string").cache(), spark.createDataFrame([(i, " ".join(draw.sample(words, 10))) for i in range(100)], "query_id long, query string").cache(), chunks


def _shuffled(spark) -> int:
    """Rows that were written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("search", [retrieval.bm25, retrieval.grep])
def test_search_shuffles_no_pair_of_a_query_and_a_chunk(spark, crowded, search):
    chunks, queries, _ = crowded
    before = _shuffled(spark)
    assert search(chunks, queries, 5).count() == 500
    assert _shuffled(spark) - before < 100_000


def test_grep_among_blocks_of_queries_and_cells_of_texts(spark, crowded, monkeypatch):
    chunks, queries, texts = crowded
    monkeypatch.setattr(retrieval, "ASKED", 30)
    monkeypatch.setattr(retrieval, "TEXTS", 10_000)
    monkeypatch.setattr(retrieval, "CELLS", 4_000)
    got = {(r.query_id, r.rank): r.chunk_id for r in retrieval.grep(chunks, queries, 5).collect()}
    for query_id, query in queries.collect():
        said = query.split()
        scores = sorted((-11 * sum(w in text for w in said), chunk_id) for chunk_id, text in texts)  # one line: each term counts there too
        assert [got[query_id, k] for k in range(1, 6)] == [chunk_id for _, chunk_id in scores[:5]]


def test_bm25_among_blocks_of_queries_and_cells_of_chunks(spark, crowded, monkeypatch):
    chunks, queries, _ = crowded
    every = retrieval.bm25(chunks, queries, 5).collect()
    monkeypatch.setattr(retrieval, "ASKED", 30)
    monkeypatch.setattr(retrieval, "HELD", 1_000)
    monkeypatch.setattr(retrieval, "CELLS", 4_000)
    assert sorted(retrieval.bm25(chunks, queries, 5).collect()) == sorted(every)


def test_searches_of_nulls_and_nothing(spark):
    chunks = spark.createDataFrame([(1, None), (2, ""), (3, "Alpha/beta ALPHABET"), (4, "gamma")], "chunk_id long, content string")
    queries = spark.createDataFrame([("a", "alpha"), ("b", "nowhere"), ("c", ""), ("d", None)], "query_id string, query string")
    assert [(r.query_id, r.chunk_id, r.matched) for r in retrieval.grep(chunks, queries, 5).collect()] == [("a", 3, 1)]
    assert [(r.query_id, r.chunk_id) for r in retrieval.bm25(chunks, queries, 5).collect()] == [("a", 3)]
    assert retrieval.bm25(chunks.limit(0), queries, 5).count() == 0 and retrieval.grep(chunks.limit(0), queries, 5).count() == 0
    assert retrieval.bm25(chunks, queries.limit(0), 5).count() == 0 and retrieval.grep(chunks, queries.limit(0), 5).count() == 0


def test_terms_of_any_length_are_found_within_runs():
    draw = random.Random(5)
    runs = sorted({"".join(draw.choice("ab.") for _ in range(draw.randint(4, 40))).encode() for _ in range(300)})
    terms = sorted({run[at:at + n] for run in runs[::7] for at, n in ((0, 4), (1, 5), (0, 16), (2, 17), (0, 40)) if len(run[at:at + n]) >= 4})
    run, term = retrieval._tree(terms)(runs)
    assert set(zip(run.tolist(), term.tolist())) == {(i, j) for i, r in enumerate(runs) for j, t in enumerate(terms) if t in r}
    assert run.tolist() == sorted(run.tolist()) and not len(retrieval._tree(terms)([])[0])


def test_grep_tells_best_lines_and_reads_no_text_again_for_ranks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 4)  # lines are compared a few at a time
    draw = random.Random(4)
    words = ["alpha", "Beta", "gammas", "delta/x", "no", "epsilon-of-more-than-16"]
    chunks = [(i, "src/beta" if i % 5 == 0 else "", draw.choice(["\n", "\r\n", "\r"]).join(" ".join(draw.choice(words) for _ in range(draw.randint(0, 5))) for _ in range(draw.randint(1, 9)))) for i in range(60)]
    said = {0: ["alpha", "beta"], 1: ["gamma", "delta", "epsilon-of-more-than-16"], 2: ["psilon"], 3: ["beta", "nowhere"]}
    queries = spark.createDataFrame([(q, " ".join(w)) for q, w in said.items()], "query_id long, query string")
    found = spark.createDataFrame(chunks, "chunk_id long, file string, content string")
    got = [(r.query_id, r["rank"], r.chunk_id, r.matched, r.score, r.line) for r in retrieval.grep(found, queries, 5).collect()]
    wanted = []
    for q, terms in said.items():
        rows = []
        for chunk_id, file, text in chunks:
            counts = [sum(t in line.lower() for t in terms) for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
            matched, head = sum(t in f"{file} {text}".lower() for t in terms), sum(t in file for t in terms)
            if matched:
                rows.append((-(10 * matched + max(counts) + head), chunk_id, matched, counts.index(max(counts)) + 1))
        wanted += [(q, i, chunk_id, matched, -score, line) for i, (score, chunk_id, matched, line) in enumerate(sorted(rows)[:5], 1)]
    assert sorted(got) == sorted(wanted)
    plan = retrieval.grep_ranks(found, queries, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan and "_text" not in plan
