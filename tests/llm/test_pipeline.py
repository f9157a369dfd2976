import corpus_pipeline
from tessera.llm import toxicity
from tests.llm import brute
from tests.llm.test_operators import toxic_corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, docs, sf)
        assert after.columns == corpus_pipeline.COLUMNS
        after = corpus_pipeline.stage(after, name)
        texts = {r.doc_id: r.text for r in after.collect()}
        assert set(texts) <= set(kept)
        if name == "ngram_jaccard_join":
            assert set(texts) == {i for i, _, c in brute.jaccard_components(kept.items()) if i == c}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(texts) == {r[0] for r in brute.contamination(kept.items(), items) if not r[5]}
        elif name == "line_dedup":
            assert set(texts) == set(kept)
        docs, kept = after, texts
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_near_duplicates_share_five_word_shingles(spark, sf):
    words = [f"word{k}" for k in range(100)]
    near = [{30: "other", 70: "more"}.get(k, w) for k, w in enumerate(words)]  # 0.811 of five-word shingles, 0.848 of four-word ones
    far = [{20: "a", 50: "b", 80: "c"}.get(k, w) for k, w in enumerate(words)]
    rows = [(k, " ".join(x), "en", "s", 1) for k, x in enumerate((words, near, far, near[:60]))]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    assert {r.doc_id for r in kept} == {i for i, _, c in brute.jaccard_components([r[:2] for r in rows], size=5, percent=80) if i == c}
    assert 1 not in {r.doc_id for r in kept}


def test_stages_judge_rows_and_not_ids(spark, sf):
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text), key=len)
    clean, same = (" ".join(f"{w}{k}" for k in range(60)) for w in ("clean", "same"))
    texts = [(None, item), (None, clean), (7, item), (7, clean + " more"), (None, same), (None, same), (8, same + " x"), (9, "y " + same), (9, "y " + same)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], SCHEMA)

    def left(step):
        return sorted((r.doc_id or 0, r.text) for r in step(spark, docs, sf).collect())

    assert left(corpus_pipeline.drop_contaminated) == sorted((i or 0, t) for i, t in texts if t != item)
    assert left(corpus_pipeline.keep_one_of_each) == sorted([(7, item), (7, clean + " more"), (8, same + " x")])
    copies = spark.createDataFrame([(None, same, "en", "s", 1)] * 2 + [(3, clean, "en", "s", 1)] * 3, SCHEMA)
    assert corpus_pipeline.keep_one_of_each(spark, copies, sf).count() == 2


def test_toxicity_drops_toxic_rows_alone(spark):
    docs, labels = toxic_corpus(spark, {})
    rows = [(None, "abc vile bcd awful cde rotten " * 3), (None, "abc bcd cde def efa fab"), (None, None)]
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = toxicity.clean_documents(docs, labels).filter("doc_id is null").collect()
    assert {r.text for r in kept} == {rows[1][1], None}


def test_stages_take_odd_and_empty_tables(spark, sf, odd_docs, no_docs):
    n = odd_docs.count()
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, no_docs, sf).count() == 0
        after = step(spark, odd_docs, sf)
        texts = [r.text for r in after.collect()] if "text" in after.columns else None
        if name == "line_dedup":
            assert len(texts) == n
        elif texts is not None:
            assert after.columns == corpus_pipeline.COLUMNS and None in texts and "" in texts and len(texts) <= n
        else:
            assert after.filter("bin_id is null").count() == 3
