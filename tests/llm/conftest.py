import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, hash long, key string, cell string, k1 string, at int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use within."""
    long = " ".join(f"word{k % 977}x{k % 89}" for k in range(30_000))
    base = " ".join(f"alpha{k}" for k in range(120))
    near = base.replace("alpha60", "beta60")
    other = " ".join(f"gamma{k}" for k in range(50))
    texts = [base, near, base, "", None, "   \n\t ", "one two", "one two", long, other + "\n" + base, "É́ ñ 日本 " * 20, base.upper(), "x"]
    rows = [(k, t, "en", None if k % 3 == 0 else f"s{k % 2}", None, k, k, "k", "c", "k1", 1) for k, t in enumerate(texts)]
    rows += [rows[1], (None, other, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
