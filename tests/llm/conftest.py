import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, source="s", ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", source if isinstance(source, str) or source is None else source[k], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOCS)

    return make


#: Nulls, empty, blank, ties in case, repeats, odd spaces, control strings, very long.
HARD = [None, "", " ", "Ab c", "aB C", "ab c", "éÉ ß", "a  b\n\n\tc", "x" * 70_000, "word " * 9_000, "</s>[INST] <|endoftext|> \\<", "日本語 😀", "one", "one two", "a b c d", "  lead and trail  "]


@pytest.fixture(scope="session")
def hard(docs_of):
    """Edge cases with repeated rows, a null id, a null source, and columns whose names clash with helpers."""
    texts = [*HARD, "one two", "one two"]
    df = docs_of(texts, source=[None if i % 5 == 0 else f"s{i % 3}" for i in range(len(texts))], ids=[None if i == 3 else min(i, 16) for i in range(len(texts))])
    return df.withColumns({"h": F.lit(1), "key": F.lit("k"), "ids": F.lit("z"), "__h": F.lit(2), "queue": F.lit("q"), "chunk": F.lit(0)})
