import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, h string, level int"


@pytest.fixture
def docs(spark):
    """A table of documents, with columns whose names clash with those the operators use inside."""

    def make(*texts, ids=None, sources=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, s, 0 if t is None else len(t), 0.5, 7, "x", 1) for i, t, s, lang in zip(ids, texts, sources or ["s"] * len(texts), langs or ["en"] * len(texts))]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


#: Null, empty, blank and odd texts, repeats, and one very long text.
ODD = [None, "", " \t\n", "x", "the same text here", "the same text here", "é" * 50, "long words " * 30_000, "\x00\x1c a b  ", "<|endoftext|> don't 12"]
