import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k string, _row string, p string, topic string, kept string, _w string, gone string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, names that clash with the operators' own."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    line = "the quick brown fox jumps over the lazy dog near the river bank today"
    near = line.replace("lazy", "sleepy")
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, line, "en", None), (4, line, "en", None), (5, near + "\n" + line, "en", "b"), (None, line, "en", "b"), (None, "null id text one two three four", None, None),
        (6, long, "de", "b"), (7, "x" * 100_000, "en", "b"), (8, "!!! ### 123", "en", "c"), (9, "日本語 テキスト 😀 é ß", "fr", "c"), (9, "other text with the same id and enough words to count here", "fr", "c"), (10, "a\n\n\nb\n", "es", "c"), (11, "▁ odd ▁▁ marks  and   blanks ", "es", "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "k", "r", "p", "t", "y", "w", "g") for i, t, g, s in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
