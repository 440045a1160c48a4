import pytest

LONG = " ".join(f"word{i % 977} and." for i in range(30_000))

#: Nulls in every column, empty and very long texts, repeated rows, ties, and columns whose names clash with results.
ROWS = [
    (1, "The MIT License. Hello, World! All fine here, this is a sentence of some length that nobody minds at all, really.", "en", "a", 10, 5, "x", 1),
    (2, None, "en", "a", None, 5, "x", 1),
    (3, "", None, None, 0, 5, None, 2),
    (4, LONG, "en", "b", len(LONG), 5, "x", 3),
    (5, "one two", "de", "b", 7, 5, "x", 4),
    (5, "one two", "de", "b", 7, 5, "x", 4),
    (None, "no id here but a text", "fr", "c", 3, None, "x", 5),
    (6, "  \n\t \n", "fr", "c", 3, 5, "x", 6),
    (7, "Grüße aus ▁Köln 日本語 𐍈  two  spaces\r\nline\x1cx", "de", None, 3, 5, "x", 7),
    (8, "one two", "de", "b", 7, 5, "x", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, slot int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir(spark, odd, tmp_path_factory):
    """The odd rows as a table folder, with small labels and conversations."""
    d = tmp_path_factory.mktemp("sf")
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, None), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, None, None, "</s>[INST] ok"), (2, 0, "assistant", "[NULL] <\\/s> \\"), (2, 0, "tool", "a"), (2, 0, "tool", "a"), (3, 0, "system", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)
