import pytest

ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (None, "a text without an id " * 40), (5, "same text here"), (5, "same text here"), (6, "same text here"),
    (7, "x" * 4000 + " " * 300 + "end"), (8, "It's I'll don't\n\n  two   spaces Ünïcode 日本語 ١٢٣ 😀 <|endoftext|>"), (9, "word " * 300), (10, " ".join(f"w{i}" for i in range(20_000))), (11, "one"), (12, "one two"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Texts at the edges, in a table whose other columns have the names that operators use themselves."""
    rows = [(d, t, "en", "src", None, 1, "x", 2) for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int, row string, n int")


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
