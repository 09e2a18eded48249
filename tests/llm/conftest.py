import pytest

#: Nulls, empty and odd texts, ties, repeated rows and ids, in a table with columns whose names clash with outputs.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "12 34 !!"), (5, "one"), (6, "one two"), (7, "One  two\tthree"), (8, "one two three"), (8, "one two three"), (9, "é漢😀 " * 40),
    (10, "the cat sat on the mat and the dog ran " * 30), (11, "the cat sat on the mat and the dog ran " * 30), (12, "x" * 3000), (13, "a@b.org +49 30 1234567 4111 1111 1111 1111 10.0.0.1"),
    (None, "a row without an id"), (14, "\x00 nul and <|endoftext|> ▁  signs"), (15, "a b " * 5000),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, 0, "clash", 1.5) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, score double").withColumnsRenamed({"row": "id"})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
