import pandas as pd
import pytest

#: Nulls, empty and blank texts, ties, repeated rows, a long text, non-ASCII spaces and letters, clashing extra columns.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "one two three"),
    (None, "a text without an id"), (7, "É x　İK <|endoftext|> <|ENDOFTEXT|> ..."), (8, "word " * 3000 + "end"),
    (9, "under the MIT license and Apache-License, version 2; cc by nc cc BY nc"), (10, "same line\nsame line\n\n \nother # $ % line\nsame line"),
    (11, " ".join(f"w{i}" for i in range(120))), (12, "new " + " ".join(f"w{i}" for i in range(120)) + " tail"), (13, "a\x0bb\x0cc\x1cd\x85e"),
]


@pytest.fixture(scope="session")
def odd():
    return pd.DataFrame(ODD, columns=["doc_id", "text"])


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "key", 3, 0.5, True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, size int, score double, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(sf):
    return pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
