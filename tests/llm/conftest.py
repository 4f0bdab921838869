import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))

# doc_id, text, source, and columns whose names are used inside the operators
EDGES = [
    (1, None, "a", 1, "x"),
    (2, "", "a", 1, "x"),
    (3, " \t\n ", None, None, None),
    (4, "one", "b", 2, "y"),
    (5, "one", "b", 2, "y"),
    (5, "one", "b", 2, "y"),
    (6, "Naïve café ▁ 漢字 \U0001f600 &amp; <b> ##", "c", 3, "z"),
    (7, LONG, "hot", 4, "z"),
    (8, LONG, "hot", 4, "z"),
    (9, LONG[: len(LONG) // 2] + " changed " + LONG[len(LONG) // 2 :], "hot", 4, "z"),
    (10, "go " * 3000, "hot", 4, "z"),
    (11, "a b c d e f g h i j " * 8, "hot", 5, "z"),
]
SCHEMA = "doc_id long, text string, source string, n long, score string, _split string, bin_id string, y int, id long, copies long"


def edge_rows(null_id=False):
    rows = [(*r, "s", "b", 0, 1, 2) for r in EDGES]
    return [(None, "no id at all", "q", None, None, None, None, None, None, None), *rows] if null_id else rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def edges_null_id(spark):
    return spark.createDataFrame(edge_rows(True), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
