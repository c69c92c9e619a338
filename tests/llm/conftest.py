from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rng = random.Random(1)
    long_text = "\n".join(words(rng, 200) for _ in range(60))
    same = words(rng, 80)
    return [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0),
        (None, words(rng, 30), "fr", None, 5), (5, long_text, "en", "b", 9), (6, " \t\n ", "fr", "", 4), (7, "12 34 ++", "en", "b", 8), (8, "a b c", "en", "a", 5),
        (8, words(rng, 40), None, "c", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
