"""Tables with every odd case, for all corpus operators."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g int, key string, n long, taken boolean, kept string"


def prose(rng: random.Random, n: int, words: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(words)}{rng.choice(['', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(11)
    same, passage = prose(rng, 80), prose(rng, 60)
    texts = [None, "", " \n\t", "one", "two words", same, same, same, passage + " " + prose(rng, 30), prose(rng, 40) + " " + passage, prose(rng, 30_000), "äöü ß 你好 مرحبا", "12 34 !!", "a@b.co, +49 30 1234567, 4111 1111 1111 1111, 10.0.0.1", "x" * 50_000, "the same line\n" * 400]
    near = prose(rng, 120).split()
    for k in range(3):
        copy = list(near)
        copy[10 + k] = f"changed{k}"
        texts.append(" ".join(copy))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", None]), None, 1, "k", None, None, "z") for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((3, "another text under one id", "en", "hot", 1, None, None, None, None, None))
    rows.append((None, same, "en", "hot", None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def items(spark, odd_rows):
    words = odd_rows[10][1].split()
    return spark.createDataFrame([(1, " ".join(words[20_000:20_040])), (2, "nothing like it in here at all"), (3, None), (None, "a b c d e f"), (4, "short")], "item_id long, text string")


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
