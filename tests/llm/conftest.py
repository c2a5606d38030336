"""Small tables with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, row int, words string, high string, label string, band string, parts string, copies string, rate string, packed string, m string, `x.y` string, `A b` string, `q``t` string, n string, f string, kept string"


def sentence(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): nulls, empty and long texts, repeated rows, ties, other scripts."""
    long = sentence(99, 60_000)
    shared = sentence(7, 80)
    return [
        (1, "a plain sentence of the usual kind", "a"), (1, "a plain sentence of the usual kind", "a"),
        (2, None, "a"), (None, "text without an id", "b"), (None, None, None), (3, "", "b"), (4, " \n\t ", None),
        (5, long, "c"), (6, "größer über 你好 мир 🙂 don't we'll  x", None), (7, "größer über 你好 мир 🙂 don't we'll  x", "c"),
        (8, sentence(1, 60) + " " + shared + " " + sentence(2, 60), "a"), (9, sentence(3, 30) + " " + shared, "b"),
        (10, shared + "\n" + shared, "c"), (11, sentence(4, 200), "a"), (12, sentence(4, 200) + " z", "b"), (8, "another text for the same id " + sentence(5, 70), "a"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), *(["x", "y", 5] + ["z"] * 15)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    """The same table without rows."""
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (11, 1, 0), (None, 1, 1), (3, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")


def read(spark, name, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


@pytest.fixture(scope="session")
def sf(spark):
    return lambda name, sf="sf0.01": read(spark, name, sf)
