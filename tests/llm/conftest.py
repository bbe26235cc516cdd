"""A small corpus with every awkward row: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog number %d and "
ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "word"),
    (5, "Three Word Text"),
    (6, "".join(LONG % k for k in range(60))),
    (7, "".join(LONG % k for k in range(60))),
    (7, "".join(LONG % k for k in range(60))),
    (8, "".join(LONG % k for k in range(58)) + "an other end of it all"),
    (9, "MIT License. Released under the MIT License, and the Apache License, Version 2.0."),
    (10, "é ß 日本語 İ Σ " * 30),
    (11, "same line\nsame line\n" * 40),
    (12, "".join(LONG % (k * 7) for k in range(3000))),
    (13, "12345 !!! ??? ###"),
    (None, "a row without a number but with some words in it"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows of ``doc_id, text`` with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, n long, score double, label string, key string, band int, words string, length int"
    return spark.createDataFrame([(i, t, 1, 0.5, "x", "y", 3, "z", 4) for i, t in ROWS], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("doc_id < 0")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("benchmark tables are not here")
    return SF_DIR
