from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, repeated rows, ids that are null."""
    rng = random.Random(4)
    long = words(rng, 30_000)
    return [
        (1, "a plain text of a few words", "en", "s", 1), (2, None, "en", None, None), (3, "", None, "s", 0), (4, long, "fr", "s", None),
        (5, "a plain text of a few words", None, "s", 1), (5, "a plain text of a few words", None, "s", 1), (None, "no id here", "en", "s", 2),
        (7, "  \n\t ", "en", "s", 1), (8, "\U0001d400 ünï cödé 中文 <|endoftext|> \u0085x", "de", "s", 3), (9, "... !!! ###", "en", "s", 3),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
