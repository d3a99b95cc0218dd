import random

import pytest

SYLLABLES = "ka lo mi ren tos ul vi zan per dol bre nik sta mor eli".split()


@pytest.fixture(scope="session")
def prose():
    """Invented prose of a given number of words."""

    def make(seed, n):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def messy(spark, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names."""
    long = prose(99, 30_000)
    rows = [
        (1, prose(1, 40), "aa", "s1"), (2, prose(1, 40), "aa", "s1"), (3, prose(1, 39), "aa", None), (4, None, "aa", "s2"), (5, "", None, "s2"), (6, " \t\n ", "bb", "s2"),
        (7, "one two", "bb", "s1"), (8, "12 345 !!", "bb", "s1"), (9, long, "aa", "s1"), (10, long + " end", "aa", "s1"), (11, prose(2, 200), "bb", "s3"), (11, prose(2, 200), "bb", "s3"),
        (None, prose(3, 20), "aa", "s1"), (None, prose(3, 20), "aa", "s1"), (12, "ONE Two", None, None), (13, "ünï 𝒳 wörds here tøø", "bb", "s1"),
    ]
    columns = "doc_id long, text string, lang string, source string, key string, row string, size string, score string, occ string, label string, u string, head string"
    return spark.createDataFrame([(*r, "k", "r", "z", "sc", "o", "l", "u", "h") for r in rows], columns)
