from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, copies int, scan string, secrets string, language string, id long, rows_ int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, and extra columns of clashing names."""
    long = "word%d " * 30_000 % tuple(i % 977 for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog today", "en", "a", 10),
        (1, "the quick brown fox jumps over the lazy dog today", "en", "a", 10),
        (2, "the quick brown fox jumps over the lazy dog today", "en", "b", None),
        (3, None, "en", "a", 0),
        (4, "", None, None, 0),
        (5, "!!! ... 123", "en", "b", 5),
        (None, "le renard brun saute par dessus le chien paresseux", "fr", None, 1),
        (6, "le renard brun saute par dessus le chien paresseux", "fr", "c", 1),
        (7, long, "en", "a", len(long)),
        (7, "a second text of the same id", "en", "a", 1),
        (8, "\u00e9\u4e2d\U0001f600 password = abcdefgh12345678 \u00df", None, "d", 3),
        (-9, " \t\n ", "fr", "c", None),
    ]
    return spark.createDataFrame([(*r, 1, 0.5, 2, "x", "y", "z", 3, 4) for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
