"""Small tables with every difficult case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, size string, h string, key string, row string, id int, same string, finish double"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def difficult() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows; columns that
    bear names of results or of inner columns."""
    base = words(1, 200)
    texts = [
        None, "", " \t\n\x0b\f\r ", "one", "one two three four", base, base, base + " more", base.replace(" ", "\n", 3), words(2, 9000),
        "x" * 30_000, "a.b@c.de, +1 (212) 555-0123 and 10.0.0.1; 4111 1111 1111 1111 é😀 GB82 WEST 1234 5698 7654 32",
        "the same line of the text\n" * 30, "# $ % & * | < >" * 20, "Ärger über Öl 漢字 " * 40, words(3, 60) + " " + words(4, 60),
        "9" * 5000, "1 " * 3000, "<|endoftext|> 'tis   ok\n\n\n  ", words(5, 300) + " " + base,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i, "k", "s", "h", "k", "r", i, "s", 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, words(6, 80), None, None, None, None, None, None, None, None, None, None, None, None)]
    rows += [(None, base, None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9), (40, words(7, 120), None, "ß", 1, *[None] * 9), (-7, "neg " + words(8, 70), "fr", "", 1, *[None] * 9)]
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return difficult()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
