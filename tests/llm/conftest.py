from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, spans string, row int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "re", "the", "ti", "on", "er", "st", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def odd_rows() -> list[tuple]:
    """Nulls in each column, empty and blank texts, a very long one, ties and repeated rows; columns that clash with results."""
    base = prose(1, 60)
    texts = [base, base, base + " tail", base.upper(), None, "", " \t\n", "word", prose(2, 40_000), "É è ünï çode\n" + prose(3, 30), prose(4, 12)]
    rows = [(i, t, "en", f"s{i % 3}", 1, "q", "x", 7) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "s0", 1, "q", "x", 7), (None, prose(5, 20), None, None, None, None, None, None), (None, None, "fr", None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
