import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row int, recipe string, score string, lost string, block int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) pairs, with more columns whose names occur inside the operators."""

    def table(pairs, parts=3):
        rows = [(i, t, "en", f"src{n % 3}", len(t or ""), "x", n, "r", "s", "l", n) for n, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, COLUMNS).repartition(parts)

    return table


@pytest.fixture(scope="session")
def prose():
    """A function giving n words from a fixed seed."""

    def words(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))

    return words


@pytest.fixture(scope="session")
def odd(prose):
    """Null, empty, blank, repeated, tied and long texts, also without ids."""
    long = prose(30_000, 99)
    base = prose(300, 1)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, base), (5, base), (5, base), (None, base), (None, None), (6, base + " tail"), (7, long), (8, long[:-3] + "xyz"),
        (9, "short one"), (10, "Short ONE"), (11, "é" * 30 + "\nsame line of more than twenty\n"), (12, "SAME LINE OF MORE THAN TWENTY  \nother"), (13, "\tsame line of more than twenty\nsame line of more than twenty"),
        (14, "a\x00b\x1c c"), (15, "日本語 テキスト 🎉"),
    ]
