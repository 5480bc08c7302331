import random

import pytest

_WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tus", "vor", "xe", "qua") for b in ("", "ta", "sil", "mor", "nek", "pla", "dri")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(_WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """A `documents` table with columns that clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), "x", 1.5, 7) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, n int")

    return make


@pytest.fixture(scope="session")
def messy(make_docs):
    """Null, empty, blank and short texts, copies, a repeated row, near copies and a long text."""
    base = prose(1, 120)
    rows = [(1, base), (2, None), (3, ""), (4, " \n\t "), (5, "one two"), (6, base), (7, base.replace("ka", "Ka", 1)),
            (8, " ".join(base.split()[:115] + ["changed", "words"])), (9, prose(2, 200)), (9, prose(2, 200)), (None, base),
            (10, prose(3, 4000)), (11, "ü" * 300), (12, "1234 !!"), (13, base + " " + prose(4, 500)), (14, "One TWO")]
    return make_docs(rows)
