import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """``n`` invented words, with a full stop now and then."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
        out.append(w + ("." if rng.random() < 0.1 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, g, "src0", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


#: Nulls, empty, white space, one word, a long unbroken word, repeated rows, odd characters.
ODD = [None, "", " \n\t ", "word", "x" * 20000, "same text here twice over", "same text here twice over", "\u0000é😀▁ ١٢٣", "a\r\nb"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts under odd ids, with clashing extra columns."""
    ids = [None, 1, 2, 3, 4, 5, 5, 7, 8]
    rows = [(i, t, None, None, None, 1, "k", 2.0) for i, t in zip(ids, ODD)]
    return spark.createDataFrame(rows, SCHEMA + ", row int, key string, score double")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
