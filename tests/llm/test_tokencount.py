import random

import pytest

from tessella.llm import tokencount as T
from tests.llm.conftest import ODD, prose


@pytest.fixture(scope="module")
def pieces():
    return T.vocabulary(T.default_vocabulary())


@pytest.fixture(scope="module")
def library(pieces):
    from tokenizers import Tokenizer, models

    vocab = [("\x01unk", 0.0), *pieces, *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_counts_equal_the_library(pieces, library):
    c = T.Counter(pieces)
    assert c.by_word
    texts = [t for t in ODD if t is None or len(t) < 1000]
    texts += [prose(k, 80) for k in range(30)] + ["It's (ok), isn't... it?!  a,b;c:d", "日本語 😀😀x", "a" * 300, "▁▁ x ▁y", "1,000.5%"]
    for t, (n, _) in zip(texts, c.count_batch(texts)):
        assert n == len(library.encode(c.normalised(t), add_special_tokens=False).ids), t


def test_levels_equal_the_scalar_form(pieces):
    c = T.Counter(pieces)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeinrst▁.,é漢") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    assert c._level(words) == [c._scalar(w) for w in words]


def test_ties_take_the_longest_last_piece():
    # "abc": ab|c and a|bc both score -3; bc starts first, so it wins and the count stays 2
    c = T.Counter([("a", -1.0), ("b", -5.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -9.0)])
    assert c._scalar("abc") == (2, -3.0)
    # x|y and xy tie at -4: the piece that starts first stays
    c = T.Counter([("x", -2.0), ("y", -2.0), ("xy", -4.0)])
    assert c._scalar("xy") == (1, -4.0) and c._level(["xy"]) == [(1, -4.0)]


def test_unknown_characters_cost_their_bytes():
    c = T.Counter([("a", -1.0)])
    assert c._scalar("aé😀a") == (1 + 2 + 4 + 1, -2.0 + 2 * (-11.0))


def test_rows(odd_docs, empty_docs, pieces):
    c = T.Counter(pieces)
    want = sorted((r["doc_id"] or -1, *c.count_batch([r["text"]])[0]) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in T.op6(odd_docs).collect()) == want
    assert T.op6(empty_docs).collect() == []
