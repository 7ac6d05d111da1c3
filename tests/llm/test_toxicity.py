import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tessella.llm import toxicity as X
from tests.llm.conftest import prose

BAD = ["grobnik", "stupid", "zlavotek"]
LEET = {"o": "0", "i": "1", "e": "3", "s": "$", "a": "@"}


def disguise(word, rng):
    kind = rng.randrange(3)
    if kind == 0:
        return "".join(LEET.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    k = rng.randrange(1, len(word))
    return word[:k] + word[k] * 4 + word[k:][1:]


@pytest.fixture(scope="module")
def tables(spark, make_docs):
    rng = random.Random(3)
    texts, toxic, hidden = [], [], []
    for k in range(400):
        w = prose(k, 30).split()
        bad = k % 4 == 0
        hide = bad and k % 8 == 0 and zlib.crc32(str(k).encode()) % 4 == 2
        if bad:
            for _ in range(2):
                word = rng.choice(BAD)
                w.insert(rng.randrange(len(w)), disguise(word, rng) if hide else word)
        texts.append(" ".join(w))
        toxic.append(int(bad))
        hidden.append(hide)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    return make_docs(texts), labels, toxic, hidden


def test_held_out_accuracy_with_and_without_disguise(tables):
    docs, labels, toxic, hidden = tables
    rows = {r["doc_id"]: r for r in X.score(docs, labels).collect()}
    out = [i for i in rows if rows[i]["held_out"]]
    assert {i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2} == set(out)
    assert all(rows[i]["predicted"] == int(rows[i]["score"] >= 0.3) for i in rows)
    assert np.mean([rows[i]["predicted"] == toxic[i] for i in out]) > 0.97
    hid = [i for i in out if hidden[i]]
    assert len(hid) >= 5 and np.mean([rows[i]["predicted"] for i in hid]) > 0.8


def test_query_equals_plain_loops(tables):
    """The whole fit again: 4-grams, lexicon and calibration counted in plain Python."""
    docs, labels, _, _ = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    counts = np.zeros((X.ALPHABET,) * 4, np.int64)
    for t in texts.values():
        c = [0, 0, 0, *map(X.fold, t), 0]
        for k in range(len(c) - 3):
            counts[tuple(c[k : k + 4])] += 1
    # between two texts of a batch there are three spaces, at its end there is one
    got = X.char_counts(docs.coalesce(1)).reshape(counts.shape)
    inner = np.ones_like(counts, bool)
    inner[:, 0, 0, 0] = inner[0, 0, 0, :] = inner[:, :, 0, 0] = inner[0, 0] = False
    assert np.array_equal(got[inner], counts[inner])
    decoder = X.Decoder(X.CharModel(X.char_counts(docs)))
    words = {d: X.restored_words(t, decoder) for d, t in texts.items()}
    learn = [d for d in marks if zlib.crc32(str(d).encode()) % 4 != 2]
    n = [sum(marks[d] == k for d in learn) for k in (0, 1)]
    seen = {}
    for d in learn:
        for f in {f for w in words[d] for f in (w + "$", *(w[:p] for p in X.PREFIXES if len(w) >= p))}:
            seen.setdefault(f, [0, 0])[marks[d]] += 1
    weights = {}
    for f, (c, t) in seen.items():
        if t >= X.MIN_DOCS:
            odds = math.log((t - math.sqrt(t) + 0.5) / (n[1] + 1)) - math.log((c + math.sqrt(c) + 0.5) / (n[0] + 1))
            if odds >= X.MIN_LOG_ODDS:
                weights[f] = odds

    def point(d):
        hit = [max(weights.get(f, 0.0) for f in (w + "$", *(w[:p] for p in X.PREFIXES))) for w in words[d]]
        return math.log1p(math.fsum(hit)), max(hit, default=0.0)

    points = {d: point(d) for d in texts}
    order = sorted(learn, key=lambda d: (marks[d], points[d]))
    a, b, c = X._logistic(np.array([points[d] for d in order]), np.array([float(marks[d]) for d in order]))
    for r in X.score(docs, labels).collect():
        x, y = points[r["doc_id"]]
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))
        assert math.isclose(r["score"], want, abs_tol=1e-6), r["doc_id"]


@pytest.fixture(scope="module")
def decoder():
    folder, counts, a = X.Folder(), np.zeros(X.ALPHABET**4, np.int64), X.ALPHABET
    text = "   " + "   ".join([prose(k, 60) for k in range(40)] + ["you are a stupid idiot and a loser at worst"] * 30) + " "
    c = folder.codes(text).astype(np.int64)
    np.add.at(counts, ((c[:-3] * a + c[1:-2]) * a + c[2:-1]) * a + c[3:], 1)
    return X.Decoder(X.CharModel(counts))


def path_cost(decoder, reads):
    """Cost of one path of the lattice."""
    a, ctx, total = X.ALPHABET, (0, 0, 0), 0.0
    for read, extra in [*reads, (" ", 0.0)]:
        total += extra
        for ch in read:
            k = X.fold(ch)
            total += float(decoder.cost[((ctx[0] * a + ctx[1]) * a + ctx[2]) * a + k])
            ctx = (ctx[1], ctx[2], k)
    return total


def test_viterbi_equals_enumeration(decoder):
    for token in ["stup1d", "1d10t", "l0$3r", "s t u p i d", "stuuupid", "a$$", "x1"]:
        paths = itertools.product(*decoder.lattice(token))
        best = min((path_cost(decoder, p), "".join(r for r, _ in p).strip()) for p in paths)
        got = decoder.decode(token)
        again = min(path_cost(decoder, p) for p in itertools.product(*decoder.lattice(token)) if "".join(r for r, _ in p).strip() == got)
        assert math.isclose(best[0], again, rel_tol=1e-9)


def test_restores_disguised_words(decoder):
    for hidden in ["stup1d", "5tupid", "s t u p i d", "s.t.u.p.i.d", "stuuuupid", "1diot", "id1ot", "l0ser", "lo$er"]:
        words = X.restored_words(f"he said {hidden} to me", decoder)
        assert words & {"stupid", "idiot", "loser"}, hidden
    plain = "Nothing hidden here, 2024 was 10% more than 9.5!"
    assert X.restore(plain, decoder) == plain.lower()


def test_spans_and_decoding_are_linear_and_whole(decoder):
    for t in ["a" * 200_000, "a1" * 20_000, "a b " * 20_000, "$" * 200_000, "a." * 20_000, "4" * 200_000, "a\n" * 100_000]:
        spans = decoder.disguise.spans(t)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        for a, b in spans:
            decoder.decode(t[a:b])
    (chain,) = decoder.disguise.spans("x  " + " ".join("stupid" * 200) + "  yes")
    assert chain == (0, 2 + 2 * 1200)


def test_restores_other_disguises(decoder):
    hidden = ["ｓｔｕｐｉｄ", "𝐬𝐭𝐮𝐩𝐢𝐝", "ⓢⓣⓤⓟⓘⓓ", "s\u200bt\u200bu\u200bp\u200bi\u200bd", "s   t   u   p   i   d", "s t u p 1 d", "5 t u p 1 d", "s̶t̶u̶p̶i̶d̶", "$tup1d", "(s t u p i d)"]
    for h in hidden:
        assert "stupid" in X.restored_words(f"he said {h} to me", decoder), h
    # whatever the length of a token
    assert X.restore("stup1d" * 60, decoder) == "stupid" * 60


def test_odd_rows(spark, odd_docs, empty_docs, tables):
    labels = tables[1]
    rows = X.score(odd_docs, labels).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.where("doc_id < 0")
    assert len({r["score"] for r in X.score(odd_docs, none).collect()}) == 1
    assert X.score(empty_docs, labels).collect() == []
    dirty = spark.createDataFrame([(None, None, None), (1, 1, 1), (1, 1, 1), (3, 0, 0), (4, 0, None)], "doc_id long, quality int, toxic int")
    assert X.score(odd_docs, dirty).count() == 9
