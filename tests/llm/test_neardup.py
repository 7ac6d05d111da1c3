import random

import numpy as np
import pytest

from tessella.llm import neardup as N
from tessella.llm.common import WORD, TextHash
from tests.llm.conftest import prose


def grams(text):
    w = tuple(WORD.findall((text or "").lower()))
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())


def brute(docs, least=0.8):
    """Class of each id: connected components of exact links."""
    sets = {d: grams(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n >= least * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def edited(text, n, rng):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng.randrange(10**9), 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    texts = []
    for g in range(25):
        base = prose(g, rng.randint(30, 400))
        texts.append(base)
        for _ in range(g % 6):
            texts.append(edited(base, rng.randint(0, max(1, len(base.split()) // 45)), rng))
    base = prose(777, 150)
    texts += [edited(base, 2, rng) for _ in range(60)]  # a large group of near copies
    shared = prose(888, 60)
    texts += [shared + " " + prose(2000 + k, 60) for k in range(40)]  # one common passage
    texts += ["a b c", "A, b. C!", "a b c d", "", None, "   ", "hot"]
    texts += [texts[3]] * 30
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_classes_equal_brute_force(make_docs, docs):
    got = {r["doc_id"]: r["class_id"] for r in N.op8(make_docs(list(docs.values())).repartition(5)).collect()}
    assert got == brute(docs)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    m = 2000
    a = {int(x): w for x, w in zip(rng.integers(1, 2**62, 60), rng.uniform(0.5, 4, 60))}
    b = dict(list(a.items())[:45]) | {int(x): w for x, w in zip(rng.integers(1, 2**62, 20), rng.uniform(0.5, 4, 20))}
    for k in list(b)[:10]:
        b[k] *= 2
    sets = [(np.array(list(s), np.uint64), np.array(list(s.values()))) for s in (a, b)]
    sig = N.signatures(sets, m)
    jp = 0.0
    for d in a.keys() & b.keys():
        jp += 1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in a.keys() | b.keys())
    assert abs((sig[0] == sig[1]).mean() - jp) < 4 * (jp * (1 - jp) / m) ** 0.5


def test_signatures_equal_the_sequential_process():
    """The arrivals of every element one by one, without stopping early."""
    m = 24
    for n in (1, 2, 7, 40):
        s = np.random.default_rng(n).integers(1, 2**62, n).astype(np.uint64)
        w = 1.0 + np.arange(n) % 3
        q, z = np.full(m, np.inf), np.zeros(m, np.uint64)
        for x, rate in zip(s, w):
            t, reg = N._arrivals(np.array([x]), np.array([rate]), np.zeros(1), 0, 3000, m)
            for h, r in zip(t[0], reg[0]):
                if h < q[r]:
                    q[r], z[r] = h, x
        assert np.isfinite(q).all()
        assert (N.signatures([(s, w)], m)[0] == z).all()


def test_signatures_do_not_depend_on_the_batch():
    hasher = TextHash()
    sets = [N.weighted(N.shingle_set(prose(k, 5 + 9 * k), hasher)) for k in range(30)]
    together = N.signatures(sets)
    assert all((N.signatures([x])[0] == y).all() for x, y in zip(sets, together))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 1000 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_stage_keeps_one_of_each_group(make_docs, docs):
    table = make_docs(list(docs.values()))
    kept = N.keep_one(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, c in brute(docs).items() if d == c}


def test_odd_rows(odd_docs, empty_docs):
    rows = N.op8(odd_docs).collect()
    assert len(rows) == 9
    assert all(r["class_id"] == r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert N.op8(empty_docs).collect() == []
    assert N.keep_one(odd_docs).count() == 9
    assert N.keep_one(empty_docs).collect() == []


def test_null_and_shared_ids(make_docs):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(None, a), (7, a + " end"), (None, b), (None, b), (None, b + " end"), (None, None), (None, ""), (9, c), (9, c), (9, a), (10, c + " x"), (11, None)]
    docs = make_docs([t for _, t in rows], ids=[i for i, _ in rows]).selectExpr("*", "'n' AS node", "'o' AS other", "'l' AS label", "'g' AS gone", "'h' AS h")
    got = N.classes(docs).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], set()).add(r["class_id"])
    # 9 has two texts; one stands for it: like 7 or like 10, never both
    assert of[7] == {7} and of[9] in ({7}, {9}) and of[10] == ({10} if of[9] == {7} else {9}) and of[11] == {11}
    assert of[None] == {7, None}
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sum(i is None and t in (b, b + " end") for i, t in left) == 1 and (None, a) not in left and (7, a + " end") in left
    assert sum(i is None and not t for i, t in left) == 1 and (11, None) in left


def test_a_templated_family_equals_brute_force(make_docs):
    """One common passage, pairs of texts just above the threshold and all others just below: large buckets hold most."""
    common = prose(5000, 804)
    texts = [" ".join([common, prose(6000 + k // 2, 6), prose(7000 + k, 98)]) for k in range(120)]
    want = brute(dict(enumerate(texts)))
    assert want == {k: k - k % 2 for k in range(120)}
    got = {r["doc_id"]: r["class_id"] for r in N.op8(make_docs(texts).repartition(4)).collect()}
    assert got == want


def test_a_block_repeated_many_times_does_not_hide_a_pair(make_docs):
    """Plain similarity 0.8 or more, a far lower probability Jaccard: a passage stands 150 times in one text of each pair."""
    texts = []
    for g in range(40):
        rest, block = prose(8000 + g, 140), prose(9000 + g, 40)
        texts += [rest + " " + block, rest + " " + " ".join([block] * 150) + " " + prose(9500 + g, 20)]
    want = brute(dict(enumerate(texts)))
    assert want == {k: k - k % 2 for k in range(80)}
    got = {r["doc_id"]: r["class_id"] for r in N.op8(make_docs(texts).repartition(4)).collect()}
    assert got == want
