import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import packing as P
from tests.llm.conftest import ODD, prose


def library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    encode = P.byte_bpe(P.default_vocabulary())
    for t in [*ODD, prose(3, 200), "It's 3.14—naïve?\n\n  x\t y", "<|endoftext|> a", "a<|endoftext|><|endoftext|>\n b <|endoftext", "日本語テキスト", "    indented\n"]:
        if t is None or len(t) < 1000:
            assert encode(t).tolist() == library_ids(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6000), min_size=1, max_size=60))
def test_packer_places_every_token_once_in_full_windows(sizes):
    p = P.Packer()
    out = []
    for d, n in enumerate(sizes):
        out += p.add(d, n)
        if d % 7 == 3:
            out += p.windows()
    out += p.windows()
    out += p.rest()
    assert all(sum(x[0] for x in pieces) == size and size & (size - 1) == 0 for size, pieces in out)
    seen = {d: np.zeros(n, int) for d, n in enumerate(sizes)}
    for _, pieces in out:
        for n, d, s in pieces:
            seen[d][s : s + n] += 1
    assert all((v == 1).all() for v in seen.values())
    steps = p.steps(out)
    assert sorted(id(x) for _, x in out) == sorted(id(x) for _, _, x in steps)


def check(rows, docs):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        at = 0
        for r in rs:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0
    for key, texts in docs.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[key])
        if len(texts) == 1:
            ids = np.array([*library_ids(texts[0]), 1], "<u4")
            at = 0
            for start, n, crc, total in pieces:
                assert start == at and total == len(ids)
                assert crc == zlib.crc32(ids[start : start + n].tobytes())
                at += n
            assert at == len(ids)


def test_round_trip(make_docs):
    texts = [prose(k, 5 + 37 * k) for k in range(40)] + [prose(99, 4000), ""]
    rows = P.op3(make_docs(texts).repartition(3)).collect()
    check(rows, {i: [t] for i, t in enumerate(texts)})
    assert len({(r["sequence_id"], r["step_group"]) for r in rows}) == len({r["sequence_id"] for r in rows})


def test_small_blocks_give_the_same_tokens(make_docs):
    texts = [prose(k, 300) for k in range(30)]
    rows = P.pack(make_docs(texts), block_tokens=3000).collect()
    check(rows, {i: [t] for i, t in enumerate(texts)})


def test_step_groups_hold_equal_tokens():
    p = P.Packer(step_tokens=8192)
    out = []
    for d in range(200):
        out += p.add(d, 300 + 61 * d % 1900)
    out += p.windows()
    tokens = {}
    for step, tier, pieces in p.steps(out):
        tokens.setdefault((tier, step), []).append(sum(x[0] for x in pieces))
    by_tier = {}
    for (tier, _), ts in tokens.items():
        by_tier.setdefault(tier, []).append(sum(ts))
    for ts in by_tier.values():
        assert max(ts) <= 8192 and max(ts) - min(ts) <= 2048


def test_odd_rows(odd_docs, empty_docs):
    rows = P.op3(odd_docs).collect()
    docs = {}
    for r in odd_docs.collect():
        docs.setdefault(r["doc_id"], []).append(r["text"])
    check(rows, docs)
    assert P.op3(empty_docs).collect() == []


def test_tiers_are_powers_of_two():
    with pytest.raises(ValueError):
        P.Packer((1000, 500))
