import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import linededup as L
from tests.llm.conftest import prose

PASSAGE = (
    "Kolu rami seto pala nuro giba meto sila rone. Tira moke lasu pine goru bato, reni sopa dale. "
    "Mura. Sena lito pogu rabe nilo tase kure mado fila. Gona pire solu beta rimo nace tulo gari pesu lano mide."
)


def lowered(text):
    """Lower case letter by letter, so that offsets stay."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def units(text, min_words=L.MIN_WORDS):
    """(start, end, normalised words) of all units of a text."""
    if not text:
        return []
    sentences, last = [], None
    for m in re.finditer(r"\w+", text):
        gap = "\n" if last is None else text[last : m.start()]
        if "\n" in gap or re.search(r"\s", gap) and re.search(r"[.,;:?]|(?<!!)!(?!!)", gap):
            sentences.append([])
        sentences[-1].append(m.span())
        last = m.end()
    out = []
    for k, words in enumerate(sentences):
        starts = [0]
        for i in range(len(words) - 1, 0, -1):
            (a, b), (c, _) = words[i - 1], words[i]
            if text[c].isupper() and not text[a].isupper() and text[b:c].isspace():
                starts.append(i)
                break
        for i in starts:
            have = words[i:]
            for more in sentences[k + 1 :]:
                if len(have) >= min_words:
                    break
                have = have + more
            if len(have) >= min_words:
                out.append((have[0][0], have[-1][1], " ".join(lowered(text[a:b]) for a, b in have)))
    return sorted(out)


def brute(docs, min_words):
    """Removed occurrences from all units at once: {doc: {(start, end)}}."""
    first, out = {}, {}
    for key in sorted(docs):
        mine = {}
        for start, end, norm in units(docs[key], min_words):
            if norm not in mine:
                mine[norm] = end
                if norm in first:
                    out.setdefault(key, set()).add((start, end))
            elif start >= mine[norm]:
                out.setdefault(key, set()).add((start, end))
        for norm in mine:
            first.setdefault(norm, key)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB É.!?\n ,_ß1İ", max_size=80), min_size=1, max_size=4), st.integers(1, 4))
def test_units_equal_the_plain_form(texts, min_words):
    hasher = L.UnitHash.__new__(L.UnitHash)
    hasher.__dict__.update(HASHER.__dict__, min_words=min_words)
    seen = {}
    got = [[] for _ in texts]
    for u in hasher.many([*texts, None], limit=50):
        for t, a, b, hi, lo, i, j in zip(*(x.tolist() for x in u)):
            got[t].append((a, b, (hi, lo)))
            assert len(re.findall(r"\w+", texts[t][:a])) == i and len(re.findall(r"\w+", texts[t][a:b])) == j - i
    for g, t in zip(got, texts):
        want = units(t, min_words)
        assert [x[:2] for x in g] == [x[:2] for x in want]
        for (_, _, d), (_, _, norm) in zip(g, want):
            assert seen.setdefault(norm, d) == d
    assert len(set(seen.values())) == len(seen)


HASHER = L.UnitHash()


def test_matches_brute_force(make_docs):
    texts = [prose(k, 60) for k in range(12)]
    texts += [prose(50, 30) + " " + PASSAGE + " " + prose(51, 30), PASSAGE, prose(60, 20).capitalize() + "\n" + PASSAGE.upper()]
    texts += [texts[0], texts[1].replace(" ", "  "), PASSAGE + " " + PASSAGE, None, "", "short text"]
    docs = dict(enumerate(texts))
    got = {}
    for r in L.removed_units(make_docs(texts).repartition(3)).collect():
        got.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
    assert got == brute(docs, L.MIN_WORDS)


def test_a_passage_in_running_text_is_found(make_docs):
    texts = [prose(1, 40) + " " + PASSAGE + " " + prose(2, 40), prose(3, 40) + " " + PASSAGE + " " + prose(4, 40), prose(5, 90)]
    rows = L.op9(make_docs(texts)).collect()
    assert [r["doc_id"] for r in rows] == [1]
    assert rows[0]["n_chars"] > 0.9 * len(PASSAGE)
    assert rows[0]["kept_docs"] == "0"


def test_cut_text_and_offsets(make_docs):
    texts = [PASSAGE, prose(9, 30) + "\n" + PASSAGE + "\n" + prose(8, 30)]
    rows = {r["doc_id"]: r for r in L.deduplicate(make_docs(texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[0]["removed_spans"] == []
    want, done = "", 0
    for s in rows[1]["removed_spans"]:
        want, done = want + texts[1][done : s["start"]], s["end"]
    assert rows[1]["text"] == want + texts[1][done:] and len(rows[1]["text"]) < len(texts[1]) - 150


def test_repeats_within_a_document_do_not_cut_the_kept_one():
    (u,) = HASHER.many(["a b c d. " * 40])
    first, again = L.repeats(u)
    assert first.sum() == 1 and u.start[first][0] == 0 and again.any()
    assert u.start[again].min() >= u.end[first][0]


def test_odd_rows(odd_docs, empty_docs):
    rows = L.op9(odd_docs).collect()
    assert rows == []
    assert L.op9(empty_docs).collect() == []
    assert L.deduplicate(odd_docs).count() == 9


def test_null_id_ranks_last(make_docs):
    rows = L.op9(make_docs([PASSAGE, PASSAGE], ids=[None, 9])).collect()
    assert [(r["doc_id"], r["kept_docs"]) for r in rows] == [(None, "9")]


def test_short_lines_are_units_whatever_surrounds_them(make_docs):
    notice = "All rights reserved."
    texts = [prose(k, 20) + f"\n{notice if k else notice.upper()}\n" + prose(k + 50, 20) for k in range(3)] + ["x y\n" + notice, f"{notice}\nq r\n\n{notice}", "so all rights reserved"]
    rows = {r["doc_id"]: r["text"] for r in L.deduplicate(make_docs(texts)).collect()}
    assert [notice.rstrip(".").lower() in rows[k].lower() for k in range(6)] == [True, False, False, False, False, True]
    assert rows[0] == texts[0] and rows[5] == texts[5] and rows[4] == ".\nq r\n\n."
    assert {r["doc_id"]: r["n_units"] for r in L.op9(make_docs(texts)).collect()} == {1: 1, 2: 1, 3: 1, 4: 2}


def test_whole_lines_match_brute_force(make_docs):
    lines = ["a", "B!", "one two", "One,  two", "---", "", prose(1, 9), prose(2, 14) + " tail. end", "İ x"]
    texts = ["\n".join(lines[(k * j + j) % len(lines)] for j in range(1 + k % 5)) for k in range(30)]
    first, want = {}, {}
    for d, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            w = [m for m in re.finditer(r"\w+", line)]
            if w:
                norm = " ".join(lowered(m[0]) for m in w)
                if norm in first:
                    want.setdefault(d, set()).add((at + w[0].start(), at + w[-1].end()))
                first.setdefault(norm, d)
            at += len(line) + 1
    got = {}
    for r in L.removed_units(make_docs(texts).repartition(3), 10**6, lines=True).collect():
        got.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
    assert got == want


def test_passages_are_told_from_short_lines(make_docs):
    texts = [PASSAGE + "\n" + prose(1, 30), "x\n" + PASSAGE + "\n" + prose(2, 30), prose(1, 30) + "\nx", "x"]
    rows = {r["doc_id"]: r["n_passages"] for r in L.op9(make_docs(texts)).collect()}
    assert rows == {1: 1, 2: 1, 3: 0}


def test_merged_spans_match_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        start = np.sort(rng.integers(0, 60, 12))
        end = start + rng.integers(1, 9, 12)
        inside = np.zeros(80, bool)
        for a, b in zip(start, end):
            inside[a:b] = True
        got = L.merged(start, end)
        assert sum(b - a for a, b in got) == inside.sum() and all(inside[a:b].all() for a, b in got)
        assert all(x[1] < y[0] for x, y in zip(got, got[1:]))


def test_lines_alone(make_docs):
    texts = [PASSAGE, "before " + PASSAGE, "x\n" + PASSAGE, "x"]
    rows = {r["doc_id"]: r["removed_spans"] for r in L.deduplicate(make_docs(texts), min_words=None).collect()}
    assert [len(rows[k]) for k in range(4)] == [0, 0, 1, 1]


def test_clashing_columns_nulls_and_repeats(make_docs, empty_docs):
    texts = [PASSAGE, PASSAGE, None, "", PASSAGE, prose(3, 20)]
    docs = make_docs(texts, ids=[1, 2, 3, 4, 2, None]).selectExpr("*", "'a' AS doc", "'b' AS doc_", "'c' AS removed_spans", "'d' AS spans", "'e' AS kept", "'f' AS `all`")
    out = L.deduplicate(docs)
    assert out.columns == [*(c for c in docs.columns if c != "removed_spans"), "removed_spans"]
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(1, PASSAGE), (2, "."), (2, "."), (3, None), (4, ""), (None, texts[5])]))
    assert L.deduplicate(empty_docs).collect() == []
