import math
import zlib
from collections import Counter

from tessella.llm import langid as L
from tests.llm.conftest import prose

WORDS = {"aa": "banana lorem sata", "bb": "wyxo zuquo krish"}


def texts():
    out, langs = [], []
    for k in range(60):
        lang = ("aa", "bb")[k % 2]
        base = WORDS[lang].split()
        out.append(" ".join(base[(k * i) % 3] + base[i % 3][: 1 + i % 4] for i in range(30 + k)))
        langs.append(lang)
    return out, langs


def brute_grams(text):
    """Counts of a text's n-grams, from strings."""
    padded = "_" + "_".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + "_"
    grams = Counter(c for c in padded if c != "_")
    grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
    grams.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != "_")
    return grams


def ranked(grams, size):
    """Codes of the most frequent n-grams."""

    def code(g):
        v = 0
        for c in g:
            v = (v << 21) | (32 if c == "_" else ord(c))
        return v

    return [c for _, c in sorted((-n, code(g)) for g, n in grams.items())][:size]


def brute_profile(text, size):
    """Out-of-place profile from strings."""
    return ranked(brute_grams(text), size)


def brute_predictions(texts, langs, size=L.PROFILE):
    """(language, score, distance) of each text, its place being its id, in plain loops."""
    learned = {}
    for i, (t, g) in enumerate(zip(texts, langs)):
        if t and g is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(g, Counter()).update(brute_grams(t) if any(c.isalpha() for c in t) else {})
    learned = {g: {c: r for r, c in enumerate(ranked(n, size))} for g, n in learned.items() if n}
    out = []
    for t in texts:
        if not learned or not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0, 1.0))
            continue
        own = brute_profile(t, size)
        d = {g: sum(abs(r - ranks[c]) if c in ranks else size for r, c in enumerate(own)) / (len(own) * size) for g, ranks in learned.items()}
        best = min(d, key=lambda g: (d[g], g))
        out.append((best, 1 / sum(math.exp((d[best] - x) / L.TEMPERATURE) for x in d.values()), d[best]))
    return out


def test_profiles_match_brute_force():
    g = L.Grams()
    for t in (prose(1, 50), "Ünder, die! straße", "a", "ab  cd\n"):
        assert g.profile(t, 300).tolist() == brute_profile(t, 300)


def test_distance_is_out_of_place():
    model = L.Model({"x": [10, 20, 30], "y": [30, 40]}, 3)
    import numpy as np

    d = model.distances(np.array([20, 30, 99]))
    assert d.tolist() == [(1 + 1 + 3) / 9, (3 + 1 + 3) / 9]


def test_learns_languages_and_ignores_held_out_labels(make_docs):
    ts, langs = texts()
    wrong = [("zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, g in enumerate(langs)]
    rows = L.op5(make_docs(ts, langs=wrong)).collect()
    assert all(r["lang_pred"] == langs[r["doc_id"]] for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_query_equals_brute_force(make_docs):
    ts, langs = texts()
    ts += [None, "", "123 !", "漢字 仮名", "banana wyxo lorem zuquo", ts[3], ts[3], "a", "x" * 5000, prose(3, 4000)]
    langs += [None, "aa", "bb", None, None, "bb", "aa", None, "cc", None]
    want = brute_predictions(ts, langs)
    rows = {r["doc_id"]: r for r in L.identify(make_docs(ts, langs=langs).repartition(3)).collect()}
    assert len(rows) == len(ts) and want[63][:2] == ("aa", 1 / len({"aa", "bb", "cc"}))  # a tie goes to the first by name
    for i, (lang, score, distance) in enumerate(want):
        assert rows[i]["lang_pred"] == lang and math.isclose(rows[i]["score"], score, abs_tol=1e-9), i
        assert math.isclose(rows[i]["distance"], distance, abs_tol=1e-9)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.op5(make_docs(ts, langs=langs)).collect()}
    assert found == {i: (r["lang_pred"], r["score"]) for i, r in rows.items()}


def test_odd_rows(odd_docs, empty_docs, make_docs):
    rows = L.op5(odd_docs).collect()
    assert len(rows) == 9 and all(r["lang_pred"] == "und" for r in rows)
    assert L.op5(empty_docs).collect() == []
    ts, langs = texts()
    docs = make_docs([*ts, None, "", "123 !"], langs=[*langs, None, "aa", "bb"])
    assert {r["doc_id"] for r in L.op5(docs).collect() if r["lang_pred"] == "und"} == {60, 61, 62}


def test_stage_keeps_known_languages(make_docs):
    ts, langs = texts()
    kept = L.keep_known(make_docs([*ts, "", "漢字 仮名 交じり 文 です" * 5], langs=[*langs, None, None]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == set(range(60))
