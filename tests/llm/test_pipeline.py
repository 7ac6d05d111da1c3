import os
import re
import shutil
import zlib

import pytest

import corpus_pipeline as C
from tests.llm import test_decontaminate, test_neardup, test_pii
from tests.llm.conftest import prose
from tests.llm.test_langid import brute_predictions
from tests.llm.test_langid import texts as language_texts
from tests.llm.test_packing import library_ids


@pytest.fixture(scope="module")
def tables(spark, make_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    ts, langs = language_texts()
    ts, langs = [t + " " + prose(k, 150) for k, t in enumerate(ts)], langs
    item = prose(4000, 40)
    ts += [ts[4], ts[5] + " end", prose(70, 60) + " " + item + " " + prose(71, 60), "", None, prose(72, 80) + " jo@corp.example"]
    langs += ["aa", "bb", "aa", None, None, "bb"]
    make_docs(ts, langs=langs).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(4001, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    yield d, ts
    shutil.rmtree(d)


def test_stages_in_order(spark, tables):
    d, ts = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, f in C.STAGES:
        out = f(spark, docs, d)
        path = f"{d}/stage-{len(kept)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != C.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "pii":
            assert "[EMAIL]" in docs.where("doc_id = 65").first()["text"]
    every = set(range(len(ts)))
    assert kept[0] == every - {63, 64}
    assert kept[1] == kept[0] - {60, 61}
    assert kept[2] == kept[1] - {62}
    assert kept[3] == kept[4] == kept[2]


def test_run(spark, tables):
    d, _ = tables
    rows = C.run(spark, d).collect()
    assert {r["doc_id"] for r in rows} >= {0, 1, 2, 65} and not {r["doc_id"] for r in rows} & {60, 61, 62, 63}
    assert os.path.isdir(d)


def test_run_equals_brute_force(spark, tables):
    """Every stage again in plain loops; the text of stage 4 is held against the brute-force spans, then packed by the library's ids."""
    d, ts = tables
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    langs = {r["doc_id"]: r["lang"] for r in rows}
    texts = {i: t for i, t in enumerate(ts)}
    found = brute_predictions(ts, [langs[i] for i in range(len(ts))])
    texts = {i: t for i, t in texts.items() if found[i][0] != "und" and found[i][2] <= 0.85}
    classes = test_neardup.brute(texts)
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    hit = {i for i, _ in test_decontaminate.brute(texts, items)}
    texts = {i: t for i, t in texts.items() if i not in hit}

    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.where(docs["doc_id"].isin(list(texts)))
    clean = {r["doc_id"]: r["text"] for r in C.sanitise(spark, docs, d).collect()}
    terms = test_pii.brute_terms([texts[i] for i in sorted(texts)])
    for i, t in texts.items():
        pattern, done = "", 0
        for a, kind, b in test_pii.brute_spans(t, terms):
            pattern += re.escape(t[done:a]) + (r"\[[A-Z]+\]" if kind < 4 else r"(\[[A-Z]+\])?")
            done = b
        assert re.fullmatch(pattern + re.escape(t[done:]), clean[i], re.S), i
    assert "[EMAIL]" in clean[65]

    want = {i: [*library_ids(t), 1] for i, t in clean.items()}
    pieces = {}
    for r in C.run(spark, d).collect():
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert pieces.keys() == want.keys()
    for i, p in pieces.items():
        p.sort()
        assert [a for a, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) == len(want[i])
