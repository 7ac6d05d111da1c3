import random

import pytest

from tessella.llm import decontaminate as D
from tessella.llm.common import WORD
from tests.llm.conftest import prose


def grams(text, n=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs.items():
        for i, x in items.items():
            n = min(5, len(WORD.findall((x or "").lower())))
            q = grams(x, n) if n else set()
            s = grams(t, n)
            if q and len(q & s) >= least * len(q):
                out[d, i] = len(q & s) / len(q)
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    items = {i: prose(1000 + i, n) for i, n in enumerate([5, 6, 9, 14, 20, 33, 47, 57, 120, 700, 1, 2, 3, 4, 7, 8])}
    items |= {20: items[5], 21: None, 22: "", 23: "only four words here", 24: "¿?"}
    docs = {}
    for k in range(60):
        w = prose(k, rng.randint(0, 3000)).split()
        if k % 3 == 0:
            item = items[k % 16].split()
            if k % 2:  # a few words of a long item changed
                for at in range(7, len(item), 60):
                    item[at] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs[k] = " ".join(w)
    docs[64] = "these are only four words here"
    docs |= {60: items[3].upper().replace(" ", "\n"), 61: None, 62: items[4] + " " + items[6], 63: items[7][: len(items[7]) // 2]}
    return docs, items


def test_finds_what_brute_force_finds(spark, make_docs, case):
    docs, items = case
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = D.search(make_docs(list(docs.values()), ids=list(docs)).repartition(3), bench).collect()
    want = brute(docs, items)
    assert len(want) > 15
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in rows} == want


def test_stage_drops_only_contaminated(spark, make_docs, case):
    docs, items = case
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    table = make_docs(list(docs.values()), ids=list(docs))
    kept = D.remove_contaminated(table, bench)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(docs) - {d for d, _ in brute(docs, items)}


def test_odd_rows(spark, odd_docs, empty_docs):
    bench = spark.createDataFrame([(1, "same text here twice over"), (None, "x y z w v")], "item_id long, text string")
    rows = D.search(odd_docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in rows] == [(5, 1, 1.0)]
    assert D.search(empty_docs, bench).collect() == []
    assert D.search(odd_docs, bench.where("item_id = 99")).collect() == []
    assert D.remove_contaminated(odd_docs, bench).count() == 7


def test_rows_without_and_with_one_id(spark, make_docs):
    """Each row of an id is judged by itself; the best counts.  A null id is one."""
    bench = spark.createDataFrame(
        [(None, "kolu rami seto pala nuro"), (1, "one two"), (1, prose(1, 30)), (1, prose(1, 30)), (2, "one two")], "item_id long, text string"
    )
    texts = ["x kolu rami seto pala nuro y", "one two", "three", prose(1, 30) + " one two", None]
    rows = D.search(make_docs(texts, ids=[None, 7, 7, 8, 9]), bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["n_item"], r["n_shared"]) for r in rows) == [
        (0, 0, 1, 1), (7, 1, 1, 1), (7, 2, 1, 1), (8, 1, 26, 26), (8, 2, 1, 1),
    ]
    clash = make_docs(texts, ids=[None, 7, 7, 8, 9]).selectExpr("*", "1 AS gone", "2 AS h", "3 AS `at`", "4 AS `row`")
    kept = D.remove_contaminated(clash, bench)
    assert kept.columns == clash.columns and [tuple(r)[0] for r in kept.collect()] == [9]


def test_query_equals_its_sql(spark, make_docs, case, tmp_path):
    import duckdb

    from tessella.llm.queries import ORACLES, QUERIES

    docs, items = case
    make_docs(list(docs.values()), ids=list(docs)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(ORACLES["op2_decontaminate"]).fetchall()
    got = QUERIES["op2_decontaminate"](spark, str(tmp_path)).select("doc_id", "item_id", "n_shared", "n_item", "containment").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 15
