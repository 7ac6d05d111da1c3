import zlib

from pyspark.sql import functions as F

from tessella.llm import sharding as S


def feistel(v, n, seed):
    """The permutation again, one number at a time."""
    a, b = S.domain(n)

    def mixed(x, k, c):
        y = (x + c) % S.PRIME
        y = y * y % S.PRIME
        return (y * k + c) % S.PRIME

    while True:
        left, right = v % a, v // a
        for i, (k, c) in enumerate(S.keys(seed)):
            if i % 2 == 0:
                left = (left + mixed(right, k, c)) % a
            else:
                right = (right + mixed(left, k, c)) % b
        v = right * a + left
        if v < n:
            return v


def test_permutation_is_a_bijection_and_matches_the_scalar_form(spark):
    for n in (1, 2, 3, 10, 97, 1000, 4096):
        got = [r["v"] for r in spark.range(n).select(S.permuted(F.col("id"), n, 20).alias("v")).collect()]
        assert sorted(got) == list(range(n))
        rows = S.placed(spark.range(n).withColumnRenamed("id", "row"), n, 20).collect()
        assert [r["v"] for r in sorted(rows)] == got
        if n <= 1000:
            assert got == [feistel(i, n, 20) for i in range(n)]


def test_law_rows(make_docs):
    docs = make_docs(["t%d" % (i % 40) for i in range(203)], ids=[i % 150 for i in range(203)])
    rows = S.op7(docs).collect()
    assert len(rows) == 203
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(8))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_rows_do_not_depend_on_partitions(make_docs):
    docs = make_docs(["text %d" % i for i in range(100)])
    a = {tuple(r) for r in S.op7(docs.repartition(1)).collect()}
    b = {tuple(r) for r in S.op7(docs.repartition(7, "text")).collect()}
    assert a == b


def test_a_dominant_repeated_row(make_docs, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 16)
    docs = make_docs(["hot"] * 100 + ["t%d" % i for i in range(50)], ids=[7] * 100 + list(range(50)))
    rows = S.op7(docs).collect()
    assert sorted((r["slot"] * 8 + r["shard"]) for r in rows) == list(range(150))
    assert sum(r["doc_id"] == 7 and r["size"] == 4 for r in rows) == 100


def test_odd_rows(odd_docs, empty_docs):
    rows = S.op7(odd_docs).collect()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want
    assert S.op7(empty_docs).collect() == []
