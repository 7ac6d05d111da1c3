"""The driver's queries against their SQL, on the smallest tables."""

import os
import subprocess
import sys

import pandas as pd
import pytest

from tessella.queries import TABLE

DATA = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def sql():
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for name in ("events", "lineitem"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    return df[cols].sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n, (_, text) in TABLE.items() if text])
def test_query_equals_sql(spark, sql, name):
    query, text = TABLE[name]
    got, want = ordered(query(spark, DATA).toPandas()), ordered(sql.sql(text).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout


def test_entry_needs_no_session():
    names, texts = eval(run("import __spark_entry__ as e; print((sorted(e.queries()), sorted(e.oracle_sql())))"))
    assert set(TABLE) <= set(names) and set(texts) <= set(names)


def test_entry_without_the_other_package():
    out = run("import sys; sys.modules['tessella.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries()))")
    assert eval(out) == sorted(TABLE)


def brute_days(divide, k, m=14, excl=4):
    """Series length, and for each window the k best (d, j), the best left j and the best right j, over all days."""
    import numpy as np

    days = pd.read_parquet(f"{DATA}/lineitem.parquet", columns=["l_shipdate"])["l_shipdate"]
    v = pd.to_datetime(days).dt.floor("D").value_counts().sort_index().to_numpy() // divide
    w = np.lib.stride_tricks.sliding_window_view(v, m).astype(np.int64)
    at, out = np.arange(len(w)), []
    for i in at:
        d2 = ((w - w[i]) ** 2).sum(axis=1)
        order = np.lexsort((2 * abs(at - i) + (at > i), d2))
        order = order[abs(order - i) > excl]
        left, right = order[order < i], order[order > i]
        best = [(round(float(np.sqrt(d2[j])), 6), int(j)) for j in order[:k]]
        out.append((best, int(left[0]) if len(left) else -1, int(right[0]) if len(right) else -1))
    return len(v), out


@pytest.mark.parametrize("name, divide, k", [("mp_self_raw_k1", 1, 1), ("mp_self_raw_topk", 1, 3), ("mp_raw_exact_ties", 8, 4)])
def test_all_days_match_brute_force(spark, sql, name, divide, k):
    n, want = brute_days(divide, k)
    assert n > 600
    got = {(r["i"], r["rank"]): (r["p"], r["j"]) for r in TABLE[name][0](spark, DATA).collect()}
    assert got == {(i, r + 1): x for i, (best, _, _) in enumerate(want) for r, x in enumerate(best)}


def test_sides_of_all_days_match_brute_force(spark, sql):
    _, want = brute_days(1, 1)
    got = {r["i"]: (r["left_j"], r["right_j"]) for r in TABLE["mp_raw_left_right"][0](spark, DATA).collect()}
    assert got == {i: x[1:] for i, x in enumerate(want)}
