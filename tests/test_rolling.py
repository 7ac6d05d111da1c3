import numpy as np

from tessella.functions import rolling as R
from tessella.sources import series as S


def test_rolling_functions_in_small_blocks(spark):
    t = np.random.default_rng(0).normal(size=100).cumsum()
    t[20], t[50] = np.nan, -np.inf
    t[70:85] = 2.0
    m = 7
    w = np.lib.stride_tricks.sliding_window_view(t, m)
    ok = np.isfinite(w).all(axis=1)
    table = S.from_array(spark, t)
    rows = R.rolling(
        table, m, block=16, f=R.finite_window(m), c=R.constant_window(m), lo=R.F.min("v").over(R.frame(m)), s=R.F.stddev_pop("v").over(R.frame(m))
    ).orderBy("i").toPandas()
    assert rows["i"].tolist() == list(range(94))
    assert rows["f"].tolist() == ok.tolist()
    assert rows["c"].tolist() == (ok & (w.min(axis=1) == w.max(axis=1))).tolist()
    assert np.allclose(rows["lo"][ok], w[ok].min(axis=1)) and np.allclose(rows["s"][ok], w[ok].std(axis=1))
    mean = R.rolling_mean_std(table, m).orderBy("i").toPandas()
    assert np.allclose(mean["w_mean"][ok], w[ok].mean(axis=1)) and mean["w_mean"][~ok].isna().all()
    total = R.rolling_sum(table, m).orderBy("i").toPandas()
    assert np.allclose(total["w_sum"][ok], w[ok].sum(axis=1))


def test_blocks_hold_every_sample_of_their_windows(spark):
    for m, block in ((3, 4), (10, 4), (5, 16), (16, 5)):
        rows = R.blocked(S.from_array(spark, np.arange(50.0)), m, block).toPandas()
        have = {b: set(g["i"]) for b, g in rows.groupby("b")}
        for first in range(50 - m + 1):
            assert set(range(first, first + m)) <= have[first // block]


def test_null_samples_count_as_missing(spark):
    df = spark.createDataFrame([("a", i, None if i == 3 else float(i)) for i in range(10)], "series_id string, i long, v double")
    w = R.windows(df, 3).orderBy("i").toPandas()
    assert len(w) == 8 and w["is_finite"].tolist() == [True, False, False, False, True, True, True, True]


def test_indexing(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("t"), F.col("id").alias("x")).repartition(5)
    one = S.indexed(df, F.col("x").cast("double"), [F.col("t")]).orderBy("i").toPandas()
    assert one["i"].tolist() == list(range(1000))
    assert one["v"].tolist() == [float(r["x"]) for r in df.orderBy("t").collect()]
    many = S.indexed(df, F.col("x"), [F.col("t")], F.col("x") % 3).toPandas()
    assert many.groupby("series_id")["i"].apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_sources_and_sinks(spark, tmp_path):
    t = S.from_array(spark, np.array([1.0, np.nan, 3.0]))
    for fmt in ("parquet", "orc", "json", "csv"):
        S.write(t, str(tmp_path / fmt), fmt)
        back = S.read(spark, str(tmp_path / fmt), fmt).orderBy("i").toPandas()
        assert back["i"].tolist() == [0, 1, 2] and back["v"][0] == 1.0 and np.isnan(back["v"][1])
