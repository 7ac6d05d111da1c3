"""Profiles against a plain float64 double loop."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import api
from tessella.operators import blocks as B_
from tessella.operators import profile as B
from tessella.operators import profile_sql as S
from tessella.sources.series import from_array


def windows(t, m):
    return np.lib.stride_tricks.sliding_window_view(t, m)


def distances(a, b, m, normalize, const_a=None, const_b=None):
    """d2 of all pairs by the plain definitions."""
    wa, wb = windows(a, m), windows(b, m)
    fa, fb = np.isfinite(wa).all(axis=1), np.isfinite(wb).all(axis=1)
    out = np.full((len(wa), len(wb)), np.inf)

    def z(w):
        c = w / max(np.abs(w).max(), 1e-300)  # units must not matter
        c = c - c.mean()
        s = np.sqrt((c * c).mean())
        return c / s if s > 0 and w.min() < w.max() else np.zeros_like(c)

    for i in np.flatnonzero(fa):
        for j in np.flatnonzero(fb):
            if not normalize:
                out[i, j] = ((wa[i] - wb[j]) ** 2).sum()
                continue
            ca = const_a[i] if const_a is not None else wa[i].min() == wa[i].max()
            cb = const_b[j] if const_b is not None else wb[j].min() == wb[j].max()
            if ca and cb:
                out[i, j] = 0.0
            elif ca or cb:
                out[i, j] = m
            else:
                za, zb = z(wa[i]), z(wb[j])
                d2 = ((za - zb) ** 2).sum() if za.any() and zb.any() else 2 * m
                out[i, j] = 0.0 if d2 < 1e-14 else d2
    return out


def plain(a, m, b=None, normalize=True, k=1, denom=4, **flags):
    d2 = distances(a, a if b is None else b, m, normalize, **flags)
    n, l = d2.shape
    excl = int(np.ceil(m / denom))
    P, I = np.full((n, k), np.inf), np.full((n, k), -1)
    left, right = np.full(n, -1), np.full(n, -1)
    for i in range(n):
        js = [j for j in range(l) if np.isfinite(d2[i, j]) and (b is not None or abs(i - j) > excl)]
        key = (lambda j: j) if b is not None else (lambda j: 2 * abs(j - i) + (j > i))
        order = sorted(js, key=lambda j: (d2[i, j], key(j)))
        for r, j in enumerate(order[:k]):
            P[i, r], I[i, r] = np.sqrt(d2[i, j]), j
        if b is None:
            left[i] = next((j for j in order if j < i), -1)
            right[i] = next((j for j in order if j > i), -1)
    return P, I, left, right


def walk(n, seed):
    return np.random.default_rng(seed).normal(size=n).cumsum()


def special(n=220):
    t = walk(n, 3)
    t[n // 5], t[n // 2], t[3 * n // 4] = np.nan, np.inf, -np.inf
    t[20:40] = 3.0
    t[150:160] = -1.5
    return t


SERIES = {
    "walk": walk(300, 1),
    "special": special(),
    "offset": walk(200, 2) + 1e6,
    "tiny": walk(200, 4) * 1e-200,
    "huge": walk(200, 5) * 1e150,
    "all_constant": np.full(80, 2.0),
    "all_missing": np.full(60, np.nan),
    "int_tile": np.tile(np.random.default_rng(0).integers(-4, 5, 37), 6).astype(float),
    "dyadic_tile": np.tile(np.random.default_rng(1).integers(-8, 9, 23) / 8, 9),
}


def run(spark, t, m, other=None, **options):
    p = B.wide(from_array(spark, t), m, None if other is None else from_array(spark, other), **options).orderBy("i").toPandas()
    return np.stack(p["p"]), np.stack(p["j"]), p["left_j"].to_numpy(), p["right_j"].to_numpy()


@pytest.mark.parametrize("name", SERIES)
@pytest.mark.parametrize(("k", "normalize", "block"), [(1, True, 64), (3, True, 50), (1, False, 64), (3, False, 37)])
def test_self_join(spark, name, k, normalize, block):
    t, m = SERIES[name], 16
    unit = {"tiny": 2.0**-660, "huge": 2.0**500}.get(name, 1.0)  # a power of two: the plain form may square
    got, want = run(spark, t, m, k=k, normalize=normalize, block=block), plain(t / unit, m, k=k, normalize=normalize)
    if not normalize:
        got = (got[0] / unit, *got[1:])
    assert np.allclose(got[0], want[0], rtol=1e-9, atol=1e-9 if normalize else 1e-6)
    exact = name in ("walk", "int_tile", "special", "all_constant", "all_missing") or not normalize and name != "offset"
    if exact and not (normalize and name in ("int_tile", "dyadic_tile")):
        for g, w in zip(got[1:], want[1:]):
            assert (g == w).all()


@pytest.mark.parametrize(("k", "normalize"), [(1, True), (3, False), (40, True)])
def test_ab_join(spark, k, normalize):
    a, b = special(150), walk(90, 9)
    got, want = run(spark, a, 16, b, k=k, normalize=normalize, block=40), plain(a, 16, b, normalize, k)
    assert np.allclose(got[0], want[0])
    assert (got[1] == want[1]).all() and (got[2] == -1).all() and (got[3] == -1).all()


@pytest.mark.parametrize("normalize", [True, False])
def test_results_do_not_depend_on_blocks(spark, normalize):
    for t in (SERIES["int_tile"], SERIES["dyadic_tile"], SERIES["special"]):
        runs = [run(spark, t, 20, k=4, normalize=normalize, block=b) for b in (19, 64, 256)]
        for other in runs[1:]:
            for x, y in zip(runs[0], other):
                assert np.array_equal(x, y)


def test_sql_tier_equals_block_tier(spark):
    t = from_array(spark, special(120))
    for normalize in (True, False):
        a = S.profile(t, 12, normalize=normalize, k=2).orderBy("i", "rank").toPandas()
        b = B.long(B.wide(t, 12, normalize=normalize, k=2)).orderBy("i", "rank").toPandas()
        assert np.allclose(a["p"], b["p"]) and (a["j"] == b["j"]).all()
        x, y = S.sides(t, 12, normalize).orderBy("i").toPandas(), B.sides(B.wide(t, 12, normalize=normalize)).orderBy("i").toPandas()
        assert (x["left_j"] == y["left_j"]).all() and (x["right_j"] == y["right_j"]).all()


def test_many_series_at_once(spark):
    parts = [from_array(spark, walk(60 + 7 * s, s), str(s)) for s in range(5)]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    got = B.wide(table, 10, block=32).toPandas()
    for s in range(5):
        mine = got[got["series_id"] == str(s)].sort_values("i")
        want = plain(walk(60 + 7 * s, s), 10)
        assert np.allclose(np.stack(mine["p"]), want[0]) and (np.stack(mine["j"]) == want[1]).all()


def test_user_constant_flags(spark):
    t = walk(150, 6)
    t[30:60] = 1.0
    flags = np.random.default_rng(0).random(150 - 16 + 1) < 0.2
    got = api.stump(t, 16, T_A_subseq_isconstant=flags)
    P, I, left, right = plain(t, 16, const_a=flags, const_b=flags)
    assert np.allclose(got.P_, P[:, 0])


def test_array_call(spark):
    import pickle

    t = walk(200, 7)
    mp = api.stump(t, 12, k=2)
    P, I, left, right = plain(t, 12, k=2)
    assert mp.shape == (189, 6)
    assert np.allclose(mp.P_, P) and (mp.I_ == I).all() and (mp.left_I_ == left).all() and (mp.right_I_ == right).all()
    again = pickle.loads(pickle.dumps(mp))
    assert (again._m, again._k, again._excl_zone_denom) == (12, 2, 4) and np.allclose(again.P_, P)
    assert mp[:10]._k == 2
    raw = api.aamp(t, 12)
    assert np.allclose(raw.P_, plain(t, 12, normalize=False)[0][:, 0])
    assert np.allclose(api.gpu_stump(t, 12, None, True, 0).P_, P[:, 0])
    assert np.allclose(api.gpu_aamp(t, 12, None, True, [0, 1]).P_, raw.P_)


def test_checks(spark):
    t = walk(60, 8)
    with pytest.raises(TypeError):
        api.stump(t.astype(np.float32), 8)
    with pytest.raises(ValueError):
        api.stump(t.reshape(2, 30), 8)
    for m in (2, 61):
        with pytest.raises(ValueError):
            api.stump(t, m)
    with pytest.raises(TypeError):
        api.stump(t, 8.0)
    for k in (0, 1.5, True):
        with pytest.raises(ValueError):
            api.stump(t, 8, k=k)
    with pytest.raises(NotImplementedError):
        api.aamp(t, 8, p=1.0)
    with pytest.raises(ValueError):
        api.gpu_stump(t, 8, None, True, -1)
    with pytest.raises(ValueError):
        api.stump(t, 8, T_A_subseq_isconstant=np.zeros(3, bool))
    with pytest.raises(ValueError):
        api.stump(t, 8, T_A_subseq_isconstant=lambda a, w, x: a)
    with pytest.warns(UserWarning):
        api.stump(t, 8, ignore_trivial=False)
    with pytest.warns(UserWarning):
        ab = api.stump(t, 8, t.copy(), ignore_trivial=False)
    assert (ab.left_I_ == -1).all() and (ab.P_ == 0).all()
    with pytest.warns(UserWarning):
        api.stump(t, 8, walk(50, 9), ignore_trivial=True)
    with pytest.warns(UserWarning):
        api.stump(t, 58)
    swapped = t.astype(">f8")
    assert np.allclose(api.stump(swapped, 8).P_, api.stump(t, 8).P_)


def test_equal_series_share_missing_markers(spark):
    a, b = walk(60, 1), walk(60, 1)
    a[10], b[10] = np.nan, np.inf
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert (api.stump(a, 8, b).left_I_ >= 0).any()  # a self-join
    b[10] = 0.0
    with pytest.warns(UserWarning, match="differ"):
        assert (api.stump(a, 8, b).left_I_ == -1).all()


def test_package_attributes():
    import tessella

    assert tessella.stump is api.stump and tessella.__version__
    assert set(api.__all__) == set(tessella._CALLS)
    with pytest.raises(AttributeError):
        tessella.nothing


@pytest.mark.parametrize("power", [-1040, -1000, -500, 500, 1000, 1014])
def test_raw_distances_at_every_scale(spark, power):
    t = np.round(walk(150, 8) * 8)
    t[60] = np.nan
    want = run(spark, t, 12, k=2, normalize=False, block=64)
    got = run(spark, t * 2.0**power, 12, k=2, normalize=False, block=64)
    for g, w in zip(got[1:], want[1:]):
        assert (g == w).all()
    with np.errstate(over="ignore", under="ignore"):
        assert np.allclose(got[0], want[0] * 2.0**power, rtol=1e-6 if power < -1020 else 1e-12, atol=0)


def test_norms_near_the_ends_of_the_range():
    x, y = np.array([[1.7e308, 0.0], [5e-324, 0.0], [3.0, 4.0], [1e200, 1e-200], [1e-200, 0.0], [0.0, 0.0]]), np.zeros((6, 2))
    y[0, 0] = 1.6e308
    assert np.allclose(B_.norms(x, y), [1e307, 5e-324, 5.0, 1e200, 1e-200, 0.0], rtol=1e-2, atol=0)
    assert B_.norms(np.array([[1.7e308]]), np.array([[-1.7e308]]))[0] == np.inf


@pytest.mark.parametrize(("strip", "k", "normalize"), [(1, 1, True), (3, 2, False), (128, 3, True)])
def test_tiles_of_strips_equal_the_broadcast_join(spark, monkeypatch, strip, k, normalize):
    """Without a broadcast, for series of different lengths, as self-join and AB-join."""
    parts = [from_array(spark, special(n), sid) for sid, n in (("a", 220), ("b", 130), ("c", 30))]
    s, t = parts[0].unionByName(parts[1]).unionByName(parts[2]), parts[1].unionByName(parts[0].where("i < 90"))

    def both():
        a = B.wide(s, 12, k=k, normalize=normalize, block=20).orderBy("series_id", "i").collect()
        return a, B.wide(s, 12, t.withColumn("series_id", F.col("series_id")), normalize, k, block=20).orderBy("series_id", "i").collect()

    want = both()
    monkeypatch.setattr(B, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(B, "strip_blocks", lambda *_: strip)
    assert both() == want
    assert len(want[0]) == 209 + 119 + 19 and len(want[1]) == 209 + 119


def test_strips():
    assert B.strip_blocks(10, 32) == 1 and B.strip_blocks(100, 32) == 8 and B.strip_blocks(10**6, 32) == B.MAX_STRIP
