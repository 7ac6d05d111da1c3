import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella import api
from pyspark.sql import functions as F

from tessella.functions import affine
from tessella.operators import mass as M
from tessella.operators import match as X
from tessella.operators import pan as P
from tessella.plans import planner
from tessella.sources.series import from_array
from tests.test_profile import distances, plain, walk


def test_mass_profiles(spark):
    t = walk(200, 1)
    t[50] = np.nan
    t[100:120] = 2.0
    q = t[10:26].copy()
    for normalize in (True, False):
        want = np.sqrt(distances(q, t, 16, normalize)[0])
        assert np.allclose(api.mass(q, t, normalize=normalize), want, atol=1e-7)
    assert np.allclose(api.mass_absolute(q, t), np.sqrt(distances(q, t, 16, False)[0]))
    d = api.mass(q, t, query_idx=10)
    assert d[10] == 0.0
    with pytest.warns(UserWarning):
        assert api.mass(q, t, query_idx=20)[20] == 0.0
    with pytest.raises(ValueError):
        api.mass(q, t, query_idx=185)
    q[3] = np.nan
    assert np.isinf(api.mass(q, t)).all()


def test_mass_options(spark):
    t = walk(80, 2)
    t[40] = np.nan
    q, l = t[:10].copy(), 71
    forced = np.ones(l, bool)
    forced[5] = False
    d = api.mass_absolute(q, t, forced)
    zero = np.where(np.isfinite(t), t, 0.0)
    want = np.sqrt(distances(q, zero, 10, False)[0])
    want[5] = np.inf
    assert np.allclose(d, want)
    M = np.zeros(l)
    M[7] = np.inf
    assert np.isinf(api.mass(q, t, M, np.ones(l))[7]) and np.isfinite(api.mass(q, t, M)[7])
    with pytest.raises(ValueError):
        api.mass(q, t, M[1:], np.ones(l))
    assert np.allclose(api.mass(q, t, Q_subseq_isconstant=True)[:30], math.sqrt(10))
    with pytest.warns(UserWarning):
        api.mass(q.reshape(-1, 1), t)


def plain_matches(d, excl, cutoff, most, first=None):
    d, out = d.copy(), []
    at = int(np.argmin(d)) if first is None else first
    while len(out) < most and np.isfinite(d[at]) and not d[at] > cutoff:
        out.append(at)
        d[max(0, at - excl) : at + excl + 1] = np.inf
        at = int(np.argmin(d))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=80), st.integers(0, 6), st.integers(1, 20))
def test_greedy_selection(values, excl, most):
    d = np.array(values, float)
    got = X.greedy(d, np.arange(len(d)), excl, most)
    assert got == plain_matches(d, excl, np.inf, most)


def test_selection_by_local_minima_equals_the_walk(spark, monkeypatch):
    d = np.random.default_rng(0).integers(0, 50, 600).astype(float)
    rows = spark.createDataFrame([("0", "0", i, float(v)) for i, v in enumerate(d)], "query_id string, series_id string, j long, d double")
    want = plain_matches(d, 4, np.inf, 10**9)
    for limit in (X.WALK, 10):
        monkeypatch.setattr(X, "WALK", limit)
        got = X.select(rows, 16, max_distance=float("inf")).orderBy("rank").toPandas()
        assert got["j"].tolist() == want


def test_match_calls(spark):
    t = walk(400, 3)
    q = t[100:120].copy()
    d = api.mass(q, t)
    excl = 5
    cut = max(d.mean() - 2 * d.std(), d.min())
    for options, want in (
        ({}, plain_matches(d, excl, cut + 1e-8, 10**9)),
        ({"max_distance": 4.0}, plain_matches(d, excl, 4.0 + 1e-8, 10**9)),
        ({"max_distance": float("inf"), "max_matches": 5}, plain_matches(d, excl, np.inf, 5)),
        ({"max_distance": lambda D: np.array([np.percentile(D, 10)])}, plain_matches(d, excl, np.percentile(d, 10) + 1e-8, 10**9)),
        ({"max_distance": 3.0, "query_idx": 100}, plain_matches(d, excl, 3.0 + 1e-8, 10**9, 100)),
    ):
        got = api.match(q, t, **options)
        assert [int(j) for _, j in got] == want
    raw = api.mass_absolute(q, t)
    got = api.aamp_match(q, t, max_distance=6.0, query_idx=300)
    assert [int(j) for _, j in got] == (plain_matches(raw, excl, 6.0, 10**9, 300) if raw[300] <= 6 else [])
    with pytest.raises(ValueError):
        api.match(np.array([1.0, np.nan, 2.0]), t)


def test_affine_copies_are_exactly_zero(spark):
    rng = np.random.default_rng(4)
    q = rng.integers(-20, 20, 16) / 4.0
    t = np.concatenate([rng.normal(size=30), 3.0 * q + 7.0, rng.normal(size=30), -q, rng.normal(size=20)])
    near = t[30:46].copy()
    assert affine.is_positive_affine(q, near) and not affine.is_positive_affine(q, -q)
    got = api.match(q, t, max_distance=1e-12)
    assert [list(x) for x in got] == [[0.0, 30]]
    near[3] = np.nextafter(near[3], np.inf)
    assert not affine.is_positive_affine(q, near) and affine.exact_distance(q, near) > 0
    assert affine.is_translation(q, q + 2.0) and not affine.is_translation(q, 2.0 * q)
    assert affine.dyadic(0.75) == (3, -2) and affine.dyadic_difference(1.0, 0.25) == (3, -2)


def test_prepared_target(spark):
    t = walk(150, 5)
    with api.prepare_target(t, 12) as target:
        kept = t.copy()
        t[:] = 0.0
        for at in (3, 60):
            q = kept[at : at + 12]
            assert np.allclose(target.mass(q), api.mass(q, kept))
            assert [int(j) for _, j in target.match(q, max_matches=3)] == [int(j) for _, j in api.match(q, kept, max_matches=3)]
        with pytest.raises(ValueError):
            target.mass(kept[:10])
    with pytest.raises(ValueError):
        target.mass(kept[:12])


def test_window_sizes_and_order():
    assert P.breadth_first(10) == [5, 2, 8, 1, 4, 7, 9, 0, 3, 6]
    assert P.breadth_first(0) == []
    assert P.window_sizes(100, 8, 20, 4) == [8, 12, 16, 20]
    assert P.window_sizes(100, 20, 8, 4) == [8, 12, 16, 20]
    assert P.window_sizes(30)[0] == 3
    with pytest.raises(ValueError):
        P.window_sizes(20, 100, 200)
    with pytest.raises(TypeError):
        P.window_sizes(20, 3.0)


def plain_pan(raw, order, sizes, done, threshold, normalize, contrast, binary, clip):
    pan = np.where(np.isinf(raw), np.nan, raw)
    at = order[:done]
    rows = pan[at]
    if normalize:
        rows = np.minimum(1.0, rows / (2 * np.sqrt(sizes[at]))[:, None])
    if contrast:
        rank = np.empty(rows.size)
        rank[np.argsort(rows, axis=None, kind="stable")] = np.linspace(0, 1, rows.size)
        rows = 1 / (1 + np.exp(-10 * (rank.reshape(rows.shape) - threshold)))
    if binary:
        rows = np.where(rows <= threshold, 0.0, 1.0)
    if clip:
        rows = np.clip(rows, 0, 1)
    pan[at] = rows
    have = sorted(at)
    for r in range(have[-1] + 1):
        pan[r] = pan[next(x for x in have if x >= r)]
    pan[np.isnan(pan)] = np.nanmax(pan)
    return pan


def test_pan(spark):
    t = walk(90, 6)
    t[30] = np.nan
    pan = api.stimp(t, 8, 24, 4)
    assert np.isnan(pan.PAN_).all() and pan.M_.tolist() == [16, 12, 24, 8, 20]
    for _ in range(3):
        pan.update()
    order, sizes = pan._order, pan._sizes
    for row, m in list(zip(order, pan.M_))[:3]:
        assert np.allclose(pan._raw[row, : 90 - m + 1], plain(t, int(m))[0][:, 0])
    for flags in ((0.2, True, True, True, True), (0.5, True, True, False, True), (0.5, True, False, False, False), (0.2, False, True, True, False)):
        assert np.allclose(pan.pan(*flags), plain_pan(pan._raw, order, sizes, 3, *flags))
    for _ in range(5):
        pan.update()
    assert np.allclose(pan.PAN_, plain_pan(pan._raw, order, sizes, 5, 0.2, True, True, True, True))
    assert len(pan.P_) == 5 and not pan.P_[0].flags.writeable
    assert api.gpu_stimp(t, 8, 12, 4, 0).M_.tolist() == [12, 8]


def test_raw_pan_scale(spark):
    t = walk(60, 7)
    pan = api.stimp(t, 8, 8, normalize=False)
    pan.update()
    got = pan.pan(contrast=False, binary=False)
    want = pan.P_[0] / ((t.max() - t.min()) * np.sqrt(8))
    assert np.allclose(got[0, : len(want)], np.minimum(1, want))


def test_planner():
    assert planner.exclusion_zone(24) == 6 and planner.exclusion_zone(10, 2.5) == 4
    for bad in (0, -1, float("inf"), True, "4"):
        with pytest.raises(ValueError):
            planner.exclusion_zone(10, bad)
    assert planner.max_window_size(100) == 79
    assert planner.estimated_peak_bytes(100_000, 50) < 256 << 20
    assert planner.estimated_peak_bytes(100_000, 50, k=20) > planner.estimated_peak_bytes(100_000, 50)
    assert planner.block_windows(10) == planner.MAX_BLOCK and planner.block_windows(10**6) == planner.MIN_BLOCK


def test_certified_distances_and_functions_on_tables(spark):
    t = np.round(walk(400, 4) * 100)
    t[200:220] = 3 * t[20:40] + 7
    t[300:320] = 3 * t[20:40] + 7
    t[310] = np.nextafter(t[310], np.inf)
    s = from_array(spark, t)
    q = M.queries_from_windows(s, {"a": 20}, 20)
    d = {r["j"]: r["d"] for r in X.certified(M.distance_profile(q, s, 20), q, s, 20).collect()}
    assert d[20] == d[200] == 0.0 and 0 < d[300] < 1e-6
    plain_d = {r["j"]: r["d"] for r in M.distance_profile(q, s, 20).collect()}
    assert all(d[j] == plain_d[j] for j in d if plain_d[j] >= 1e-6)
    cut = X.select(M.distance_profile(q, s, 20), 20, max_distance=lambda p: p.groupBy("query_id", "series_id").agg(F.lit(1e-3).alias("cutoff")))
    assert [r["j"] for r in cut.orderBy("j").collect()] == [20, 200, 300]


@pytest.mark.parametrize("walk_limit", [10, 10**6])
@pytest.mark.parametrize(("most", "first"), [(None, None), (5, None), (None, 33), (4, 33)])
def test_selection_by_either_way(spark, monkeypatch, walk_limit, most, first):
    monkeypatch.setattr(X, "WALK", walk_limit)
    rng = np.random.default_rng(3)
    d = rng.integers(0, 40, 300) / 8
    rows = spark.createDataFrame([("q", "s", j, float(x)) for j, x in enumerate(d)], "query_id string, series_id string, j long, d double")
    got = X.select(rows, 12, max_distance=4.0, max_matches=most, query_idx=first).orderBy("rank").collect()
    ok = np.flatnonzero(d <= 4.0 + 1e-8)
    want = X.greedy(d[ok], ok, 3, np.inf if most is None else most, first)
    assert [r["j"] for r in got] == ok[want].tolist()
