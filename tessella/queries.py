"""Queries that the driver runs, with their SQL.

Series derive from the driver's tables: hourly sums of events in cents (exact
doubles), the same by event type on a dense grid, daily counts of line items.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import api
from tessella import oracles as O
from tessella.functions import distance as D
from tessella.functions import rolling as R
from tessella.operators import mass as M
from tessella.operators import match as X
from tessella.operators import nearest as N
from tessella.operators import pan as P
from tessella.operators import profile as B
from tessella.operators import profile_sql as S
from tessella.sources import series as series_source

Query = Callable[[SparkSession, str], DataFrame]
HOUR, DAY = 24, 14
GAPS, FLAT = (144, 360), (180, 251)


# ------------------------------------------------------------------ series
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "user_id", "value")


def _cents():
    """The sum of values in whole cents: exact in any order."""
    return F.sum(F.round(F.col("value") * 100).cast("long")).cast("double")


def hourly(spark: SparkSession, sf_dir: str, kind: str | None = None, nan: tuple[int, ...] = (), flat: tuple[int, int] | None = None) -> DataFrame:
    rows = _events(spark, sf_dir)
    if kind:
        rows = rows.where(F.col("event_type") == kind)
    s = series_source.bucketed(rows, F.col("ts"), _cents(), "hour")
    v = F.col("v")
    if flat:
        v = F.when(F.col("i").between(*flat), F.lit(3.0)).otherwise(v)
    if nan:
        v = F.when(F.col("i").isin(*nan), F.lit(float("nan"))).otherwise(v)
    return s.withColumn("v", v)


def by_type(spark: SparkSession, sf_dir: str, fill: float = float("nan")) -> DataFrame:
    return series_source.gridded(_events(spark, sf_dir), F.col("ts"), _cents(), "hour", F.col("event_type"), fill)


def daily(spark: SparkSession, sf_dir: str, divide: int = 1) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate")
    s = series_source.bucketed(rows, F.col("l_shipdate"), F.count("*").cast("double"), "day")
    return s.withColumn("v", F.floor(F.col("v") / divide).cast("double"))


def scaled_days(power: int) -> Query:
    """The daily profile in units of a power of two whose squares are no doubles, and back."""

    def run(spark, sf_dir):
        s = daily(spark, sf_dir)
        p = B.wide(s.withColumn("v", F.col("v") * F.lit(2.0**power)), DAY, normalize=False, k=2)
        return _long(p.withColumn("p", F.transform("p", lambda x: x / F.lit(2.0**power))))

    return run


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series: event values in order of their ids."""
    return series_source.indexed(_events(spark, sf_dir), F.col("value"), [F.col("event_id")])


# ------------------------------------------------------------------ shapes of results
def _long(p: DataFrame) -> DataFrame:
    rows = p if "rank" in p.columns else B.long(p)
    return rows.select("series_id", "i", "rank", F.round("p", 6).alias("p"), "j")


def _self(source: Callable[[SparkSession, str], DataFrame], m: int, **options) -> Query:
    return lambda spark, sf_dir: _long(B.wide(source(spark, sf_dir), m, **options))


def _rounded(*names: str) -> list:
    return ["series_id", "i", *[F.round(n, 6).alias(n) for n in names]]


def _window_frame(f: Callable[[DataFrame, int], DataFrame], *names: str, nan: tuple[int, ...] = GAPS) -> Query:
    return lambda spark, sf_dir: f(hourly(spark, sf_dir, nan=nan, flat=FLAT), HOUR).select(*_rounded(*names))


def _asked(spark: SparkSession, sf_dir: str, at: int, m: int, normalize: bool, series: DataFrame | None = None, **options) -> DataFrame:
    s = hourly(spark, sf_dir) if series is None else series
    q = M.queries_from_windows(s, {"0": at}, m)
    return M.distance_profile(q, s, m, normalize, **options)


def _mass(at: int, normalize: bool, own: bool = False, source: Callable = hourly, m: int = HOUR) -> Query:
    def run(spark, sf_dir):
        d = _asked(spark, sf_dir, at, m, normalize, source(spark, sf_dir))
        d = M.with_query_index(d, at, normalize) if own else d
        return d.select("query_id", "series_id", "j", F.round("d", 6).alias("d"))

    return run


def _match(at: int, normalize: bool = True, own: bool = False, **options) -> Query:
    def run(spark, sf_dir):
        d = _asked(spark, sf_dir, at, HOUR, normalize)
        d = M.with_query_index(d, at, normalize) if own else d
        return X.select(d, HOUR, **options).select("query_id", "series_id", "rank", F.round("d", 6).alias("d"), "j")

    return run


def _isfinite_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw profile where all windows are forced finite: a missing sample counts as 0."""
    s = hourly(spark, sf_dir, nan=GAPS)
    forced = R.window_flags(s, HOUR).select("series_id", "i", F.lit(True).alias("is_finite"))
    d = _asked(spark, sf_dir, 400, HOUR, False, s, finite=forced)
    return d.select("query_id", "series_id", "j", F.round("d", 6).alias("d"))


# ------------------------------------------------------------------ pan
_SIZES = list(range(8, 65, 8))


def _pan_rows(updates: int) -> list[tuple[int, int, int]]:
    return [(r, u, _SIZES[r]) for u, r in enumerate(P.breadth_first(len(_SIZES))[:updates])]


def _pan(updates: int, **options) -> Query:
    def run(spark, sf_dir):
        s = hourly(spark, sf_dir, nan=(144,))
        lengths = s.groupBy("series_id").agg(F.count("*").alias("n"))
        cells = P.picture(P.profiles(s, _SIZES, updates), lengths, len(_SIZES), **options)
        return cells.select("series_id", F.col("pan_row").cast("int").alias("pan_row"), "i", F.round("value", 6).alias("value"))

    return run


def _pan_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.profiles(hourly(spark, sf_dir, nan=(144,)), _SIZES)
    return rows.select("pan_row", "upd", "m", "i", F.round("p", 6).alias("p"))


# ------------------------------------------------------------------ others
def _equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series (event types, and one twice) with the first that equals it, up to the marker of a missing sample.

    Series meet by a digest of their samples, then sample by sample.
    """
    a = by_type(spark, sf_dir)
    odd = F.when(~series_source.is_finite(F.col("v")), F.lit(float("inf"))).otherwise(F.col("v"))
    a = a.unionByName(a.where(F.col("series_id") == "view").select(F.lit("view again").alias("series_id"), "i", odd.alias("v")))
    sample = F.struct("i", F.when(series_source.is_finite(F.col("v")), F.col("v")))
    digest = a.groupBy("series_id").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(sample, F.lit(k))).alias(f"x{k}") for k in range(2)])
    first = digest.groupBy("n", "x0", "x1").agg(F.min("series_id").alias("first_id"))
    pairs = digest.join(first, ["n", "x0", "x1"]).select("series_id", "first_id")
    b = a.select(F.col("series_id").alias("first_id"), "i", F.col("v").alias("_v"))
    both = a.join(pairs, "series_id").join(b, ["first_id", "i"])
    fa, fb = series_source.is_finite(F.col("v")), series_source.is_finite(F.col("_v"))
    same = F.when(fa & fb, F.col("v") == F.col("_v")).otherwise(~fa & ~fb)
    return both.groupBy("series_id", "first_id").agg(F.min(same.cast("int")).alias("is_equal"))


# ------------------------------------------------------------------ array calls, and users' functions
def _array(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """The hourly series as array calls take it: a row an hour, which a driver holds."""
    return hourly(spark, sf_dir).orderBy("i").toPandas()["v"].to_numpy()


def _profile_rows(spark: SparkSession, found) -> DataFrame:
    k = (found.shape[1] - 2) // 2
    rows = [("0", i, r + 1, float(p), int(j)) for i, row in enumerate(found) for r, (p, j) in enumerate(zip(row[:k], row[k : 2 * k]))]
    return _long(spark.createDataFrame(rows, B.PROFILE))


def _array_profile(call: Callable) -> Query:
    return lambda spark, sf_dir: _profile_rows(spark, call(_array(spark, sf_dir)))


def _array_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given means, of which one is infinite: its window counts as missing."""
    t = _array(spark, sf_dir)
    means = np.zeros(len(t) - HOUR + 1)
    means[7] = np.inf
    d = api.mass(t[400 : 400 + HOUR], t, means, np.ones(len(means)))
    return spark.createDataFrame(list(enumerate(map(float, d))), "j long, d double").select("j", F.round("d", 6).alias("d"))


def _array_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared target and a threshold that is a function of the profile."""
    t = _array(spark, sf_dir)
    with api.prepare_target(t, HOUR) as target:
        found = target.match(t[400 : 400 + HOUR], max_distance=lambda d: 0.75 * d.mean())
    rows = [("0", "0", r + 1, float(d), int(j)) for r, (d, j) in enumerate(found)]
    return spark.createDataFrame(rows, "query_id string, series_id string, rank int, d double, j long").withColumn("d", F.round("d", 6))


def _array_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pan = api.gpu_stimp(_array(spark, sf_dir), 8, 64, 8, 0, False)
    for _ in range(3):
        pan.update()
    got = pan.pan(threshold=0.5, contrast=False, binary=False)
    rows = [("0", r, i, float(v)) for r, row in enumerate(got) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "series_id string, pan_row int, i long, value double").withColumn("value", F.round("value", 6))


def _raw_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hourly(spark, sf_dir, nan=(144,))
    shown = F.when(series_source.is_finite(F.col("v")), F.col("v"))
    ranges = s.groupBy("series_id").agg(F.min(shown).alias("lo"), F.max(shown).alias("hi"))
    lengths = s.groupBy("series_id").agg(F.count("*").alias("n"))
    cells = P.picture(P.profiles(s, _SIZES, 3, False), lengths, len(_SIZES), 0.5, binary=False, ranges=ranges)
    return cells.select("series_id", F.col("pan_row").cast("int").alias("pan_row"), "i", F.round("value", 6).alias("value"))


def _first_sample_sevenths(a: np.ndarray, w: int) -> np.ndarray:
    return np.mod(a[: len(a) - w + 1], 7) == 0


def _user_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth window is constant, says the user."""
    s = hourly(spark, sf_dir)
    flags = R.window_flags(s, HOUR).select("series_id", "i", (F.col("i") % 5 == 0).alias("is_constant"))
    return _long(B.wide(s, HOUR, constant=flags))


def _user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hourly(spark, sf_dir)
    return _long(B.wide(s, HOUR, constant=B.constant_flags(s, HOUR, _first_sample_sevenths)))


def _certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches where one window is an exact affine copy of the query."""
    s = hourly(spark, sf_dir)
    copy = s.where(F.col("i").between(400, 400 + HOUR - 1)).select("series_id", (F.col("i") - 300).alias("i"), (2 * F.col("v") + 3).alias("_c"))
    s = s.join(copy, ["series_id", "i"], "left").select("series_id", "i", F.coalesce("_c", "v").alias("v"))
    q = M.queries_from_windows(s, {"0": 400}, HOUR)
    d = X.certified(M.distance_profile(q, s, HOUR), q, s, HOUR)
    found = X.select(d, HOUR, max_distance=lambda p: p.groupBy("query_id", "series_id").agg((0.75 * F.avg("d")).alias("cutoff")))
    exact = F.when((F.col("d") == 0) | (F.col("d") >= 1e-6), F.round("d", 6))
    return found.select("query_id", "series_id", "rank", exact.alias("d"), "j")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.statistics(B.wide(hourly(spark, sf_dir, nan=GAPS), HOUR))
    return s.select("series_id", *[F.round(c, 6).alias(c) for c in ("mean_p", "min_p", "max_p")], "n_missing")


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = R.windows(hourly(spark, sf_dir), HOUR)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return w.select("series_id", "i", F.size("w").cast("long").alias("n"), F.round(total, 6).alias("w_sum"), F.col("w")[0].alias("w_first"))


def _normal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = R.windows(hourly(spark, sf_dir), HOUR).select("series_id", "i", D.znormalised(F.col("w"), HOUR).alias("z"))
    return w.select("series_id", "i", F.posexplode("z").alias("k", "z")).select("series_id", "i", F.col("k").cast("int").alias("k"), F.round("z", 6).alias("z"))


def _discords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.discords(B.wide(hourly(spark, sf_dir), HOUR), HOUR, 10)
    return d.select("series_id", "rank", F.round("p", 6).alias("p"), "i")


def _motif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.motif(B.wide(hourly(spark, sf_dir), HOUR)).select("series_id", F.round("p", 6).alias("p"), "i", "j")


def _ab(left: str, right: str, normalize: bool, k: int = 1) -> Query:
    return lambda spark, sf_dir: _long(B.wide(hourly(spark, sf_dir, left), HOUR, hourly(spark, sf_dir, right), normalize, k))


def _ab_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type's hours (gaps 0) against the view events' as one target."""
    a = by_type(spark, sf_dir, 0.0)
    t = a.where(F.col("series_id") == "view").select("i", "v")
    ids = a.select("series_id").distinct()
    return _long(B.wide(a, HOUR, ids.join(t, F.lit(True)).select("series_id", "i", "v"), False))


def _values_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long series, m = 50: first distance and neighbour of every window."""
    return N.nearest(values(spark, sf_dir), 50).select("series_id", "i", F.round("p", 6).alias("p"), "j")


def _values_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = values(spark, sf_dir)
    d = M.distance_profile(M.queries_from_windows(s, {"0": 100, "1": 500}, 50), s, 50)
    return d.select("query_id", "series_id", "j", F.round("d", 6).alias("d"))


def _frame(source: str, m: int, columns: str) -> str:
    return f"WITH {source}, {O.windows(m)} SELECT series_id, i::BIGINT AS i, {columns} FROM w"


_h, _gaps, _flat = O.hourly(), O.hourly(nan=GAPS), O.hourly(constant=FLAT)
_special = O.hourly(nan=GAPS, constant=FLAT)
_days, _steps = O.daily_counts(), O.daily_counts(divide=8)
_VALUES = "s AS (SELECT '0' AS series_id, row_number() OVER (ORDER BY event_id) - 1 AS i, value AS v FROM events)"

#: name -> (query, SQL or None)
TABLE: dict[str, tuple[Query, str | None]] = {
    # rolling functions and windows
    "rolling_mean_std": (
        _window_frame(R.rolling_mean_std, "w_mean", "w_std"),
        _frame(_special, HOUR, "CASE WHEN f THEN round(list_avg(w), 6) END AS w_mean, CASE WHEN f THEN round(list_stddev_pop(w), 6) END AS w_std"),
    ),
    "rolling_min_max": (
        _window_frame(R.rolling_min_max, "w_min", "w_max"),
        _frame(_special, HOUR, "CASE WHEN f THEN round(list_min(w), 6) END AS w_min, CASE WHEN f THEN round(list_max(w), 6) END AS w_max"),
    ),
    "rolling_sum": (_window_frame(R.rolling_sum, "w_sum"), _frame(_special, HOUR, "CASE WHEN f THEN round(list_sum(w), 6) END AS w_sum")),
    "window_is_finite": (
        lambda spark, sf: R.window_flags(hourly(spark, sf, nan=GAPS), HOUR).select("series_id", "i", F.col("is_finite").cast("int").alias("flag")),
        _frame(_gaps, HOUR, "f::INT AS flag"),
    ),
    "window_is_constant": (
        lambda spark, sf: R.window_flags(hourly(spark, sf, nan=GAPS, flat=FLAT), HOUR).select("series_id", "i", F.col("is_constant").cast("int").alias("flag")),
        _frame(_special, HOUR, "c::INT AS flag"),
    ),
    "windows_collect": (_collected, _frame(_h, HOUR, "len(w)::BIGINT AS n, round(list_sum(w), 6) AS w_sum, w[1] AS w_first")),
    "znorm_windows": (
        _normal_windows,
        f"WITH {_h}, {O.windows(HOUR)} SELECT series_id, i::BIGINT AS i, (k - 1)::INT AS k, round(z[k], 6) AS z FROM (SELECT series_id, i, z, unnest(range(1, {HOUR + 1})) AS k FROM w)",
    ),
    # profiles
    "mp_self_norm_k1": (_self(hourly, HOUR), O.profile(_h, HOUR)),
    "mp_self_norm_topk": (_self(hourly, HOUR, k=3), O.profile(_h, HOUR, 3)),
    "mp_left_right": (lambda spark, sf: B.sides(B.wide(hourly(spark, sf), HOUR)), O.sides(_h, HOUR)),
    "mp_self_raw_k1": (_self(daily, DAY, normalize=False), O.profile(_days, DAY, 1, False)),
    "mp_self_raw_topk": (_self(daily, DAY, normalize=False, k=3), O.profile(_days, DAY, 3, False)),
    "mp_raw_left_right": (lambda spark, sf: B.sides(B.wide(daily(spark, sf), DAY, normalize=False)), O.sides(_days, DAY, False)),
    "mp_raw_exact_ties": (_self(lambda spark, sf: daily(spark, sf, 8), DAY, normalize=False, k=4), O.profile(_steps, DAY, 4, False)),
    "mp_raw_huge": (scaled_days(900), O.profile(_days, DAY, 2, False)),
    "mp_raw_tiny": (scaled_days(-900), O.profile(_days, DAY, 2, False)),
    "mp_user_flags": (_user_flags, O.profile(_h, HOUR, constant="i % 5 = 0")),
    "mp_user_function": (_user_function, O.profile(_h, HOUR, constant="w[1]::BIGINT % 7 = 0")),
    "array_stump": (_array_profile(lambda t: api.stump(t, HOUR, k=2)), O.profile(_h, HOUR, 2)),
    "array_gpu_stump": (_array_profile(lambda t: api.gpu_stump(t, HOUR, t.copy(), True, [0, 1])), O.profile(_h, HOUR)),
    "array_gpu_aamp": (_array_profile(lambda t: api.gpu_aamp(t, HOUR, k=2, device_id=0)), O.profile(_h, HOUR, 2, False)),
    "array_aamp_ab": (
        _array_profile(lambda t: api.aamp(t[:300], HOUR, t[300:], False)),
        O.ab(f"{O.hourly(name='h')}, s AS (SELECT * FROM h WHERE i < 300)", "t AS (SELECT series_id, i - 300 AS i, v FROM h WHERE i >= 300)", HOUR, False),
    ),
    "mp_ab_norm": (_ab("click", "view", True), O.ab(O.hourly(kinds="'click'"), O.hourly(kinds="'view'", name="t"), HOUR, True)),
    "mp_ab_raw": (_ab("click", "view", False, 2), O.ab(O.hourly(kinds="'click'"), O.hourly(kinds="'view'", name="t"), HOUR, False, 2)),
    "mp_ab_by_series": (
        _ab_zero,
        O.ab(O.hourly_by_type("0.0"), "t AS (SELECT x.series_id, y.i, y.v FROM (SELECT DISTINCT series_id FROM s) x CROSS JOIN (SELECT i, v FROM s WHERE series_id = 'view') y)", HOUR, False),
    ),
    "mp_constant_windows": (_self(lambda spark, sf: hourly(spark, sf, flat=FLAT), HOUR, k=2), O.profile(_flat, HOUR, 2)),
    "mp_nonfinite_windows": (_self(lambda spark, sf: hourly(spark, sf, nan=GAPS, flat=FLAT), HOUR), O.profile(_special, HOUR)),
    "mp_excl_denom_1": (_self(hourly, HOUR, denom=1), O.profile(_h, HOUR, denom=1)),
    "mp_excl_denom_2_5": (_self(hourly, HOUR, denom=2.5), O.profile(_h, HOUR, denom=2.5)),
    "mp_excl_denom_8": (_self(hourly, HOUR, denom=8), O.profile(_h, HOUR, denom=8)),
    "mp_by_series": (_self(by_type, HOUR), O.profile(O.hourly_by_type(), HOUR)),
    "mp_small_blocks": (_self(hourly, HOUR, k=2, block=96), O.profile(_h, HOUR, 2)),
    "mp_sql_tier": (lambda spark, sf: _long(S.profile(hourly(spark, sf), HOUR)), O.profile(_h, HOUR)),
    "mp_sql_tier_sides": (lambda spark, sf: S.sides(hourly(spark, sf), HOUR), O.sides(_h, HOUR)),
    "mp_long_series": (_values_profile, O.long_profile(_VALUES, 50)),
    # distance profiles and matches
    "mass_norm": (_mass(400, True), f"WITH {O.query_profile(_h, HOUR, 400, True)} SELECT '0' AS query_id, series_id, j::BIGINT AS j, round(d, 6) AS d FROM d"),
    "mass_raw": (_mass(400, False), f"WITH {O.query_profile(_h, HOUR, 400, False)} SELECT '0' AS query_id, series_id, j::BIGINT AS j, round(d, 6) AS d FROM d"),
    "mass_query_idx": (
        _mass(400, True, True, lambda spark, sf: hourly(spark, sf, nan=GAPS)),
        f"WITH {O.query_profile(_gaps, HOUR, 400, True, True)} SELECT '0' AS query_id, series_id, j::BIGINT AS j, round(d, 6) AS d FROM d",
    ),
    "mass_isfinite_override": (
        _isfinite_override,
        f"WITH {O.query_profile(_gaps.replace(chr(39) + 'nan' + chr(39) + '::DOUBLE', '0.0'), HOUR, 400, False)} SELECT '0' AS query_id, series_id, j::BIGINT AS j, round(d, 6) AS d FROM d",
    ),
    "mass_long_series": (
        _values_mass,
        f"WITH {_VALUES}, {O.windows(50)} SELECT q.query_id, '0' AS series_id, b.i::BIGINT AS j, round({O.distance(50, True, snap=False)}, 6) AS d "
        "FROM (VALUES ('0', 100), ('1', 500)) q(query_id, s) JOIN w a ON a.i = q.s CROSS JOIN w b",
    ),
    "match_default_threshold": (_match(400), O.matches(_h, HOUR, 400)),
    "match_fixed_threshold": (_match(400, max_distance=5.5), O.matches(_h, HOUR, 400, cutoff="5.5")),
    "match_topk": (_match(400, max_distance=float("inf"), max_matches=7), O.matches(_h, HOUR, 400, cutoff="'inf'::DOUBLE", most=7)),
    "match_query_idx": (_match(400, own=True, query_idx=400, max_distance=6.0), O.matches(_h, HOUR, 400, cutoff="6.0", first=400, own=True)),
    "aamp_match": (_match(400, normalize=False), O.matches(_h, HOUR, 400, False)),
    "array_mass_means": (
        _array_mass,
        f"WITH {O.query_profile(_h, HOUR, 400, True)} SELECT j::BIGINT AS j, CASE WHEN j = 7 THEN 'inf'::DOUBLE ELSE round(d, 6) END AS d FROM d",
    ),
    "array_prepared_match": (_array_match, O.matches(_h, HOUR, 400, cutoff="(SELECT 0.75 * avg(d) FROM d)")),
    "match_certified": (_certified, O.matches(O.with_copies(O.hourly(name="h"), 100, 400, HOUR), HOUR, 400, cutoff="(SELECT 0.75 * avg(d) FROM d)")),
    "discords_top10": (_discords, O.discords(_h, HOUR, 10)),
    "motif_top1": (_motif, O.motif(_h, HOUR)),
    # pan profile
    "stimp_profiles": (
        _pan_profiles,
        f"WITH {O.pan_profiles(O.hourly(nan=(144,)), _pan_rows(len(_SIZES)))} SELECT pan_row::INT AS pan_row, upd::INT AS upd, m::INT AS m, i::BIGINT AS i, round(p, 6) AS p FROM pr",
    ),
    "pan_normalize": (_pan(8, contrasted=False, binary=False), O.pan_picture(O.hourly(nan=(144,)), _pan_rows(8), 8, contrast=False, binary=False)),
    "pan_contrast": (_pan(8, binary=False), O.pan_picture(O.hourly(nan=(144,)), _pan_rows(8), 8, binary=False)),
    "pan_binary": (_pan(8), O.pan_picture(O.hourly(nan=(144,)), _pan_rows(8), 8)),
    "pan_partial_repeat": (_pan(3, threshold=0.5, binary=False), O.pan_picture(O.hourly(nan=(144,)), _pan_rows(3), 8, threshold=0.5, binary=False)),
    "pan_raw": (_raw_pan, O.pan_picture(O.hourly(nan=(144,)), _pan_rows(3), 8, threshold=0.5, binary=False, normalize=False)),
    "array_gpu_stimp": (_array_pan, O.pan_picture(_h, _pan_rows(3), 8, threshold=0.5, contrast=False, binary=False, normalize=False)),
    # series
    "series_equal_ab": (
        _equality,
        f"""WITH {O.hourly_by_type()}, a AS (SELECT * FROM s UNION ALL SELECT 'view again', i, v FROM s WHERE series_id = 'view'),
e AS (SELECT a.series_id, b.series_id AS first_id, bool_and(coalesce(a.v = b.v, FALSE) OR NOT isfinite(a.v) AND NOT isfinite(b.v)) AS same
  FROM a JOIN a b USING (i) GROUP BY ALL)
SELECT series_id, min(first_id) AS first_id, 1::INT AS is_equal FROM e WHERE same GROUP BY series_id""",
    ),
    "profile_stats": (
        _statistics,
        f"""WITH {_gaps}, {O.windows(HOUR)}, {O.pairs(HOUR)}, n AS (SELECT w.i, min(p.d) AS d FROM w LEFT JOIN p USING (i) GROUP BY ALL)
SELECT '0' AS series_id, round(avg(d), 6) AS mean_p, round(min(d), 6) AS min_p, round(max(d), 6) AS max_p, count(*) FILTER (d IS NULL)::BIGINT AS n_missing FROM n""",
    ),
}

QUERIES: dict[str, Query] = {name: q for name, (q, _) in TABLE.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in TABLE.items() if sql}
