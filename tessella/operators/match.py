"""Occurrences of a query: a threshold on its distance profile, then nearest-first selection.

The selection takes the lowest (distance, index) left and then excludes its
zone, until nothing is left or there are enough.  Whatever is not the lowest
within a zone's reach of itself cannot be decided before its neighbours, but a
local minimum can: so rounds of local minima, each one window function over
positions, give the sequential result and run in parallel.  Short candidate
lists are walked in one pass instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import affine
from tessella.plans.planner import exclusion_zone
from tessella.sources.series import check_schema, checkpointed

#: Candidates of one query in one series up to which one task walks them.
WALK = 200_000


def default_threshold(profile: DataFrame) -> DataFrame:
    """(query_id, series_id, cutoff): max(mean - 2 deviations, minimum) of the finite distances."""
    d = F.when(F.col("d") < float("inf"), F.col("d"))
    return profile.groupBy("query_id", "series_id").agg(
        F.least(F.max(d), F.greatest(F.min(d), F.avg(d) - 2 * F.stddev_pop(d))).alias("cutoff")
    )


def greedy(d: np.ndarray, j: np.ndarray, excl: int, most: float, first: int | None = None) -> list[int]:
    """Positions in ``d`` of the selection, nearest first; ``first`` is considered before all."""
    order = np.lexsort((j, d))
    taken: list[int] = []
    blocked: set[int] = set()
    if first is not None:
        own = np.flatnonzero(j == first)
        if not len(own):
            return []
        order = np.concatenate([own, order[order != own[0]]])
    for p in order.tolist():
        if len(taken) >= most:
            break
        at = int(j[p])
        if at in blocked:
            continue
        taken.append(p)
        blocked.update(range(at - excl, at + excl + 1))
    return taken


def select(
    profile: DataFrame, m: int, max_distance: float | DataFrame | Callable[[DataFrame], DataFrame] | None = None, max_matches: float | None = None,
    atol: float = 1e-8, query_idx: int | None = None, denom=None,
) -> DataFrame:
    """(query_id, series_id, rank, d, j) from a distance profile (query_id, series_id, j, d).

    ``max_distance`` is a number, a table (query_id, series_id, cutoff), a
    function from the profile to such a table, or None for the default.
    """
    excl = exclusion_zone(m, denom)
    most = math.inf if max_matches is None else float(max_matches)
    finite = profile.where(F.col("d") < float("inf"))
    if isinstance(max_distance, (int, float)):
        ok = finite if math.isnan(max_distance) else finite.where(F.col("d") <= atol + float(max_distance))
    else:
        cut = default_threshold(profile) if max_distance is None else max_distance(profile) if callable(max_distance) else max_distance
        ok = finite.join(cut, ["query_id", "series_id"]).where(F.isnan("cutoff") | (F.col("d") <= F.col("cutoff") + atol)).drop("cutoff")
    own = None
    if query_idx is not None:  # taken first whatever its rank; without it there are no matches
        ok = checkpointed(ok)
        own = ok.where(F.col("j") == int(query_idx))
        ok = ok.join(own.select("query_id", "series_id"), ["query_id", "series_id"], "left_semi").where(F.abs(F.col("j") - int(query_idx)) > excl)
        most -= 1
    if most < math.inf:
        # only so many of the nearest can be visited; a rank limit is applied before rows move
        rank = F.row_number().over(Window.partitionBy("query_id", "series_id").orderBy("d", "j"))
        ok = ok.withColumn("_r", rank).where(F.col("_r") <= max(0, math.ceil(most)) * (2 * excl + 1)).drop("_r")
    ok = checkpointed(ok)
    largest = ok.groupBy("query_id", "series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > WALK:
        found = local_minima(ok, excl)
    else:

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            got = pdf.iloc[greedy(pdf["d"].to_numpy(), pdf["j"].to_numpy(), excl, most)]
            return got[["query_id", "series_id", "j", "d"]]

        found = ok.groupBy("query_id", "series_id").applyInPandas(walk, "query_id string, series_id string, j long, d double")
    found = found.withColumn("_o", F.lit(1))
    if own is not None:
        found = found.unionByName(own.select("query_id", "series_id", "j", "d", F.lit(0).alias("_o")))
        most += 1
    rank = F.row_number().over(Window.partitionBy("query_id", "series_id").orderBy("_o", "d", "j"))
    found = found.select("query_id", "series_id", rank.alias("rank"), "d", "j")
    return found.where(F.col("rank") <= most) if most < math.inf else found


def certified(profile: DataFrame, queries: DataFrame, series: DataFrame, m: int, below: float = 1e-6) -> DataFrame:
    """A z-normalised profile whose distances under ``below`` are decided in rational arithmetic.

    An exact copy a*q + b with a > 0 is at 0, anything else at its true
    distance.  Only the windows of such suspects are fetched; ``queries`` is
    (query_id, q) or (query_id, series_id, q).  Constant windows and queries
    keep their distances.
    """
    key = ["query_id", "series_id", "j"]
    suspects = profile.where(F.col("d") < below).select(*key, "d")
    at = suspects.select(*key, F.explode(F.sequence(F.col("j"), F.col("j") + (m - 1))).alias("i"))
    w = at.join(check_schema(series), ["series_id", "i"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("w"))
    asked = queries.select("query_id", "q", *(["series_id"] if "series_id" in queries.columns else []))
    rows = suspects.join(w.select(*key, F.col("w.v").alias("w")), key).join(asked, [c for c in asked.columns if c != "q"])

    def run(batches):
        for batch in batches:
            out = []
            for q, w, d in zip(*(batch.column(c).to_pylist() for c in (3, 4, 5))):
                q, w = np.array(q, np.float64), np.array(w, np.float64)
                out.append(float(affine.refine_near_zero(q, w[None, :], np.array([d]), np.array([w.min() == w.max()]), below)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], names=[*key, "_d"])

    exact = rows.select(*key, "q", "w", "d").mapInArrow(run, "query_id string, series_id string, j long, _d double")
    return profile.join(exact, key, "left").withColumn("d", F.coalesce("_d", "d")).select(*profile.columns)


def local_minima(candidates: DataFrame, excl: int) -> DataFrame:
    """The selection among all candidates by rounds of local minima.

    A candidate is taken when no candidate left within its zone comes before it
    by (distance, index).  Positions are dealt to bands with the zone repeated
    around them, so no round sorts a whole series in one task.
    """
    band = max(1 << 16, 8 * (excl + 1))
    left, taken = candidates.select("query_id", "series_id", "j", "d"), None
    while True:
        spread = F.sequence(
            F.call_function("div", F.greatest(F.col("j") - excl, F.lit(0)), F.lit(band).cast("long")),
            F.call_function("div", F.col("j") + excl, F.lit(band).cast("long")),
        )
        near = Window.partitionBy("query_id", "series_id", "b").orderBy("j").rangeBetween(-excl, excl)
        home = F.call_function("div", F.col("j"), F.lit(band).cast("long")) == F.col("b")
        rows = left.withColumn("b", F.explode(spread)).withColumn("best", F.min(F.struct("d", "j")).over(near))
        first = checkpointed(rows.where(home & (F.col("best.j") == F.col("j"))).select("query_id", "series_id", "j", "d"))
        taken = first if taken is None else taken.unionByName(first)
        zone = first.select("query_id", "series_id", F.explode(F.sequence(F.col("j") - excl, F.col("j") + excl)).alias("j"))
        left = checkpointed(left.join(zone, ["query_id", "series_id", "j"], "left_anti"))
        if left.isEmpty():
            return taken


def discords(profile: DataFrame, m: int, k: int, denom=None) -> DataFrame:
    """The k windows farthest from their nearest neighbour, zones apart: (series_id, rank, p, i)."""
    far = profile.select(F.lit("discord").alias("query_id"), "series_id", F.col("i").alias("j"), (-F.col("p")[0]).alias("d"))
    far = far.where(F.col("d") > float("-inf"))
    found = select(far, m, max_distance=float("inf"), max_matches=k, denom=denom)
    return found.select("series_id", "rank", (-F.col("d")).alias("p"), F.col("j").alias("i"))


def motif(profile: DataFrame) -> DataFrame:
    """The closest pair of each series: (series_id, p, i, j); ties to the lowest window."""
    best = profile.groupBy("series_id").agg(F.min(F.struct(F.col("p")[0].alias("p"), "i", F.col("j")[0].alias("j"))).alias("x"))
    return best.select("series_id", "x.p", "x.i", "x.j")
