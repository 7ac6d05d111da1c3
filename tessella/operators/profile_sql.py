"""Matrix profile in pure SQL expressions: for short series, and as an auditable form.

Windows are arrays; the join of windows with windows of the same series outside
the exclusion zone is a theta join; the best neighbours are struct minima or a
ranked window (which Spark limits before its shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.distance import raw_squared, tie_key, znorm_squared, znormalised
from tessella.functions.rolling import windows
from tessella.plans.planner import exclusion_zone


def _prepared(series: DataFrame, m: int, normalize: bool) -> DataFrame:
    w = windows(series, m)
    if normalize:
        safe = F.when(F.col("is_finite"), F.col("w")).otherwise(F.array_repeat(F.lit(0.0), m))
        w = w.withColumn("w", znormalised(safe, m))
    return w


def pairs(series: DataFrame, m: int, other: DataFrame | None = None, normalize: bool = True, denom=None) -> DataFrame:
    """(series_id, i, j, d2, key) of all admissible window pairs."""
    a = _prepared(series, m, normalize)
    b = _prepared(other, m, normalize) if other is not None else a
    b = b.select("series_id", F.col("i").alias("j"), F.col("w").alias("wb"), F.col("is_finite").alias("fb"), F.col("is_constant").alias("cb"))
    i, j = F.col("i"), F.col("j")
    joined = a.join(b, "series_id")
    if other is None:
        joined = joined.where(F.abs(i - j) > exclusion_zone(m, denom))
    if normalize:
        d2 = znorm_squared(F.col("w"), F.col("wb"), F.col("is_constant"), F.col("cb"), F.col("is_finite"), F.col("fb"), m)
    else:
        d2 = raw_squared(F.col("w"), F.col("wb"), F.col("is_finite"), F.col("fb"))
    return joined.select("series_id", "i", "j", d2.alias("d2"), tie_key(i, j, other is None).alias("key"))


def profile(series: DataFrame, m: int, other: DataFrame | None = None, normalize: bool = True, k: int = 1, denom=None) -> DataFrame:
    """(series_id, i, rank, p, j): the k nearest neighbours; (inf, -1) where there are fewer."""
    found = pairs(series, m, other, normalize, denom).where(F.col("d2") < float("inf"))
    rank = F.row_number().over(Window.partitionBy("series_id", "i").orderBy("d2", "key"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k).select("series_id", "i", "rank", F.sqrt("d2").alias("p"), "j")
    slots = windows(series, m).select("series_id", "i", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(best, ["series_id", "i", "rank"], "left").select(
        "series_id", "i", "rank", F.coalesce("p", F.lit(float("inf"))).alias("p"), F.coalesce("j", F.lit(-1).cast("long")).alias("j")
    )


def sides(series: DataFrame, m: int, normalize: bool = True, denom=None) -> DataFrame:
    """(series_id, i, left_j, right_j) of a self-join; -1 where there is none."""
    found = pairs(series, m, None, normalize, denom).where(F.col("d2") < float("inf"))
    agg = found.groupBy("series_id", "i").agg(
        F.min(F.when(F.col("j") < F.col("i"), F.struct("d2", "key", "j"))).alias("l"),
        F.min(F.when(F.col("j") > F.col("i"), F.struct("d2", "key", "j"))).alias("r"),
    )
    none = F.lit(-1).cast("long")
    return windows(series, m).select("series_id", "i").join(agg, ["series_id", "i"], "left").select(
        "series_id", "i", F.coalesce("l.j", none).alias("left_j"), F.coalesce("r.j", none).alias("right_j")
    )
