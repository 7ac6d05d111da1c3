"""Rolling functions over the windows of a series table.

A window i covers samples i .. i+m-1.  Samples are dealt to blocks of windows,
with the m-1 samples after a block repeated in it, so frames are evaluated in
partitions of bounded size however long a series is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessella.sources.series import as_value, is_finite

BLOCK = 1 << 16


def blocks_of(i: Column, m: int, block: int) -> Column:
    """The blocks that need sample ``i``: those of the windows that hold it."""
    first = F.greatest(F.lit(0).cast("long"), F.call_function("floor", (i - (m - 1)) / F.lit(float(block))).cast("long"))
    return F.sequence(first, F.call_function("div", i, F.lit(block).cast("long")))


def blocked(series: DataFrame, m: int, block: int = BLOCK) -> DataFrame:
    """The samples of every block, with the block's number ``b``."""
    return series.select("series_id", "i", as_value(F.col("v")).alias("v"), F.explode(blocks_of(F.col("i"), m, block)).alias("b"))


def frame(m: int) -> WindowSpec:
    return Window.partitionBy("series_id", "b").orderBy("i").rowsBetween(0, m - 1)


def rolling(series: DataFrame, m: int, block: int = BLOCK, **columns: Column) -> DataFrame:
    """One row a window: series_id, i and the given window expressions (over ``frame(m)``)."""
    rows = blocked(series, m, block)
    rows = rows.select("series_id", "i", "b", F.count("*").over(frame(m)).alias("_n"), *[c.alias(n) for n, c in columns.items()])
    return rows.where((F.col("_n") == m) & (F.call_function("div", F.col("i"), F.lit(block).cast("long")) == F.col("b"))).select("series_id", "i", *columns)


def finite_window(m: int) -> Column:
    """True where all samples of the window are finite."""
    return F.min(is_finite(F.col("v")).cast("int")).over(frame(m)) == 1


def constant_window(m: int) -> Column:
    """True where the window is finite and its minimum equals its maximum."""
    return finite_window(m) & (F.min("v").over(frame(m)) == F.max("v").over(frame(m)))


def _if_finite(m: int, c: Column) -> Column:
    return F.when(finite_window(m), c)


def rolling_min_max(series: DataFrame, m: int) -> DataFrame:
    """Minimum and maximum of each finite window, null for others."""
    return rolling(series, m, w_min=_if_finite(m, F.min("v").over(frame(m))), w_max=_if_finite(m, F.max("v").over(frame(m))))


def rolling_sum(series: DataFrame, m: int) -> DataFrame:
    return rolling(series, m, w_sum=_if_finite(m, F.sum("v").over(frame(m))))


def rolling_mean_std(series: DataFrame, m: int) -> DataFrame:
    """Mean and population deviation, evaluated afresh in each frame (no running sums)."""
    return rolling(series, m, w_mean=_if_finite(m, F.avg("v").over(frame(m))), w_std=_if_finite(m, F.stddev_pop("v").over(frame(m))))


def window_flags(series: DataFrame, m: int) -> DataFrame:
    """Finite and constant flags of each window."""
    return rolling(series, m, is_finite=finite_window(m), is_constant=constant_window(m))


def windows(series: DataFrame, m: int) -> DataFrame:
    """Each window as an array, with its flags: the input of the SQL tier."""
    return rolling(
        series, m,
        w=F.collect_list("v").over(frame(m)), is_finite=finite_window(m), is_constant=constant_window(m),
    )
