"""Distance profiles: one query against all windows of every series.

Queries are rows (query_id, q); a query has the window length in samples, so
the table of queries is broadcast only when it is small (Spark decides by
size), and each block of windows is visited once for all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import blocks as B
from tessella.operators.profile import block_rows
from tessella.plans.planner import block_windows
from tessella.sources.series import check_schema

PROFILE = "query_id string, series_id string, j long, d double"


def queries_from_windows(series: DataFrame, starts: dict[str, int], m: int) -> DataFrame:
    """(query_id, q): windows of stored series as queries; ``starts`` is {query_id: first sample}."""
    spark = series.sparkSession
    at = spark.createDataFrame([(k, int(v)) for k, v in starts.items()], "query_id string, s long")
    rows = series.join(F.broadcast(at), (F.col("i") >= F.col("s")) & (F.col("i") < F.col("s") + m))
    rows = rows.groupBy("query_id", "series_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    return rows.where(F.size("x") == m).select("query_id", "series_id", F.col("x.v").alias("q"))


def distance_profile(
    queries: DataFrame, series: DataFrame, m: int, normalize: bool = True,
    constant: DataFrame | None = None, finite: DataFrame | None = None, query_constant: bool | None = None,
    block: int | None = None,
) -> DataFrame:
    """(query_id, series_id, j, d) of each query (query_id, q array) against each window.

    A query with a missing sample is at infinity from all; so is a window with
    one.  ``constant`` (series_id, i, is_constant) overrides the flags of
    windows, ``finite`` (series_id, i, is_finite), in raw mode, which windows
    are measured: one forced finite has 0 for missing samples.
    """
    series = check_schema(series)
    block = block_windows(m) if block is None else block
    rows = block_rows(series, m, block, constant)
    if finite is not None and not normalize:
        f = finite.select("series_id", "i", "is_finite", F.call_function("div", F.col("i"), F.lit(block).cast("long")).alias("b"))
        f = f.groupBy("series_id", "b").agg(F.array_sort(F.collect_list(F.struct("i", "is_finite"))).alias("f"))
        rows = rows.join(f.select("series_id", "b", F.col("f.is_finite").alias("fin")), ["series_id", "b"], "left")
    else:
        rows = rows.withColumn("fin", F.lit(None).cast("array<boolean>"))
    asked = queries.select("query_id", "q", *(["series_id"] if "series_id" in queries.columns else []))
    joined = rows.join(asked, "series_id") if "series_id" in asked.columns else rows.crossJoin(asked)
    joined = joined.select("query_id", "series_id", "b", "samples", "flags", "fin", "q").sortWithinPartitions("series_id", "b")

    def run(batches):
        last, made = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                qid, sid, number = (batch.column(c)[r].as_py() for c in range(3))
                if last != (sid, number):
                    values = np.array(batch.column(3)[r].as_py(), np.float64)
                    flags, fin = batch.column(4)[r].as_py(), batch.column(5)[r].as_py()
                    made = B.block(
                        values, number * block, m, normalize,
                        None if flags is None else np.array(flags, bool), None if fin is None else np.array(fin, bool),
                    )
                    last = (sid, number)
                q = np.array([np.nan if x is None else x for x in batch.column(6)[r].as_py()], np.float64)
                if not np.isfinite(q).all():
                    d = np.full(made.n, np.inf)
                else:
                    flat = bool(q.min() == q.max()) if query_constant is None else query_constant
                    d = B.distance_profile(q, made, flat)
                j = np.arange(made.first, made.first + made.n)
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array([qid] * made.n, pa.string()), "series_id": pa.array([sid] * made.n, pa.string()),
                    "j": pa.array(j), "d": pa.array(d),
                })

    return joined.mapInArrow(run, PROFILE)


def with_query_index(profile: DataFrame, query_idx: int, normalize: bool) -> DataFrame:
    """The profile with the query's own window at 0; in raw mode only where it is finite."""
    own = F.col("j") == query_idx
    if not normalize:
        own = own & (F.col("d") < float("inf"))
    return profile.withColumn("d", F.when(own, F.lit(0.0)).otherwise(F.col("d")))
