"""Profiles of growing series.

New samples add windows, and only pairs with a new window can change a profile.
The state is the best lists of every block; an update joins the blocks that
have new windows with all others, and merges.  ``GrowingProfile`` keeps series
and state as tables and can be the sink of a streaming query.

An update writes its samples and the new state under its number and enters the
number, with the batch it took, into a log last.  What a crash left behind is
written again; a batch that is in the log is not taken twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import blocks as B
from tessella.operators.profile import _PART, _merged, _partials
from tessella.plans.planner import block_windows, check_window_size, exclusion_zone, positive_int
from tessella.sources.series import SCHEMA, check_schema


def merged_state(parts: DataFrame, block: int, k: int) -> DataFrame:
    """One row for each (series, block, side)."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        size, n = (k if first["side"] == "all" else 1), int(pdf["n"].max())
        best = B.Best(int(first["b"]) * block, n, size, True)
        for d2, j in zip(pdf["d2"], pdf["j"]):
            best.add(np.repeat(np.arange(len(j) // size), size), np.asarray(j, np.int64), np.asarray(d2, np.float64))
        row = {"series_id": first["series_id"], "b": first["b"], "side": first["side"], "n": n}
        return pd.DataFrame([row | {"d2": best.d2.reshape(-1), "j": best.j.reshape(-1)}])

    return parts.groupBy("series_id", "b", "side").applyInPandas(merge, _PART)


_LOG = "version long, batch long"


class GrowingProfile:
    """The self-join profile of series that grow at their end; state in ``path``, where it goes on when opened again."""

    def __init__(self, spark: SparkSession, path: str, m: int, k: int = 1, normalize: bool = True, denom=None):
        self.spark, self.path = spark, path.rstrip("/")
        self.m, self.k, self.normalize = check_window_size(m, m), positive_int(k, "k"), normalize
        self.excl, self.block = exclusion_zone(m, denom), block_windows(m)
        self.version, self.batch = self._last()

    def _last(self) -> tuple[int, int]:
        """The number of the last complete update, and the last batch of a stream that was taken; 0 and -1 at first."""
        try:
            row = self.spark.read.schema(_LOG).parquet(f"{self.path}/log").agg(F.max("version"), F.max("batch")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, -1
        return row[0] or 0, -1 if row[1] is None else row[1]

    def _read(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def series(self) -> DataFrame:
        return self._samples(self.version)

    def _samples(self, version: int) -> DataFrame:
        """All samples up to an update; each update's are written once."""
        return self._read(SCHEMA, *(f"{self.path}/series/{v}" for v in range(1, version + 1)))

    def _state(self) -> DataFrame:
        return self._read(_PART, *([f"{self.path}/state/{self.version}"] if self.version else []))

    def update(self, samples: DataFrame, batch: int | None = None) -> None:
        """Takes new samples (series_id, i, v); positions continue each series without gaps.

        ``batch`` numbers the batches of a stream; one that was taken before
        changes nothing.
        """
        if batch is not None and batch <= self.batch:
            return
        then = self.version + 1
        check_schema(samples).write.mode("overwrite").parquet(f"{self.path}/series/{then}")
        new, every = self._read(SCHEMA, f"{self.path}/series/{then}"), self._samples(then)
        start = new.groupBy("series_id").agg(F.min("i").alias("i"))
        # the first window that holds a new sample
        block = F.call_function("div", F.greatest(F.col("i") - (self.m - 1), F.lit(0).cast("long")), F.lit(self.block).cast("long"))
        first = start.select("series_id", block.alias("first_block"))
        touched = every.join(first.select("series_id"), "series_id", "left_semi")
        parts = _partials(touched, None, self.m, self.block, self.k, self.excl, self.normalize, first=first)
        kept = self._state().join(first, "series_id", "left").where(F.col("first_block").isNull() | (F.col("b") < F.col("first_block")))
        state = merged_state(kept.drop("first_block").unionByName(parts), self.block, self.k)
        state.write.mode("overwrite").parquet(f"{self.path}/state/{then}")
        self.spark.createDataFrame([(then, batch)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self.version, self.batch = then, self.batch if batch is None else batch

    def profile(self) -> DataFrame:
        """series_id, i, p, j, left_j, right_j of all windows so far."""
        return _merged(self._state(), self.block, self.k, True, self.normalize)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Updates from a streaming DataFrame of samples, one update a micro-batch; one stream, with one checkpoint, for a profile."""

        def batch(df: DataFrame, number: int) -> None:
            if not df.isEmpty():
                self.update(df, number)

        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
