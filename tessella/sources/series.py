"""Series as tables: (series_id STRING, i BIGINT, v DOUBLE), i dense from 0 in each series.

A null value counts as missing, like NaN and the infinities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SCHEMA = "series_id string, i long, v double"


def as_value(c: Column) -> Column:
    """DOUBLE with null replaced by NaN: aggregates over rows would drop a null."""
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def check_schema(df: DataFrame) -> DataFrame:
    """A series table with exactly its three columns; the value must be DOUBLE already."""
    kinds = dict(df.dtypes)
    missing = {"series_id", "i", "v"} - kinds.keys()
    if missing:
        raise ValueError(f"a series table needs the columns {sorted(missing)}")
    if kinds["v"] != "double":
        raise TypeError(f"series values must be double but are {kinds['v']}")
    return df.select(F.col("series_id").cast("string").alias("series_id"), F.col("i").cast("long").alias("i"), as_value(F.col("v")).alias("v"))


def indexed(df: DataFrame, value: Column, order: list[Column], by: Column | None = None) -> DataFrame:
    """A series table of ``value`` in the given order, one series for each value of ``by``.

    With ``by``, positions are numbered inside each series.  Without, the rows
    are range-partitioned by the order and numbered by partition offsets, so
    one long series is never sorted in one task.
    """
    if by is not None:
        cols = [by.cast("string").alias("series_id"), as_value(value).alias("v"), *[o.alias(f"_o{k}") for k, o in enumerate(order)]]
        names = [F.col(f"_o{k}") for k in range(len(order))]
        i = F.row_number().over(Window.partitionBy("series_id").orderBy(*names)) - 1
        return df.select(*cols).withColumn("i", i.cast("long")).select("series_id", "i", "v")
    names = [F.col(f"_o{k}").asc() for k in range(len(order))]
    rows = df.select(F.lit("0").alias("series_id"), as_value(value).alias("v"), *[o.alias(f"_o{k}") for k, o in enumerate(order)])
    return numbered(rows, ["series_id"], names, "i").select("series_id", "i", "v")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place from 0 of each row among those with its values of ``by``, in the given order.

    Rows are dealt to ranges of (by, order) and numbered by their place in the
    range and the counts of ranges before, so no group, however large, is
    sorted in one task.  Rows that are equal in (by, order) are numbered in any
    order.
    """
    keys = [F.col(c).asc() for c in by]
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # the place of a row in its partition is the low part of the generated id
    rows = rows.withColumns({"_p": F.spark_partition_id(), "_g": F.monotonically_increasing_id()})
    rows = rows.withColumn("_g", F.col("_g") - F.shiftleft(F.col("_p").cast("long"), 33))
    rows = checkpointed(rows)  # numbers and offsets must see the same ranges
    counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.min("_g").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))  # a row for each group in each range
    return rows.join(offsets, [*by, "_p"]).withColumn(name, F.col("_base") + F.col("_g")).drop("_p", "_g", "_base")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialised in the shared checkpoint folder, which survives lost executors."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))  # one machine, as in tests
    return df.checkpoint(eager=True)


#: For each unit of time a longer one, whose units are numbered apart.
_LONGER = {"second": "day", "minute": "month", "hour": "year", "day": "year", "week": "year", "month": "year"}


def bucketed(df: DataFrame, time: Column, value: Column, unit: str, by: Column | None = None) -> DataFrame:
    """One sample a calendar unit (`hour`, `day`): the aggregate ``value`` of its rows, in time order.

    Units without rows are left out; see ``gridded`` for a dense grid.
    """
    keys = [F.date_trunc(unit, time).alias("_t")] + ([by.cast("string").alias("series_id")] if by is not None else [])
    agg = df.groupBy(*keys).agg(as_value(value).alias("v"))
    if by is None:
        agg = agg.withColumn("series_id", F.lit("0"))
    return _by_time(agg, unit)


def _by_time(agg: DataFrame, unit: str) -> DataFrame:
    """(series_id, i, v) of (series_id, _t, v), numbered by time: within each longer unit, then by the counts before."""
    agg = agg.withColumn("_long", F.date_trunc(_LONGER[unit], F.col("_t")))
    place = F.row_number().over(Window.partitionBy("series_id", "_long").orderBy("_t")) - 1
    counts = agg.groupBy("series_id", "_long").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("series_id").orderBy("_long").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("series_id"), F.col("_long"), F.coalesce(before, F.lit(0)).alias("_base"))
    same = [F.col("a.series_id") == F.col("o.series_id"), F.col("a._long").eqNullSafe(F.col("o._long"))]
    rows = agg.withColumn("_k", place).alias("a").join(offsets.alias("o"), same)
    return rows.select("a.series_id", (F.col("_base") + F.col("_k")).cast("long").alias("i"), "v")


def gridded(df: DataFrame, time: Column, value: Column, unit: str, by: Column, fill: float = float("nan")) -> DataFrame:
    """Like ``bucketed`` on one dense grid from the table's first unit to its last; gaps get ``fill``."""
    agg = df.groupBy(by.cast("string").alias("series_id"), F.date_trunc(unit, time).alias("_t")).agg(value.alias("_v"))
    ends = agg.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    step = F.expr(f"interval 1 {unit}")
    # `ends` is one row
    full = agg.select("series_id").distinct().join(F.broadcast(ends), F.lit(True))
    full = full.select("series_id", F.explode(F.sequence("lo", "hi", step)).alias("_t"))
    joined = full.join(agg, ["series_id", "_t"], "left")
    return _by_time(joined.select("series_id", "_t", as_value(F.coalesce("_v", F.lit(fill))).alias("v")), unit)


def from_array(spark: SparkSession, values: np.ndarray, series_id: str = "0") -> DataFrame:
    """A series table of an in-memory series."""
    v = check_series(values)
    table = pa.table({"series_id": pa.array([series_id] * len(v)), "i": pa.array(np.arange(len(v))), "v": pa.array(v)})
    return spark.createDataFrame(table, schema=T.StructType([T.StructField("series_id", T.StringType()), T.StructField("i", T.LongType()), T.StructField("v", T.DoubleType())]))


def check_series(a, name: str = "T") -> np.ndarray:
    """A private native float64 copy of a one-dimensional series; (n, 1) columns are flattened by the callers that allow it."""
    arr = np.asarray(a)
    if arr.dtype.kind != "f" or arr.dtype.itemsize != 8:
        raise TypeError(f"`{name}` must have dtype float64 but has {arr.dtype}")
    if arr.ndim != 1:
        raise ValueError(f"`{name}` must be 1-dimensional but has {arr.ndim} dimensions")
    return np.array(arr, dtype=np.float64)


def flattened(a) -> np.ndarray:
    arr = np.asarray(a)
    return arr.reshape(-1) if arr.ndim == 2 and arr.shape[1] == 1 else arr


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored series table (any of Spark's formats)."""
    reader = spark.read.schema(SCHEMA) if fmt in ("csv", "json") else spark.read
    return check_schema(reader.format(fmt).load(path))


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Stores any result table."""
    df.write.format(fmt).mode(mode).save(path)
