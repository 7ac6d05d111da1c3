"""Matrix profile, block tier.

Each series is dealt to blocks of windows (a block's samples are one row).  The
admissible pairs of blocks are listed as numbers and joined with broadcast rows
while these are few; beyond that, block rows move to pairs of strips of blocks,
once for each strip they meet.  So a series of any length spreads over all
tasks, and a self-join visits each pair of blocks once, for both directions.  A task merges what it finds for a block before it emits
it; one shuffle by (series, block) merges tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.rolling import blocks_of
from tessella.operators import blocks as B
from tessella.plans.planner import block_windows, exclusion_zone, positive_int
from tessella.sources.series import as_value, check_schema

HELD_BLOCKS = 48
#: Blocks on a side of the squares in which pairs are dealt; a task keeps twice as many blocks made.
SQUARE = 4
#: Samples of block rows up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Blocks in a strip at most: a tile of two strips holds twice as many block rows and their best lists.
MAX_STRIP = 128
_PART = "series_id string, b long, side string, n int, d2 array<double>, j array<long>"
PROFILE = "series_id string, i long, rank int, p double, j long"


def block_rows(series: DataFrame, m: int, block: int, constant: DataFrame | None = None) -> DataFrame:
    """(series_id, b, samples[, flags]): the samples of each block of windows, in order.

    A block holds at most block + m - 1 samples.  ``constant`` is an optional
    table (series_id, i, is_constant) that overrides flags, one row a window.
    """
    s = series.select("series_id", "i", as_value(F.col("v")).alias("v"), F.explode(blocks_of(F.col("i"), m, block)).alias("b"))
    rows = s.groupBy("series_id", "b").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    rows = rows.where(F.size("s") >= m).select("series_id", "b", F.col("s.v").alias("samples"))
    if constant is not None:
        flags = constant.select("series_id", "i", "is_constant", F.call_function("div", F.col("i"), F.lit(block).cast("long")).alias("b"))
        flags = flags.groupBy("series_id", "b").agg(F.array_sort(F.collect_list(F.struct("i", "is_constant"))).alias("f"))
        rows = rows.join(flags.select("series_id", "b", F.col("f.is_constant").alias("flags")), ["series_id", "b"], "left")
    else:
        rows = rows.withColumn("flags", F.lit(None).cast("array<boolean>"))
    return rows


def constant_flags(series: DataFrame, m: int, func: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(series_id, i, is_constant) from a user's function of a whole series and the window length.

    It is called once a series, in one task, and sees missing samples as NaN; a
    window with one is never constant.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.sort_values("i")["v"].to_numpy(np.float64)
        flags = np.asarray(func(np.where(np.isfinite(a), a, np.nan), m))
        n = len(a) - m + 1
        if n < 1:
            return pd.DataFrame({"series_id": [], "i": [], "is_constant": []})
        if flags.dtype != np.bool_ or flags.shape != (n,):
            raise ValueError(f"a function of constant windows returns {n} booleans here, not {flags.dtype} {flags.shape}")
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(a))])
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "i": np.arange(n), "is_constant": flags & (bad[m:] == bad[:-m])})

    return check_schema(series).groupBy("series_id").applyInPandas(run, "series_id string, i long, is_constant boolean")


def block_counts(series: DataFrame, m: int, block: int) -> DataFrame:
    """(series_id, last): the number of the last block of windows of each series."""
    last = F.call_function("div", F.max("i") - (m - 1), F.lit(block).cast("long"))
    return series.groupBy("series_id").agg(F.max("i").alias("_i"), last.alias("last")).where(F.col("_i") >= m - 1).select("series_id", "last")


def _grid(a: DataFrame, b: DataFrame | None, first: DataFrame | None = None) -> DataFrame:
    """(series_id, qb, tb): pairs of block numbers from block counts; for a self-join those with qb <= tb.

    ``first`` (series_id, first_block) leaves only pairs with tb >= first_block.
    """
    one = F.lit(0).cast("long")
    na = a.select("series_id", F.col("last").alias("na"))
    if b is None:
        if first is None:
            na = na.withColumn("lo", one)
        else:
            na = na.join(first, "series_id", "left").withColumn("lo", F.coalesce("first_block", one)).where("lo <= na")
        g = na.select("series_id", "na", "lo", F.explode(F.sequence(one, F.col("na"))).alias("qb"))
        return g.select("series_id", "qb", F.explode(F.sequence(F.greatest("qb", "lo"), F.col("na"))).alias("tb"))
    g = na.join(b.select("series_id", F.col("last").alias("nb")), "series_id")
    g = g.select("series_id", "nb", F.explode(F.sequence(one, F.col("na"))).alias("qb"))
    return g.select("series_id", "qb", F.explode(F.sequence(one, F.col("nb"))).alias("tb"))


def _cells(rows: list[DataFrame], counts: list[DataFrame], first: DataFrame | None, tasks: int) -> DataFrame:
    """The grid with the samples of both blocks of each pair, for few samples: block rows are broadcast.

    Pairs are dealt in squares of ``SQUARE`` blocks a side, whose blocks and
    lists a task meets again.
    """
    square = [F.call_function("div", F.col(c), F.lit(SQUARE).cast("long")) for c in ("qb", "tb")]
    cells = _grid(counts[0], counts[1] if len(counts) > 1 else None, first)
    cells = cells.repartition(tasks, F.xxhash64("series_id", *square)).sortWithinPartitions("series_id", *square, "qb", "tb")
    for which, r in (("t", rows[-1]), ("q", rows[0])):
        named = r.select("series_id", F.col("b").alias(f"{which}b"), F.col("samples").alias(f"{which}s"), F.col("flags").alias(f"{which}f"))
        cells = cells.join(F.broadcast(named), ["series_id", f"{which}b"])
    return cells.select("series_id", "qb", "tb", "qs", "qf", "ts", "tf")


def strip_blocks(blocks: int, tasks: int) -> int:
    """Blocks in a strip: as many as leave about two tiles (strip x strip) a task, ``MAX_STRIP`` at most."""
    return max(1, min(MAX_STRIP, int(blocks / max(1.0, (4 * tasks) ** 0.5))))


def _tiles(rows: list[DataFrame], counts: list[DataFrame], first: DataFrame | None, size: int) -> DataFrame:
    """The block rows of every pair of strips of ``size`` blocks: series_id, qt, tt, lo, side, b, samples, flags.

    A block row moves once for each strip it meets, not for each block.
    """
    self_join, each = len(rows) == 1, F.lit(size).cast("long")

    def strips(c: DataFrame) -> DataFrame:
        return c.select("series_id", F.call_function("div", F.col("last"), each).alias("last"))

    lows = None if first is None else first.select("series_id", F.call_function("div", F.col("first_block"), each).alias("first_block"))
    tiles = _grid(strips(counts[0]), None if self_join else strips(counts[1]), lows)
    tiles = tiles.select("series_id", F.col("qb").alias("qt"), F.col("tb").alias("tt"))
    low = F.lit(0).cast("long")
    tiles = tiles.withColumn("lo", low) if first is None else tiles.join(first.select("series_id", F.col("first_block").alias("lo")), "series_id", "left")
    tiles = tiles.withColumn("lo", F.coalesce("lo", low))

    def side(r: DataFrame, name: str, key: str) -> DataFrame:
        r = r.withColumn(key, F.call_function("div", F.col("b"), each)).join(tiles, ["series_id", key])
        return r.select("series_id", "qt", "tt", "lo", F.lit(name).alias("side"), "b", "samples", "flags")

    t = side(rows[-1], "t", "tt")
    return side(rows[0], "q", "qt").unionByName(t.where("qt != tt") if self_join else t)


class _Work:
    """What a task holds: a few blocks of windows, and the best lists of the blocks it has seen."""

    def __init__(self, m: int, block: int, k: int, excl: int, normalize: bool, self_join: bool):
        self.m, self.block, self.k, self.normalize, self.self_join = m, block, k, normalize, self_join
        self.excl = excl if self_join else None
        self.held: dict[tuple[str, str, int, str], B.Best] = {}
        self.made: dict[tuple[str, str, int], B.Block] = {}

    def windows(self, which: str, sid: str, number: int, samples, flags) -> B.Block:
        key = (which, sid, number)
        if key not in self.made:
            if len(self.made) >= 2 * SQUARE:
                del self.made[next(iter(self.made))]
            values = np.asarray(samples.values.to_numpy(zero_copy_only=False), np.float64)
            constant = None if not flags.is_valid else np.array([bool(x) for x in flags.as_py()])
            self.made[key] = B.block(values, number * self.block, self.m, self.normalize, constant)
        return self.made[key]

    def best(self, sid: str, x: B.Block, number: int, side: str) -> B.Best:
        key = (sid, "q", number, side)
        got = self.held.pop(key, None) or B.Best(x.first, x.n, 1 if side != "all" else self.k, self.self_join)
        self.held[key] = got  # the latest used last
        return got

    def pair(self, sid: str, qb: int, tb: int, q: tuple, t: tuple) -> None:
        """Joins two blocks, given as (samples, flags)."""
        x = self.windows("q", sid, qb, *q)
        same = self.self_join and qb == tb
        y = x if same else self.windows("q" if self.self_join else "t", sid, tb, *t)
        mirror = self.self_join and not same
        into = []
        for side in ("left", "right", *(("all",) if self.k > 1 else ())) if self.self_join else ("all",):
            if not (side == "left" and qb != tb):
                into.append((side, 0, self.best(sid, x, qb, side)))
            if mirror and side != "right":
                into.append((side, 1, self.best(sid, y, tb, side)))
        B.join(x, y, self.k, self.excl, into, mirror)

    def drained(self, keep: int = 0) -> pa.RecordBatch:
        """The lists used longest ago, all but ``keep``, which are then forgotten."""
        gone = list(self.held)[: max(0, len(self.held) - keep)]
        lists = [self.held.pop(g) for g in gone]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in gone], pa.string()), pa.array([g[2] for g in gone], pa.int64()),
                pa.array([g[3] for g in gone], pa.string()), pa.array([x.n for x in lists], pa.int32()),
                pa.array([x.d2.reshape(-1) for x in lists], pa.list_(pa.float64())),
                pa.array([x.j.reshape(-1) for x in lists], pa.list_(pa.int64())),
            ],
            names=["series_id", "b", "side", "n", "d2", "j"],
        )


def _partials(
    series: DataFrame, other: DataFrame | None, m: int, block: int, k: int, excl: int, normalize: bool,
    flags: tuple = (None, None), first: DataFrame | None = None,
) -> DataFrame:
    """Best lists of each block from each task.

    One count of the samples decides whether block rows are few enough to be
    broadcast to pairs of blocks; otherwise they move to pairs of strips.
    """
    spark = series.sparkSession
    self_join = other is None
    sides = [series] if self_join else [series, other]
    rows = [block_rows(s, m, block, f) for s, f in zip(sides, flags)]
    counts = [block_counts(s, m, block) for s in sides]
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    samples = sum(s.count() for s in sides)

    def work() -> _Work:
        return _Work(m, block, k, excl, normalize, self_join)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = work()
        for batch in batches:
            for row in range(batch.num_rows):
                sid, qb, tb = (batch.column(c)[row].as_py() for c in range(3))
                q, t = ((batch.column(c)[row], batch.column(c + 1)[row]) for c in (3, 5))
                w.pair(sid, qb, tb, q, t)
                if len(w.held) > HELD_BLOCKS * 3:
                    yield w.drained(HELD_BLOCKS)
        if w.held:
            yield w.drained()

    def tile(table: pa.Table) -> pa.Table:
        w = work()
        sid, qt, tt, lo = (table[c][0].as_py() for c in ("series_id", "qt", "tt", "lo"))
        found: dict[str, dict[int, tuple]] = {"q": {}, "t": {}}
        for side, b, x, f in zip(table["side"].to_pylist(), table["b"].to_pylist(), table["samples"], table["flags"]):
            found[side][b] = (x, f)
        targets = found["q"] if self_join and qt == tt else found["t"]
        for qb in sorted(found["q"]):
            for tb in sorted(targets, reverse=qb % 2 == 1):  # back and forth, so that blocks made are met again
                if not self_join or tb >= max(qb, lo):
                    w.pair(sid, qb, tb, found["q"][qb], targets[tb])
        return pa.Table.from_batches([w.drained()])

    if samples * 8 * (1 + m / block) <= BROADCAST_BYTES:
        return _cells(rows, counts, first, tasks).mapInArrow(run, _PART)
    longest = max(c.agg(F.max("last")).first()[0] or 0 for c in counts) + 1
    tiles = _tiles(rows, counts, first, strip_blocks(longest, tasks))
    return tiles.groupBy("series_id", "qt", "tt").applyInArrow(tile, _PART)


def _merged(parts: DataFrame, block: int, k: int, self_join: bool, normalize: bool) -> DataFrame:
    """Profile rows (rank 1..k, side all) and, for a self-join, rank -1 and -2 for the left and right neighbour."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        sid, first, n = pdf["series_id"].iloc[0], int(pdf["b"].iloc[0]) * block, int(pdf["n"].iloc[0])
        out = {}
        for side, group in pdf.groupby("side", sort=True):
            size = 1 if side != "all" else k
            got = B.Best(first, n, size, self_join)
            for d2, j in zip(group["d2"], group["j"]):
                row = np.repeat(np.arange(n), size)
                got.add(row, np.asarray(j, np.int64), np.asarray(d2, np.float64))
            out[side] = got
        if self_join:
            for side in ("left", "right"):
                out.setdefault(side, B.Best(first, n, 1, True))
            if k == 1:
                top = B.Best(first, n, 1, True)
                for side in ("left", "right"):
                    top.add(np.arange(n), out[side].j[:, 0], out[side].d2[:, 0])
                out["all"] = top
        top = out["all"]
        i = np.arange(first, first + n)
        frame = {
            "series_id": sid,
            "i": i,
            "p": list(B.distances(top.d2, normalize)),
            "j": list(top.j),
            "left_j": out["left"].j[:, 0] if self_join else np.full(n, -1),
            "right_j": out["right"].j[:, 0] if self_join else np.full(n, -1),
        }
        return pd.DataFrame(frame)

    schema = "series_id string, i long, p array<double>, j array<long>, left_j long, right_j long"
    return parts.groupBy("series_id", "b").applyInPandas(merge, schema)


def wide(
    series: DataFrame, m: int, other: DataFrame | None = None, normalize: bool = True, k: int = 1, denom=None,
    constant: DataFrame | None = None, other_constant: DataFrame | None = None, block: int | None = None,
) -> DataFrame:
    """One row a window: series_id, i, p (k distances), j (k neighbours), left_j, right_j.

    ``other`` makes it an AB-join of series with equal ids.  Missing neighbours
    are (inf, -1), also where a series of the other side is absent altogether
    only as no row.  The result does not depend on ``block``.
    """
    series = check_schema(series)
    k = positive_int(k, "k")
    block = block_windows(m) if block is None else positive_int(block, "block")
    other = None if other is None else check_schema(other)
    parts = _partials(series, other, m, block, k, exclusion_zone(m, denom), normalize, (constant, other_constant))
    return _merged(parts, block, k, other is None, normalize)


def long(profile: DataFrame) -> DataFrame:
    """(series_id, i, rank, p, j) of a wide profile."""
    rows = profile.select("series_id", "i", F.posexplode(F.arrays_zip("p", "j")).alias("r", "x"))
    return rows.select("series_id", "i", (F.col("r") + 1).alias("rank"), "x.p", "x.j")


def sides(profile: DataFrame) -> DataFrame:
    return profile.select("series_id", "i", "left_j", "right_j")


def statistics(profile: DataFrame) -> DataFrame:
    """Mean, smallest and largest first distance over the finite ones, and how many windows have none."""
    p = F.col("p")[0]
    ok = p < float("inf")
    return profile.groupBy("series_id").agg(
        F.avg(F.when(ok, p)).alias("mean_p"), F.min(F.when(ok, p)).alias("min_p"), F.max(F.when(ok, p)).alias("max_p"),
        F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("n_missing"),
    )
