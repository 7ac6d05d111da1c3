"""Sharding by a Feistel permutation over global row numbers.

Every document gets a row number from 0 to N-1 that depends on the rows' values
alone, not on files, partitions or executors.  A generalised Feistel network on
Z_a x Z_b (a*b >= N, a*b - N < a) with cycle walking permutes [0, N).  The image
v gives shard = v mod S and slot = v div S: shard sizes differ by one at most,
slots have no gaps, and anyone who knows N and the seed can compute both, or
invert them, without reading the table.

DataFrame functions only.  Nothing larger than one row of counts for each of a
fixed number of buckets is gathered anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PRIME = 2_147_483_647
ROUNDS = 6
BUCKETS = 4096
WALK = 32
CHUNK = 1 << 16


def domain(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and a*b - n < a; at most 2**31 each for n < 2**61."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an increment for each round, from the seed."""
    out, x = [], (seed * 2 + 1) % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        k = x or 1
        x = (x * 48271 + 11) % PRIME
        out.append((k, x))
    return out


def _mixed(x: Column, k: Column, c: Column) -> Column:
    # every product stays below 2**62
    y = (x + c) % PRIME
    y = (y * y) % PRIME
    return (y * k + c) % PRIME


def _feistel(v: Column, a: int, b: int, seed: int) -> Column:
    rounds = F.array(
        *[
            F.struct(F.lit(i % 2 == 0).alias("e"), F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c"))
            for i, (k, c) in enumerate(keys(seed))
        ]
    )
    start = F.struct((v % F.lit(a)).cast("long").alias("l"), F.call_function("div", v, F.lit(a).cast("long")).alias("r"))
    end = F.aggregate(
        rounds,
        start,
        lambda s, t: F.when(
            t["e"],
            F.struct(((s["l"] + _mixed(s["r"], t["k"], t["c"])) % F.lit(a)).cast("long").alias("l"), s["r"].alias("r")),
        ).otherwise(
            F.struct(s["l"].alias("l"), ((s["r"] + _mixed(s["l"], t["k"], t["c"])) % F.lit(b)).cast("long").alias("r"))
        ),
    )
    return F.transform(F.array(end), lambda s: s["r"] * F.lit(a).cast("long") + s["l"])[0]


def _walked(v: Column, n: int, a: int, b: int, seed: int) -> Column:
    """``v``, sent through the network again until it lies in [0, n)."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), v, lambda v, _: F.when(v < n, v).otherwise(_feistel(v, a, b, seed))
    )
    return F.transform(
        F.array(walked), lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    )[0]


def permuted(row: Column, n: int, seed: int) -> Column:
    """The image of ``row`` under the permutation of [0, n).

    A walk leaves [0, n) again with probability below 1/sqrt(n) a step and
    ends within a - 1 steps, so 32 steps suffice: for n <= 1024 because
    a <= 32, beyond that with odds under 1e-48 a row (such a row raises an
    error instead of getting a wrong place).
    """
    a, b = domain(n)
    return _walked(_feistel(row, a, b, seed), n, a, b, seed)


def placed(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``rows`` with ``v``, the image of ``row``: the same numbers as ``permuted``.

    The first pass through the network is plain arithmetic, which Spark
    compiles; only the few rows that leave [0, n) walk on in a lambda.
    """
    a, b = domain(n)
    names = rows.columns
    out = rows.withColumns({"l": F.col("row") % F.lit(a).cast("long"), "r": F.call_function("div", F.col("row"), F.lit(a).cast("long"))})
    for i, (k, c) in enumerate(keys(seed)):
        of, to, size = ("r", "l", a) if i % 2 == 0 else ("l", "r", b)
        out = out.withColumn("y", (F.col(of) + c) % PRIME)
        out = out.withColumn("y", (F.col("y") * F.col("y")) % PRIME)
        out = out.withColumn(to, (F.col(to) + (F.col("y") * k + c) % PRIME) % F.lit(size).cast("long"))
    out = out.withColumn("v", F.col("r") * F.lit(a).cast("long") + F.col("l"))
    v = F.when(F.col("v") < n, F.col("v")).otherwise(_walked(F.col("v"), n, a, b, seed))
    return out.select(*names, v.alias("v"))


def row_numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row): a number from 0 for each row of ``docs``.

    Order: hash bucket, id (nulls first), text hash.  Equal rows are counted
    before they are shuffled and expanded again afterwards in chunks, so one
    row that makes up a third of the table costs one row of shuffle a task.
    """
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    small = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("h"),
    )
    grouped = (
        small.groupBy("doc_id", "size", "text_crc32", "h")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(BUCKETS)).cast("int"))
    )
    in_bucket = (
        Window.partitionBy("bucket")
        .orderBy(F.col("doc_id").asc_nulls_first(), "h", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = grouped.withColumn("before", F.coalesce(F.sum("n").over(in_bucket), F.lit(0)))
    # one row a bucket, BUCKETS at most
    counts = small.select(F.pmod(F.xxhash64("doc_id", "h"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count("*").alias("m"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    placed = placed.join(F.broadcast(offsets), "bucket").withColumn("first", F.col("base") + F.col("before"))
    chunks = placed.withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    )
    last = F.least(F.col("n"), (F.col("c") + 1) * CHUNK) - 1
    return chunks.select(
        "doc_id", "size", "text_crc32",
        F.explode(F.sequence(F.col("first") + F.col("c") * CHUNK, F.col("first") + last)).alias("row"),
    )


def shard(docs: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row of ``docs``: doc_id, size, text_crc32, row, shard, slot.

    Law `rows`: shard sizes differ by one at most.  Null ids sort first and are
    ids of their own; a null text has no bytes (size 1); equal rows are
    interchangeable and each gets its own place; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    n = docs.count()
    if n == 0:
        n = 1
    return (
        placed(row_numbers(docs, id_col, text_col), n, seed)
        .select(
            "doc_id", "size", "text_crc32", "row",
            (F.col("v") % shards).cast("int").alias("shard"),
            F.call_function("div", F.col("v"), F.lit(shards).cast("long")).alias("slot"),
        )
    )


def op7(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row",
    )
