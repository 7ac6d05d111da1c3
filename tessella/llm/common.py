"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = re.compile(r"\w+")
_M64 = (1 << 64) - 1
_MEMO_LIMIT = 1 << 19


# --------------------------------------------------------------- session
def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tessella-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Survives the loss of any executor, unlike a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back.

    For larger intermediates: columnar, compressed, and re-readable column by
    column.  The folder's own retention removes the files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts fit a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def release() -> None:
    """Gives memory that a task has freed back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# --------------------------------------------------------------- documents
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id) -> F.Column:  # type: ignore[name-defined]
    """True where crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_key(text: str = "text"):
    """64-bit hash of a text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def bounded_sample(ids: DataFrame, group: str, size: int) -> DataFrame:
    """At most ``size`` rows of (doc_id, group) for each group, those with the lowest hash of their id.

    Groups are counted first; a hash threshold that leaves about four times as
    many rows is applied where the rows are, so only those are ranked.
    """
    n = small(ids.groupBy(group).agg(F.count("*").alias("__n")))
    h = F.xxhash64(F.col("doc_id"), F.lit(7))
    unit = F.shiftrightunsigned("__h", 11) / F.lit(float(1 << 53))
    near = ids.withColumn("__h", h).join(n, group).where(unit * F.col("__n") <= 4.0 * size)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("__h", "doc_id"))
    return near.withColumn("__r", rank).where(F.col("__r") <= size).drop("__n", "__h", "__r")


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, materialised; marked for broadcast if it has few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` over column lists.

    ``make`` runs once for each task and returns the function that turns the
    columns of one batch (as Python lists) into output columns.
    """
    names = df.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            got = step({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            if got and len(got[out_schema.names[0]]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in out_schema], schema=out_schema
                )
        release()

    return df.mapInArrow(run, schema)


# --------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's), for uint64 arrays; wraps around."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHash(dict):
    """word -> 64-bit hash, remembered in bounded memory."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(tokens: Iterable[str], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64)


class TextHash:
    """Hashes of the words (runs of word characters, lower case) of whole texts, many texts at once.

    A word's hash is the sum of a random 64-bit value of each character times a
    power of an odd base by its place, finalised with the length.
    """

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self) -> None:
        self.inside = np.zeros(0x110000, bool)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            self.inside[lo:hi] = np.fromiter((chr(c).isalnum() for c in range(lo, hi)), bool, hi - lo)
        self.inside[ord("_")] = True
        self.value = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.power = np.empty(0, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, self._BASE, np.uint64))])
        return self.power

    def one(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None], limit: int = 1 << 18) -> list[np.ndarray]:
        """The hashes of each text's words in order; about ``limit`` characters are held at a time."""
        out: list[np.ndarray] = []
        group: list[str] = []
        held = 0
        for t in texts:
            low = t.lower() if t else ""
            group.append(low)
            held += len(low)
            if held >= limit:
                out += self._group(group)
                group, held = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, lows: list[str]) -> list[np.ndarray]:
        cp = np.frombuffer(("\n".join(lows) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = self.inside[cp]
        edge = np.flatnonzero(ok[1:] != ok[:-1]) + 1
        if ok[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]  # the last character is none of a word
        ends = np.cumsum([len(t) + 1 for t in lows])
        if not len(start):
            return [np.empty(0, np.uint64) for _ in lows]
        size = end - start
        at = np.flatnonzero(ok)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(len(at)) - np.repeat(first, size)
        terms = self.value[cp[at]] * self._powers(int(size.max()) + 1)[place]
        h = mix(np.add.reduceat(terms, first) + size.astype(np.uint64))
        return np.split(h, np.searchsorted(start, ends[:-1]))


class TermHash:
    """Places and hashes of the terms of whole texts: runs of at least ``least`` letters, in lower case.

    Offsets are code points of the text as it is; case is dropped letter by letter.
    """

    def __init__(self, least: int):
        self.least = least
        letter = re.compile(r"[^\W\d_]")
        self.inside = np.zeros(0x110000, bool)
        low = np.arange(0x110000, dtype=np.int64)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            for c in range(lo, hi):
                x = chr(c)
                if letter.match(x):
                    self.inside[c] = True
                    if len(x.lower()) == 1:
                        low[c] = ord(x.lower())
        self.value = mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[low]
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(256, TextHash._BASE, np.uint64)]))

    def many(self, texts: list[str | None], limit: int = 1 << 18) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, ends, hashes) of each text's terms."""
        out: list = []
        group: list[str] = []
        held = 0
        for t in texts:
            group.append(t or "")
            held += len(group[-1])
            if held >= limit:
                out += self._group(group)
                group, held = [], 0
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = self.inside[cp]
        edge = np.flatnonzero(ok[1:] != ok[:-1]) + 1
        if ok[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        long = end - start >= self.least
        start, end = start[long], end[long]
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = np.concatenate([[0], ends[:-1]])
        size = end - start
        if len(start):
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            if int(size.max()) >= len(self.power):
                self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()) * 2, TextHash._BASE, np.uint64)]))
            at = np.repeat(start, size) + place
            h = mix(np.add.reduceat(self.value[cp[at]] * self.power[place], first) + size.astype(np.uint64))
        else:
            h = np.empty(0, np.uint64)
        cut_at = np.searchsorted(start, ends[:-1])
        parts = zip(np.split(start, cut_at), np.split(end, cut_at), np.split(h, cut_at), begins)
        return [(s - b, e - b, x) for s, e, x, b in parts]


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; of the whole text if it is shorter, none if empty."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        acc = np.uint64(n)
        for h in hashes:
            acc = mix(np.array([acc], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
        return np.array([acc], np.uint64)
    acc = hashes[: n - width + 1].copy()
    for k in range(1, width):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += hashes[k : n - width + 1 + k]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64).view(np.uint64)


# --------------------------------------------------------------- Bloom filter
class Bloom:
    """A Bloom filter over 64-bit hashes.

    Only a pre-filter: what passes it is joined exactly afterwards.  It has
    about ``PER_KEY`` bits for each key, counted beforehand, and at most
    2**``MOST`` bits (64 MB broadcast): beyond some 50 million keys a larger
    share of rows passes, but the memory stays.
    """

    TURNS = (0, 21, 42)
    PER_KEY, LEAST, MOST = 10, 16, 29

    def __init__(self, table: np.ndarray, bits: int):
        self.table, self.bits = table, bits

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Bloom:
        """Built by a distributed OR; what reaches the driver is as large as the filter at most."""
        keys = keys.where(F.col(column).isNotNull())
        bits = min(cls.MOST, max(cls.LEAST, (cls.PER_KEY * keys.count()).bit_length()))
        turned = [F.col(column)] + [
            F.shiftrightunsigned(F.col(column), s).bitwiseOR(F.shiftleft(F.col(column), 64 - s)) for s in cls.TURNS[1:]
        ]
        position = F.explode(F.array(*[t.bitwiseAND(F.lit((1 << bits) - 1)) for t in turned]))
        found = (
            keys.select(position.alias("p"))
            .select(
                F.shiftright("p", 6).cast("int").alias("w"),
                F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int")).alias("m"),
            )
            .groupBy("w")
            .agg(F.bit_or("m").alias("m"))
        )
        table = np.zeros(1 << (bits - 6), np.uint64)
        got = found.toArrow()
        if got.num_rows:
            table[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
        return cls(table, bits)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """Boolean mask of the uint64 hashes that may be in the set."""
        mask = np.uint64((1 << self.bits) - 1)
        hit = np.ones(len(hashes), bool)
        live = None
        for s in self.TURNS:
            h = hashes if live is None else hashes[live]
            p = ((h >> np.uint64(s)) | (h << np.uint64(64 - s)) if s else h) & mask
            ok = (self.table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            if live is None:
                hit = ok
            else:
                hit[live[~ok]] = False
            live = np.flatnonzero(hit)
            if not len(live):
                break
        return hit


def split_by(docs: DataFrame, keys: DataFrame, by: list) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` that may have a key, rows that certainly have none).

    ``keys`` has one column, 64-bit hashes; ``by`` are the columns of ``docs``
    whose ``xxhash64`` is looked up.  The texts of the second part, usually
    nearly all, need no shuffle; the first is joined exactly afterwards.
    """
    (name,) = keys.columns
    spark = docs.sparkSession
    small_batches(spark)
    bloom = spark.sparkContext.broadcast(Bloom.of(keys, name))
    names = docs.columns
    tagged = docs.select("*", F.xxhash64(*by).alias(fresh(names, "h")))

    def part(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = bloom.value.test(unsigned(batch.column(len(names)).to_numpy(zero_copy_only=False)))
                kept = batch.filter(pa.array(hit == inside))
                yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(names))], names=names)
            release()

        return tagged.mapInArrow(run, docs.schema)

    return part(True), part(False)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (one column doc_id, null being an id); all columns stay."""
    ids = cut(ids.distinct())
    maybe, kept = split_by(docs, ids.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h")), [F.col("doc_id").cast("long")])
    name = fresh(docs.columns, "gone")
    gone = ids.select(F.col("doc_id").alias(name))
    return kept.unionByName(maybe.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti"))
