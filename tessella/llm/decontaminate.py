"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size: class c holds items of up to 2**c word shingles
(five words; an item of fewer words is one shingle of its own length).  For each class that occurs, a document is seen as windows of
2**(c+1) shingles that start at every multiple of 2**c, so an occurrence of an
item always lies whole in some window at most four times its size; its
containment there is a Jaccard similarity that MinHash can see, however long
the document is.  Minima of blocks are computed once and merged upwards for all
classes.  With one minimum a band and 64 bands, a window with an item contained
to 0.8 is missed with odds below 2e-6 (and usually below 1e-12).  Items so short
that containment needs all their shingles (up to four at 0.8) are found without
odds: one of their shingles is looked up in every document.

Candidates are verified exactly: the share of the item's distinct shingles that
the whole document has.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Bloom, TextHash, cut, map_rows, mix, shingles, signed, small_batches, without_ids

WIDTH = 5
CONTAINMENT = 0.8
BANDS = 64
LEAST = 3  # log2 of the smallest block
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_LONE = np.uint64(0x94D049BB133111EB)
_NONE = np.empty(0, np.uint64)
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)


def size_class(n: int) -> int:
    return max(LEAST, (n - 1).bit_length())


def _hashed(s: np.ndarray, k: int) -> np.ndarray:
    h = (s ^ _SEEDS[k]) * _ODD[k]
    h ^= h >> np.uint64(32)
    return h


def _key(least: np.ndarray, k: int, c: int) -> np.ndarray:
    """Band key of a minimum: the band and the size class are part of it."""
    return mix(least ^ (_SEEDS[k] + np.uint64(c)))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Shingles of ``width`` words, salted by the width; none if there are fewer words."""
    return mix(shingles(hashes, width) ^ np.uint64(width)) if len(hashes) >= width else np.empty(0, np.uint64)


def _lone(s: np.ndarray) -> np.ndarray:
    """Keys of shingles that are looked up themselves."""
    return mix(s ^ _LONE)


def items(benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, row, class, width, n, shingles, keys) of all items that have words.

    Class 0 holds items that need all their shingles.  ``row`` tells items of
    one id apart.
    """

    def make():
        hasher = TextHash()

        def step(cols):
            out: dict[str, list] = {n: [] for n in ("item_id", "row", "class", "width", "n", "shingles", "keys")}
            for item, h in zip(cols["item_id"], hasher.many(cols["text"])):
                width = min(WIDTH, len(h))
                s = np.unique(grams(h, width)) if width else h
                if len(s):
                    c = 0 if len(s) - 1 < containment * len(s) else size_class(len(s))
                    if c:
                        least = [_hashed(s, k).min() for k in range(BANDS)]
                        keys = np.array([_key(np.array([v]), k, c)[0] for k, v in enumerate(least)])
                    else:
                        keys = _lone(s[:1])
                    out["item_id"].append(item)
                    out["row"].append(signed(np.array([xxhash.xxh64_intdigest(s.tobytes())], np.uint64))[0])
                    out["class"].append(c)
                    out["width"].append(width)
                    out["n"].append(len(s))
                    out["shingles"].append(signed(s))
                    out["keys"].append(signed(keys))
            return out

        return step

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "item_id long, row long, class int, width int, n int, shingles array<long>, keys array<long>")


def search(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of all pairs at or above ``containment``.

    Texts without words match nothing.  A null id, of a document or an item, is
    an id like others; where rows share an id, each is judged by itself and the
    pair of ids reports the best of them.  Extra columns are ignored, empty
    tables give no rows.

    Two Bloom filters of fixed size and the list of size classes (at most 60)
    are broadcast; band keys and shingles of items are joined, not broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = cut(items(benchmark, containment).dropDuplicates(["item_id", "row"]))
    kinds = [(r["class"], r["width"]) for r in known.select("class", "width").distinct().collect()]
    classes = sorted({c for c, _ in kinds if c})
    widths = sorted({w for c, w in kinds if not c})  # of shingles that are looked up themselves
    keys = known.select("row", F.explode("keys").alias("key")).distinct()
    if not kinds:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long, containment double")
    bands = spark.sparkContext.broadcast(Bloom.of(keys, "key"))
    parts = spark.sparkContext.broadcast(Bloom.of(known.select(F.explode("shingles").alias("s")), "s"))

    def make():
        hasher = TextHash()
        block = 1 << LEAST

        def collided(s: list[np.ndarray]) -> dict[int, np.ndarray]:
            """Document number in the batch -> band keys that may be an item's."""
            n_blocks = [-(-len(x) // block) if classes else 0 for x in s]
            base = np.concatenate([[0], np.cumsum(n_blocks)])
            total = int(base[-1])
            if not total:
                return {}
            flat = np.zeros(total * block, np.uint64)
            pad = np.ones(total * block, bool)
            for x, b in zip(s, base):
                flat[b * block : b * block + len(x)] = x
                pad[b * block : b * block + len(x)] = False
            owner = np.repeat(np.arange(len(s)), n_blocks)
            inside = np.arange(total) - base[owner]
            # level c has blocks of 2**c shingles; index pairs give a block of the next level, or a
            # window (a block and its successor), and repeat a block that has none in its text
            levels = []
            own, pos = owner, inside
            for c in range(LEAST, classes[-1] + 1):
                merge = None
                if c > LEAST:
                    even = np.flatnonzero(pos % 2 == 0)
                    nxt = np.minimum(even + 1, len(own) - 1)
                    merge = even, np.where(own[nxt] == own[even], nxt, even)
                    own, pos = own[even], pos[even] // 2
                nxt = np.minimum(np.arange(1, len(own) + 1), len(own) - 1)
                levels.append((c, merge, own, np.where(own[nxt] == own, nxt, np.arange(len(own)))))
            hits: dict[int, list] = {}
            for k in range(BANDS):
                h = _hashed(flat, k)
                h[pad] = _TOP
                least = h.reshape(-1, block).min(axis=1)
                for c, merge, own, nxt in levels:
                    if merge is not None:
                        least = np.minimum(least[merge[0]], least[merge[1]])
                    if c in classes:
                        key = _key(np.minimum(least, least[nxt]), k, c)
                        for i in np.flatnonzero(bands.value.test(key)):
                            hits.setdefault(int(own[i]), []).append(key[i])
            return {d: np.unique(np.array(v, np.uint64)) for d, v in hits.items()}

        def step(cols):
            out: dict[str, list] = {"doc_id": [], "keys": [], "hits": []}
            ids, hashes = cols["doc_id"], hasher.many(cols["text"])
            at = 0
            while at < len(ids):
                group, lone, held = [], [], 0
                begin = at
                while at < len(ids) and held < 100_000:
                    s = grams(hashes[at], WIDTH)
                    group.append(s)
                    lone.append([s if w == WIDTH else grams(hashes[at], w) for w in widths])
                    held += len(s)
                    at += 1
                found = collided(group)
                for d, sets in enumerate(lone):
                    own = [_lone(s) for s in sets if len(s)]
                    own = [k[bands.value.test(k)] for k in own]
                    if any(map(len, own)):
                        found[d] = np.unique(np.concatenate([found.get(d, _NONE), *own]))
                for d, key in sorted(found.items()):
                    s = np.unique(np.concatenate([group[d], *lone[d]]))
                    out["doc_id"].append(ids[begin + d])
                    out["keys"].append(signed(key))
                    out["hits"].append(signed(s[parts.value.test(s)]))
            return out

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(map_rows(rows, make, "doc_id long, keys array<long>, hits array<long>"))
    found = found.withColumn("at", F.monotonically_increasing_id())  # materialised above, so it stays
    pairs = found.select("at", F.explode("keys").alias("key")).join(keys, "key").select("at", "row").distinct()
    shared = F.size(F.array_intersect("hits", "shingles")).cast("long")
    best = (
        pairs.join(found.select("at", "doc_id", "hits"), "at")
        .join(known.select("row", "item_id", F.col("n").cast("long").alias("n_item"), "shingles"), "row")
        .select("doc_id", "item_id", shared.alias("n_shared"), "n_item")
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .where(F.col("containment") >= containment)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("b"))
    )
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay, whatever their names.

    Rows of one id (null being one) go together.  Null and empty texts stay;
    without items, and in an empty table, nothing goes.
    """
    return without_ids(docs, search(docs, benchmark, containment).select("doc_id"))


def op2(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
