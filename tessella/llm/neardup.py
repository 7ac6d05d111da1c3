"""Near-duplicate detection by ProbMinHash, banding and exact verification.

Texts are weighted sets of five-word shingles (weight 1 + ln of the count).
Each shingle emits a Poisson process of arrivals with its weight as rate; each
arrival hits a random register, and a register keeps its earliest arrival.  Two
texts agree in a register with the probability Jaccard similarity of their
sets.  Repeats can push that far below the plain Jaccard similarity that
decides, so a text with repeats is also searched with all weights 1, where
registers agree with the plain one; without repeats both are the same.
Arrivals after the time at which all registers are taken cannot matter, so
processes are stopped there; the stopping time is bounded beforehand and
doubled in the rare case that a register stayed free.

Equal texts are one node.  Registers are joined to ``BANDS`` bands of ``ROWS``;
nodes of a bucket are candidates: all pairs of a small bucket; in a larger one
each node with three centres (the node with most company over all its buckets,
the lowest id, and a random one for each bucket).  The likeliest centre of each
node is verified first; what is not yet in one class then is verified as well.
Large buckets that still hold several classes are then compared exactly, all
nodes of one class with all of another, as products of blocks; buckets of the
same nodes once.  So copies of one text stay linear, and only unlike texts in
one large bucket cost their pairs.  A pair is linked if the exact Jaccard
similarity of the distinct shingles is 0.8 or more, and classes are the
connected components of links.

At plain similarity 0.8 a pair misses all 42 bands of 6 with odds of 3e-6,
whatever its weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import (
    Bloom, TextHash, cut, fresh, map_rows, mix, release, shingles, signed, small_batches, unsigned, without_ids, written,
)

WIDTH = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 42
SMALL_BUCKET = 12
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 500_000, 4096
#: Rows without id stand behind all ids: nodes from here on.
NAMELESS = 1 << 62
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)


# ------------------------------------------------------------- signatures
def weighted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights."""
    vals, counts = np.unique(s, return_counts=True)
    return vals, 1.0 + np.log(counts)


def _arrivals(s: np.ndarray, w: np.ndarray, h: np.ndarray, j: int, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Times and registers of arrivals j .. j+k-1 of each element, given the time of arrival j-1.

    Each depends on the element and the number of the arrival alone.
    """
    step = np.arange(j, j + k, dtype=np.uint64) * _GOLD
    r = mix(s[:, None] + step)
    gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[:, None]
    gap[:, 0] += h
    register = ((mix(r ^ _SALT) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    return np.cumsum(gap, axis=1), register.astype(np.int64)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = ROWS * BANDS) -> np.ndarray:
    """ProbMinHash signatures, one row of ``m`` element hashes for each non-empty weighted set."""
    n = len(sets)
    out = np.zeros((n, m), np.uint64)
    slack = 4.0
    todo = np.arange(n)
    while len(todo):
        s = np.concatenate([sets[d][0] for d in todo])
        w = np.concatenate([sets[d][1] for d in todo])
        sizes = np.array([len(sets[d][0]) for d in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        total = np.array([sets[d][1].sum() for d in todo])
        stop = (m / total * (np.log(m) + slack))[owner]
        h, j = np.zeros(len(s)), 0
        live = np.arange(len(s))
        when, where, what = [], [], []
        while len(live):
            k = int(min(256, max(1, 16384 // len(live))))
            t, reg = _arrivals(s[live], w[live], h[live], j, k, m)
            early = t < stop[live][:, None]
            e, a = np.nonzero(early)
            when.append(t[e, a])
            where.append(owner[live[e]] * m + reg[e, a])
            what.append(s[live[e]])
            h[live] = t[:, -1]
            live = live[early[:, -1]]
            j += k
        when, where, what = np.concatenate(when), np.concatenate(where), np.concatenate(what)
        q = np.full(len(todo) * m, np.inf)
        np.minimum.at(q, where, when)
        win = when == q[where]
        z = np.zeros(len(todo) * m, np.uint64)
        z[where[win]] = what[win]
        filled = np.isfinite(q).reshape(-1, m).all(axis=1)
        out[todo[filled]] = z.reshape(-1, m)[filled]
        todo = todo[~filled]
        slack *= 2.0
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) 64-bit keys; the band's number is part of the key."""
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    acc = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * _SALT, (n, m // rows)).copy()
    for k in range(rows):
        acc = mix(acc * _GOLD + parts[:, :, k])
    return acc


def shingle_set(text: str | None, hasher: TextHash) -> np.ndarray:
    return shingles(hasher.one(text), WIDTH)


# ------------------------------------------------------------- graph
def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b); the label is the lowest node of the component, which has no row itself.

    Alternating large-star and small-star steps: each round is a few
    aggregations and joins, none of which gathers a node's neighbours.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

    def state(d):
        return d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()

    now = state(e)
    while now["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = cut(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        then, now = now, state(e)
        if then == now:
            break
    return e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


# ------------------------------------------------------------- operator
def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, node, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"), F.col("text").cast("string").alias("text"))


def _node() -> Column:
    """The id; for a null id a hash of the text, from ``NAMELESS`` on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(text, F.lit(1)), 2) + F.lit(NAMELESS))


def _signed_docs(rows: DataFrame) -> DataFrame:
    """(node, hi, lo, keys) of all texts with words; hi and lo identify the words in order."""

    def make():
        hasher = TextHash()

        def step(cols):
            out: dict[str, list] = {"node": [], "hi": [], "lo": [], "keys": []}
            nodes, hashes, at = cols["node"], hasher.many(cols["text"]), 0
            seen: dict[int, np.ndarray] = {}
            while at < len(nodes):
                held, sets, which = 0, [], []
                while at < len(nodes) and held < 30_000:
                    h = hashes[at]
                    if len(h):
                        d = xxhash.xxh128_intdigest(h.tobytes())
                        which.append((nodes[at], d))
                        if d not in seen:
                            seen[d] = np.empty(0, np.int64)  # filled below
                            vals, weights = weighted(shingles(h, WIDTH))
                            sets.append((d, (vals, weights)))
                            if weights.max() > 1.0:
                                sets.append((d, (vals, np.ones(len(vals)))))
                            held += len(vals) * (1 + (weights.max() > 1.0))
                    at += 1
                if sets:
                    keys = band_keys(signatures([x for _, x in sets]))
                    for (d, _), k in zip(sets, keys):
                        seen[d] = np.union1d(seen[d], signed(k))
                for node, d in which:
                    out["node"].append(node)
                    out["hi"].append(d >> 64)
                    out["lo"].append(d & 0xFFFFFFFFFFFFFFFF)
                    out["keys"].append(seen[d])
            for c in ("hi", "lo"):
                out[c] = signed(np.array(out[c], np.uint64))
            return out

        return step

    return map_rows(rows.select("node", "text"), make, "node long, hi long, lo long, keys array<long>")


def _candidates(buckets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (key, node): (node, centre) the likeliest centre of each node, (a, b) candidate pairs, (key, node) of large buckets."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    shared = written(buckets.join(sizes, "key"), "buckets")
    company = shared.groupBy("node").agg(F.sum("k").alias("hub"))
    ranked = shared.join(company, "node")
    centres = ranked.groupBy("key").agg(
        F.max(F.struct("hub", (-F.col("node")).alias("i"))).alias("h"),
        F.min("node").alias("low"),
        F.max(F.struct(F.xxhash64("key", "node").alias("r"), "node")).alias("r"),
    )
    centres = centres.select("key", (-F.col("h.i")).alias("hub"), "low", F.col("r.node").alias("any"))
    stars = written(shared.join(centres, "key"), "stars")
    votes = stars.where("node != hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    first = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("i"))).alias("b"))
    first = first.select("node", (-F.col("b.i")).alias("centre"))
    small = stars.where(F.col("k") <= SMALL_BUCKET).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("ns"))
    small = small.select("ns", F.posexplode("ns").alias("i", "a"))
    small = small.select("a", F.explode(F.slice("ns", F.col("i") + 2, F.lit(SMALL_BUCKET))).alias("b"))
    large = stars.where(F.col("k") > SMALL_BUCKET)
    ends = F.explode(F.array("hub", "low", "any")).alias("c")
    star = large.select("node", ends).where("node != c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    return first, small.unionByName(star).distinct(), large.select("key", "node")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose exact similarity reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    # a set at most 0.8 times as large as the other cannot reach 0.8
    near = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * similarity
    both = pairs.join(left, "a").join(right, "b").where(near)
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.where(inter >= (F.size("sa") + F.size("sb") - inter) * F.lit(similarity)).select("a", "b")


def _block_links(table: pa.Table, similarity: float) -> pa.Table:
    """The linked (a, b) of different labels: one from each block of ``table``, or both from its only one."""
    nodes, labels, block = (table[c].to_numpy() for c in ("node", "label", "block"))
    lists = pa.concat_arrays(table["s"].chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    _, col, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(nodes)), sizes)
    shared = count[col] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    names, of, members = np.unique(labels, return_inverse=True, return_counts=True)
    if block.min() == block.max():
        left = left[of[left] != members.argmax()]  # the others with all
    if len(names) == 1 or not len(left):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    inter = np.zeros((len(left), len(right)))
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, (at, at + COLUMNS))
        has = np.zeros((len(nodes), COLUMNS), np.float32)
        has[row[lo:hi], col[lo:hi] - at] = 1
        inter += has[left] @ has[right].T
    union = sizes[left][:, None] + sizes[right] - inter
    i, j = np.nonzero((inter >= union * similarity) & (labels[left][:, None] != labels[right]))
    a, b = nodes[left[i]], nodes[right[j]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _large_links(large: DataFrame, label: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All links (a, b) between different labels inside the buckets (key, node)."""
    own = sets.select("node", F.size("s").alias("size")).join(label, "node", "left")
    tagged = written(large.join(own.select("node", "size", F.coalesce("label", "node").alias("label")), "node"), "large")
    mixed = tagged.groupBy("key").agg(
        F.count("*").alias("k"), F.sum("size").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
        *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)],
    ).where("low != high")
    mixed = mixed.groupBy("x0", "x1").agg(F.min_by(F.struct("key", "k", "size"), "key").alias("m"))
    parts = F.ceil(F.greatest(F.col("m.k") / BLOCK, F.col("m.size") / BLOCK_SHINGLES)).cast("int")
    dealt = tagged.select("key", "node", "label").join(mixed.select("m.key", parts.alias("parts")), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "node", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def run(table: pa.Table) -> pa.Table:
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        both = pa.compute.count_distinct(table["block"]).as_py() == 2
        if p != q and not both:
            return table.select(["node", "label"]).rename_columns(["a", "b"]).slice(0, 0)
        found = _block_links(table, similarity)
        release()
        return found

    return dealt.join(sets, "node").groupBy("key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def _labels(docs: DataFrame, similarity: float) -> DataFrame:
    """(node, label) of the nodes whose class is named by another node, its lowest."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs)
    signed_docs = written(_signed_docs(rows), "signatures")
    # one text a node: of rows that share an id, the one with the lowest digest
    text = signed_docs.groupBy("node").agg(F.min(F.struct("hi", "lo")).alias("t")).select("node", "t.hi", "t.lo")
    text = cut(text)
    # materialised, so that the join below can split a text that has very many copies
    same = cut(text.groupBy("hi", "lo").agg(F.min("node").alias("rep")))
    member = cut(text.join(same, ["hi", "lo"]).select("node", "rep"))
    reps = signed_docs.join(same.select("hi", "lo", F.col("rep").alias("node")), ["hi", "lo", "node"], "left_semi")
    reps = reps.dropDuplicates(["node"])  # equal rows
    first, pairs, large = _candidates(reps.select(F.explode("keys").alias("key"), "node"))
    pairs = written(pairs, "pairs")
    first = cut(first)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(first.select(F.explode(F.array("node", "centre")).alias("node")))
    ends = cut(same.withColumnRenamed("rep", "node").join(ends.distinct(), "node", "left_semi"))
    wanted = spark.sparkContext.broadcast(Bloom.of(ends.select(F.xxhash64("node").alias("h")), "h"))

    def make():
        hasher = TextHash()

        def step(cols):
            out: dict[str, list] = {"node": [], "hi": [], "lo": [], "s": []}
            at = np.flatnonzero(wanted.value.test(unsigned(cols["h"])))
            for k, h in zip(at, hasher.many([cols["text"][k] for k in at])):
                if len(h):
                    d = xxhash.xxh128_intdigest(h.tobytes())
                    out["node"].append(cols["node"][k])
                    out["hi"].append(d >> 64)
                    out["lo"].append(d & 0xFFFFFFFFFFFFFFFF)
                    out["s"].append(signed(np.unique(shingles(h, WIDTH))))
            for c in ("hi", "lo"):
                out[c] = signed(np.array(out[c], np.uint64))
            return out

        return step

    sets = map_rows(rows.select("node", F.xxhash64("node").alias("h"), "text"), make, "node long, hi long, lo long, s array<long>")
    sets = sets.join(ends, ["node", "hi", "lo"], "left_semi").select("node", "s")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    links = _verified(first.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), sets, similarity)
    links = cut(links)
    label = cut(components(links))
    la = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    rest = pairs.join(la, "a", "left").join(lb, "b", "left")
    rest = rest.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    more = cut(_verified(rest, sets, similarity))
    equal = member.where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    # the first links only through their labels; equal texts by their representative
    merged = label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)
    label = cut(components(merged))
    merged = label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(cut(_large_links(large, label, sets, similarity)))
    return components(merged.unionByName(equal))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``.

    The class is named by its lowest document id.  Texts without words are
    classes of their own; texts of fewer than five words are one shingle.  Rows
    of one id are one document; if their texts differ, one of them (that with
    the lowest digest) stands for it.  A row without id stands for its text:
    its class is that of the ids like it, or null if there are none.  Ids are
    below 2**62.  Extra columns are ignored; an empty table gives no rows.
    """
    final = _labels(docs, similarity)
    labels = final.select(F.col("node").alias("__n"), "label")
    named = F.coalesce("label", "node")
    return _rows(docs).join(labels, F.col("node") == F.col("__n"), "left").select(
        "doc_id", F.when(named < NAMELESS, named).alias("class_id")
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose document has the lowest id of its class; all columns stay, whatever their names.

    Repeated rows of the kept id stay.  Of rows without id none stays that is
    like a row with one; of others, one for each class.  Texts without words
    stay, but of equal rows without id and words only one.
    """
    gone = cut(_labels(docs, similarity).select("node"))
    named = without_ids(docs.where(F.col("doc_id").cast("long").isNotNull()), gone.where(F.col("node") < NAMELESS).select(F.col("node").alias("doc_id")))
    node, other = fresh(docs.columns, "node"), fresh([*docs.columns, "node"], "other")
    rest = docs.where(F.col("doc_id").cast("long").isNull()).withColumn(node, _node())
    rest = rest.join(gone.select(F.col("node").alias(other)), F.col(node) == F.col(other), "left_anti")
    return named.unionByName(rest.dropDuplicates([node]).drop(node))


def op8(docs: DataFrame) -> DataFrame:
    return classes(docs)
