"""Substring deduplication by hashing normalised units.

Every whole line that has a word is a unit, whatever its length; with line ends
between paragraphs only, these are the paragraphs.  Lines alone miss a passage
that stands inside another line, so sentences of at least ``min_words`` words
are units too (a parameter; None for lines alone): such a unit starts at every
line start, after every mark (full stop, comma and the like, with white space,
between two words), and at a capitalised word that follows an unmarked word; it
ends at the first mark or line end that gives it enough words.
Units are normalised (lower case, words only) and hashed to 128 bits.  Over
the whole table each digest keeps its earliest occurrence, by document id and
then offset; all others are removed, as spans of the original text.

Digests are counted with partial sums, so a line that a third of all documents
share costs one row a task; the earliest document of each shared digest is
joined back to the occurrences, after a Bloom filter of fixed size has let
pass only digests that occur in two documents or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Bloom, fresh, map_rows, mix, release, signed, small_batches, written

MIN_WORDS = 8
#: Words of a run of removed units from which it counts as a passage.
PASSAGE_WORDS = 25
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_SALT = np.uint64(0xA0761D6478BD642F)
_LINE = np.uint64(0xE7037ED1A0B428DB)
_LATE = (1 << 63) - 1
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Units(NamedTuple):
    """Units of several texts, by text and start, lines last: number of the text, offsets, 128-bit digest, words [a, b)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    a: np.ndarray
    b: np.ndarray


class UnitHash:
    """Finds and hashes the units of whole texts, many texts at once.

    The digest of words a .. b-1 is a difference of prefix sums of word hashes
    times powers of an odd base, shifted back to power 0; so all units of a
    text cost one pass, however they overlap.
    """

    def __init__(self, min_words: int | None = MIN_WORDS, lines: bool = False):
        self.min_words, self.lines = 1 << 60 if min_words is None else min_words, lines
        n = 0x110000
        self.word, self.space, self.upper = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        low = np.arange(n, dtype=np.int64)
        for a, b in ((0, 0xD800), (0xE000, n)):
            for c in range(a, b):
                x = chr(c)
                if x.isalnum():
                    self.word[c] = True
                    self.upper[c] = x.isupper()
                    y = x.lower()
                    if len(y) == 1:
                        low[c] = ord(y)
                elif x.isspace():
                    self.space[c] = True
        self.word[ord("_")] = True
        self.mark = np.zeros(n, bool)
        self.mark[[ord(c) for c in ".,;:?"]] = True
        self.value = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[low]
        self.powers: dict[int, np.ndarray] = {}

    def _power(self, base: int, n: int) -> np.ndarray:
        have = self.powers.get(base)
        if have is None or len(have) < n:
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, base, np.uint64)]))
            self.powers[base] = have
        return have[:n]

    def many(self, texts: list[str | None], limit: int = 1 << 18) -> Iterator[Units]:
        group: list[str] = []
        held = first = 0
        for k, t in enumerate(texts):
            group.append(t or "")
            held += len(group[-1])
            if held >= limit or k == len(texts) - 1:
                yield self._group(group, first)
                group, held, first = [], 0, k + 1

    def _group(self, texts: list[str], number: int) -> Units:
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        word, space = self.word[cp], self.space[cp]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return Units(*[np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)])
        # words
        size = end - start
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.flatnonzero(word)
        place = np.arange(len(at)) - np.repeat(first, size)
        h = mix(np.add.reduceat(self.value[cp[at]] * self._power(_B1, int(size.max()) + 1)[place], first) + size.astype(np.uint64))
        # clauses: between two words is a stop if there is a line end, or white space and a mark
        def between(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return total[start[1:]] - total[end[:-1]]

        bang = cp == 33
        alone = bang.copy()  # repeated exclamation marks are decoration
        alone[1:] &= ~bang[:-1]
        alone[:-1] &= ~bang[1:]
        blanks = between(space)
        line = between(cp == 10) > 0
        stop = line | (blanks > 0) & (between(alone | self.mark[cp]) > 0)
        cuts = np.append(np.flatnonzero(stop) + 1, len(start))  # numbers of words before stops; the last is all of them
        begins = np.concatenate([[0], cuts[:-1]])
        # capitalised words after uncapitalised ones, inside a clause: the last of each
        apart = blanks == start[1:] - end[:-1]
        big = self.upper[cp[start]]
        pasted = np.flatnonzero(apart & big[1:] & ~big[:-1]) + 1
        sentence = np.searchsorted(begins, pasted, side="right") - 1
        inside = begins[sentence] != pasted
        pasted, sentence = pasted[inside], sentence[inside]
        last = np.ones(len(pasted), bool)
        last[:-1] = sentence[1:] != sentence[:-1]
        a = np.sort(np.concatenate([begins, pasted[last]]))
        # ends: the first stop that leaves enough words, in the same text
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(text_ends, start[a], side="right")
        k = np.searchsorted(cuts, a + self.min_words)
        fits = k < len(cuts)
        a, owner, b = a[fits], owner[fits], cuts[k[fits]]
        fits = end[b - 1] <= text_ends[owner]
        a, owner, b = a[fits], owner[fits], b[fits]
        clauses = len(a)
        if self.lines:  # texts end lines
            ends = np.append(np.flatnonzero(line) + 1, len(start))
            a, b = np.concatenate([a, [0], ends[:-1]]), np.concatenate([b, ends])
            owner = np.searchsorted(text_ends, start[a], side="right")
        base = np.concatenate([[0], text_ends])[owner]
        out = [owner + number, start[a] - base, end[b - 1] - base]
        n = len(h) + 1
        for salt, power in ((np.uint64(0), _B1), (_SALT, _B2)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((mix(h ^ salt) if salt else h) * self._power(power, n)[:-1])])
            back = self._power(pow(power, -1, 1 << 64), n)
            d = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
            d[clauses:] = mix(d[clauses:] ^ _LINE)  # lines equal only lines
            out.append(d)
        before = np.searchsorted(start, base)  # words of the texts before
        return Units(*out, a - before, b - before)


def repeats(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the first occurrences of digests in their text, and of later ones that don't overlap them."""
    first, again = np.ones(len(u.text), bool), np.zeros(len(u.text), bool)
    if not len(u.text):
        return first, again
    order = np.lexsort((u.start, u.lo, u.hi, u.text))
    t, hi, lo = u.text[order], u.hi[order], u.lo[order]
    same = np.concatenate([[False], (t[1:] == t[:-1]) & (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))[same]
    later = order[same]
    first[later] = False
    again[later] = u.start[later] >= u.end[order[lead]]
    return first, again


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def removed_units(docs: DataFrame, min_words: int | None = MIN_WORDS, lines: bool = False) -> DataFrame:
    """(doc_id, start, end, kept_doc_id, a, b): every unit occurrence that is not its digest's earliest.

    With ``lines``, whole lines of any length are units beside sentences of at
    least ``min_words`` words.  Offsets are code points of the original text,
    end exclusive; a and b count words alike.  The earliest occurrence is that
    of the lowest id (a null id comes last), then the lowest start.  Rows of
    one id are one document: repeated rows get equal decisions.  Texts without
    words have no units; other columns are ignored; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs)

    def gathered(parts: list[dict[str, np.ndarray]], names: tuple[str, ...]) -> dict[str, np.ndarray]:
        return {n: np.concatenate([p[n] for p in parts]) if parts else [] for n in names}

    def count():
        hasher = UnitHash(min_words, lines)

        def step(cols):
            ids = np.array([_LATE if d is None else d for d in cols["doc_id"]], np.int64)
            parts = [{"hi": signed(u.hi), "lo": signed(u.lo), "doc": ids[u.text]} for u in hasher.many(cols["text"])]
            return gathered(parts, ("hi", "lo", "doc"))

        return step

    seen = map_rows(rows, count, "hi long, lo long, doc long")
    shared = (
        seen.groupBy("hi", "lo")
        .agg(F.min("doc").alias("kept"), F.max("doc").alias("other"))
        .where("kept < other")
        .select("hi", "lo", "kept")
    )
    shared = written(shared, "units")
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(shared, "hi"))

    def occur():
        hasher = UnitHash(min_words, lines)

        def step(cols):
            ids = np.array([_LATE if d is None else d for d in cols["doc_id"]], np.int64)
            parts = []
            for u in hasher.many(cols["text"]):
                first, again = repeats(u)
                at = np.flatnonzero(again | (first & bloom.value.test(u.hi))) if len(u.hi) else np.empty(0, np.int64)
                hi, lo, once = signed(u.hi[at]), signed(u.lo[at]), again[at]
                parts.append({"hi": hi, "lo": lo, "doc": ids[u.text[at]], "start": u.start[at], "end": u.end[at], "a": u.a[at], "b": u.b[at], "again": once})
            return gathered(parts, ("hi", "lo", "doc", "start", "end", "a", "b", "again"))

        return step

    # read twice below
    found = written(map_rows(rows, occur, "hi long, lo long, doc long, start int, end int, a int, b int, again boolean"), "occurrences")
    place = ["start", "end", "a", "b"]
    spans = found.where(~F.col("again")).join(shared, ["hi", "lo"]).where("doc > kept").select("doc", *place, "kept")
    local = found.where("again").select("doc", *place, F.col("doc").alias("kept"))
    ids = [F.when(F.col(c) != _LATE, F.col(c)).alias(n) for c, n in (("doc", "doc_id"), ("kept", "kept_doc_id"))]
    return spans.unionByName(local).select(ids[0], "start", "end", ids[1], "a", "b")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans that overlap or touch as one; they come by start."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return list(zip(start[new].tolist(), np.append(reach[new[1:] - 1], reach[-1]).tolist()))


def removed_spans(docs: DataFrame, min_words: int | None = MIN_WORDS) -> DataFrame:
    """One row for each document that loses text.

    doc_id, n_units, spans (array of start, end, merged), n_chars, kept_docs,
    n_passages (runs of at least ``PASSAGE_WORDS`` words without one that
    stays).  Nulls, ties, repeats and other columns are as for ``removed_units``.
    """
    one = removed_units(docs, min_words, lines=True).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "a", "b"))).alias("all"),
        F.sort_array(F.collect_set("kept_doc_id")).alias("kept_docs"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, every = batch.column(1), batch.column(1).flatten()
            start, end, a, b = (every.field(k).to_numpy() for k in range(4))
            edge = np.concatenate([[0], np.cumsum(units.value_lengths().to_numpy())])
            spans, passages = [], []
            for lo, hi in zip(edge[:-1], edge[1:]):
                spans.append([{"start": x, "end": y} for x, y in merged(start[lo:hi], end[lo:hi])])
                passages.append(sum(y - x >= PASSAGE_WORDS for x, y in merged(a[lo:hi], b[lo:hi])))
            n = [sum(x["end"] - x["start"] for x in xs) for xs in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(edge)), pa.array(spans, _SPANS), pa.array(n, pa.int64()), batch.column(2), pa.array(passages, pa.int64())],
                names=["doc_id", "n_units", "spans", "n_chars", "kept_docs", "n_passages"],
            )

    return one.select("doc_id", "all", "kept_docs").mapInArrow(
        run, "doc_id long, n_units long, spans array<struct<start:int,end:int>>, n_chars long, kept_docs array<long>, n_passages long"
    )


def deduplicate(docs: DataFrame, min_words: int | None = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated units cut out of ``text`` and a column ``removed_spans`` of their original offsets.

    A column of that name is replaced; all others stay, whatever their names.
    Null and empty texts stay as they are; rows of one id share their spans, so
    they are taken as repeated rows (a span beyond a shorter text cuts nothing).
    """
    kept = [c for c in docs.columns if c != "removed_spans"]
    doc, text = fresh(docs.columns, "doc"), kept.index("text")
    spans = removed_spans(docs, min_words).select(F.col("doc_id").alias(doc), F.col("spans").alias("removed_spans"))
    joined = docs.select(*kept).join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
    no = F.array().cast("array<struct<start:int,end:int>>")
    joined = joined.select(*kept, F.coalesce("removed_spans", no).alias("removed_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, cuts in zip(batch.column(text).to_pylist(), batch.column(len(kept)).to_pylist()):
                if t and cuts:
                    at = [0, *(x for s in cuts for x in (s["start"], s["end"])), len(t)]
                    t = "".join(t[a:b] for a, b in zip(at[::2], at[1::2]))
                out.append(t)
            cols = batch.columns
            cols[text] = pa.array(out, cols[text].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
        release()

    return joined.mapInArrow(run, joined.schema)


def op9(docs: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    kept = F.array_join(F.transform("kept_docs", lambda k: k.cast("string")), ",")
    return removed_spans(docs).select("doc_id", "n_units", "n_chars", spans.alias("spans"), kept.alias("kept_docs"), "n_passages")
