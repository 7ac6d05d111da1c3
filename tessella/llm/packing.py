"""Hierarchical multi-length packing.

A document's token ids are cut into windows of the longest tier; what is left
over is routed to the smallest tier (a power of two) that holds it.  Tiers are
packed from the longest down: a window takes the largest piece routed to its
tier, then its gap is filled from shorter tiers, best fit first; only when
every remaining piece is longer than the gap is one cut to close it.  So each
window of a tier is full.  The sequences of a tier are dealt into step groups
of equal token counts and nearly equal attention cost.

Packing is local to an input partition and streams through it with bounded
memory, so there is no shuffle and a lost task is simply run again.  A
partition's last window is cut into full windows of powers of two, so it needs
no padding either.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import release, small_batches

TIERS = (2048, 1024, 512, 256)
EOS = 1
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 15

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
    ("step_group", pa.int64()),
])


def byte_bpe(path: str):
    """An encoder with the ids of the byte-level BPE file ``path`` (JSON of a fast tokenizer).

    The vocabulary is read as ranks and run by a faster BPE engine; tests hold
    the ids against the file's own library.  Like there, the text of an added
    token is that token wherever it stands.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
    # the usual printable stand-ins for bytes
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in kept}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if piece not in added and all(c in byte for c in piece)}
    engine = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        return np.asarray(engine.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


Piece = tuple[int, int, int]  # length, document, start


class Packer:
    """Packs pieces into full windows; keeps what doesn't fill one yet."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers must be distinct powers of two, longest first")
        self.tiers, self.step_tokens = tiers, step_tokens
        self.items: list[Piece] = []

    def add(self, doc: int, n: int) -> list[tuple[int, list[Piece]]]:
        """Takes a document of ``n`` tokens; returns its full windows of the longest tier."""
        top = self.tiers[0]
        full = [(top, [(top, doc, s)]) for s in range(0, n - top + 1, top)]
        if n % top:
            insort(self.items, (n % top, doc, n - n % top))
        return full

    def _fill(self, size: int, pieces: list[Piece]) -> int:
        gap = size - sum(p[0] for p in pieces)
        items = self.items
        while gap and items:
            k = bisect_right(items, (gap, 1 << 62, 1 << 62)) - 1
            if k >= 0:
                pieces.append(items.pop(k))
                gap -= pieces[-1][0]
            else:  # all are longer: the shortest is cut
                n, doc, start = items.pop(0)
                pieces.append((gap, doc, start))
                insort(items, (n - gap, doc, start + gap))
                gap = 0
        return gap

    def windows(self) -> list[tuple[int, list[Piece]]]:
        """All windows that can be filled, longest tier first; the rest stays."""
        out = []
        for size, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while self.items and self.items[-1][0] > below:
                k = bisect_right(self.items, (size, 1 << 62, 1 << 62)) - 1
                pieces = [self.items.pop(k)]
                if self._fill(size, pieces):
                    for p in pieces:
                        insort(self.items, p)
                    return out
                out.append((size, pieces))
        return out

    def rest(self) -> list[tuple[int, list[Piece]]]:
        """What is left, in full windows of powers of two."""
        total, out = sum(p[0] for p in self.items), []
        size = self.tiers[0]
        while total:
            while size > total:
                size //= 2
            pieces: list[Piece] = []
            self._fill(size, pieces)
            out.append((size, pieces))
            total -= size
        return out

    def steps(self, windows: list[tuple[int, list[Piece]]]) -> list[tuple[int, int, list[Piece]]]:
        """(step, tier, pieces): each step holds as many tokens, of one tier; costs are dealt evenly."""
        out, step = [], 0
        by: dict[int, list[list[Piece]]] = {}
        for size, pieces in windows:
            by.setdefault(size, []).append(pieces)
        for size in sorted(by, reverse=True):
            ws = sorted(by[size], key=lambda ps: -sum(p[0] * p[0] for p in ps))
            each = max(1, self.step_tokens // size)
            n = -(-len(ws) // each)
            for k, ps in enumerate(ws):
                lap, at = divmod(k, n)
                out.append((step + (at if lap % 2 == 0 else n - 1 - at), size, ps))
            step += n
        return sorted(out, key=lambda x: x[0])


def pack(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of all rows of ``docs`` with their places in sequences.

    A null or empty text has one token (the end mark).  Null ids and repeated
    rows are packed like any other; an empty table gives no pieces; other
    columns are ignored.  ``sequence_id`` and ``step_group`` are unique over
    the table: the partition's number, then a count.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        base = TaskContext.get().partitionId() << 40
        packer = Packer(tiers)
        ids: dict[int, tuple] = {}
        ready: list[tuple[int, list[Piece]]] = []
        n_doc = n_seq = n_step = held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n_seq, n_step, ready, held
            ready += packer.windows()
            if last:
                ready += packer.rest()
            cols: list[list] = [[] for _ in _OUT]
            top = -1
            for step, tier, pieces in packer.steps(ready):
                top = max(top, step)
                at = 0
                for n, doc, start in pieces:
                    key, arr = ids[doc]
                    row = (key, start, n, zlib.crc32(arr[start : start + n].astype("<u4").tobytes()), len(arr),
                           base + n_seq, at, tier, base + n_step + step)
                    for c, v in zip(cols, row):
                        c.append(v)
                    at += n
                n_seq += 1
            n_step += top + 1
            ready, held = [], 0
            live = {p[1] for p in packer.items}
            for doc in [d for d in ids if d not in live]:
                del ids[doc]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                arr = np.append(encode(text), np.uint32(EOS))
                ids[n_doc] = (key, arr)
                ready += packer.add(n_doc, len(arr))
                n_doc += 1
                held += len(arr)
                if held >= block_tokens:
                    yield from flush(False)
        yield from flush(True)
        release()

    return rows.mapInArrow(run, SCHEMA)


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs)
