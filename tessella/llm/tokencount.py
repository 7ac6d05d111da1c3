"""Exact token counts of a unigram tokenizer without building its tokens.

Aho-Corasick enumerates all vocabulary pieces in the text; dynamic programming
over the positions carries the best score and the number of pieces that reach
it, and no back pointers.  Ties follow the unigram tokenizer's rules: a
candidate replaces another at the same end only if its score is strictly
higher, and candidates come in the order of their start, so the longest last
piece wins.  A character that is no piece by itself also costs the lowest
score less 10 and counts as its UTF-8 bytes (byte fallback).

Where no piece has a word mark after another character, words can be counted
apart: scores are whole numbers, so sums are exact and each word's optimum is
part of the text's.  Counts of words are remembered in bounded memory.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_MEMO_LIMIT = 1 << 19
_LONG = 64
_ALNUM = re.compile(r"[^\W_]")
_SIGNS = frozenset(".,;:!?")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a piece model file with the file's scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not any(f(i) for f in special)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.lens = np.array([len(p) for p, _ in pieces], np.int64)
        self.scores = np.array([s for _, s in pieces], np.float64)
        for k, (p, _) in enumerate(pieces):
            self.auto.add_word(p, k)
        if pieces:
            self.auto.make_automaton()
        self.empty = not pieces
        self.unknown = (self.scores.min() if pieces else 0.0) - UNKNOWN_PENALTY
        exact = bool((self.scores == np.round(self.scores)).all())
        self.by_word = exact and not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        # Cuts that no piece spans: before marks, around white space that is in no piece, and
        # between a letter or digit and a sign that no piece has beside one.
        pairs = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        beside: dict[str, set[str]] = {}
        for q in pairs:
            for c, d in (q, q[::-1]):
                if c in _SIGNS and _ALNUM.match(d):
                    beside.setdefault(c, set()).add(d)
        # a few odd letters that stand beside a sign in some piece are kept out of runs instead
        odd = "".join(sorted({d for ds in beside.values() if len(ds) <= 20 for d in ds}))
        sign = re.escape("".join(sorted(c for c in _SIGNS if beside.get(c, set()) <= set(odd))) or "\0")
        run = rf"[^\W_{re.escape(odd)}]"
        white = re.escape("".join(c for c in "\n\r\t" if not any(c in p for p, _ in pieces)) or "\0")
        self.split = re.compile(
            rf"{MARK}*+{run}++(?=[{sign}{white}{MARK}]|\Z)|{MARK}*+[{sign}]++(?={run}|[{white}{MARK}]|\Z)"
            rf"|{MARK}*+[^{white}{MARK}]++|{MARK}++|[{white}]"
        )
        self.memo: dict[str, tuple[int, float]] = {}

    def normalised(self, text: str | None) -> str:
        """A word mark in front and in place of every space; empty stays empty."""
        return (MARK + text).replace(" ", MARK) if text else ""

    def count_batch(self, texts: list[str | None]) -> list[tuple[int, float]]:
        parts = []
        for text in texts:
            t = self.normalised(text)
            parts.append(([t] if t else []) if not self.by_word else self.split.findall(t))
        if len(self.memo) > _MEMO_LIMIT:
            self.memo.clear()
        new = list({w for ws in parts for w in ws} - self.memo.keys())
        self.memo.update(zip(new, self._solve(new)))
        get, out = self.memo.__getitem__, []
        for ws in parts:
            got = [*zip(*map(get, ws))] or [(0,), (0.0,)]
            out.append((sum(got[0]), float(sum(got[1]))))
        return out

    def _solve(self, words: list[str]) -> list[tuple[int, float]]:
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= _LONG]
        for k, w in enumerate(words):
            if len(w) > _LONG:
                out[k] = self._scalar(w)
        for at in range(0, len(short), 20000):
            some = short[at : at + 20000]
            for k, r in zip(some, self._level([words[k] for k in some])):
                out[k] = r
        return out

    def _scalar(self, w: str) -> tuple[int, float]:
        """Plain dynamic programming over one long string."""
        n = len(w)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        single = [False] * n
        if not self.empty:
            for end, k in self.auto.iter(w):
                ends[end + 1].append(k)
                if self.lens[k] == 1:
                    single[end] = True
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            top, c = None, 0
            for k in sorted(ends[e], key=lambda k: -self.lens[k]):
                s = e - int(self.lens[k])
                v = best[s] + float(self.scores[k])
                if top is None or v > top:
                    top, c = v, count[s] + 1
            if not single[e - 1]:
                v = best[e - 1] + self.unknown
                if top is None or v > top:
                    top, c = v, count[e - 1] + len(w[e - 1].encode("utf-8", "surrogatepass"))
            best[e], count[e] = top, c
        return count[n], best[n]

    def _level(self, words: list[str]) -> list[tuple[int, float]]:
        """The same for many short strings at once, one end position after another."""
        if not words:
            return []
        size = np.array([len(w) for w in words], np.int64)
        base = np.concatenate([[0], np.cumsum(size + 1)[:-1]])  # each word has size + 1 states
        joined = "\0".join(words)
        # character k of the joined string is between state k and state k + 1
        found = chain.from_iterable(self.auto.iter(joined)) if not self.empty else ()
        hits = np.fromiter(found, np.int64).reshape(-1, 2)
        end, k = hits[:, 0] + 1, hits[:, 1]
        start = end - self.lens[k]
        score, n = self.scores[k], np.ones(len(k), np.int64)
        single = np.zeros(len(joined) + 1, bool)
        single[start[self.lens[k] == 1]] = True
        is_char = np.ones(len(joined) + 1, bool)
        is_char[base[1:] - 1] = False
        is_char[len(joined)] = False
        lone = np.flatnonzero(is_char & ~single)
        if len(lone):
            width = np.array([len(joined[i].encode("utf-8", "surrogatepass")) for i in lone], np.int64)
            start, end = np.append(start, lone), np.append(end, lone + 1)
            score, n = np.append(score, np.full(len(lone), self.unknown)), np.append(n, width)
        word = np.searchsorted(base, start, side="right") - 1
        inside = end <= base[word] + size[word]  # none crosses a separator unless a piece holds it
        start, end, score, n, word = start[inside], end[inside], score[inside], n[inside], word[inside]
        level = end - base[word]
        # by level, end, start: one key, as all lengths here are at most 64
        order = np.argsort((level << 48) | (end << 8) | (255 - (end - start)), kind="stable")
        start, end, score, n, level = start[order], end[order], score[order], n[order], level[order]
        best = np.zeros(len(joined) + 1)
        count = np.zeros(len(joined) + 1, np.int64)
        cuts = np.searchsorted(level, np.arange(1, int(size.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            s, e = start[a:b], end[a:b]
            v = best[s] + score[a:b]
            first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            top = np.maximum.reduceat(v, first)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(e))))
            win = np.flatnonzero(v == top[run])
            _, at = np.unique(run[win], return_index=True)  # the earliest start among equals
            win = win[at]
            best[e[win]] = v[win]
            count[e[win]] = count[s[win]] + n[a:b][win]
        last = base + size
        return list(zip(count[last].tolist(), best[last].tolist()))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score for the whole text of every row.

    A null or empty text has no tokens and score 0.  Repeated rows get equal
    results; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        counter = Counter(vocabulary(path))

        def step(cols):
            got = counter.count_batch(cols["text"])
            return {"doc_id": cols["doc_id"], "n_tokens": [g[0] for g in got], "score": [g[1] for g in got]}

        return step

    return map_rows(rows, make, "doc_id long, n_tokens long, score double")


def op6(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
