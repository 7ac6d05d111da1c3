"""Toxicity scoring behind a noisy channel.

Writers disguise words by look-alike signs, spacing and repetition, and by
other forms of letters (full width, mathematical, circled) and invisible
characters, which are undone first.  A character lattice holds the readings of each disguised token: a sign stands for
itself or a letter it looks like, a gap between single letters is kept or
dropped, a run of one letter is kept or shortened.  Viterbi decoding under a
character 4-gram model of the whole corpus, with a cost for each channel
operation, restores the likeliest reading.  A token whose lattice has one path
is its own reading, so only disguised tokens are decoded.

The restored text is scored by a lexicon of words and word beginnings whose
log-odds are learned from labelled rows, and a logistic calibration.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import TextHash, bounded_sample, held_out, map_rows, mix, release, shingles, signed, small_batches, written

#: Bound of the labelled sample that lexicon and calibration are fitted on, for each label.
SAMPLE = 6000
THRESHOLD = 0.3
MIN_DOCS = 4
MIN_LOG_ODDS = 2.5
PREFIXES = (4, 5, 6)

#: Signs and the letters they look like.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SUBSTITUTE, DROP_GAP, SHORTEN, DOUBLED, DROP_SIGN = 0.7, 0.4, 0.3, 0.8, 1.0

ALPHABET = 28  # edge, a to z, other
_WORD = re.compile(r"\w+")
_SPACED = re.compile(r"[^\W_](?:[ ._*\-]+[^\W_])+")
#: Signs that can stand for a letter among letters set apart; the others are too often just marks.
_APART = "".join(c for c in LOOKALIKES if c not in "!|+(")
_CHAIN = re.compile(rf"(?:[^\W_]|[{re.escape(_APART)}])(?:[ ._*\-]+(?:[^\W_]|[{re.escape(_APART)}]))+")
#: Signs of which one in three in a row makes a token worth decoding that has no letter; numbers have none.
_STRONG = "@$€£¡"
_MEMO_TOKEN = 64


def fold(c: str) -> int:
    """1 to 26 for a letter whatever its accents, 27 for another sign, 0 for white space."""
    if c.isspace():
        return 0
    k = ord(unicodedata.normalize("NFKD", c.lower())[0]) - 96
    return k if 1 <= k <= 26 else 27


@cache
def _plain_forms() -> dict[int, str | None]:
    """Other forms of letters, digits and look-alike signs -> the plain one; invisible characters and overlays -> nothing."""
    out: dict[int, str | None] = {c: None for c in range(0x300, 0x370)}
    for c in range(0x80, 0x20000):
        x = chr(c)
        kind = unicodedata.category(x)
        if kind == "Cf":
            out[c] = None
        elif kind not in ("Cn", "Cs", "Co"):
            y = unicodedata.normalize("NFKC", x).lower()
            if y.isascii() and all(z.isalnum() or z in LOOKALIKES for z in y):
                out[c] = y
    return out


def plain(text: str) -> str:
    """Lower case, with other forms of characters made plain."""
    low = text.lower()
    return low if low.isascii() else low.translate(_plain_forms())


LETTER, SIGN, GAP, BANG, APART, STRONG = 1, 2, 4, 8, 16, 32


class Folder:
    """Tables over code points: folded codes, and classes of characters."""

    def __init__(self) -> None:
        self.table = np.full(0x10000, 27, np.uint8)
        self.kind = np.zeros(0x10000, np.uint8)
        for c in range(0x3001):
            if not 0xD800 <= c < 0xE000:
                x = chr(c)
                self.table[c] = fold(x)
                self.kind[c] = LETTER * x.isalpha() | SIGN * (x in LOOKALIKES) | GAP * (x in " ._*-") | BANG * (x == "!") | APART * (x.isalpha() or x in _APART) | STRONG * (x in _STRONG)

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)

    def codes(self, text: str) -> np.ndarray:
        return self.table[self.points(text)]


class CharModel:
    """Character 4-grams with backing off, as one dense table of log-probabilities."""

    def __init__(self, counts: np.ndarray):
        a = ALPHABET
        c4 = counts.reshape(a, a, a, a).astype(np.float64)
        c3, c2, c1 = c4.sum(axis=0), c4.sum(axis=(0, 1)), c4.sum(axis=(0, 1, 2))
        p = (c1 + 1) / (c1.sum() + a)
        for c in (c2, c3, c4):
            total = c.sum(axis=-1, keepdims=True)
            kinds = (c > 0).sum(axis=-1, keepdims=True)
            p = (c + (kinds + 1) * p) / (total + kinds + 1)
        self.cost = (-np.log(p)).astype(np.float32).reshape(-1)


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of folded character 4-grams over all texts; at most 28**4 rows reach the driver."""
    small_batches(docs.sparkSession)
    size = ALPHABET**4

    def run(batches):
        import pyarrow as pa

        folder, total, a = Folder(), np.zeros(size, np.int64), ALPHABET
        for batch in batches:
            for text in _joined(batch.column(0).to_pylist()):
                c = folder.codes(text).astype(np.int32)
                total += np.bincount(((c[:-3] * a + c[1:-2]) * a + c[2:-1]) * a + c[3:], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["g", "n"])
        release()

    def _joined(texts, limit=1 << 21):
        """Texts with white space around them, several at a time."""
        held, n = [], 0
        for t in texts:
            if t:
                held.append(t)
                n += len(t)
                if n >= limit:
                    yield "   " + "   ".join(held) + " "
                    held, n = [], 0
        if held:
            yield "   " + "   ".join(held) + " "

    rows = docs.select(F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    if got.num_rows:
        out[got["g"].to_numpy()] = got["n"].to_numpy()
    return out


class _Codes(dict):
    """Folded codes, remembered."""

    def __missing__(self, c: str) -> int:
        k = self[c] = fold(c)
        return k


class Decoder:
    """Viterbi decoding of disguised tokens."""

    def __init__(self, model: CharModel):
        self.cost = model.cost
        self.disguise = Disguise()
        self.memo: dict[str, str] = {}
        self.code = _Codes().__getitem__

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each position, the readings (text, channel cost) of a character or run."""
        out: list[list[tuple[str, float]]] = []
        i, n = 0, len(token)
        single = bool(_SPACED.fullmatch(token)) or bool(_CHAIN.fullmatch(token))
        while i < n:
            c = token[i]
            j = i
            while j < n and token[j] == c:
                j += 1
            if c in LOOKALIKES:
                k = j - i
                reads = [(token[i:j], 0.0)]
                lost = SHORTEN if k > 2 else DOUBLED
                reads += [(x * r, SUBSTITUTE + 0.2 * (k - 1) + lost * (r < k)) for x in LOOKALIKES[c] for r in sorted({1, min(k, 2), k})]
            elif c.isalpha():
                reads = [(token[i:j], 0.0)]
                if j - i > 1:
                    reads.append((c, SHORTEN if j - i > 2 else DOUBLED))
                if j - i > 2:
                    reads.append((c * 2, SHORTEN))
            else:
                reads = [(token[i:j], 0.0), ("", DROP_GAP if single and c in " ._*-" else DROP_SIGN)]
            out.append(reads)
            i = j
        return out

    def decode(self, token: str) -> str:
        """The likeliest reading of a whole token; equal costs go to the reading that comes first in the lattice.

        Linear in the token: a state keeps its last reading and where it came from.
        """
        if token in self.memo:
            return self.memo[token]
        a, costs = ALPHABET, self.cost
        beam: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for reads in [*self.lattice(token), [(" ", 0.0)]]:
            coded = [(read, extra, [self.code(c) for c in read]) for read, extra in reads]
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (cost, path) in beam.items():
                for read, extra, codes in coded:
                    s, total = state, cost + extra
                    for k in codes:
                        at = s * a + k
                        total += float(costs[at])
                        s = at % (a * a * a)
                    if s not in after or total < after[s][0]:
                        after[s] = (total, (path, read) if read else path)
            beam = after
        _, path = min(beam.values(), key=lambda x: x[0])
        parts = []
        while path is not None:
            path, read = path
            parts.append(read)
        best = "".join(reversed(parts)).strip()
        if len(token) <= _MEMO_TOKEN:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = best
        return best


class Disguise:
    """Finds tokens whose lattice has more than one path worth decoding."""

    def __init__(self) -> None:
        self.folder = Folder()

    @staticmethod
    def _chains(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of three or more characters apart, two letters at least, with nothing but gaps between them."""
        unit = np.concatenate([[False], (kind & APART) > 0, [False]])
        edge = np.flatnonzero(unit[1:] != unit[:-1])
        start, end = edge[::2], edge[1::2]
        one = end - start == 1
        if one.sum() < 3:
            return start[:0], start[:0]
        other = np.concatenate([[0], np.cumsum((kind & GAP) == 0)])
        tied = one[1:] & one[:-1] & (other[start[1:]] == other[end[:-1]])
        ends = np.diff(np.concatenate([[0], tied.astype(np.int8), [0]]))
        first, last = np.flatnonzero(ends == 1), np.flatnonzero(ends == -1)
        letters = np.concatenate([[0], np.cumsum((kind[start] & LETTER) > 0)])
        good = (last - first >= 2) & (letters[last + 1] - letters[first] >= 2)
        return start[first[good]], end[last[good]]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """In order, without overlaps; whole chains and tokens, however long; linear in the text."""
        cp = self.folder.points(text)
        if len(cp) < 3:
            return []
        kind = self.folder.kind[cp]
        letter, sign, gap = (kind & LETTER) > 0, (kind & SIGN) > 0, (kind & GAP) > 0
        core = np.zeros(len(cp), bool)
        # a run of three, or two doubled letters in a row
        twice = (cp[1:] == cp[:-1]) & letter[1:]
        core[:-2] |= twice[1:] & twice[:-1]
        if len(cp) > 3:
            core[:-3] |= twice[2:] & twice[:-2]
        # a look-alike beside a letter; an exclamation mark only in front of one
        core[:-1] |= (sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:] & ((kind[1:] & BANG) == 0))
        # look-alikes alone
        strong = (kind & STRONG) > 0
        core[:-2] |= sign[:-2] & sign[1:-1] & sign[2:] & (strong[:-2] | strong[1:-1] | strong[2:])
        # letters apart
        core[1:-1] |= letter[:-2] & gap[1:-1] & (cp[1:-1] != 32) & letter[2:]
        chains = dict(zip(*(x.tolist() for x in self._chains(kind))))
        for p in chains:
            core[p] = True
        out, done = [], 0
        for p in np.flatnonzero(core).tolist():
            if p < done:
                continue
            if p in chains:
                out.append((p, chains[p]))
                done = chains[p]
                continue
            a = b = p
            while a > done and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace() and b not in chains:
                b += 1
            while a < b and not (kind[a] & (LETTER | SIGN)):
                a += 1
            while b > a and (kind[b - 1] & BANG or not kind[b - 1] & (LETTER | SIGN)):
                b -= 1
            if b > a:
                out.append((a, b))
            done = max(b, p + 1)
        return out


def restored_words(text: str | None, decoder: Decoder) -> set[str]:
    """Distinct words of the text with disguised tokens restored; the written forms stay too."""
    if not text:
        return set()
    low = plain(text)
    out = set(_WORD.findall(low))
    for a, b in decoder.disguise.spans(low):
        out.update(_WORD.findall(decoder.decode(low[a:b])))
    return out


def restore(text: str | None, decoder: Decoder) -> str | None:
    """The text in plain lower case with disguised tokens restored."""
    if text is None:
        return None
    low, out, done = plain(text), [], 0
    for a, b in decoder.disguise.spans(low):
        out += [low[done:a], decoder.decode(low[a:b])]
        done = b
    return "".join([*out, low[done:]])


def _features(word: str) -> list[str]:
    return [word + "$", *[word[:n] for n in PREFIXES if len(word) >= n]]


class Scorer:
    """Lexicon weights and a logistic of the sum of each word's best weight."""

    def __init__(self, weights: dict[str, float], slope: tuple[float, float, float]):
        self.weights, self.slope = weights, slope
        self.memo: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.memo.get(word)
        if w is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            w = self.memo[word] = max((self.weights.get(f, 0.0) for f in _features(word)), default=0.0)
        return w

    def raw(self, words: set[str]) -> tuple[float, float]:
        hit = sorted(w for w in map(self.weight, words) if w)
        return math.log1p(math.fsum(hit)), (hit[-1] if hit else 0.0)

    def score(self, words: set[str]) -> float:
        x, y = self.raw(words)
        z = self.slope[0] + self.slope[1] * x + self.slope[2] * y
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge; slopes are not negative."""
    if len(set(y.tolist())) < 2:
        return (2.0 if len(y) and y[0] else -2.0), 0.0, 0.0
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(3)
        w = w + np.linalg.solve(h, a.T @ (y - p) - 0.5 * w)
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` rows a label that are not held out, by hash of the id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    marks = bounded_sample(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic", sample)
    marks = marks.select(F.col("doc_id").alias("__d"), "toxic")  # at most 2 * sample rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(marks), F.col("doc_id") == F.col("__d"))
    # one row an id, however often it is repeated, so the sample stays bounded
    return _one_of_each(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def _one_of_each(sample: DataFrame) -> DataFrame:
    """The rows of the bounded sample that share none of four least shingles with one of a lower id.

    Copies would lend their rare words the weight of many documents.
    """
    from pyspark.sql.window import Window

    def make():
        hasher = TextHash()

        def step(cols):
            least = []
            for doc, h in zip(cols["doc_id"], hasher.many(cols["text"])):
                s = shingles(h)
                seeds = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                own = np.full(4, np.uint64(doc % (1 << 63)))
                least.append(signed(mix(s[:, None] ^ seeds).min(axis=0) if len(s) else mix(own)).tolist())
            return cols | {"least": least}

        return step

    rows = written(map_rows(sample, make, "doc_id long, toxic int, text string, least array<long>"), "labelled")
    for k in range(4):
        rank = F.row_number().over(Window.partitionBy(F.col("least")[k]).orderBy("doc_id", "text"))
        rows = rows.withColumn(f"r{k}", rank)
    return rows.where(" AND ".join(f"r{k} = 1" for k in range(4))).select("doc_id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[CharModel, Scorer]:
    """The character model of all texts, and lexicon and calibration from the labelled sample.

    Word counts stay in Spark; features at or above ``MIN_LOG_ODDS`` reach the
    driver.
    """
    spark = docs.sparkSession
    model = CharModel(char_counts(docs))
    shared = spark.sparkContext.broadcast(model)
    rows = _labelled(docs, labels, sample)

    def make():
        decoder = Decoder(shared.value)

        def step(cols):
            n: dict[str, list[int]] = {}
            for toxic, text in zip(cols["toxic"], cols["text"]):
                for f in {f for w in restored_words(text, decoder) for f in _features(w)}:
                    n.setdefault(f, [0, 0])[toxic] += 1
            return {"f": list(n), "clean": [v[0] for v in n.values()], "toxic": [v[1] for v in n.values()]}

        return step

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = map_rows(rows.select("toxic", "text"), make, "f string, clean long, toxic long")
    counts = counts.groupBy("f").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("t") >= MIN_DOCS)
    # counts moved one deviation against the feature, so that a few chance documents don't make a word toxic
    t, c = F.col("t") - F.sqrt("t") + 0.5, F.col("c") + F.sqrt("c") + 0.5
    odds = F.log(t / (n1 + 1.0)) - F.log(c / (n0 + 1.0))
    # at most a few features for each of the 2 * sample rows can have MIN_DOCS toxic rows
    best = counts.withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS).select("f", "w").collect()
    weights = {r["f"]: float(r["w"]) for r in best}
    lexicon = spark.sparkContext.broadcast(weights)

    def point():
        decoder, scorer = Decoder(shared.value), Scorer(lexicon.value, (0.0, 0.0, 0.0))

        def step(cols):
            got = [scorer.raw(restored_words(t, decoder)) for t in cols["text"]]
            return {"toxic": cols["toxic"], "x": [g[0] for g in got], "y": [g[1] for g in got]}

        return step

    points = map_rows(rows.select("toxic", "text"), point, "toxic int, x double, y double").orderBy("toxic", "x", "y").toArrow()
    x = np.column_stack([points["x"].to_numpy(), points["y"].to_numpy()]) if points.num_rows else np.empty((0, 2))
    y = points["toxic"].to_numpy().astype(np.float64) if points.num_rows else np.empty(0)
    return model, Scorer(weights, _logistic(x, y))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for the whole text of every row.

    A null or empty text has no words: its score is the calibration's for
    none.  Without labels of both kinds every row gets one constant score.  Null ids are
    never held out; repeated rows get equal scores; other columns are ignored.
    """
    spark = docs.sparkSession
    model, scorer = fit(docs, labels)
    shared = spark.sparkContext.broadcast((model, scorer.weights, scorer.slope))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))

    def make():
        m, weights, slope = shared.value
        decoder, s = Decoder(m), Scorer(weights, slope)

        def step(cols):
            got = [s.score(restored_words(t, decoder)) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "held_out": cols["held_out"],
                "score": got,
                "predicted": [int(g >= THRESHOLD) for g in got],
            }

        return step

    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def op4(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
