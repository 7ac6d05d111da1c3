"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3 letters,
word edges included) in order of frequency.  A document is compared with each
language's profile by the out-of-place distance: the sum over the document's
n-grams of the difference of the two ranks, or the profile length where the
language lacks the n-gram.  The nearest language wins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import bounded_sample, held_out, map_rows, release, small, small_batches

PROFILE = 400
#: Bound of the labelled sample that the profiles are fitted on, for each language.
SAMPLE = 1500
TEMPERATURE = 0.03
_SPACE = 32


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        table[lo:hi] = np.fromiter((chr(c).isalpha() for c in range(lo, hi)), bool, hi - lo)
    return table


class Grams:
    """n-gram codes of a text: exact, 21 bits a letter."""

    def __init__(self) -> None:
        self.alpha = _letters()

    def codes(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        ok = self.alpha[cp]
        if not ok.any():
            return np.empty(0, np.int64)
        a = np.empty(len(cp) + 2, np.int64)
        a[0] = a[-1] = _SPACE
        a[1:-1] = np.where(ok, cp, _SPACE)
        gap = a == _SPACE
        keep = np.ones(len(a), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        a, gap = a[keep], gap[keep]
        if not gap[-1]:
            a, gap = np.append(a, _SPACE), np.append(gap, True)
        one = a[~gap]
        two = (a[:-1] << 21) | a[1:]
        mid = ~gap[1:-1]
        three = ((a[:-2] << 42) | (a[1:-1] << 21) | a[2:])[mid]
        return np.concatenate([one, two, three])

    def profile(self, text: str | None, size: int) -> np.ndarray:
        """The ``size`` most frequent codes, most frequent first, ties by code."""
        c = self.codes(text)
        if not len(c):
            return c
        vals, counts = _counted(c)
        return vals[np.argsort(-counts, kind="stable")[:size]]


def _counted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = np.sort(c)
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return c[edge], np.diff(np.append(edge, len(c)))


class Model:
    """Language profiles as one sorted code table with a rank for each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), size, np.int32)
        for k, lang in enumerate(self.langs):
            for rank, c in enumerate(profiles[lang][:size]):
                self.ranks[k, np.searchsorted(self.codes, c)] = rank

    def distances(self, profile: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, 0 to 1."""
        n = len(profile)
        at = np.searchsorted(self.codes, profile)
        at[at == len(self.codes)] = 0 if len(self.codes) else 0
        known = self.codes[at] == profile if len(self.codes) else np.zeros(n, bool)
        at = np.where(known, at, len(self.codes))
        place = np.arange(n, dtype=np.int32)
        ranks = self.ranks[:, at]
        out = np.where(ranks == self.size, self.size, np.abs(ranks - place))
        return out.sum(axis=1) / (n * self.size)

    def predict(self, profile: np.ndarray) -> tuple[str, float, float]:
        """Language, confidence, distance; ties go to the first language by name."""
        if not len(profile) or not self.langs:
            return "und", 0.0, 1.0
        d = self.distances(profile)
        k = int(np.argmin(d))
        w = np.exp(-(d - d[k]) / TEMPERATURE)
        return self.langs[k], float(1.0 / w.sum()), float(d[k])


def fit(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> Model:
    """Profiles from text and lang of rows that are not held out.

    At most ``sample`` ids of each language, those with the lowest hash.  What
    reaches the driver is ``size`` n-grams a language.
    """
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    ids = ids.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    chosen = small(bounded_sample(ids, "lang", sample).distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "lang")]
    chosen = chosen.select(F.col("doc_id").alias("__doc_id"), F.col("lang").alias("__lang"))
    rows = rows.where(F.col("text").isNotNull()).join(chosen, on, "left_semi").select("lang", "text")

    def make():
        grams = Grams()

        def step(cols):
            out = {"lang": [], "code": [], "n": []}
            by: dict[str, list[str]] = {}
            for lang, text in zip(cols["lang"], cols["text"]):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                vals, counts = _counted(np.concatenate([grams.codes(t) for t in texts]))
                out["lang"] += [lang] * len(vals)
                out["code"] += vals.tolist()
                out["n"] += counts.tolist()
            return out

        return step

    counts = map_rows(rows, make, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    best = counts.withColumn("r", top).where(F.col("r") <= size)
    profiles: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "r").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return Model(profiles, size)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, distance for every row of ``docs``.

    Whole texts are read.  A null text or one without letters gives `und`,
    score 0 and distance 1; so does every row if there is nothing to learn
    from.  A null id is never held out.  Repeated rows are judged alike; other
    columns are ignored.
    """
    spark = docs.sparkSession
    model = model or fit(docs)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))

    def make():
        grams, m = Grams(), shared.value

        def step(cols):
            got = [m.predict(grams.profile(t, m.size)) for t in cols["text"]]
            return {
                "doc_id": cols["doc_id"],
                "held_out": cols["held_out"],
                "lang_pred": [g[0] for g in got],
                "score": [g[1] for g in got],
                "distance": [g[2] for g in got],
            }

        return step

    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, distance double")


def keep_known(docs: DataFrame, max_distance: float = 0.85) -> DataFrame:
    """The rows of ``docs`` whose language can be told.

    Rejected: no text, no letters, or a distance above ``max_distance`` to
    every profile, which only text in a script or language outside the learned
    ones reaches; so does every row if there is nothing to learn from.  Null
    ids and repeated rows are judged like any other; all columns stay, whatever
    their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    model = fit(docs)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    import pyarrow as pa

    names = docs.columns
    at = names.index("text")

    def run(batches):
        grams, m = Grams(), shared.value
        for batch in batches:
            got = (m.predict(grams.profile(t, m.size)) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([g[0] != "und" and g[2] <= max_distance for g in got], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op5(docs: DataFrame) -> DataFrame:
    return identify(docs)
