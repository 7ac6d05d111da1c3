"""Information-theoretic sanitisation of personal data.

Base patterns find e-mail addresses, IP addresses, payment cards and phone
numbers.  Each distinct value is a protected entity.  A term (word) that stands
near an entity may reveal it.  With document counts over the whole corpus,

    IC(e) = -log2( n(e) / N ),   PMI(e; t) = IC(e) + log2 P(e | t),

PMI / IC is the share of the entity's information that the term discloses.
P(e | t) is not n(e,t) / n(t) itself but the lower end of its confidence
interval (Wilson, one deviation): most values stand in one text, where a plain
ratio would take every chance neighbour at its word.

Terms at or above ``REMOVE`` are removed, those at or above ``GENERALISE`` are
replaced by the entity's class, in each document that holds the entity.  A term
that more likely than not stands for the entity, by two texts or more, reveals
it in any document, and is treated alike wherever it stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import (
    Bloom, TermHash, WordHash, cut, fresh, map_rows, release, signed, small_batches, split_by, text_key, written,
)

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
GENERALISE, REMOVE = 0.6, 0.85
#: P(e | t) and texts from which a term is marked in every document.
CERTAIN, TEXTS = 0.5, 2
MIN_TERM = 4
#: Terms that a counting task holds before it emits them.
HELD_TERMS = 1 << 20
#: Stands for any document, in place of an entity.
ANY = 0
_LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that starts inside a run of digits exists only if one starts at its beginning.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and _LOCAL.match(text, left - 1):
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, in order."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(d := g.lstrip("0")) <= 3 and int(d or 0) <= 255 for g in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(kind: int, value: str) -> str:
    """One form for all ways to write a value."""
    return f"{kind}:" + (value.lower() if kind < 2 else "".join(c for c in value if c.isdigit()))


def _outside(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words [start, end) that overlap no base span."""
    if not spans or not len(start):
        return np.ones(len(start), bool)
    begin = np.array([a for a, _, _ in spans])
    reach = np.maximum.accumulate([b for _, _, b in spans])
    k = np.searchsorted(begin, end, side="left") - 1
    return (k < 0) | (reach[k] <= start)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))


def _hashed_entities(text: str, spans: list[tuple[int, int, int]], memo: WordHash) -> list[tuple[int, int, int]]:
    """(place, kind, entity) of the base spans."""
    return [(a, kind, memo[_entity(kind, text[a:b])]) for a, kind, b in spans]


def _least_share(n: Column, of: Column) -> Column:
    """Lower end of the confidence interval (one deviation) of the share n / of."""
    p = F.least(F.lit(1.0), n / of)
    return (p + 0.5 / of - F.sqrt(p * (1 - p) / of + 0.25 / (of * of))) / (1 + 1 / of)


def _disclosure(n: Column, n_term: Column, n_entity: Column, total: int) -> Column:
    """PMI / IC; 0 where the entity stands in every document."""
    ic = -F.log2(n_entity / F.lit(float(total)))
    return F.when(ic > 0, 1 + F.log2(_least_share(n, n_term)) / F.when(ic > 0, ic)).otherwise(F.lit(0.0))


def disclosing_terms(docs: DataFrame, window: int = WINDOW, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, kind, disclosure) of all pairs that reach ``generalise``; entity 0 stands for any document.

    Candidates are terms within ``window`` words of an entity.  Counts are
    documents, over the whole table.  A term stands in no fewer documents than
    it stands in near entities, which rules out common words before terms are
    counted.  The pairs are a DataFrame; only Bloom filters are broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs)

    def near():
        memo, hasher = WordHash(), TermHash(MIN_TERM)

        def step(cols):
            out: dict[str, list] = {"entity": [], "kind": [], "term": [], "key": []}
            spans = [base_spans(t) for t in cols["text"]]
            some = [k for k, s in enumerate(spans) if s]
            for k, (start, end, h) in zip(some, hasher.many([cols["text"][k] for k in some])):
                text, free = cols["text"][k], _outside(start, end, spans[k])
                start, h = start[free], h[free]
                pairs: set[tuple[int, int, int]] = set()
                for a, kind, e in _hashed_entities(text, spans[k], memo):
                    i = int(np.searchsorted(start, a))
                    pairs.add((e, kind, 0))
                    for t in h[max(0, i - window) : i + window].tolist():
                        pairs.add((e, kind, t))
                        pairs.add((ANY, 0, t))
                for e, kind, t in sorted(pairs):
                    out["entity"].append(e)
                    out["kind"].append(kind)
                    out["term"].append(t)
                    out["key"].append(cols["key"][k])
            for c in ("entity", "term"):
                out[c] = signed(np.array(out[c], np.uint64))
            return out

        return step

    # term 0 stands for the entity itself
    pairs = map_rows(rows.select("key", "text"), near, "entity long, kind int, term long, key long")
    joint = cut(
        pairs.groupBy("entity", "kind", "term", "key").agg(F.count("*").alias("n"))
        .groupBy("entity", "kind", "term").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    )
    total = max(1, docs.count())
    entities = joint.where((F.col("term") == 0) & (F.col("entity") != ANY)).select("entity", F.col("n").alias("n_entity"))
    beside = joint.where(F.col("entity") == ANY).select("term", F.col("n").alias("n_near"))
    both = joint.where((F.col("term") != 0) & (F.col("entity") != ANY)).join(entities, "entity").join(beside, "term")
    n, n_entity = F.col("n"), F.col("n_entity")
    both = cut(both.where(_disclosure(n, F.col("n_near"), n_entity, total) >= generalise).drop("n_near"))
    wanted = spark.sparkContext.broadcast(Bloom.of(both.select("term").distinct(), "term"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = TermHash(MIN_TERM), np.empty(0, np.uint64)
        counts = np.empty(0, np.int64)

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(signed(held)), pa.array(counts)], names=["term", "n"])

        for batch in batches:
            seen = [held]
            for _, _, h in hasher.many(batch.column(0).to_pylist()):
                seen.append(np.unique(h[wanted.value.test(h)]) if len(h) else h)
            every = np.concatenate(seen)
            weight = np.concatenate([counts, np.ones(len(every) - len(held), np.int64)])
            held, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, weight, len(held)).astype(np.int64)
            if len(held) > HELD_TERMS:
                yield emitted()
                held, counts = held[:0], counts[:0]
        if len(held):
            yield emitted()
        release()

    df = rows.select("text").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    found = both.join(df, "term").withColumn("disclosure", F.least(F.lit(1.0), _disclosure(n, F.col("n_term"), n_entity, total)))
    found = cut(found.where(F.col("disclosure") >= generalise))
    certain = found.where((F.col("texts") >= TEXTS) & (_least_share(n, F.col("n_term")) >= CERTAIN))
    best = certain.groupBy("term").agg(F.max(F.struct("disclosure", (-F.col("kind")).alias("k"))).alias("b"))
    best = best.select(F.lit(ANY).cast("long").alias("entity"), "term", (-F.col("b.k")).cast("int").alias("kind"), "b.disclosure")
    return written(found.select("entity", "term", "kind", "disclosure").unionByName(best), "terms")


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, key, found): the places of disclosing terms in every document that has one."""
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(Bloom.of(terms.select("term").distinct(), "term"))
    turned = F.shiftleft("entity", 17).bitwiseOR(F.shiftrightunsigned("entity", 47))
    pairs = sc.broadcast(Bloom.of(terms.select(turned.bitwiseXOR(F.col("term")).alias("p")), "p"))

    def occur():
        memo, hasher = WordHash(), TermHash(MIN_TERM)

        def step(cols):
            out: dict[str, list] = {n: [] for n in ("doc_id", "key", "entity", "term", "start", "end")}
            for doc, key, text, (start, end, h) in zip(cols["doc_id"], cols["key"], cols["text"], hasher.many(cols["text"])):
                hit = np.flatnonzero(words.value.test(h)) if len(h) else ()
                if not len(hit):
                    continue
                spans = base_spans(text)
                hit = hit[_outside(start[hit], end[hit], spans)]
                start, end, h = start[hit], end[hit], h[hit]
                for e in sorted({ANY, *(e for _, _, e in _hashed_entities(text, spans, memo))}):
                    turn = np.uint64((e << 17 | e >> 47) & (1 << 64) - 1)
                    at = np.flatnonzero(pairs.value.test(h ^ turn)) if len(h) else ()
                    if len(at):
                        out["doc_id"] += [doc] * len(at)
                        out["key"] += [key] * len(at)
                        out["entity"] += [e] * len(at)
                        out["term"] += h[at].tolist()
                        out["start"] += start[at].tolist()
                        out["end"] += end[at].tolist()
            for c in ("entity", "term"):
                out[c] = signed(np.array(out[c], np.uint64))
            return out

        return step

    places = map_rows(_rows(docs), occur, "doc_id long, key long, entity long, term long, start int, end int")
    return (
        places.join(terms, ["entity", "term"])
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind", "disclosure"))).alias("found"))
    )


def _joined(left: DataFrame, spans: DataFrame, doc: str, key: str, found: str = "found") -> DataFrame:
    d, k = fresh(left.columns, "d"), fresh(left.columns, "k")
    right = spans.select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("found").alias(found))
    return left.join(right, F.col(doc).eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), "left").drop(d, k)


def detect(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, counts of base matches, base_sha256, spans, n_term, n_private (all of them).

    A null text counts as empty.  Spans are `kind:start:end` in code points,
    end exclusive, by start and then kind (base kinds as listed, `term` last);
    `base_sha256` hashes the base ones alone.  Null ids and repeated rows are
    kept; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    spans = _term_spans(docs, disclosing_terms(docs))

    def base():
        def step(cols):
            out: dict[str, list] = {"doc_id": cols["doc_id"], "key": cols["key"], "n": [], "sha": [], "base": []}
            for text in cols["text"]:
                found = base_spans(text)
                out["n"].append([sum(k == i for _, k, _ in found) for i in range(4)])
                joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
                out["sha"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["base"].append([{"start": a, "kind": k, "end": b} for a, k, b in found])
            return out

        return step

    rows = map_rows(_rows(docs), base, "doc_id long, key long, n array<long>, sha string, base array<struct<start:int,kind:int,end:int>>")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    terms = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))
    terms = F.coalesce(F.array_distinct(terms), none)
    together = F.sort_array(F.concat("base", terms))
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    text = F.array_join(F.transform(together, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    return _joined(rows, spans, "doc_id", "key").select(
        "doc_id",
        *[F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.col("sha").alias("base_sha256"),
        text.alias("spans"),
        F.size(terms).cast("long").alias("n_term"),
        F.size(together).cast("long").alias("n_private"),
    )


def sanitise(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """``docs`` with base matches replaced by their class, disclosing terms generalised to it or removed.

    All columns stay, whatever their names, `text` changed; `n_chars`, where
    there is one, follows the new text.  A null text stays null, an empty one
    empty; rows with null ids and repeated rows are kept and treated alike; an
    empty table stays empty.  A place that several entities claim is removed if
    one of them asks for it.
    """
    names = docs.columns
    doc, key, found = (fresh(names, n) for n in ("doc", "key", "found"))
    spans = cut(_term_spans(docs, disclosing_terms(docs)))
    maybe, rest = split_by(docs, spans.select(F.xxhash64("doc_id", "key").alias("h")), [F.col("doc_id").cast("long"), text_key()])
    maybe = _joined(maybe.withColumn(key, text_key()).withColumn(doc, F.col("doc_id").cast("long")), spans, doc, key, found)
    none = F.lit(None).cast(dict(spans.dtypes)["found"]).alias(found)
    marked = maybe.select(*names, found).unionByName(rest.select(*names, none))

    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def clean(text, found):
        if text is None:
            return None
        marks = [(a, b, _LABEL[KINDS[k]]) for a, k, b in base_spans(text)]
        marks += [(x["start"], x["end"], "" if x["disclosure"] >= remove else _LABEL[KINDS[x["kind"]]]) for x in found or ()]
        out, done = [], 0
        for a, b, label in sorted(marks):
            if b <= done:
                continue
            if a >= done:
                out += [text[done:a], label]
            done = b
        return "".join([*out, text[done:]])

    def run(batches):
        for batch in batches:
            texts = [clean(t, f) for t, f in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            cols = [batch.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, cols[at].type)
            if size is not None:
                cols[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)
        release()

    return marked.select(*names, found).mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    return detect(docs)
