"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``docs``, those of
``documents`` and any others, whatever their names.  Every stage takes an empty
table, null ids and repeated rows; what it does with them is said below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, langid, neardup, packing, pii
from tessella.llm.common import documents, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: null and empty texts, texts without letters; ids play no part."""
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the lowest id of each near-duplicate class, with its repeated rows.

    Of rows without id one stays for each class that has no row with one.
    """
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; rows of one id, null being one, go together."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and terms that disclose it; every row stays, null and empty texts as they are."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; a null or empty text is its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", sanitise),
    ("pack", pack),
]

#: The stages hash, sketch and tokenise; SQL cannot express them.  Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, f = stage
        out = f(spark, docs, sf_dir)
        return out if name == STAGES[-1][0] else written(out, name)

    return reduce(step, STAGES, documents(spark, sf_dir))
