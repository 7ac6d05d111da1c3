"""The queries of this package that the driver runs, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import audio, decontaminate, langid, linededup, neardup, packing, pii, sharding, tokencount, toxicity
from tessella.llm.common import documents


def _on_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": _on_documents(pii.op1),
    "op2_decontaminate": lambda spark, sf_dir: decontaminate.op2(spark, documents(spark, sf_dir), sf_dir),
    "op3_pack": _on_documents(packing.op3),
    "op4_toxicity": lambda spark, sf_dir: toxicity.op4(spark, documents(spark, sf_dir), sf_dir),
    "op5_language": _on_documents(langid.op5),
    "op6_token_count": _on_documents(tokencount.op6),
    "op7_shard": _on_documents(sharding.op7),
    "op8_near_duplicates": _on_documents(neardup.op8),
    "op9_repeated_units": _on_documents(linededup.op9),
    "op10_audio": _on_documents(audio.op10),
}

#: Exact containment of five-word shingles (of whole items that are shorter); the search may find no other pairs and miss none.
ORACLES: dict[str, str] = {
    "op2_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT *, least(len(w), 5) AS k FROM (
    SELECT row_number() OVER () AS r, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0
), ds AS (
  SELECT DISTINCT r, doc_id, k, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT d.*, x.k, unnest(range(1, greatest(len(w) - x.k + 2, 1))) AS i FROM d, (SELECT DISTINCT k FROM b) x)
), bs AS (
  SELECT DISTINCT r, item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), n AS (SELECT r, count(*) AS n_item FROM bs GROUP BY r),
h AS (
  SELECT ds.r AS dr, bs.r AS br, doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.k = bs.k AND ds.s = bs.s GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, max({'c': n_shared / n_item::DOUBLE, 'i': n_item, 's': n_shared}) AS x FROM h JOIN n ON n.r = br GROUP BY ALL
)
SELECT doc_id, item_id, x.s::BIGINT AS n_shared, x.i::BIGINT AS n_item, x.c AS containment FROM best WHERE x.c >= 0.8
""",
}
