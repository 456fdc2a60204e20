"""The queries of this subpackage by name, and the SQL they are checked against."""

from __future__ import annotations

from ..plans.unit_queries import ENTRY
from ..sources.tables import table
from . import canonical, encode, leak, lookalike, repair, split, vectors


def _nearest(spark, d):
    chunks = table(spark, d, "chunks")
    return vectors.nearest(chunks, "chunk_id", "embedding", chunks.filter("chunk_id % 50 = 0"))


QUERIES = {
    "p1_found": lambda spark, d: canonical.found(table(spark, d, "curves"), table(spark, d, "mnemonic_ref")),
    "p1_misses": lambda spark, d: canonical.misses(table(spark, d, "curves"), table(spark, d, "mnemonic_ref")),
    "p3_found": lambda spark, d: repair.found(table(spark, d, "text_blocks"), table(spark, d, "images")),
    "p3_texts": lambda spark, d: repair.repair_texts(repair.scans(table(spark, d, "text_blocks"), table(spark, d, "images"))),
    "p4_found": lambda spark, d: split.found(table(spark, d, "chunks")),
    "p4_pieces": lambda spark, d: split.split_texts(table(spark, d, "chunks"), "chunk_id", "content"),
    "p6_found": lambda spark, d: vectors.found(table(spark, d, "chunks")),
    "p6_nearest": _nearest,
    "p8_ids": lambda spark, d: encode.encode_texts(table(spark, d, "documents"), "doc_id", "text"),
    "p9_found": lambda spark, d: leak.found(table(spark, d, "documents"), table(spark, d, "eval_items")),
    "p9_overlaps": lambda spark, d: leak.find_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items")),
    "p10_found": lambda spark, d: lookalike.found(table(spark, d, "documents")),
    "p10_forms": lambda spark, d: lookalike.one_form(table(spark, d, "documents"), "doc_id", "text"),
}

_TYPED = f"""WITH {ENTRY}, e AS (SELECT curve_id, mnemonic, name, coalesce(cm.id, tm.id, cn.id, tn.id, 0) AS ref_id FROM curves c
  LEFT JOIN code cm ON cm.typed = c.mnemonic LEFT JOIN title tm ON tm.typed = c.mnemonic LEFT JOIN code cn ON cn.typed = c.name LEFT JOIN title tn ON tn.typed = c.name)"""

ORACLE_SQL = {
    "p1_found": f"{_TYPED} SELECT DISTINCT curve_id, ref_id FROM e WHERE mnemonic IS NULL OR mnemonic NOT IN (SELECT code FROM mnemonic_ref)",
    "p1_misses": f"{_TYPED} SELECT mnemonic, name, count(*) AS n FROM e WHERE ref_id = 0 GROUP BY mnemonic, name",
    "p6_found": """
WITH v AS (SELECT chunk_id, CAST(embedding AS DOUBLE[384]) AS e FROM chunks
  WHERE embedding IS NOT NULL AND len(embedding) = 384 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id
WHERE array_cosine_similarity(a.e, b.e) >= 0.92
""",
    "p4_found": r"""
SELECT chunk_id, CASE WHEN regexp_matches(content, '[^\s\x0b\x1c-\x1f\x85\p{Z}]{501}') THEN 1 ELSE 0 END AS forced
FROM chunks WHERE length(content) > 500
""",
}
