"""Searches over the chunk collections and the SQL they are checked against.  The query vector is a stored one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..functions.vocab import ANSWER_COMMON_WORDS
from ..operators import search as s
from ..sources.tables import table
from .well_queries import rounded

# The queries asked.
TERM, LONG, TERMS, PAGES = "sequence boundary", "gamma ray", ["gamma ray", "density", "shale"], [10, 20, 30, 40, 50]
TYPES = ["text", "combined", "geological_keyword", "image_description"]


def stored_vectors(chunks, n: int) -> list[list[float]]:
    """The vectors of the first ``n`` chunks that have a usable one, in place of a model's."""
    usable = chunks.filter("size(embedding) > 0 and exists(embedding, x -> x <> 0)")
    return [list(r.embedding) for r in usable.orderBy("chunk_id").select("embedding").limit(n).collect()]


def _with_vector(f):
    def run(spark, d):
        chunks = table(spark, d, "chunks")
        return rounded(f(chunks, stored_vectors(chunks, 1)[0]))

    return run


def _repeats(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").withColumnRenamed("text", "content")
    return s.without_repeats(docs.select("doc_id", "content"), ["doc_id"]).select("doc_id")


def _diversify(chunks, v):
    return s.diversified(s.nearest(chunks, v, 40), 12).select("chunk_id", "content_type", "score", "place")


def _images(spark, d):
    chunks = table(spark, d, "chunks")
    return rounded(s.images_for(chunks, table(spark, d, "images"), TERM, stored_vectors(chunks, 1)[0], 20))


def _sweep(spark, d):
    chunks = table(spark, d, "chunks")
    return rounded(s.threshold_sweep(chunks, stored_vectors(chunks, 4), [0.1, 0.2, 0.3, 0.4, 0.7]))


def _confidence(spark, d):
    """Per well the mean of what there is of mean interpretation confidence and mean quality score; else 0.5."""
    i = table(spark, d, "interpretations").groupBy("well_id").agg(F.avg(F.nanvl("confidence_score", F.lit(None))).alias("a"))
    q = table(spark, d, "curves").filter("quality_score between 0 and 1").groupBy("well_id").agg(F.avg("quality_score").alias("b"))
    x = table(spark, d, "wells").select("well_id").join(i, "well_id", "left").join(q, "well_id", "left")
    n = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    total = F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return rounded(x.select("well_id", F.when(n > 0, total / n).otherwise(0.5).alias("confidence")))


QUERIES = {
    "knn_topk": _with_vector(lambda c, v: s.nearest(c, v, 20, by=["collection"]).select("collection", "rank", "chunk_id", "score")),
    "knn_filtered": _with_vector(lambda c, v: s.knowledge(c, v, 25, "environment", least=-0.9).select("rank", "chunk_id", "score")),
    "search_exact": _with_vector(lambda c, v: s.exact(c, TERM).select("chunk_id", "collection", "score")),
    "search_hybrid": _with_vector(lambda c, v: s.search_all(c, TERM, v, 50, -1.0)),
    "search_by_type": _with_vector(lambda c, v: s.search_by_type(c, LONG, v, TYPES, 10)),
    "search_page": _with_vector(lambda c, v: s.search_by_page(c, PAGES)),
    "search_page_text": _with_vector(lambda c, v: s.search_by_page(c, PAGES, LONG, v)),
    "search_concepts": _with_vector(lambda c, v: s.search_by_concepts(c, TERMS, v, 15)),
    "related_terms": _with_vector(lambda c, v: s.related_terms(c, LONG, 10)),
    "dedup_prefix": _repeats,
    "diversify": _with_vector(_diversify),
    "image_discovery": _images,
    "ambiguity_groups": lambda spark, d: s.ambiguous_images(table(spark, d, "images")),
    "collection_stats": lambda spark, d: s.collection_counts(table(spark, d, "chunks")),
    "threshold_sweep": _sweep,
    "vocabulary_learning": lambda spark, d: s.learned_terms(table(spark, d, "chunks")),
    "gathered_context": _with_vector(lambda c, v: s.gathered_context(c, {"funnel": v})),
    "confidence_mean": _confidence,
}

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0"
_V = f"""v AS (SELECT embedding AS q FROM chunks WHERE {_USABLE} ORDER BY chunk_id LIMIT 1),
sim AS (SELECT c.*, CASE WHEN {_USABLE} THEN 1 - list_sum(list_transform(list_zip(c.embedding, v.q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) / 2 END AS sc FROM chunks c, v)"""


def _match(query: str) -> str:
    """SQL of the match score over the rows of ``sim``."""
    words = query.split()
    shared = "(" + " + ".join(f"CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END" for w in words) + f")::DOUBLE / {len(words)} * 0.2::DOUBLE" if len(words) > 1 else "0"
    gate = " OR ".join(f"contains(lower(content), '{x}')" for x in [query, *s.variations(query)])
    score = f"least(1, greatest(0, coalesce(sc, 0)) + CASE WHEN contains(content, '{query}') THEN 0.5 WHEN contains(lower(content), '{query}') THEN 0.4 ELSE 0 END::DOUBLE + {shared})"
    return f"CASE WHEN {gate} THEN {score} END" if len(words) <= 2 else score


_EXACT = "CASE " + " ".join(f"WHEN contains(content, '{x}') THEN 0.95::DOUBLE WHEN contains(lower(content), '{x}') THEN 0.85::DOUBLE" for x in [TERM, *s.variations(TERM)]) + " END"


def _all(query: str, k: int, least: float, exact: str) -> str:
    """CTE ``res`` of the hybrid search."""
    return f"""ex AS (SELECT *, {exact} AS score, 0 AS src FROM chunks WHERE collection <> 'spem_image_metadata'),
nn AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(sc, 9) DESC, chunk_id) AS rk FROM sim WHERE sc IS NOT NULL),
un AS (SELECT chunk_id, collection, chunk_type, page, content, score, src FROM ex WHERE score IS NOT NULL
  UNION ALL SELECT chunk_id, collection, chunk_type, page, content, sc, 1 FROM nn WHERE rk <= {k} AND contains(lower(content), '{query}') AND sc >= {least}),
dd AS (SELECT *, coalesce(chunk_type, 'unknown') AS kind FROM un QUALIFY row_number() OVER (PARTITION BY trim(content[:100], ' ') ORDER BY src, chunk_id) = 1),
rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dd),
pl AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank) AS kr FROM rk),
res AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN kr = 1 THEN 0 ELSE 1 END, rank) AS place FROM pl)"""


ORACLE_SQL = {
    "knn_topk": f"WITH {_V} SELECT collection, rank, chunk_id, round(sc, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(sc, 9) DESC, chunk_id) AS rank FROM sim WHERE sc IS NOT NULL) WHERE rank <= 20",
    "knn_filtered": f"WITH {_V} SELECT rank, chunk_id, round(2 * sc - 1, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(sc, 9) DESC, chunk_id) AS rank FROM sim WHERE sc IS NOT NULL AND collection = 'spem_geological_knowledge' AND chunk_type = 'environment') WHERE rank <= 25 AND 2 * sc - 1 >= -0.9",
    "search_exact": f"SELECT * FROM (SELECT chunk_id, collection, {_EXACT} AS score FROM chunks WHERE collection <> 'spem_image_metadata') WHERE score IS NOT NULL",
    "search_hybrid": f"WITH {_V},{_all(TERM, 50, -1, _EXACT)} SELECT chunk_id, collection, kind, page, round(score, 6) AS score, place FROM res WHERE place <= 50",
    "search_by_type": f"""WITH {_V}, m AS (SELECT *, {_match(LONG)} AS score FROM sim WHERE content_type IN ({', '.join(repr(t) for t in TYPES)})),
o AS (SELECT * FROM m WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY trim(content[:100], ' ') ORDER BY round(score, 9) DESC, chunk_id) = 1)
SELECT content_type, row_number() OVER (PARTITION BY content_type ORDER BY round(score, 9) DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score FROM o QUALIFY rank <= 10""",
    "search_page": f"SELECT chunk_id, page, 1.0::DOUBLE AS score FROM chunks WHERE page IN ({', '.join(map(str, PAGES))})",
    "search_page_text": f"WITH {_V} SELECT * FROM (SELECT chunk_id, page, round({_match(LONG)}, 6) AS score FROM sim WHERE page IN ({', '.join(map(str, PAGES))}) AND contains(lower(content), '{LONG}')) WHERE score IS NOT NULL",
    "search_concepts": f"""WITH {_V},{_all(" ".join(TERMS), 30, 0.2, "CAST(NULL AS DOUBLE)")},
e AS (SELECT chunk_id, score AS s FROM res WHERE place <= 30 UNION ALL (SELECT chunk_id, sc FROM sim WHERE sc IS NOT NULL ORDER BY round(sc, 9) DESC, chunk_id LIMIT 30)),
g AS (SELECT chunk_id, max(s) AS s FROM e GROUP BY chunk_id),
h AS (SELECT chunk_id, s, len(list_intersect(list_distinct(coalesce(geological_terms, [])), {TERMS!r}))::DOUBLE / {len(TERMS)} AS share FROM g JOIN chunks USING (chunk_id))
SELECT chunk_id, round(0.6::DOUBLE * s + 0.4::DOUBLE * share, 6) AS score, row_number() OVER (ORDER BY round(0.6::DOUBLE * s + 0.4::DOUBLE * share, 9) DESC, chunk_id) AS rank FROM h WHERE share > 0 OR s > 0.5 QUALIFY rank <= 15""",
    "related_terms": r"""WITH x AS (SELECT content, lower(content) AS low FROM chunks WHERE contains(lower(content), 'gamma') OR contains(lower(content), 'ray')),
p AS (SELECT unnest(list_distinct(list_concat(regexp_extract_all(content, '\(([A-Z]{1,4})\)', 1), regexp_extract_all(content, '([A-Za-z0-9]+_\w*[A-Za-z0-9])', 1),
  CASE WHEN contains(low, 'gamma') THEN regexp_extract_all(substring(low, greatest(1, instr(low, 'gamma') - 20), 45), '([a-z_]{2,10})', 1) ELSE [] END,
  CASE WHEN contains(low, 'ray') THEN regexp_extract_all(substring(low, greatest(1, instr(low, 'ray') - 20), 43), '([a-z_]{2,10})', 1) ELSE [] END))) AS term FROM x)
SELECT term, count(*) AS n FROM p WHERE length(term) > 1 AND lower(term) NOT IN ('and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'the', 'to', 'with', 'gamma', 'ray') GROUP BY term ORDER BY n DESC, term LIMIT 10""",
    "dedup_prefix": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY trim(text[:100], ' ') ORDER BY doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1",
    "diversify": f"""WITH {_V}, r AS (SELECT *, row_number() OVER (ORDER BY round(sc, 9) DESC, chunk_id) AS rank FROM sim WHERE sc IS NOT NULL QUALIFY rank <= 40),
b AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY rank) AS kr FROM r)
SELECT chunk_id, content_type, round(sc, 6) AS score, row_number() OVER (ORDER BY CASE WHEN kr = 1 THEN 0 ELSE 1 END, rank) AS place FROM b QUALIFY place <= 12""",
    "image_discovery": f"""WITH {_V}, p AS (SELECT page AS page_number, max({_match(TERM)}) AS s FROM sim WHERE page IS NOT NULL GROUP BY page),
x AS (SELECT id, page_number, image_type, s * 0.8::DOUBLE AS score FROM images JOIN p USING (page_number) WHERE s * 0.8::DOUBLE > -0.6), t AS (SELECT *, CASE WHEN score > 0.3 THEN 1 ELSE 2 END AS tier FROM x)
SELECT id, page_number, image_type, round(score, 6) AS score, tier, row_number() OVER (ORDER BY tier, round(score, 9) DESC, id) AS rank FROM t QUALIFY rank <= 20""",
    "ambiguity_groups": "SELECT source_file, page_number, count(*) OVER (PARTITION BY source_file, page_number) AS n, row_number() OVER (PARTITION BY source_file, page_number ORDER BY id) AS choice, id FROM images QUALIFY n > 1 AND choice <= 3",
    "collection_stats": "SELECT coalesce(collection, 'all') AS collection, count(*) AS chunks, count(*) FILTER (len(embedding) > 0) AS vectors FROM chunks GROUP BY ROLLUP (collection)",
    "threshold_sweep": f"""WITH q AS (SELECT chunk_id AS qid, embedding AS q FROM chunks WHERE {_USABLE} ORDER BY chunk_id LIMIT 4),
d AS (SELECT qid, c.chunk_id, 1 - list_sum(list_transform(list_zip(c.embedding, q.q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) / 2 AS sc FROM chunks c, q WHERE {_USABLE}),
n AS (SELECT sc FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, chunk_id) <= 50)
SELECT t AS threshold, count(*) AS hits, round(avg(sc), 6) AS mean_score FROM n, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.7])::DOUBLE AS t) WHERE sc >= t GROUP BY t""",
    "vocabulary_learning": f"""WITH w AS (SELECT list_filter(list_transform(coalesce(geological_terms, []), lambda t: lower(t)), lambda t: length(t) > 2) AS a,
  list_filter(regexp_split_to_array(lower(coalesce(content, '')), '{WS}+'), lambda w: length(w) > 3 AND regexp_matches(w, '^[a-z]+$') AND NOT list_contains({ANSWER_COMMON_WORDS!r}, w)) AS b FROM chunks)
SELECT term, count(*) AS chunks FROM (SELECT unnest(list_distinct(list_concat(a, b))) AS term FROM w) GROUP BY term""",
    "gathered_context": f"""WITH {_V}, k AS (SELECT * FROM sim WHERE sc IS NOT NULL AND collection = 'spem_geological_knowledge')
""" + " UNION ALL ".join(f"(SELECT '{c}:funnel' AS category, row_number() OVER (ORDER BY round(sc, 9) DESC, chunk_id) AS rank, chunk_id, round(2 * sc - 1, 6) AS score FROM k WHERE {w} QUALIFY rank <= {n} AND 2 * sc - 1 >= -2)" for c, n, w in (("pattern", 2, "chunk_type = 'pattern'"), ("sequence", 3, "true"), ("environment", 3, "chunk_type = 'environment'"), ("surface", 2, "chunk_type = 'surface'"))),
    "confidence_mean": """WITH i AS (SELECT well_id, avg(confidence_score) FILTER (NOT isnan(confidence_score)) AS a FROM interpretations GROUP BY well_id), q AS (SELECT well_id, avg(quality_score) AS b FROM curves WHERE quality_score BETWEEN 0 AND 1 GROUP BY well_id)
SELECT well_id, round(CASE WHEN a IS NULL AND b IS NULL THEN 0.5 WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS confidence FROM wells LEFT JOIN i USING (well_id) LEFT JOIN q USING (well_id)""",
}
