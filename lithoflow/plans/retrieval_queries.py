"""Searches put together, over the chunk and image tables, and the SQL they are checked against.  The query vector is a stored one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WS
from ..functions.vocab import INDICATOR_WORDS
from ..operators import retrieval as r
from ..operators import search as s
from ..sources.tables import table
from .search_queries import _USABLE, _V, LONG, TERM, TYPES, _with_vector, stored_vectors
from .well_queries import rounded

PER_TYPE, TOP = 10, 5
#: Thresholds tried, and pages whose images are described.
THRESHOLDS = [-0.2, -0.3, -0.4, -0.5, -0.6, -0.7, -0.8]


def image_links(chunks, images):
    """In the tables no chunk names its image, so a chunk is taken to be about the first image of its page."""
    first = images.filter("page_number is not null").groupBy("page_number").agg(F.min("id").alias("image_id"))
    return chunks.filter(s.of_images()).join(first, F.col("page") == F.col("page_number")).select("chunk_id", "image_id")


def _with_images(f, query):
    def run(spark, d):
        chunks, images = table(spark, d, "chunks"), table(spark, d, "images")
        return rounded(f(chunks, images, image_links(chunks, images), query, stored_vectors(chunks, 1)[0]))

    return run


def _matches(spark, d):
    chunks = table(spark, d, "chunks").filter(s.of_images())
    return rounded(chunks.select("chunk_id", s.image_match(TERM).alias("boundary"), s.image_match(LONG).alias("ray")))


def _contexts(spark, d):
    return r.page_contexts(table(spark, d, "chunks"), table(spark, d, "images"))


def _related(spark, d):
    chunks = table(spark, d, "chunks")
    vector = stored_vectors(chunks, 1)[0]
    target = chunks.filter(F.expr(f"get(geological_terms, 0) = '{LONG}'")).agg(F.min("chunk_id")).first()[0]
    return rounded(r.related_context(chunks, {"chunk_id": target, "geological_terms": [LONG]}, "", lambda text: vector))


def _confidence(spark, d):
    chunks = table(spark, d, "chunks")
    p = table(spark, d, "interpretations").groupBy("well_id").agg(F.avg(F.nanvl("confidence_score", F.lit(None))).alias("p"))
    q = table(spark, d, "curves").filter("quality_score between 0 and 1").groupBy("well_id").agg(F.avg("quality_score").alias("q"))
    near = s.knowledge(chunks, stored_vectors(chunks, 1)[0], 5, least=-2.0).agg(F.avg("score").alias("k")).withColumn("one", F.lit(1))
    x = table(spark, d, "wells").select("well_id", F.lit(1).alias("one")).join(p, "well_id", "left").join(q, "well_id", "left").join(F.broadcast(near), "one", "left")
    return rounded(x.select("well_id", r.interpretation_confidence([F.col(c) for c in "pkq"]).alias("confidence")))


def _thresholds(spark, d):
    chunks = table(spark, d, "chunks")
    return rounded(r.chosen_thresholds(s.threshold_sweep(chunks, stored_vectors(chunks, 4), THRESHOLDS)))


QUERIES = {
    "image_match": _matches,
    "exact_hits": _with_vector(lambda c, v: s.exact(c, TERM).select("chunk_id", "collection", "score")),
    "hybrid_hits": _with_vector(lambda c, v: s.search_all(c, TERM, v, 50, -1.0)),
    "typed_hits": _with_vector(lambda c, v: s.search_by_type(c, LONG, v, TYPES, PER_TYPE)),
    "search_dispatch": _with_vector(lambda c, v: r.by_kind(c, LONG, v, "text", PER_TYPE)),
    "search_images": _with_vector(lambda c, v: r.by_kind(c, LONG, v, "image", 2 * TOP)),
    "image_concept": _with_images(lambda c, i, links, q, v: r.images_by_concept(c, i, links, q, v, TOP), LONG),
    "image_concept_few": _with_images(lambda c, i, links, q, v: r.images_by_concept(c, i, links, q, v, 40), LONG),
    "image_choice": _with_images(lambda c, i, links, q, v: r.images_with_choice(c, i, links, q, v, 20), LONG),
    "image_context": _contexts,
    "related_context": _related,
    "interpretation_confidence": _confidence,
    "threshold_choice": _thresholds,
    "vocabulary_terms": lambda spark, d: r.learned_vocabulary(table(spark, d, "chunks")),
}


def _r5(query: str) -> str:
    """SQL of the image match: the term, its variations in order, then its words."""
    cases = [f"WHEN contains(low, '{query}') THEN 0.95::DOUBLE"]
    for v in s.variations(query):
        if len(v) > 2:
            cases.append(f"WHEN contains(low, '{v}') THEN 0.85::DOUBLE")
        else:
            at = f"instr(low, '{v}')"
            near = f"substring(low, greatest(1, {at} - 30), {at} + {len(v) + 30} - greatest(1, {at} - 30))"
            cases.append(f"WHEN contains(low, '{v}') AND ({' OR '.join(f'''contains({near}, '{w}')''' for w in INDICATOR_WORDS)}) THEN 0.70::DOUBLE")
    words = query.split()
    held = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words)
    places = "list_filter([" + ", ".join(f"instr(low, '{w}')" for w in words) + "], lambda p: p > 0)"
    cases.append(f"WHEN ({held})::DOUBLE / {len(words)} >= 0.7 THEN 0.6::DOUBLE * ({held}) / {len(words)}")
    cases.append(f"WHEN ({held})::DOUBLE / {len(words)} >= 0.5 AND ({held}) >= 2 AND list_max({places}) - list_min({places}) < 50 THEN 0.48::DOUBLE")
    return f"CASE {' '.join(cases)} END"


_GATE = " OR ".join(f"contains(low, '{x}')" for x in [LONG, *s.variations(LONG)])
_TYPED = f"""{_V}, lo AS (SELECT *, lower(content) AS low FROM sim WHERE sc IS NOT NULL),
fa AS (SELECT *, CASE WHEN collection = 'spem_image_metadata' THEN sc * (1 + 0.2::DOUBLE * {_r5(LONG)}) WHEN {_GATE} THEN sc END AS score FROM lo),
on1 AS (SELECT * FROM fa WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY content_type, trim(content[:100], ' ') ORDER BY round(sc, 9) DESC, chunk_id) = 1),
ty AS (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM on1),
txt AS (SELECT chunk_id, page, score, row_number() OVER (ORDER BY list_position(['text', 'combined', 'geological_keyword'], content_type), rank) AS rank FROM ty WHERE content_type IN ('text', 'combined', 'geological_keyword') AND rank <= 10 AND page > 0)"""


def _concept(k: int) -> str:
    """CTE ``res`` of the images by concept."""
    return f"""{_TYPED}, img AS (SELECT min(id) AS id, page_number FROM images WHERE page_number IS NOT NULL GROUP BY page_number),
di AS (SELECT i.id, t.score, m.source_file, m.page_number FROM ty t JOIN img i ON i.page_number = t.page JOIN images m ON m.id = i.id WHERE t.content_type = 'image_description' AND t.collection = 'spem_image_metadata' AND t.rank <= {2 * k}
  QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY t.rank) = 1),
pa AS (SELECT m.id, x.score * 0.8::DOUBLE AS score, m.source_file, m.page_number FROM txt x JOIN images m ON m.page_number = x.page WHERE x.score > 0.7 AND (SELECT count(*) FROM di) < {k} AND m.id NOT IN (SELECT id FROM di)
  QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY x.rank) = 1),
al AS (SELECT *, CASE WHEN score > 0.3 THEN 1 ELSE 2 END AS tier FROM (SELECT * FROM di UNION ALL SELECT * FROM pa) WHERE score > -0.6),
res AS (SELECT *, row_number() OVER (ORDER BY tier, round(score, 9) DESC, id) AS rank FROM al QUALIFY rank <= {k})"""




def _held(query: str) -> str:
    """SQL of the exact score: images by R5, other chunks by what stands in them."""
    cases = " ".join(f"WHEN contains(content, '{x}') THEN 0.95::DOUBLE WHEN contains(low, '{x}') THEN 0.85::DOUBLE" for x in [query, *s.variations(query)])
    return f"CASE WHEN collection = 'spem_image_metadata' THEN {_r5(query)} ELSE CASE {cases} END END"


def _hybrid(query: str, k: int, least: float) -> str:
    """CTE ``res`` of the hybrid search over all collections."""
    return f"""l AS (SELECT *, lower(content) AS low FROM sim),
ex AS (SELECT *, {_held(query)} AS score, 0 AS src FROM l),
nn AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(sc, 9) DESC, chunk_id) AS rk FROM l WHERE sc IS NOT NULL),
un AS (SELECT chunk_id, collection, chunk_type, page, content, score, src FROM ex WHERE score IS NOT NULL
  UNION ALL SELECT chunk_id, collection, chunk_type, page, content, sc, 1 FROM nn WHERE rk <= {k} AND contains(low, '{query}') AND sc >= {least}),
dd AS (SELECT *, coalesce(chunk_type, 'unknown') AS kind FROM un QUALIFY row_number() OVER (PARTITION BY trim(content[:100], ' ') ORDER BY src, chunk_id) = 1),
rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dd),
pl AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank) AS kr FROM rk),
res AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN kr = 1 THEN 0 ELSE 1 END, rank) AS place FROM pl QUALIFY place <= {k})"""


ORACLE_SQL = {
    "related_context": f"WITH {_V}, {_hybrid(LONG, 10, 0.3)} SELECT chunk_id, page, round(score, 6) AS score, place FROM res WHERE chunk_id <> (SELECT min(chunk_id) FROM chunks WHERE geological_terms[1] = '{LONG}')",
    "exact_hits": f"SELECT * FROM (SELECT chunk_id, collection, round({_held(TERM)}, 6) AS score FROM (SELECT *, lower(content) AS low FROM chunks)) WHERE score IS NOT NULL",
    "hybrid_hits": f"WITH {_V}, {_hybrid(TERM, 50, -1)} SELECT chunk_id, collection, kind, page, round(score, 6) AS score, place FROM res",
    "typed_hits": f"WITH {_TYPED} SELECT content_type, rank, chunk_id, round(score, 6) AS score FROM ty WHERE content_type IN ({', '.join(repr(t) for t in TYPES)}) AND rank <= {PER_TYPE}",
    "image_match": f"SELECT chunk_id, round({_r5(TERM)}, 6) AS boundary, round({_r5(LONG)}, 6) AS ray FROM (SELECT chunk_id, lower(content) AS low FROM chunks WHERE collection = 'spem_image_metadata')",
    "search_dispatch": f"WITH {_TYPED} SELECT chunk_id, 'text' AS content_type, page, round(score, 6) AS score, rank FROM txt",
    "search_images": f"WITH {_TYPED} SELECT chunk_id, content_type, page, round(score, 6) AS score, rank FROM ty WHERE content_type = 'image_description' AND rank <= {2 * TOP}",
    "image_concept": f"WITH {_concept(TOP)} SELECT id, source_file, page_number, round(score, 6) AS score, tier, rank FROM res",
    "image_concept_few": f"WITH {_concept(40)} SELECT id, source_file, page_number, round(score, 6) AS score, tier, rank FROM res",
    "image_choice": f"""WITH {_concept(40)}, g AS (SELECT *, count(*) OVER (PARTITION BY source_file, page_number) > 1 AS ambiguous, row_number() OVER (PARTITION BY source_file, page_number ORDER BY rank) AS choice FROM res),
h AS (SELECT *, row_number() OVER (PARTITION BY ambiguous ORDER BY rank) AS place, max(CASE WHEN ambiguous THEN 1 ELSE 0 END) OVER () AS paged FROM g)
SELECT id, source_file, page_number, ambiguous, CASE WHEN ambiguous THEN choice END AS choice FROM h WHERE CASE WHEN ambiguous THEN choice <= 3 WHEN paged = 1 THEN place <= 10 ELSE place <= 20 END""",
    "image_context": """WITH f AS (SELECT page, content, row_number() OVER (PARTITION BY page ORDER BY chunk_id) AS place FROM chunks WHERE page IS NOT NULL QUALIFY place <= 8),
p AS (SELECT page, string_agg('Page ' || page || ': ' || coalesce(content, ''), ' | ' ORDER BY place) AS context FROM f GROUP BY page) SELECT id, context FROM images JOIN p ON page = page_number""",
    "interpretation_confidence": f"""WITH {_V}, k AS (SELECT avg(2 * sc - 1) AS k FROM (SELECT sc FROM sim WHERE sc IS NOT NULL AND collection = 'spem_geological_knowledge' ORDER BY round(sc, 9) DESC, chunk_id LIMIT 5)),
p AS (SELECT well_id, avg(confidence_score) FILTER (NOT isnan(confidence_score)) AS p FROM interpretations GROUP BY well_id), q AS (SELECT well_id, avg(quality_score) AS q FROM curves WHERE quality_score BETWEEN 0 AND 1 GROUP BY well_id)
SELECT well_id, round(coalesce(list_avg(list_filter([p.p, k.k, q.q], lambda x: x IS NOT NULL)), 0.5), 6) AS confidence FROM wells LEFT JOIN p USING (well_id) LEFT JOIN q USING (well_id), k""",
    "threshold_choice": f"""WITH q AS (SELECT chunk_id AS qid, embedding AS q FROM chunks WHERE {_USABLE} ORDER BY chunk_id LIMIT 4),
d AS (SELECT qid, c.chunk_id, 1 - list_sum(list_transform(list_zip(c.embedding, q.q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) / 2 AS sc FROM chunks c, q WHERE {_USABLE}),
n AS (SELECT sc FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, chunk_id) <= 50),
t AS (SELECT t, avg(sc) AS m FROM n, (SELECT unnest({THRESHOLDS})::DOUBLE AS t) WHERE sc >= t GROUP BY t), b AS (SELECT t FROM t ORDER BY round(m, 9) DESC, t DESC LIMIT 1)
SELECT round(greatest(t + 0.2, -0.2), 6) AS strict, t AS moderate, round(least(t - 0.2, -0.8), 6) AS relaxed FROM b""",
    "vocabulary_terms": f"""WITH w AS (SELECT list_distinct(list_concat(list_filter(list_transform(coalesce(geological_terms, []), lambda t: trim(lower(t), ' ')), lambda t: length(t) > 2),
  list_filter(list_transform(regexp_split_to_array(lower(coalesce(content, '')), '{WS}+'), lambda t: trim(t, ';:,')), lambda t: length(t) > 3))) AS ws FROM chunks WHERE collection = 'spem_geological_terms')
SELECT term, count(*) AS chunks FROM (SELECT unnest(ws) AS term FROM w) WHERE regexp_full_match(term, '\\p{{L}}+') AND NOT list_contains({r.NO_TERMS!r}, term) GROUP BY term""",
}
