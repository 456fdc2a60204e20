"""Queries on answers, labels and what belongs together, over whole tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import text as tx
from ..functions import vocab
from ..functions.text import WS
from ..operators import documents
from ..sources import stores
from ..sources.tables import table
from .well_queries import rounded

#: Which concepts the fixed list of an image's content stands for.
KNOWN = [*an.LOG_CONCEPTS, *an.ENVIRONMENT_CONCEPTS]


def _select(name, columns):
    return lambda spark, d: rounded(table(spark, d, name).select(*columns()))


def _parts(c):
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")


def _explained(kind):
    """The answer to one question about every image."""
    question = {"pattern": "Which signature is that?", "environment": "Which depositional setting?", "sequence": "Which systems tract?", "logs": "Which curve?", "content": "What is it?"}[kind]
    return lambda: ["id", an.explained(F.lit(question), F.col("caption"), F.lit(None).cast("string"), _parts(F.col("geological_content")), F.lit(None).cast("string"), F.col("image_type")).alias("answer")]


def _nearby(spark, d):
    return stores.nearby_text(table(spark, d, "images"), table(spark, d, "text_blocks"))


def _pending(spark, d):
    return stores.pending(table(spark, d, "images").select("source_file", "id"), table(spark, d, "text_blocks").filter("block_type = 'header'"), "source_file").select("id")


def _batch(spark, d):
    i = table(spark, d, "images").select(F.when(F.col("caption").isNull(), "no caption").alias("error"), tx.scale_factor(F.col("width"), F.col("height")).alias("scale"))
    return rounded(stores.batch_stats(i))


def _options(spark, d):
    x = table(spark, d, "images").select("page_number", "id", F.col("caption").alias("content"))
    return an.options(x, "page_number", "id", 40)


def _enhanced(spark, d):
    i = table(spark, d, "images")
    names = stores.with_enhanced(i.select("id", "file_path"), i.filter("width < 700").select(F.concat(F.lit("enhanced/"), F.element_at(F.split("file_path", "/"), -1)).alias("path")))
    return names.select("id", "file_path")


def _compared(spark, d):
    i = table(spark, d, "images").select("image_type", F.col("id").alias("name"), "width", "height")
    return rounded(documents.compared_extractions(i.filter("image_type = 'well_log'"), i.filter("image_type <> 'well_log'")))


QUERIES = {
    "result_lines": _select("chunks", lambda: ["chunk_id", tx.result_line(F.coalesce("content", F.lit("")), F.col("page"), F.lit(0.5), F.coalesce("geological_terms", F.array().cast("array<string>"))).alias("line")]),
    "content_descriptions": _select("images", lambda: ["id", an.content_description(F.col("image_type")).alias("says")]),
    "relevance_labels": _select("interpretations", lambda: ["interp_id", an.relevance_label(F.col("confidence_score")).alias("label")]),
    "question_kinds": _select("eval_items", lambda: ["item_id", an.asked_about(F.col("question")).alias("about")]),
    "diagram_kinds": _select("images", lambda: ["id", *[an.diagram_kinds(F.col("context_text"), F.col("width"), F.col("height"))[c].alias(c) for c in ("well_log", "sequence", "depositional")]]),
    "explain_pattern": _select("images", _explained("pattern")),
    "explain_environment": _select("images", _explained("environment")),
    "explain_logs": _select("images", _explained("logs")),
    "explain_content": _select("images", _explained("content")),
    "answer_confidence": _select("eval_items", lambda: ["item_id", tx.answer_confidence(F.col("answer").isNull(), tx.concepts(F.coalesce("answer", F.lit(""))), F.lit("unknown"), F.coalesce("answer", F.lit("")), F.col("question"), F.col("passage")).alias("confidence")]),
    "caption_fallback": _select("images", lambda: ["id", tx.caption_of(F.col("context_text"), F.col("caption")).alias("caption")]),
    "image_nearby_text": _nearby,
    "images_pending": _pending,
    "images_enhanced": _enhanced,
    "batch_stats": _batch,
    "image_options": _options,
    "lanczos_size": _select("images", lambda: ["id", tx.lanczos_size(F.col("width"), F.col("height"))["width"].alias("width"), tx.lanczos_size(F.col("width"), F.col("height"))["height"].alias("height")]),
    "extraction_compare": _compared,
    "images_per_page": lambda spark, d: documents.images_per_page(table(spark, d, "images")),
    "term_words": lambda spark, d: tx.term_words(table(spark, d, "documents"), "doc_id", "text", vocab.KNOWLEDGE_TERMS),
}


def _has(c: str, words: list[str], n: int) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{w}') THEN 1 ELSE 0 END" for w in words) + f") >= {n}"


_PARTS = "list_filter(list_transform(string_split(coalesce(geological_content, ''), ';'), lambda t: trim(t, ' ')), lambda t: t <> '')"


def _named(words: list[str]) -> str:
    return f"list_filter({_PARTS}, lambda t: list_contains({words!r}, t))"


_FIRST = "array_to_string(list_slice(g, 1, 3), ', ')"
_CAPTION = ", ".join(f"trim(nullif(regexp_extract(context_text, '(?i){p}', 0), ''), ' ')" for p in vocab.CAPTION_PATTERNS)


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


ORACLE_SQL = {
    "result_lines": f"""SELECT chunk_id, 'Page ' || coalesce(page, 0) || ' | 0.500 | ' || CASE WHEN length(c) > 200 THEN c[:200] || '...' ELSE c END
  || CASE WHEN len(g) = 0 THEN '' WHEN len(g) > 3 THEN ' | ' || {_FIRST} || ' (+' || (len(g) - 3) || ' more)' ELSE ' | ' || {_FIRST} END AS line
FROM (SELECT chunk_id, page, regexp_replace(coalesce(content, ''), '{WS}+', ' ', 'g') AS c, coalesce(geological_terms, []) AS g FROM chunks)""",
    "content_descriptions": "SELECT id, CASE image_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.CONTENT_DESCRIPTIONS.items()) + f" ELSE '{vocab.CONTENT_DESCRIPTIONS['other']}' END AS says FROM images",
    "relevance_labels": "SELECT interp_id, CASE WHEN confidence_score >= 0.7 THEN 'High' WHEN confidence_score >= 0.4 THEN 'Moderate' ELSE 'Low' END AS label FROM interpretations",
    "question_kinds": "SELECT item_id, CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{p}') THEN '{k}'" for p, k in an.ASKED) + " ELSE 'general' END AS about FROM eval_items",
    "diagram_kinds": f"SELECT id, {_has('context_text', an.LOG_WORDS, 2)} OR coalesce(height::DOUBLE / nullif(width, 0) > 1.5, false) AS well_log, {_has('context_text', an.SEQUENCE_WORDS, 2)} AS sequence, {_has('context_text', an.ENVIRONMENT_WORDS, 1)} AS depositional FROM images",
    "explain_pattern": "SELECT id, CASE WHEN image_type = 'well_log' THEN 'Well log patterns. They tell of the deposition.' ELSE 'Geological pattern type: ' || coalesce(image_type, 'unknown') || '. It needs a closer analysis.' END AS answer FROM images",
    "explain_environment": f"SELECT id, CASE WHEN len({_named(an.ENVIRONMENT_CONCEPTS)}) > 0 THEN 'It relates to a depositional environment: ' || array_to_string({_named(an.ENVIRONMENT_CONCEPTS)}, ', ') || '.' ELSE 'Depositional features stand in the patterns.' END AS answer FROM images",
    "explain_logs": f"SELECT id, CASE WHEN len({_named(an.LOG_CONCEPTS)}) > 0 THEN 'Well log types: ' || array_to_string({_named(an.LOG_CONCEPTS)}, ', ') || '.' ELSE 'Well log patterns of certain rock properties.' END AS answer FROM images",
    "explain_content": f"""SELECT id, coalesce(nullif(concat_ws(' | ', CASE WHEN length(caption) > 0 THEN 'Image description: ' || caption END, CASE WHEN len({_PARTS}) > 0 THEN 'Key geological concepts: ' || array_to_string(list_slice({_PARTS}, 1, 5), ', ') END), ''),
  'No explanation without a closer analysis.') AS answer FROM images""",
    "answer_confidence": f"""WITH a AS (SELECT *, list_distinct(list_transform(list_filter(regexp_split_to_array(coalesce(answer, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^([A-Z][a-z]+|[a-z]{{4,}})$')), lambda w: lower(w))) AS c FROM eval_items)
SELECT item_id, round((CASE WHEN answer IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(list_filter(c, lambda w: NOT list_contains({vocab.ANSWER_COMMON_WORDS!r}, w))) > 0 THEN 1 ELSE 0 END
  + CASE WHEN length(coalesce(answer, '')) > 20 THEN 1 ELSE 0 END + CASE WHEN len(list_intersect(list_distinct({_words("lower(question)")}), list_distinct({_words("lower(passage)")}))) >= 2 THEN 1 ELSE 0 END) / 5.0::DOUBLE, 6) AS confidence FROM a""",
    "caption_fallback": f"SELECT id, coalesce({_CAPTION}, CASE WHEN length(trim(caption, ' ')) < 200 THEN trim(caption, ' ') END, '') AS caption FROM images",
    "image_nearby_text": """SELECT i.id, string_agg(b.text, ' ' ORDER BY b.id) AS context FROM images i JOIN text_blocks b USING (source_file, page_number)
WHERE b.text IS NOT NULL AND b.bbox.x0 <= i.bbox.x1 + 50 AND b.bbox.x1 >= i.bbox.x0 - 50 AND b.bbox.y0 <= i.bbox.y1 + 200 AND b.bbox.y1 >= i.bbox.y0 - 100 GROUP BY i.id""",
    "images_pending": "SELECT id FROM images WHERE source_file NOT IN (SELECT source_file FROM text_blocks WHERE block_type = 'header' AND source_file IS NOT NULL)",
    "images_enhanced": "SELECT id, CASE WHEN width < 700 THEN 'enhanced/' || string_split(file_path, '/')[-1] ELSE file_path END AS file_path FROM images",
    "batch_stats": """SELECT count(*) FILTER (caption IS NOT NULL) AS processed, count(*) FILTER (caption IS NULL) AS errors, round(avg(s) FILTER (caption IS NOT NULL), 6) AS mean_scale FROM (SELECT caption,
  CASE WHEN m IS NULL THEN greatest(f, 1) ELSE greatest(least(f, m), 1) END AS s FROM (SELECT caption, least(1600.0::DOUBLE / width, 1200.0::DOUBLE / height) AS f,
  CASE WHEN least(width, height) < 200 THEN 10.0::DOUBLE WHEN least(width, height) < 400 THEN 6 WHEN least(width, height) < 600 THEN 4 WHEN least(width, height) < 800 THEN 2 END AS m FROM images))""",
    "image_options": "SELECT number, page_number, number || '. ' || CASE WHEN length(trim(caption, ' ')) > 0 THEN caption[:100] ELSE 'no description' END AS label FROM (SELECT *, row_number() OVER (ORDER BY page_number, id) AS number FROM images) WHERE number <= 40",
    "lanczos_size": """SELECT id, CAST(CASE WHEN f > 1 THEN floor(width * f) ELSE width END AS INTEGER) AS width, CAST(CASE WHEN f > 1 THEN floor(height * f) ELSE height END AS INTEGER) AS height
FROM (SELECT *, least(1600.0::DOUBLE / width, 1200.0::DOUBLE / height, 8) AS f FROM images)""",
    "extraction_compare": """WITH a AS (SELECT row_number() OVER (ORDER BY id) AS pair, width::BIGINT * height AS px FROM images WHERE image_type = 'well_log'), b AS (SELECT row_number() OVER (ORDER BY id) AS pair, width::BIGINT * height AS px FROM images WHERE image_type <> 'well_log')
SELECT pair, one, other, round(other::DOUBLE / one, 6) AS ratio FROM (SELECT 0 AS pair, (SELECT count(*) FROM a) AS one, (SELECT count(*) FROM b) AS other UNION ALL SELECT pair, a.px, b.px FROM a JOIN b USING (pair) WHERE pair <= 3)""",
    "images_per_page": "SELECT page_number, count(*) AS count FROM images GROUP BY page_number",
    "term_words": "SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0))) AS term FROM documents) WHERE list_contains("
    + repr([t.lower() for t in vocab.KNOWLEDGE_TERMS if " " not in t and "-" not in t]) + ", term)",
}
