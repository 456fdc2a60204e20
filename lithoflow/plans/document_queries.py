"""Queries on documents, text blocks, images and chunks, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..operators import documents as dc
from ..sources.tables import table
from .well_queries import rounded

def _image_content():
    return F.concat_ws("; ", F.array_join(tx.terms_in(F.concat_ws(" ", "caption", "context_text"), dc.TERMS), "; "), F.array_join("geological_indicators", "; "))



def _select(name, columns):
    """A projection of a whole table; ``columns`` makes the list, as columns need a session."""
    return lambda spark, d: rounded(table(spark, d, name).select(*columns()))


def _joined(c):
    return F.array_join(c, ", ")


def _overlapping(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", F.posexplode(dc.overlapping_chunks(F.col("text"))).alias("chunk_no", "p"))
    return docs.select("doc_id", "chunk_no", F.col("p.start").alias("start"), F.col("p.stop").alias("stop"), F.md5(F.expr("substring(text, p.start + 1, p.stop - p.start)")).alias("digest"))


def _semantic(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.posexplode(dc.semantic_chunks(F.col("content"), dc.INDEX_TERMS)).alias("piece_no", "piece"))


def _terms_by_category(spark, d):
    x = table(spark, d, "documents").select(F.explode(tx.terms_in(F.col("text"), dc.TERMS)).alias("term"))
    counts = x.groupBy("term").agg(F.count("*").alias("docs"))
    return counts.join(F.broadcast(vocab.as_table(spark, "extraction", vocab.EXTRACTION_TERMS).select("category", "term").distinct()), "term").select("category", "term", "docs")


QUERIES = {
    "clean_text": _select("documents", lambda: ["doc_id", tx.clean(F.col("text")).alias("cleaned")]),
    "section_split": lambda spark, d: dc.sections(table(spark, d, "documents"), "doc_id", "text", "page_number"),
    "chunk_overlap": _overlapping,
    "chunk_semantic": _semantic,
    "term_extract": _select("documents", lambda: ["doc_id", _joined(F.array_sort(tx.terms_in(F.col("text"), dc.TERMS))).alias("terms")]),
    "term_extract_words": _select("documents", lambda: ["doc_id", _joined(F.array_sort(tx.terms_in(F.col("text"), dc.TERMS, whole_words=True))).alias("terms")]),
    "knowledge_keywords": _select("chunks", lambda: ["chunk_id", _joined(tx.terms_in(F.col("content"), vocab.KNOWLEDGE_TERMS)).alias("keywords")]),
    "term_density": _select("documents", lambda: ["doc_id", F.size(tx.words(F.col("text"))).alias("words"), tx.density(F.col("text"), dc.TERMS).alias("density")]),
    "terms_by_category": _terms_by_category,
    "classify_chunk": _select("chunks", lambda: ["chunk_id", tx.chunk_kind(F.col("content")).alias("kind")]),
    "classify_image": _select("images", lambda: ["id", tx.image_kind(F.col("caption"), F.col("context_text")).alias("kind")]),
    "classify_block": _select("text_blocks", lambda: ["id", tx.block_kind(F.col("text"), F.col("font_info.size"), F.col("font_info.flags")).alias("kind"), tx.structure_level(tx.block_kind(F.col("text"), F.col("font_info.size"), F.col("font_info.flags")), F.col("font_info.size")).alias("level")]),
    "image_description": lambda spark, d: dc.image_descriptions(table(spark, d, "images")),
    "image_content": _select("images", lambda: ["id", _image_content().alias("content")]),
    "page_from_content": _select("chunks", lambda: ["chunk_id", tx.page_of(F.col("content")).alias("page")]),
    "caption_extract": _select("images", lambda: ["id", tx.caption_in(F.col("caption")).alias("caption")]),
    "page_summary": lambda spark, d: rounded(dc.page_summaries(table(spark, d, "text_blocks"), table(spark, d, "images"))),
    "page_combined": lambda spark, d: dc.combined_pages(table(spark, d, "chunks"), table(spark, d, "images")),
    "keyword_context": lambda spark, d: dc.keyword_contexts(table(spark, d, "text_blocks"), vocab.EXTRACTION_TERMS),
    "extraction_summary": lambda spark, d: dc.extraction_summary(table(spark, d, "text_blocks"), table(spark, d, "images")),
    "concepts_from_answer": _select("interpretations", lambda: ["interp_id", _joined(tx.concepts(F.col("interpretation_text"))).alias("concepts")]),
    "systems_tract_flags": _select("interpretations", lambda: ["interp_id", _joined(tx.systems_tracts(F.col("interpretation_text"))).alias("tracts"), _joined(tx.key_surfaces(F.col("interpretation_text"))).alias("surfaces")]),
    "environment_label": _select("interpretations", lambda: ["interp_id", tx.environment(F.col("interpretation_text")).alias("environment"), tx.detailed_environment(F.col("interpretation_text")).alias("detailed")]),
    "evidence_extract": _select("documents", lambda: ["doc_id", F.array_join(tx.statements(F.col("text"), vocab.EVIDENCE_STARTS, 20, 5), " | ").alias("evidence")]),
    "recommend_extract": _select("documents", lambda: ["doc_id", F.array_join(tx.statements(F.col("text"), vocab.RECOMMENDATION_STARTS, 15, 3), " | ").alias("recommendations")]),
    "scale_factor": _select("images", lambda: ["id", tx.scale_factor(F.col("width"), F.col("height")).alias("factor")]),
    "analysis_confidence": _select("images", lambda: ["id", tx.analysis_confidence(F.coalesce("caption", F.lit("")), F.coalesce("geological_content", F.lit("")), F.coalesce("caption", F.lit("")), F.coalesce("context_text", F.lit("")), F.coalesce("context_text", F.lit("")), dc.INDEX_TERMS).alias("confidence")]),
}


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(text, terms):
    return f"list_filter({_list(terms)}, lambda t: contains(lower({text}), lower(t)))"


def _count(text, terms):
    return f"coalesce(len({_in(text, terms)}), 0)"


def _words(text):
    return f"list_filter(regexp_split_to_array({text}, '{tx.WS}+'), lambda w: w <> '')"


def _clean(text):
    t = f"regexp_replace({text}, '{tx.WS}+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, 'Page [0-9]+', '', 'g'), '^[0-9]+ *$', '')"
    return f"trim(translate(replace(replace({t}, '•', '* '), '–', '-'), '“”‘’', '\"\"'''''), ' ')"


_P, _S, _E = (_count("content", k) for k in (vocab.PATTERN_KEYWORDS, vocab.SURFACE_KEYWORDS, vocab.ENVIRONMENT_KEYWORDS))
_IMAGE = "CASE " + " ".join(f"WHEN regexp_matches(lower(concat_ws(' ', caption, context_text)), '{p}') THEN '{k}'" for p, k in tx.IMAGE_CASES) + " ELSE 'other' END"
_BLOCK = r"""CASE WHEN coalesce(font_info.size, 0) > 14 AND (coalesce(font_info.flags, 0) & 16) <> 0 THEN 'header' WHEN regexp_matches(trim(lower(text), ' '), '^(figure|fig\.|table|plate)') THEN 'caption'
  WHEN regexp_matches(trim(lower(text), ' '), '^(•|-|1\.|a\)|i\))') THEN 'list' ELSE 'paragraph' END"""
_ENV = f"coalesce((SELECT upper(e[1]) || e[2:] FROM (SELECT {_in('interpretation_text', vocab.ENVIRONMENTS)}[1] AS e)), 'Undetermined')"


def _statements(starts, longer, most):
    runs = ", ".join(f"regexp_extract_all(text, '(?i)({s}[^.\\n]*)(?:\\.|\\z|\\n\\z)', 1)" for s in starts)
    return f"CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_filter(list_transform(flatten([{runs}]), lambda x: trim(x, ' ')), lambda x: length(x) > {longer})[1:{most}], ' | '), '') END"


def _some(label, c, shown=None):
    return f"CASE WHEN coalesce(length({c}), 0) > 0 THEN '{label}' || {shown or c} END"


ORACLE_SQL = {
    "clean_text": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "section_split": f"""WITH l AS (SELECT doc_id, page_number, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), 1) AS pos FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CASE WHEN regexp_matches(line, '(?i){"|".join(vocab.SECTION_PATTERNS)}') THEN 1 ELSE 0 END AS hd FROM l),
s AS (SELECT *, sum(hd) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS no FROM h),
g AS (SELECT doc_id, CAST(no AS BIGINT) AS section_no, max(CASE WHEN hd = 1 THEN trim(line[:100], ' ') END) AS title, string_agg(CASE WHEN hd = 0 THEN line END, ' ' ORDER BY pos) AS body, any_value(page_number) AS p FROM s GROUP BY doc_id, no),
n AS (SELECT *, max(section_no) OVER (PARTITION BY doc_id) AS n, {_clean("body")} AS cleaned FROM g)
SELECT doc_id, section_no, coalesce(title, CASE WHEN n = 0 THEN 'Page ' || coalesce(CAST(p AS VARCHAR), '0') ELSE 'General' END) AS title, cleaned AS body FROM n WHERE cleaned <> ''""",
    "chunk_overlap": r"""WITH RECURSIVE c AS (
  SELECT doc_id, text, length(text) AS n, 0 AS k, 0 AS a FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, k + 1, greatest(a + 1, e - 50) FROM (SELECT *, CASE WHEN h < n AND st > 0 THEN h - 100 + st ELSE h END AS e FROM (SELECT *, length(regexp_extract(substring(text, h - 99, 100), '(?s)^(.*[.!?])', 1)) AS st FROM (SELECT *, least(a + 500, n) AS h FROM c))) WHERE e < n),
p AS (SELECT *, CASE WHEN h < n AND st > 0 THEN h - 100 + st ELSE h END AS e FROM (SELECT *, length(regexp_extract(substring(text, h - 99, 100), '(?s)^(.*[.!?])', 1)) AS st FROM (SELECT *, least(a + 500, n) AS h FROM c)))
SELECT doc_id, k AS chunk_no, a AS start, CAST(e AS INT) AS stop, md5(substring(text, a + 1, CAST(e AS BIGINT) - a)) AS digest FROM p""",
    "chunk_semantic": f"""WITH RECURSIVE s AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(content, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM chunks WHERE content IS NOT NULL),
t AS (SELECT chunk_id, i, ss[i] AS x, {_in("ss[i]", dc.INDEX_TERMS)} AS own, len(ss) AS n FROM s, LATERAL (SELECT unnest(generate_series(1, len(ss))) AS i) u),
f AS (SELECT chunk_id, n, 1 AS i, 0 AS piece, ' ' || x AS cur, own AS terms FROM t WHERE i = 1
  UNION ALL SELECT t.chunk_id, t.n, t.i, f.piece + CASE WHEN z.cut THEN 1 ELSE 0 END, CASE WHEN z.cut THEN ' ' || t.x ELSE f.cur || ' ' || t.x END, CASE WHEN z.cut THEN t.own ELSE list_distinct(list_concat(f.terms, t.own)) END
  FROM f JOIN t ON t.chunk_id = f.chunk_id AND t.i = f.i + 1, LATERAL (SELECT length(f.cur) + length(t.x) > 500 OR (len(f.terms) > 0 AND len(t.own) > 0 AND NOT list_has_any(f.terms, t.own)) AS cut) z)
SELECT chunk_id, piece AS piece_no, trim(arg_max(cur, i), ' ') AS piece FROM f GROUP BY chunk_id, piece""",
    "term_extract": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_sort({_in('text', dc.TERMS)}), ', '), '') ELSE '' END AS terms FROM documents",
    "analysis_confidence": f"""SELECT id, round(0.8::DOUBLE * 0.20 + least(0.3::DOUBLE * b + 0.1::DOUBLE * (u - b), 1) * 0.25 + least(t::DOUBLE / {len(dc.INDEX_TERMS)}, 1) * 0.20
  + CASE WHEN length(x) > 100 THEN 0.8 WHEN length(x) > 50 THEN 0.6 ELSE 0.5 END::DOUBLE * 0.15 + CASE WHEN length(x) > 200 AND n > 0 THEN 0.9 WHEN length(x) > 100 THEN 0.8 ELSE 0.7 END::DOUBLE * 0.20, 6) AS confidence
FROM (SELECT id, x, len(list_intersect(q, g)) AS b, len(list_distinct(list_concat(q, g))) AS u, len(list_distinct(list_concat(q, a))) AS t, len(a) AS n FROM (
  SELECT id, coalesce(context_text, '') AS x, {_in("coalesce(caption, '')", [t.lower() for t in dc.INDEX_TERMS])} AS q, {_in("coalesce(geological_content, '')", [t.lower() for t in dc.INDEX_TERMS])} AS g, {_in("coalesce(context_text, '')", [t.lower() for t in dc.INDEX_TERMS])} AS a FROM images))""",
    "knowledge_keywords": f"SELECT chunk_id, coalesce(array_to_string({_in('content', vocab.KNOWLEDGE_TERMS)}, ', '), '') AS keywords FROM chunks",
    "term_density": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len({_words('text')}) END AS words, round(CASE WHEN text IS NULL THEN 0 ELSE {_count('text', dc.TERMS)}::DOUBLE / greatest(len({_words('text')}), 1) END, 6) AS density FROM documents",
    "terms_by_category": f"WITH t AS (SELECT unnest({_in('text', dc.TERMS)}) AS term FROM documents), c AS (SELECT term, count(*) AS docs FROM t GROUP BY term), v AS (SELECT DISTINCT * FROM (VALUES {', '.join(repr((c, t)) for c, ts in vocab.EXTRACTION_TERMS.items() for t in ts)}) AS x(category, term)) SELECT category, term, docs FROM c JOIN v USING (term)",
    "classify_chunk": f"SELECT chunk_id, CASE WHEN {_P} > {_S} AND {_P} > {_E} THEN 'pattern' WHEN {_S} > {_E} THEN 'surface' WHEN {_E} > 0 THEN 'environment' ELSE 'general' END AS kind FROM chunks",
    "classify_image": f"SELECT id, {_IMAGE} AS kind FROM images",
    "classify_block": f"SELECT id, kind, CASE WHEN kind = 'header' THEN CASE WHEN coalesce(font_info.size, 0) > 18 THEN 1 WHEN coalesce(font_info.size, 0) > 14 THEN 2 ELSE 3 END WHEN kind = 'caption' THEN 4 ELSE 5 END AS level FROM (SELECT *, {_BLOCK} AS kind FROM text_blocks)",
    "image_description": f"""SELECT id, concat_ws(' | ', 'Geological image: ' || coalesce(image_type, 'unknown'), 'Page ' || coalesce(CAST(page_number AS VARCHAR), 'unknown'), 'Dimensions: ' || width || 'x' || height,
  {_some("Caption: ", "caption")}, {_some("Geological content: ", "geological_content")}, {_some("Context: ", "context_text", "CASE WHEN length(context_text) > 200 THEN context_text[:200] || '...' ELSE context_text END")},
  {_some("Visual indicators: ", "array_to_string(geological_indicators, ', ')")}) AS description FROM images""",
    "image_content": f"SELECT id, concat_ws('; ', coalesce(array_to_string({_in('''concat_ws(' ', caption, context_text)''', dc.TERMS)}, '; '), ''), array_to_string(geological_indicators, '; ')) AS content FROM images",
    "page_from_content": "SELECT chunk_id, CAST(coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(content, '{p}', 1), '') AS INT)" for p in vocab.PAGE_PATTERNS) + ", 0) AS INT) AS page FROM chunks",
    "caption_extract": "SELECT id, coalesce(" + ", ".join(f"trim(nullif(regexp_extract(caption, '(?i){p}', 0), ''), ' ')" for p in vocab.CAPTION_PATTERNS) + ") AS caption FROM images",
    "page_summary": f"""WITH b AS (SELECT source_file, page_number, string_agg(text, ' ' ORDER BY id, text) AS text, count(*) AS blocks FROM text_blocks WHERE text IS NOT NULL GROUP BY 1, 2),
i AS (SELECT source_file, page_number, count(*) AS images, coalesce(array_to_string(list_sort(list_distinct(list(image_type) FILTER (image_type IS NOT NULL))), ', '), '') AS types FROM images GROUP BY 1, 2),
x AS (SELECT source_file, page_number, coalesce(blocks, 0) AS blocks, coalesce(images, 0) AS images, types, coalesce(text, '') AS text FROM b FULL JOIN i USING (source_file, page_number)),
y AS (SELECT *, len({_words("text")}) AS words, {_in("text", dc.TERMS)} AS terms FROM x)
SELECT source_file, page_number, blocks, images, words, round(len(terms)::DOUBLE / greatest(words, 1), 6) AS density, concat_ws('; ', words || ' words of text', CASE WHEN images > 0 THEN images || ' images (' || types || ')' END,
  CASE WHEN len(terms) > 0 THEN 'Geological content: ' || array_to_string(list_sort(terms)[1:5], ', ') END) AS summary FROM y""",
    "page_combined": """WITH t AS (SELECT page, string_agg(CASE WHEN length(content) > 200 THEN content[:200] || '...' ELSE content END, ' ' ORDER BY chunk_id) AS t, count(*) AS text_chunks FROM chunks WHERE collection = 'spem_text_content' AND page IS NOT NULL AND content IS NOT NULL GROUP BY page),
i AS (SELECT page_number AS page, string_agg(coalesce(image_type, 'unknown') || ' (' || coalesce(geological_content, '') || ')', ', ' ORDER BY id) AS i, count(*) AS image_chunks FROM images GROUP BY page_number)
SELECT page, coalesce(text_chunks, 0) AS text_chunks, coalesce(image_chunks, 0) AS image_chunks, concat_ws(' | ', 'Document page ' || page, 'Text content: ' || t, 'Images: ' || i) AS content FROM t FULL JOIN i USING (page)""",
    "keyword_context": f"""WITH v AS (SELECT DISTINCT * FROM (VALUES {', '.join(repr((c, t)) for c, ts in vocab.EXTRACTION_TERMS.items() for t in ts)}) AS x(category, term)),
h AS (SELECT page_number, id, term, trim(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: contains(lower(s), lower(term)))[1], ' ') AS s FROM (SELECT page_number, id, text, unnest({_in("text", dc.TERMS)}) AS term FROM text_blocks WHERE text IS NOT NULL)),
f AS (SELECT term, s, min((page_number, id)) AS place FROM h WHERE s IS NOT NULL GROUP BY term, s), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY place, s) AS k FROM f)
SELECT category, term, contexts FROM v JOIN (SELECT term, string_agg(s, ' | ' ORDER BY k) AS contexts FROM k WHERE k <= 3 GROUP BY term) USING (term)""",
    "extraction_summary": """WITH x AS (SELECT source_file, page_number, 1 AS b, 0 AS i, geological_terms AS terms, 'text' AS kind FROM text_blocks
  UNION ALL SELECT source_file, page_number, 0, 1, geological_indicators, 'image_' || coalesce(image_type, 'other') FROM images),
t AS (SELECT source_file, count(DISTINCT t) AS terms FROM (SELECT source_file, unnest(terms) AS t FROM x) GROUP BY source_file)
SELECT source_file, pages, blocks, images, kinds, coalesce(terms, 0) AS terms FROM (SELECT source_file, count(DISTINCT page_number) AS pages, CAST(sum(b) AS BIGINT) AS blocks, CAST(sum(i) AS BIGINT) AS images, array_to_string(list_sort(list_distinct(list(kind))), ', ') AS kinds FROM x GROUP BY source_file) LEFT JOIN t USING (source_file)""",
    "concepts_from_answer": f"SELECT interp_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(interpretation_text, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^([A-Z][a-z]+|[a-z]{{4,}})$')), lambda w: lower(w)), lambda w: NOT list_contains({_list(vocab.ANSWER_COMMON_WORDS)}, w))))[1:10], ', '), CASE WHEN interpretation_text IS NOT NULL THEN '' END) AS concepts FROM interpretations",
    "systems_tract_flags": "SELECT interp_id, concat_ws(', ', " + ", ".join(f"CASE WHEN contains(lower(interpretation_text), '{w}') THEN '{t}' END" for w, t in (("lowstand", "LST"), ("transgressive", "TST"), ("highstand", "HST"))) + ") AS tracts, concat_ws(', ', " + ", ".join(f"CASE WHEN contains(lower(interpretation_text), '{w}') THEN '{t}' END" for w, t in (("maximum flooding", "MFS"), ("transgressive surface", "TS"), ("sequence boundary", "SB"))) + ") AS surfaces FROM interpretations",
    "environment_label": f"SELECT interp_id, {_ENV} AS environment, CASE WHEN {_count('interpretation_text', tx.MODIFIERS)} > 0 THEN array_to_string({_in('interpretation_text', tx.MODIFIERS)}, ' ') || ' ' || lower({_ENV}) ELSE {_ENV} END AS detailed FROM interpretations",
    "evidence_extract": f"SELECT doc_id, {_statements(vocab.EVIDENCE_STARTS, 20, 5)} AS evidence FROM documents",
    "recommend_extract": f"SELECT doc_id, {_statements(vocab.RECOMMENDATION_STARTS, 15, 3)} AS recommendations FROM documents",
    "scale_factor": "SELECT id, round(CASE WHEN least(width, height) < 800 THEN greatest(least(1600.0::DOUBLE / width, 1200.0::DOUBLE / height, CASE WHEN least(width, height) < 200 THEN 10 WHEN least(width, height) < 400 THEN 6 WHEN least(width, height) < 600 THEN 4 ELSE 2 END), 1) ELSE greatest(least(1600.0::DOUBLE / width, 1200.0::DOUBLE / height), 1) END, 6) AS factor FROM images",
}
