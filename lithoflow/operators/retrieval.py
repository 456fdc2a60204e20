"""Searches put together: by kind, images by concept with a choice between them, what stands around an image or a result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.answers import enhanced_question, is_specific
from . import search

#: Content types of each kind of search.
KINDS = {"text": ["text", "combined", "geological_keyword"], "image": ["image_description"], "geological": ["geological_keyword"], "combined": ["combined"]}
#: Text hits taken for their pages, the score they have to exceed, and what their images get of it.
TEXT_HITS, STRONG, OF_PAGE = 10, 0.7, 0.8
#: Rows of a page, and of a search, that make the context of an image.
CONTEXT_ROWS, SEARCH_ROWS, LEAST = 8, 10, 0.3


def by_kind(chunks: DataFrame, query: str, vector: Sequence[float], kind: str = "all", k: int = 10) -> DataFrame:
    """``chunk_id, content_type, page, score, rank``: a search of one kind.

    'all' searches everything; 'text' takes the ``k`` best of each text type, one type after the other, under one name and
    from pages over 0; the others take one type.  Another kind is an error.
    """
    out = ["chunk_id", "content_type", "page", "score", "rank"]
    if kind == "all":
        found = search.search_all(chunks, query, vector, k, search.DEFAULTS.moderate)
        return found.join(chunks.select("chunk_id", "content_type"), "chunk_id").withColumnRenamed("place", "rank").select(*out)
    if kind not in KINDS:
        raise ValueError(f"kind must be all, {', '.join(KINDS)}")
    types = KINDS[kind]
    found = search.search_by_type(chunks, query, vector, types, k).join(chunks.select("chunk_id", "page"), "chunk_id")
    if kind != "text":
        return found.select(*out)
    # at most k of each type
    order = F.array_position(tx.literals(types), F.col("content_type"))
    placed = found.filter("page > 0").withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "rank")))
    return placed.select("chunk_id", F.lit("text").alias("content_type"), "page", "score", F.col("n").alias("rank"))


def images_by_concept(chunks: DataFrame, images: DataFrame, links: DataFrame, query: str, vector: Sequence[float], k: int = 5, known: frozenset[str] = frozenset()) -> DataFrame:
    """``id, source_file, page_number, score, tier, rank``: the images that match a concept.

    ``links`` (chunk_id, image_id) says which image a chunk is about; hits of images that are not there are dropped, and of
    several hits of an image the first counts.  Where these are fewer than ``k``, images of the pages of strong text hits come
    to them, each once and by its first hit.  A query that names something (``known`` holds the vocabulary) has its own
    limits, and no images at all if the best is poor.
    """
    about = images.select("id", "source_file", "page_number").dropDuplicates(["id"])
    hits = by_kind(chunks, query, vector, "image", 2 * k).join(links, "chunk_id").withColumnRenamed("image_id", "id")
    first = Window.partitionBy("id").orderBy("rank")
    direct = hits.withColumn("__k", F.row_number().over(first)).filter("__k = 1").select("id", "score").join(about, "id")
    # both are as few as is asked for
    strong = by_kind(chunks, query, vector, "text", TEXT_HITS).filter(F.col("score") > STRONG)
    few = direct.agg((F.count("*") < k).alias("few"))
    beside = strong.select(F.col("page").alias("page_number"), "score", "rank").join(F.broadcast(few.filter("few")).withColumn("one", F.lit(1)), F.lit(1) == F.col("one"))
    beside = about.join(F.broadcast(beside.select("page_number", "score", "rank")), "page_number").join(direct.select("id"), "id", "left_anti")
    beside = beside.withColumn("__k", F.row_number().over(first)).filter("__k = 1").select("id", (F.col("score") * OF_PAGE).alias("score"), "source_file", "page_number")
    s = search.DEFAULTS
    specific = is_specific(query, set(known))
    high, low = (s.specific_first, s.specific_rest) if specific else (s.general_first, s.general_rest)
    every = direct.unionByName(beside).withColumn("tier", F.when(F.col("score") > high, 1).otherwise(2)).filter((F.col("tier") == 1) | (F.col("score") > low))
    order = ["tier", F.desc(F.round("score", 9)), "id"]
    best = every.orderBy(*order).limit(k)
    one = Window.partitionBy(F.lit(0))
    placed = best.withColumn("rank", F.row_number().over(one.orderBy(*order)))
    if specific:
        poor = (F.count_if(F.col("tier") == 1).over(one) < k) & (F.max("score").over(one) < s.specific_rest)
        placed = placed.withColumn("__p", poor).filter("not __p").drop("__p")
    return placed.select("id", "source_file", "page_number", "score", "tier", "rank")


def images_with_choice(chunks: DataFrame, images: DataFrame, links: DataFrame, query: str, vector: Sequence[float], k: int = 5, known: frozenset[str] = frozenset(), most: int = 3) -> DataFrame:
    """``id, source_file, page_number, ambiguous, choice``: the images of a concept, those of one page as choices.

    Of a page with several of them up to ``most`` come out, numbered; beside such pages only ``k // 2`` others, else ``k``.
    """
    found = images_by_concept(chunks, images, links, query, vector, 2 * k, known)
    page = Window.partitionBy("source_file", "page_number")
    x = found.withColumn("ambiguous", F.count("*").over(page) > 1).withColumn("choice", F.row_number().over(page.orderBy("rank")))
    some = Window.partitionBy(F.lit(0))
    x = x.withColumn("any", F.max("ambiguous").over(some)).withColumn("place", F.row_number().over(Window.partitionBy("ambiguous").orderBy("rank")))
    keep = F.when(F.col("ambiguous"), F.col("choice") <= most).otherwise(F.col("place") <= F.when(F.col("any"), k // 2).otherwise(k))
    return x.filter(keep).select("id", "source_file", "page_number", "ambiguous", F.when(F.col("ambiguous"), F.col("choice")).alias("choice"))


def _in_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, context``: rows ``place, page, content`` in order, ' | ' between them."""
    line = F.concat(F.lit("Page "), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.lit(": "), F.coalesce("content", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), " | ")
    return rows.groupBy(*by).agg(joined.alias("context"))


def page_contexts(chunks: DataFrame, images: DataFrame, most: int = CONTEXT_ROWS) -> DataFrame:
    """``id, context``: what the first ``most`` chunks of its page say around each image; images of pages without chunks are left out.

    The first chunks are chosen a page, whatever its images are.
    """
    w = Window.partitionBy("page").orderBy("chunk_id")
    first = chunks.filter("page is not null").select("page", "chunk_id", "content").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    pages = _in_lines(first, ["page"])
    return images.select("id", "page_number").join(pages, F.col("page_number") == F.col("page")).select("id", "context")


def image_context(chunks: DataFrame, image: dict, question: str, embed: Callable[[str], Sequence[float]], most: int = CONTEXT_ROWS) -> DataFrame:
    """One row ``context``: what is said on the page of ``image``, and, where its surroundings make the question clearer, what a search for that finds.

    ``image`` has page_number, geological_content and context_text; ``embed`` gives the vector of a text.
    """
    page = chunks.filter(F.col("page") == image["page_number"]).select("page", "content", F.col("chunk_id").alias("__o")).orderBy("__o").limit(most)
    rows = page.select("page", "content", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__o")).alias("place"))
    if question:
        texts = page.orderBy("__o").agg(F.collect_list("content").alias("t"))
        asked = enhanced_question(F.lit(question), F.col("t"), F.lit(image.get("geological_content")), F.lit(image.get("context_text")))
        clearer = texts.select(asked.alias("q")).first()[0]
        if clearer != question:
            found = search.search_all(chunks, clearer, embed(clearer), SEARCH_ROWS, LEAST).select("chunk_id", "page", (F.col("place") + most).alias("place"))
            rows = rows.unionByName(found.join(chunks.select("chunk_id", "content"), "chunk_id").select("page", "content", "place"))
    w = Window.partitionBy(F.lit(0)).orderBy("place")
    first = rows.orderBy("place").limit(most).withColumn("place", F.row_number().over(w))
    return _in_lines(first.withColumn("one", F.lit(1)), ["one"]).select("context")


def related_context(chunks: DataFrame, target: dict, question: str, embed: Callable[[str], Sequence[float]]) -> DataFrame:
    """``chunk_id, page, score, place``: what a search for the question and the first three terms of a result finds beside the result itself."""
    query = " ".join([question, *(target.get("geological_terms") or [])[:3]]).strip()
    found = search.search_all(chunks, query, embed(query), SEARCH_ROWS, LEAST)
    return found.filter(F.col("chunk_id") != target["chunk_id"]).select("chunk_id", "page", "score", "place")


def interpretation_confidence(parts: Sequence[Column]) -> Column:
    """The mean of those of ``parts`` (mean confidence of the patterns, mean similarity of the knowledge, mean quality of the curves) that are there; else 0.5."""
    there = F.array_compact(F.array(*[F.nanvl(p.cast("double"), F.lit(None)) for p in parts]))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)).otherwise(0.5)


def chosen_thresholds(sweep: DataFrame) -> DataFrame:
    """One row ``strict, moderate, relaxed`` from rows ``threshold, mean_score``: the threshold of the best mean, of equals the highest, and 0.2 above and below it.

    The strict one is -0.2 at least, the relaxed one -0.8 at most; nothing swept gives nulls.
    """
    best = sweep.agg(F.max_by("threshold", F.struct(F.round("mean_score", 9).alias("m"), F.col("threshold").alias("t"))).alias("t"))
    t = F.col("t")
    return best.select(F.when(t.isNotNull(), F.greatest(t + 0.2, F.lit(-0.2))).alias("strict"), t.alias("moderate"), F.when(t.isNotNull(), F.least(t - 0.2, F.lit(-0.8))).alias("relaxed"))


# Words that are no terms.
NO_TERMS = ["the", "and", "for", "with", "this", "that", "from", "have", "been"]


def learned_vocabulary(chunks: DataFrame, collection: str = "spem_geological_terms") -> DataFrame:
    """``term, chunks``: the terms of a collection, those it is tagged with of more than two letters and its words of more than three, letters only."""
    tagged = F.filter(F.transform(F.coalesce("geological_terms", F.array().cast("array<string>")), lambda t: F.trim(F.lower(t))), lambda t: F.length(t) > 2)
    plain = F.filter(F.transform(tx.words(F.lower(F.coalesce("content", F.lit("")))), lambda w: F.regexp_replace(w, "^[;:,]+|[;:,]+$", "")), lambda w: F.length(w) > 3)
    kept = F.filter(F.array_distinct(F.concat(tagged, plain)), lambda w: F.rlike(w, F.lit(r"^\p{L}+$")) & ~w.isin(NO_TERMS))
    return chunks.filter(F.col("collection") == collection).select(F.explode(kept).alias("term")).groupBy("term").agg(F.count("*").alias("chunks"))
