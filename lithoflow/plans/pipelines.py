"""Whole runs: log files to patterns, scanned pages to a chunk store, patterns to interpretations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as tx
from ..functions import vocab
from ..operators import documents, retrieval, search, wells
from ..sources import las
from . import models, prompts
from .lineage import cut


def patterns_of_samples(samples: DataFrame) -> DataFrame:
    """All detectors, overlaps resolved."""
    return wells.resolve_overlaps(wells.patterns(samples))


def patterns_of_files(spark: SparkSession, path: str) -> DataFrame:
    """LAS files to patterns, overlaps resolved."""
    return patterns_of_samples(las.samples(spark, path))


def analyzed_image(chunks: DataFrame, images: DataFrame, name: str, question: str, vision: models.VisionModel = models.no_vision, model: models.LanguageModel = models.no_model, embedder: models.Embedder = models.hashed_ngrams) -> DataFrame:
    """``id, question, answer, concepts, confidence, context``: a question about one image, named by its id or a part of it; one row, without an id if there is none.

    The answer is the models'; where they say nothing, what is known of the image explains it.
    """
    spark = images.sparkSession
    shape = "id string, question string, answer string, concepts array<string>, confidence double, context string"
    found = answers.resolve_image(images, name).first()
    if found is None:
        return spark.createDataFrame([(None, question, f"Image not found: {name}", [], 0.0, None)], shape)
    image = found.asDict()
    around = retrieval.image_context(chunks, image, question, lambda text: embedder([text])[0].tolist()).first()
    context = around.context if around else ""
    said, _ = models.seen(vision, image["file_path"], question, image.get("context_text"), model)
    one = spark.createDataFrame([(image["id"], question, said or None, image.get("caption"), image.get("geological_content"), context)], "id string, question string, said string, caption string, content string, context string")
    content = F.coalesce("content", F.lit(""))
    known = F.filter(F.transform(F.split(content, ";"), lambda t: F.trim(t)), lambda t: t != "")
    answer = F.coalesce("said", answers.explained(F.col("question"), F.col("caption"), F.col("content"), known, F.lit(None).cast("string"), F.lit("unknown")))
    x = one.withColumn("answer", answer)
    sure = tx.analysis_confidence(F.col("question"), content, F.col("answer"), F.lit(""), F.col("context"), vocab.KNOWLEDGE_TERMS)
    return x.select("id", "question", "answer", tx.concepts(F.col("answer")).alias("concepts"), sure.alias("confidence"), tx.shortened(F.col("context"), 500).alias("context"))


def knowledge_chunks(pages: DataFrame, key: str, text: str, page: str, embedder: models.Embedder = models.hashed_ngrams) -> DataFrame:
    """Pages as knowledge chunks: sections, overlapping pieces, kind, keywords and vectors."""
    s = documents.sections(pages, key, text, page).withColumn("__n", F.col("section_no"))
    s = s.select(key, "section_no", "title", "body", F.posexplode(documents.overlapping_chunks(F.col("body"))).alias("piece_no", "p"))
    body = F.expr("substring(body, p.start + 1, p.stop - p.start)")
    c = s.select(F.format_string("chunk_%s_%03d_%03d", F.col(key).cast("string"), "section_no", "piece_no").alias("id"), F.col(key), F.col("title").alias("section"), body.alias("content"))
    c = c.join(pages.select(key, F.col(page).alias("page")), key)
    c = c.withColumns({"collection": F.lit(search.KNOWLEDGE), "chunk_type": tx.chunk_kind(F.col("content")), "geological_terms": tx.terms_in(F.col("content"), vocab.KNOWLEDGE_TERMS)})
    return c.join(models.embedded(c, "id", "content", embedder), "id")


def interpretations(samples: DataFrame, chunks: DataFrame, mode: str = "comprehensive", model: models.LanguageModel = models.no_model, embedder: models.Embedder = models.hashed_ngrams) -> DataFrame:
    """``curve_id, prompt, reply`` and what the reply says, for each curve with patterns.

    The model is asked on the executors, a prompt a row.
    """
    # read twice, for the query and for the prompts
    found = cut(patterns_of_samples(samples))
    types = [r.type for r in found.select("type").distinct().orderBy("type").collect()]
    query = {"sequence": prompts.sequence_query, "environment": prompts.environment_query}.get(mode, lambda t: " ".join(prompts.canned_query("pattern", x) for x in t))(types)
    context = search.knowledge(chunks, embedder([query])[0].tolist(), 8, least=-2.0)
    asked = prompts.prompts(found, wells.log_summary(samples), context, mode)

    replied = models.with_replies(asked, model)
    r = F.col("reply")
    return replied.select(
        "curve_id", "prompt", "reply", tx.systems_tracts(r).alias("systems_tracts"), tx.key_surfaces(r).alias("key_surfaces"), tx.detailed_environment(r).alias("environment"),
        tx.statements(r, vocab.EVIDENCE_STARTS, 20, 5).alias("evidence"), tx.statements(r, vocab.RECOMMENDATION_STARTS, 15, 3).alias("recommendations"),
    )


def knowledge_on(chunks: DataFrame, category: str, name: str, k: int = 5, embedder: models.Embedder = models.hashed_ngrams) -> DataFrame:
    """The ``k`` knowledge chunks on a pattern, a surface or an environment, of that type."""
    if category not in ("pattern", "surface", "environment"):
        raise ValueError("category must be pattern, surface or environment")
    return search.knowledge(chunks, embedder([prompts.canned_query(category, name)])[0].tolist(), k, category)
