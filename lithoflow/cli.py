"""Command line: searches over a chunk table."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import documents, retrieval, search
from .plans import models, pipelines
from .plans.retrieval_queries import image_links
from .sources.tables import table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lithoflow", description="Search chunks of geological documents.")
    p.add_argument("root", help="folder of the tables")
    p.add_argument("-q", "--query", default="")
    p.add_argument("-t", "--type", choices=["all", "text", "image", "geo", "page", "combined", "find-images", "ask-image", "list-images", "stats"], default="all")
    p.add_argument("-i", "--image", default="", help="the image that ask-image is about")
    p.add_argument("-m", "--max", type=int, default=10)
    p.add_argument("-s", "--threshold", type=float, default=search.DEFAULTS.moderate)
    return p


def run(spark: SparkSession, argv: list[str] | None = None):
    """The result of one command as a DataFrame."""
    a = parser().parse_args(argv)
    chunks = table(spark, a.root, "chunks")
    vector = models.hashed_ngrams([a.query])[0].tolist()
    if a.type == "stats":
        return search.collection_counts(chunks)
    if a.type == "list-images":
        return documents.images_per_page(table(spark, a.root, "images")).orderBy("page_number")
    if not a.query:
        raise SystemExit("a query is needed")
    if a.type == "page":
        return search.search_by_page(chunks, [int(x) for x in a.query.replace(",", " ").split()])
    if a.type == "geo":
        return search.search_by_concepts(chunks, [t.strip() for t in a.query.split(",")], vector, a.max)
    if a.type == "find-images":
        images = table(spark, a.root, "images")
        # only what the query may hold of the vocabulary
        asked = sorted({a.query.strip().lower(), *a.query.lower().split()})
        known = frozenset(r.term for r in retrieval.learned_vocabulary(chunks).filter(F.col("term").isin(asked)).collect())
        return retrieval.images_by_concept(chunks, images, image_links(chunks, images), a.query, vector, a.max, known)
    if a.type == "ask-image":
        return pipelines.analyzed_image(chunks, table(spark, a.root, "images"), a.image, a.query)
    if a.type in ("text", "image", "combined"):
        return retrieval.by_kind(chunks, a.query, vector, a.type, a.max)
    return search.search_all(chunks, a.query, vector, a.max, a.threshold)


def main() -> None:
    run(SparkSession.builder.appName("lithoflow").getOrCreate()).show(50, truncate=100)


if __name__ == "__main__":
    main()
