"""Searching chunk collections: exact, vector, hybrid, by page, concept and type; duplicates, variety, images.

A query's text, words, variations and vector are literals of the plan, so a search is one pass over the chunks.
The score of a vector is 1 - d / 2 with the squared distance d, the cosine where lengths are 1; vectors of
another dimension than the query's, null and zero ones have no score.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab

IMAGES = "spem_image_metadata"
KNOWLEDGE = "spem_geological_knowledge"


@dataclass(frozen=True)
class Settings:
    """Thresholds and sizes of the searches."""

    similarity: float = 0.3
    strict: float = 0.7
    moderate: float = 0.4
    relaxed: float = 0.2
    knowledge: float = -0.1
    specific_first: float = -0.2
    specific_rest: float = -0.1
    general_first: float = 0.3
    general_rest: float = -0.6
    prefix: int = 100


DEFAULTS = Settings()


def variations(term: str) -> list[str]:
    """Other writings of a term of several words: joined by underscores, its words, its initials; in alphabetical order."""
    term = term.strip().lower()
    words = term.split()
    if len(words) < 2:
        return []
    return sorted({"_".join(words), *words, "".join(w[0] for w in words)} - {term})


def similarity(vector: Sequence[float], column: str = "embedding") -> Column:
    """1 - d / 2, or null where there is no usable vector."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    d = F.aggregate(F.zip_with(F.col(column), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    usable = (F.size(column) == len(vector)) & F.exists(column, lambda x: x != 0)
    return F.when(usable, 1 - d / 2)


def contains(c: Column, text: str) -> Column:
    return F.contains(F.lower(c), F.lit(text.strip().lower()))


def top_k(df: DataFrame, k: int, score: str = "score", tie: str = "chunk_id", by: list[str] | None = None) -> DataFrame:
    """The ``k`` best rows, of each group ``by`` if given, with their ``rank``; equal scores in the order of ``tie``."""
    ranked = F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("__s"), tie))
    x = df.withColumn("__s", F.round(score, 9))
    if not by:
        x = x.orderBy(F.desc("__s"), tie).limit(k)  # only the k best reach the window
    return x.withColumn("rank", ranked).filter(F.col("rank") <= k).drop("__s")


def nearest(chunks: DataFrame, vector: Sequence[float], k: int, by: list[str] | None = None, where: Column | None = None, least: float | None = None) -> DataFrame:
    """The ``k`` chunks nearest to a vector, of each group ``by`` if given; ``where`` holds before, ``least`` after the choice."""
    x = (chunks if where is None else chunks.filter(where)).withColumn("score", similarity(vector)).filter("score is not null")
    best = top_k(x, k, by=by)
    return best if least is None else best.filter(F.col("score") >= least)


def of_images() -> Column:
    """Whether a chunk is of the image collection; one of no collection isn't."""
    return F.coalesce(F.col("collection") == IMAGES, F.lit(False))


def image_match(query: str, column: str = "content") -> Column:
    """How surely an image's text is on a term, or null: 0.95 if it holds the term; by the first variation that counts 0.85, or 0.70
    for one of up to two letters, which only counts near an indicator; else by the words of the term it holds, 0.60 x their share
    from 0.7 on, 0.48 from 0.5 on if they begin within 50 letters."""
    q, low = query.strip().lower(), F.lower(column)
    score = F.when(F.contains(low, F.lit(q)), 0.95)
    for v in variations(query):
        hit = F.contains(low, F.lit(v))
        if len(v) <= 2:
            at = F.instr(low, F.lit(v))
            begin = F.greatest(F.lit(1), at - 30)
            around = F.substring(low, begin, at + len(v) + 30 - begin)
            score = score.when(hit & F.exists(tx.literals(vocab.INDICATOR_WORDS), lambda w: F.contains(around, w)), 0.70)
        else:
            score = score.when(hit, 0.85)
    words = q.split()
    if len(words) < 2:
        return score
    places = F.filter(F.transform(tx.literals(words), lambda w: F.instr(low, w)), lambda p: p > 0)
    share = F.size(places) / len(words)
    close = (F.size(places) >= 2) & (F.array_max(places) - F.array_min(places) < 50)
    return score.when(share >= 0.7, 0.6 * share).when((share >= 0.5) & close, 0.48)


def exact(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold the term or a variation, score 0.95 as it stands, 0.85 in another case, and images by ``image_match``; for queries of up to three words."""
    if not 1 <= len(query.split()) <= 3:
        return chunks.limit(0).withColumn("score", F.lit(None).cast("double"))
    score = None
    for v in [query.strip(), *variations(query)]:
        for hit, value in ((F.contains("content", F.lit(v)), 0.95), (F.contains(F.lower("content"), F.lit(v.lower())), 0.85)):
            score = F.when(hit, F.lit(value)) if score is None else score.when(hit, F.lit(value))
    return chunks.withColumn("score", F.when(of_images(), image_match(query)).otherwise(score)).filter("score is not null")


def without_repeats(df: DataFrame, order: list, prefix: int = DEFAULTS.prefix, by: list[str] | None = None) -> DataFrame:
    """The first row, in ``order``, of those whose content begins alike, in each group ``by`` if given."""
    w = Window.partitionBy(*(by or []), F.trim(F.substring("content", 1, prefix))).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def diversified(df: DataFrame, k: int, kind: str = "content_type") -> DataFrame:
    """Up to ``k`` of ranked rows: the best of each kind first, then the rest by rank; ``place`` numbers them."""
    best = F.row_number().over(Window.partitionBy(kind).orderBy("rank")) == 1
    x = df.withColumn("__first", (~best).cast("int"))
    return x.orderBy("__first", "rank").limit(k).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__first", "rank"))).drop("__first")


def search_all(chunks: DataFrame, query: str, vector: Sequence[float], k: int = 50, least: float = DEFAULTS.relaxed) -> DataFrame:
    """Exact hits and those nearest vectors that hold the query, without repeats, by score, varied by type."""
    hits = exact(chunks, query).withColumn("source", F.lit(0))
    near = nearest(chunks, vector, k, by=["collection"]).drop("rank").filter(contains(F.col("content"), query) & (F.col("score") >= least)).withColumn("source", F.lit(1))
    kinds = hits.unionByName(near).withColumn("kind", F.coalesce("chunk_type", F.lit("unknown")))
    once = without_repeats(kinds, ["source", "chunk_id"])
    # more than k rows are only needed where the best of a kind lies behind them
    ranked = once.withColumn("__s", F.round("score", 9))
    ahead = ranked.withColumn("__k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("__s"), "chunk_id"))).filter(F.col("__k") <= k)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__s"), "chunk_id"))).drop("__s", "__k")
    return diversified(ranked, k, "kind").select("chunk_id", "collection", "kind", "page", "score", "place")


def match_score(query: str, vector: Sequence[float]) -> Column:
    """Vector score plus what the text shares with the query, 1 at most; null where a short query has no variation in it."""
    q = query.strip()
    words = q.lower().split()
    low = F.lower("content")
    base = F.greatest(F.lit(0.0), F.coalesce(similarity(vector), F.lit(0.0)))
    whole = F.when(F.contains("content", F.lit(q)), 0.5).when(F.contains(low, F.lit(q.lower())), 0.4).otherwise(0.0)
    shared = sum(F.contains(low, F.lit(w)).cast("int") for w in words) / len(words) * 0.2 if len(words) > 1 else F.lit(0.0)
    score = F.least(F.lit(1.0), base + whole + shared)
    if len(words) <= 2:
        return F.when(F.exists(tx.literals([q.lower(), *variations(q)]), lambda v: F.contains(low, v)), score)
    return score


def search_by_type(chunks: DataFrame, query: str, vector: Sequence[float], types: list[str], k: int = 10) -> DataFrame:
    """The best ``k`` of each content type by vector score, without repeats; of those that hold the term or a variation, and images
    by ``image_match``, which adds up to a fifth."""
    low = F.lower("content")
    held = F.exists(tx.literals([query.strip().lower(), *variations(query)]), lambda v: F.contains(low, v))
    factor = F.when(of_images(), 1 + 0.2 * image_match(query)).when(held, 1.0)
    # of repeats the nearest stays, before images are scored up
    x = chunks.filter(F.col("content_type").isin(types)).withColumn("__v", similarity(vector)).withColumn("score", F.col("__v") * factor).filter("score > 0")
    once = without_repeats(x, [F.round("__v", 9).desc(), "chunk_id"], by=["content_type"])
    return top_k(once, k, by=["content_type"]).select("content_type", "rank", "chunk_id", "score")


def search_by_page(chunks: DataFrame, pages: list[int], query: str | None = None, vector: Sequence[float] | None = None) -> DataFrame:
    """The chunks of some pages; with a query only those that hold it, scored, else all at 1."""
    x = chunks.filter(F.col("page").isin(pages))
    x = x.withColumn("score", F.lit(1.0)) if not query else x.filter(contains(F.col("content"), query)).withColumn("score", match_score(query, vector)).filter("score is not null")
    return x.select("chunk_id", "page", "score").orderBy("page", F.desc("score"), "chunk_id")


def search_by_concepts(chunks: DataFrame, terms: list[str], vector: Sequence[float], k: int = 10) -> DataFrame:
    """Chunks by 0.6 x score + 0.4 x share of the terms they are tagged with, of those tagged or scored over 0.5."""
    found = search_all(chunks, " ".join(terms), vector, 2 * k).select("chunk_id", F.col("score").alias("s"))
    near = nearest(chunks, vector, 2 * k).select("chunk_id", F.col("score").alias("s"))
    tagged = F.size(F.array_intersect(F.coalesce("geological_terms", F.array().cast("array<string>")), tx.literals(terms))) / len(terms)
    every = found.unionByName(near).groupBy("chunk_id").agg(F.max("s").alias("s"))
    x = chunks.select("chunk_id", tagged.alias("share")).join(F.broadcast(every), "chunk_id").filter("share > 0 or s > 0.5")
    return top_k(x.withColumn("score", 0.6 * F.col("s") + 0.4 * F.col("share")), k).select("chunk_id", "score", "rank")


def related_terms(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Abbreviations in brackets, words with underscores and words near the query, of chunks that hold a word of it; by count."""
    words = [w for w in query.lower().split() if w not in vocab.QUERY_COMMON_WORDS]
    low = F.lower("content")
    x = chunks.filter(F.exists(tx.literals(words), lambda w: F.contains(low, w))).select("content", low.alias("low"))
    pieces = [F.regexp_extract_all("content", F.lit(r"\(([A-Z]{1,4})\)"), F.lit(1)), F.regexp_extract_all("content", F.lit(r"([A-Za-z0-9]+_\w*[A-Za-z0-9])"), F.lit(1))]
    for w in words:
        at = F.instr("low", F.lit(w))
        around = F.expr("substring(low, greatest(1, instr(low, '{0}') - 20), {1})".format(w.replace("'", "''"), len(w) + 40))
        pieces.append(F.when(at > 0, F.regexp_extract_all(around, F.lit("([a-z_]{2,10})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    found = x.select(F.explode(F.array_distinct(F.flatten(F.array(*pieces)))).alias("term")).filter((F.length("term") > 1) & ~F.lower("term").isin(*vocab.QUERY_COMMON_WORDS, *words))
    return found.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def images_for(chunks: DataFrame, images: DataFrame, query: str, vector: Sequence[float], k: int = 5, first: float = DEFAULTS.general_first, rest: float = DEFAULTS.general_rest) -> DataFrame:
    """Images of the pages whose chunks match best, 0.8 x score; those over ``first`` before those over ``rest``."""
    pages = chunks.filter("page is not null").withColumn("score", match_score(query, vector)).filter("score is not null").groupBy(F.col("page").alias("page_number")).agg(F.max("score").alias("s"))
    x = images.select("id", "page_number", "image_type").join(pages, "page_number").withColumn("score", F.col("s") * 0.8).filter(F.col("score") > rest)
    x = x.withColumn("tier", F.when(F.col("score") > first, 1).otherwise(2)).withColumn("__s", F.round("score", 9))
    return x.orderBy("tier", F.desc("__s"), "id").limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", F.desc("__s"), "id"))).select("id", "page_number", "image_type", "score", "tier", "rank")


def ambiguous_images(images: DataFrame, most: int = 3) -> DataFrame:
    """Pages with several images, and up to ``most`` of each."""
    by = Window.partitionBy("source_file", "page_number")
    x = images.withColumn("n", F.count("*").over(by)).filter("n > 1").withColumn("choice", F.row_number().over(by.orderBy("id")))
    return x.filter(F.col("choice") <= most).select("source_file", "page_number", "n", "choice", "id")


def collection_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and usable vectors by collection, and in all."""
    usable = F.count_if(F.size("embedding") > 0)
    return chunks.rollup("collection").agg(F.count("*").alias("chunks"), usable.alias("vectors")).withColumn("collection", F.coalesce("collection", F.lit("all")))


def threshold_sweep(chunks: DataFrame, vectors: list[Sequence[float]], thresholds: list[float], k: int = 50) -> DataFrame:
    """Per threshold how many of the queries' best scores pass, and their mean."""
    found = None
    for v in vectors:
        part = nearest(chunks, v, k).select("score")
        found = part if found is None else found.unionByName(part)
    x = found.select("score", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")).filter(F.col("score") >= F.col("threshold"))
    return x.groupBy("threshold").agg(F.count("*").alias("hits"), F.avg("score").alias("mean_score"))


def learned_terms(chunks: DataFrame) -> DataFrame:
    """Tagged terms of more than two letters and words of more than three, letters only, with the chunks they are in."""
    tagged = F.filter(F.transform(F.coalesce("geological_terms", F.array().cast("array<string>")), lambda t: F.lower(t)), lambda t: F.length(t) > 2)
    plain = F.filter(tx.words(F.lower(F.coalesce("content", F.lit("")))), lambda w: (F.length(w) > 3) & F.rlike(w, F.lit(r"^[a-z]+$")) & ~w.isin(vocab.ANSWER_COMMON_WORDS))
    return chunks.select(F.explode(F.array_distinct(F.concat(tagged, plain))).alias("term")).groupBy("term").agg(F.count("*").alias("chunks"))


def knowledge(chunks: DataFrame, vector: Sequence[float], k: int = 5, kind: str | None = None, least: float = DEFAULTS.knowledge) -> DataFrame:
    """Knowledge chunks, of one kind if given, by 2 x cosine - 1; ``least`` holds after the choice."""
    where = F.col("collection") == KNOWLEDGE
    best = nearest(chunks, vector, k, where=where if kind is None else where & (F.col("chunk_type") == kind))
    return best.withColumn("score", 2 * F.col("score") - 1).filter(F.col("score") >= least)


def gathered_context(chunks: DataFrame, vectors: dict[str, Sequence[float]]) -> DataFrame:
    """Knowledge for an interpretation: two chunks for each pattern, three on sequences, three on environments, two on surfaces."""
    out = None
    for name, v in sorted(vectors.items()):
        for category, k, kind in ((f"pattern:{name}", 2, "pattern"), (f"sequence:{name}", 3, None), (f"environment:{name}", 3, "environment"), (f"surface:{name}", 2, "surface")):
            part = knowledge(chunks, v, k, kind, least=-2.0).select(F.lit(category).alias("category"), "rank", "chunk_id", "score")
            out = part if out is None else out.unionByName(part)
    return out
