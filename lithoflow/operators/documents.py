"""Pages, blocks, images and chunks: sections, chunking, page summaries and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab

TERMS = vocab.flat(vocab.EXTRACTION_TERMS)
INDEX_TERMS = vocab.flat(vocab.INDEX_TERMS)


def sections(docs: DataFrame, key: str, text: str, page: str) -> DataFrame:
    """``key, section_no, title, body``: a line that holds a header pattern begins a section titled by it.

    What stands before the first header is 'General'; a text without header is one section 'Page n'.  Bodies
    are cleaned, sections without body left out.
    """
    header = "(?i)" + "|".join(vocab.SECTION_PATTERNS)
    lines = docs.select(F.col(key).alias("__k"), F.col(page).alias("__p"), F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("pos", "line"))
    w = Window.partitionBy("__k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_header", F.rlike("line", F.lit(header)).cast("int")).withColumn("section_no", F.sum("is_header").over(w))
    title = F.max(F.when(F.col("is_header") == 1, F.trim(F.substring("line", 1, 100))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_header") == 0, F.struct("pos", "line")))), lambda x: x["line"]), " ")
    g = lines.groupBy("__k", "section_no").agg(title.alias("title"), body.alias("body"), F.first("__p").alias("__p"), F.max("pos").alias("__last"))
    last = Window.partitionBy("__k")
    g = g.withColumn("__n", F.max("section_no").over(last)).withColumn("body", tx.clean(F.col("body"))).filter("body <> ''")
    general = F.when(F.col("__n") == 0, F.concat(F.lit("Page "), F.coalesce(F.col("__p").cast("string"), F.lit("0")))).otherwise("General")
    return g.select(F.col("__k").alias(key), "section_no", F.coalesce("title", general).alias("title"), "body")


def overlapping_chunks(text: Column, size: int = 500, overlap: int = 50, look_back: int = 100) -> Column:
    """``array<struct<start, stop>>`` (from 0): pieces of ``size`` cut behind the last full stop of their last ``look_back`` characters, if any.

    The next piece begins ``overlap`` before the end of the one before; the piece that reaches the end is the last.
    """
    least = size - look_back - overlap
    t = F.coalesce(text, F.lit(""))
    begin = F.struct(F.lit(0).alias("at"), F.length(t).alias("n"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(acc, _):
        at, n = acc["at"], acc["n"]
        hard = F.least(at + size, n)
        tail = F.substring(t, hard - look_back + 1, F.lit(look_back))
        stop = F.length(F.regexp_extract(tail, r"(?s)^(.*[.!?])", 1))
        end = F.when((hard < n) & (stop > 0), hard - look_back + stop).otherwise(hard)
        piece = F.array(F.struct(at.alias("start"), end.cast("int").alias("stop")))
        after = F.when(end >= n, n).otherwise(F.greatest(at + 1, end - overlap)).cast("int")
        return F.when(at >= n, acc).otherwise(F.struct(after.alias("at"), n.alias("n"), F.concat(acc["out"], piece).alias("out")))

    return F.aggregate(F.sequence(F.lit(1), (F.floor(F.length(t) / least) + 2).cast("int")), begin, step, lambda acc: acc["out"])


def semantic_chunks(text: Column, terms: list[str], size: int = 500) -> Column:
    """``array<string>``: sentences put together until ``size`` is passed or the terms have nothing in common.

    The first sentence carries a leading blank, which counts.
    """
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    none = F.array().cast("array<string>")
    begin = F.struct(none.alias("out"), F.lit("").alias("cur"), none.alias("terms"))

    def step(acc, s):
        own = tx.terms_in(s, terms)
        apart = (F.size(acc["terms"]) > 0) & (F.size(own) > 0) & ~F.arrays_overlap(acc["terms"], own)
        cut = ((F.length(acc["cur"]) + F.length(s) > size) & (acc["cur"] != "")) | ((acc["cur"] != "") & apart)
        joined = F.concat(acc["cur"], F.lit(" "), s)
        return F.when(cut, F.struct(F.concat(acc["out"], F.array(F.trim(acc["cur"]))).alias("out"), F.concat(F.lit(" "), s).alias("cur"), own.alias("terms"))).otherwise(
            F.struct(acc["out"].alias("out"), joined.alias("cur"), F.array_union(acc["terms"], own).alias("terms"))
        )

    return F.aggregate(sentences, begin, step, lambda acc: F.when(acc["cur"] != "", F.concat(acc["out"], F.array(F.trim(acc["cur"])))).otherwise(acc["out"]))


def image_descriptions(images: DataFrame) -> DataFrame:
    """``id, description`` of each image: type, page, size and what is there of caption, content, context and indicators."""
    some = lambda label, c, shown=None: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(label), c if shown is None else shown))
    hints = F.array_join(F.coalesce("geological_indicators", F.array().cast("array<string>")), ", ")
    parts = [
        F.concat(F.lit("Geological image: "), F.coalesce("image_type", F.lit("unknown"))), F.concat(F.lit("Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("unknown"))),
        F.concat(F.lit("Dimensions: "), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")),
        some("Caption: ", F.col("caption")), some("Geological content: ", F.col("geological_content")),
        some("Context: ", F.col("context_text"), tx.shortened(F.col("context_text"), 200)), some("Visual indicators: ", hints),
    ]
    return images.select("id", F.concat_ws(" | ", *parts).alias("description"))


def page_summaries(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Per page of a source: words, images by type and the first five terms, as numbers and as one line."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "text")))
    b = blocks.filter("text is not null").groupBy("source_file", "page_number").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.count("*").alias("blocks"))
    i = images.groupBy("source_file", "page_number").agg(F.count("*").alias("images"), F.array_join(F.array_sort(F.collect_set("image_type")), ", ").alias("types"))
    x = b.join(i, ["source_file", "page_number"], "full").withColumn("text", F.coalesce("text", F.lit("")))
    x = x.withColumn("words", F.size(tx.words(F.col("text")))).withColumn("terms", F.slice(F.array_sort(tx.terms_in(F.col("text"), TERMS)), 1, 5))
    line = F.concat_ws(
        "; ", F.format_string("%d words of text", "words"), F.when(F.col("images") > 0, F.format_string("%d images (%s)", "images", "types")),
        F.when(F.size("terms") > 0, F.concat(F.lit("Geological content: "), F.array_join("terms", ", "))),
    )
    return x.select("source_file", "page_number", F.coalesce("blocks", F.lit(0)).cast("bigint").alias("blocks"), F.coalesce("images", F.lit(0)).cast("bigint").alias("images"), "words", tx.density(F.col("text"), TERMS).alias("density"), line.alias("summary"))


def combined_pages(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Per page the text chunks, shortened, and the images, as one content; a page with either side is there."""
    t = chunks.filter((F.col("collection") == "spem_text_content") & F.col("page").isNotNull() & F.col("content").isNotNull())
    t = t.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", tx.shortened(F.col("content"), 200).alias("c")))), lambda x: x["c"]), " ").alias("t"), F.count("*").alias("text_chunks"))
    label = F.concat(F.coalesce("image_type", F.lit("unknown")), F.lit(" ("), F.coalesce("geological_content", F.lit("")), F.lit(")"))
    i = images.groupBy(F.col("page_number").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", label.alias("l")))), lambda x: x["l"]), ", ").alias("i"), F.count("*").alias("image_chunks"))
    content = F.concat_ws(" | ", F.concat(F.lit("Document page "), F.col("page").cast("string")), F.concat(F.lit("Text content: "), F.col("t")), F.concat(F.lit("Images: "), F.col("i")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return t.join(i, "page", "full").select("page", zero("text_chunks"), zero("image_chunks"), content.alias("content"))


def keyword_contexts(blocks: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """``category, term, contexts``: for each term found the first three distinct sentences that hold it.

    Of a block only its first sentence with the term counts; blocks are taken in order of page and id.
    """
    terms = vocab.as_table(blocks.sparkSession, "v", vocabulary).select("category", "term").distinct()
    hit = blocks.filter("text is not null").select("page_number", "id", "text", F.explode(tx.terms_in(F.col("text"), vocab.flat(vocabulary))).alias("term"))
    sentence = F.get(F.filter(F.split("text", "[.!?]+"), lambda s: F.contains(F.lower(s), F.lower(F.col("term")))), F.lit(0))
    hit = hit.select("page_number", "id", "term", F.trim(sentence).alias("s")).filter("s is not null")
    # the first place of each sentence, combined before the shuffle; then three of each term
    first = hit.groupBy("term", "s").agg(F.min(F.struct("page_number", "id")).alias("at"))
    w = Window.partitionBy("term").orderBy("at", "s")
    top = first.withColumn("k", F.row_number().over(w)).filter("k <= 3").groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " | ").alias("contexts"))
    return F.broadcast(terms).join(top, "term").select("category", "term", "contexts")


def extraction_summary(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Per source: pages, blocks, images, terms and kinds of content."""
    none = F.array().cast("array<string>")
    b = blocks.select("source_file", "page_number", F.lit(1).alias("b"), F.lit(0).alias("i"), F.coalesce("geological_terms", none).alias("terms"), F.lit("text").alias("kind"))
    i = images.select("source_file", "page_number", F.lit(0).alias("b"), F.lit(1).alias("i"), F.coalesce("geological_indicators", none).alias("terms"), F.concat(F.lit("image_"), F.coalesce("image_type", F.lit("other"))).alias("kind"))
    x = b.unionByName(i)
    counts = x.groupBy("source_file").agg(F.count_distinct("page_number").alias("pages"), F.sum("b").alias("blocks"), F.sum("i").alias("images"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    terms = x.select("source_file", F.explode("terms").alias("t")).groupBy("source_file").agg(F.count_distinct("t").alias("terms"))
    return counts.join(terms, "source_file", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))


def images_per_page(images: DataFrame) -> DataFrame:
    """``page_number, count``: how many images each page number has."""
    return images.groupBy("page_number").count()


def compared_extractions(one: DataFrame, other: DataFrame, most: int = 3) -> DataFrame:
    """``pair, one, other, ratio``: the images of two extractions (name, width, height) side by side by their names, the first ``most``; pair 0 has the counts."""

    def first(df, name):
        top = df.orderBy("name").limit(most).select("name", (F.col("width").cast("bigint") * F.col("height")).alias(name))
        return top.withColumn("pair", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name"))).drop("name")

    pairs = first(one, "one").join(first(other, "other"), "pair")
    counts = one.agg(F.count("*").alias("one")).withColumn("pair", F.lit(0)).join(other.agg(F.count("*").alias("other")).withColumn("pair", F.lit(0)), "pair")
    return counts.unionByName(pairs).select("pair", "one", "other", F.try_divide(F.col("other"), F.col("one")).alias("ratio"))
