"""Stores of chunks, extractions, tables, images and interpretations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab
from ..plans.lineage import cut

# The shape of an extraction result.
EXTRACTION_SCHEMA = """
document_info struct<title string, source_file string>,
pages array<struct<page_number int, page_metadata struct<width double, height double>,
  text_blocks array<struct<id string, text string, block_type string, bbox array<double>, font_info struct<font string, size double, color int, flags int>, geological_terms array<string>>>,
  images array<struct<id string, image_type string, width int, height int, file_path string, caption string, context_text string, geological_content string>>,
  tables array<struct<id string, data array<array<string>>>>>>
"""


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes chunks by collection; with 'overwrite' only the collections written are replaced."""
    w = chunks.write.mode(mode).partitionBy("collection")
    (w.option("partitionOverwriteMode", "dynamic") if mode == "overwrite" else w).parquet(path)


def upsert_chunks(chunks: DataFrame, path: str, key: str = "id") -> None:
    """Writes chunks into a store: rows of a known ``key`` are replaced, others added, in the collections of ``chunks``; other collections are not touched.

    The new content of a collection is cut off from the old one before it takes its place.
    """
    spark = chunks.sparkSession
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        return write_chunks(chunks, path)
    one = chunks.dropDuplicates(["collection", key])
    touched = one.select("collection").distinct()
    kept = old.join(touched, "collection", "left_semi").join(one.select("collection", key), ["collection", key], "left_anti")
    write_chunks(cut(kept.unionByName(one, allowMissingColumns=True)), path)


def page_report(pages: DataFrame, source: str) -> DataFrame:
    """``value``: the lines of a report on one source, from ``source_file, page_number, images, blocks, tables, keywords, summary``."""
    p = pages.filter(F.col("source_file") == source)
    total = p.agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("images", "blocks", "tables")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"))
    head = total.select(F.lit(0).alias("part"), F.expr(f"""posexplode(concat(
        array({", ".join(repr(x) for x in ("EXTRACTION SUMMARY", f"Document: {source}"))}, concat('Total Pages: ', pages), concat('- Total Images: ', images), concat('- Total Text Blocks: ', blocks), concat('- Total Tables: ', tables), 'KEYWORDS FOUND:'),
        transform(keywords, k -> concat('- ', k)), array('PAGE-BY-PAGE SUMMARY:')))"""))
    lines = p.select(F.lit(1).alias("part"), F.col("page_number").alias("pos"), F.format_string("Page %d: %s", "page_number", F.coalesce("summary", F.lit(""))).alias("col"))
    return head.unionByName(lines).orderBy("part", "pos").select(F.col("col").alias("value"))


def write_report(pages: DataFrame, source: str, path: str) -> None:
    """Writes the report on one source as one text file."""
    page_report(pages, source).coalesce(1).write.mode("overwrite").text(path)


def read_chunks(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if collection is None else df.filter(F.col("collection") == collection)


def read_extraction(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The blocks, images and tables of extraction results in JSON, each a DataFrame."""
    pages = spark.read.schema(EXTRACTION_SCHEMA).json(path, multiLine=True).select(F.col("document_info.source_file").alias("source_file"), F.explode("pages").alias("p"))

    def of(name):
        return pages.select("source_file", F.col("p.page_number").alias("page_number"), F.explode(f"p.{name}").alias("x")).select("source_file", "page_number", "x.*")

    return {"text_blocks": of("text_blocks"), "images": of("images"), "tables": of("tables")}


def write_json(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """Writes rows as JSON lines, by the values of ``by``."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path)


def structured_blocks(raw: DataFrame) -> DataFrame:
    """Blocks of ``lines`` of ``spans`` as text, in the font of the first span; blocks without text are left out.

    ``raw`` has id, page_number, bbox and lines array<struct<spans array<struct<text, font, size, color, flags>>>>.
    """
    text = F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line["spans"], lambda s: s["text"]), "")), "\n")
    first = F.get(F.get("lines", F.lit(0))["spans"], F.lit(0))
    font = F.struct(*[first[c].alias(c) for c in ("font", "size", "color", "flags")])
    return raw.select("id", "page_number", "bbox", F.trim(text).alias("text"), font.alias("font_info")).filter("text <> ''")


def kept_tables(tables: DataFrame) -> DataFrame:
    """Tables of more than one row, with their size and all their text."""
    flat = F.array_join(F.transform("data", lambda r: F.array_join(r, " ", "")), " ")
    return tables.filter(F.size("data") > 1).withColumns({"row_count": F.size("data"), "col_count": F.size(F.get("data", F.lit(0))), "text": flat})


def image_id(page: Column, index: Column, content: Column) -> Column:
    """``spem_img_<page>_<index>_<first 8 digits of the content's md5>``."""
    return F.format_string("spem_img_%03d_%03d_%s", page, index, F.substring(F.md5(content), 1, 8))


def image_box(rectangles: Column, width: Column, height: Column) -> Column:
    """The first rectangle of an image on its page, else all but a tenth at each side; null where the page's size isn't known either."""
    inner = F.struct((width * 0.1).alias("x0"), (height * 0.1).alias("y0"), (width * 0.9).alias("x1"), (height * 0.9).alias("y1"))
    return F.coalesce(F.get(rectangles, F.lit(0)), inner)


def nearby_text(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """``id, context``: the text of the blocks of the same page that meet an image's box, widened by 50, 100 and 200."""
    i, b = images.select(F.col("id").alias("image"), "source_file", "page_number", F.col("bbox").alias("ib")), blocks.select("source_file", "page_number", F.col("id").alias("block"), "text", F.col("bbox").alias("tb"))
    meet = (F.col("tb.x0") <= F.col("ib.x1") + 50) & (F.col("tb.x1") >= F.col("ib.x0") - 50) & (F.col("tb.y0") <= F.col("ib.y1") + 200) & (F.col("tb.y1") >= F.col("ib.y0") - 100)
    j = i.join(b, ["source_file", "page_number"]).filter(meet & F.col("text").isNotNull())
    return j.groupBy(F.col("image").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), " ").alias("context"))


def with_enhanced(images: DataFrame, enhanced: DataFrame) -> DataFrame:
    """``images`` with the path of the enhanced file where there is one of the same name (jpeg as png)."""
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?i)\.jpe?g$", ".png")
    # of several of a name the first path counts
    e = enhanced.groupBy(F.element_at(F.split("path", "/"), -1).alias("__name")).agg(F.min("path").alias("__path"))
    return images.withColumn("__n", name).join(e, F.col("__n") == F.col("__name"), "left").withColumn("file_path", F.coalesce("__path", "file_path")).select(*images.columns)


def pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """The inputs without an output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def batch_stats(results: DataFrame) -> DataFrame:
    """Of ``error, scale`` rows: how many were processed, failed, and the mean scale of the first."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.avg(F.when(F.col("error").isNull(), F.col("scale"))).alias("mean_scale"))


def image_rows(raw: DataFrame, blocks: DataFrame) -> DataFrame:
    """Images as an extractor yields them (source_file, page_number, index, content, width, height, rectangles, page_width, page_height, file_path)
    with id, box, text around, caption, type and what they are about; those of under 100 bytes are no images."""
    kept = raw.filter(F.length("content") >= 100)
    x = kept.withColumns({"id": image_id(F.col("page_number"), F.col("index"), F.col("content")), "bbox": image_box(F.col("rectangles"), F.col("page_width"), F.col("page_height"))})
    x = x.join(nearby_text(x, blocks), "id", "left").withColumn("context_text", F.coalesce("context", F.lit("")))
    x = x.withColumn("caption", tx.caption_of(F.col("context_text"), F.lit(None).cast("string")))
    about = F.array_join(tx.terms_in(F.concat_ws(" ", "caption", "context_text"), vocab.KNOWLEDGE_TERMS), "; ")
    return x.select("id", "source_file", "page_number", tx.image_kind(F.col("caption"), F.col("context_text")).alias("image_type"), "bbox", "width", "height", "file_path", "caption", "context_text", about.alias("geological_content"))


def write_tables(tables: DataFrame, path: str) -> None:
    """Writes tables of more than one row as JSON, by source."""
    write_json(kept_tables(tables), path, ["source_file"], "overwrite")


def write_metadata(chunks: DataFrame, path: str) -> None:
    """Writes what a store holds: chunks and usable vectors by collection, in one JSON file."""
    usable = F.count_if(F.coalesce(F.size("embedding"), F.lit(0)) > 0)
    write_json(chunks.groupBy("collection").agg(F.count("*").alias("chunks"), usable.alias("vectors")).coalesce(1), path, mode="overwrite")


def write_interpretations(df: DataFrame, path: str, key: str = "well_id") -> None:
    """Adds interpretations as JSON, by well, with the time they were written."""
    write_json(df.withColumn("written_at", F.current_timestamp()), path, [key])
