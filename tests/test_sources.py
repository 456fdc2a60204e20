import json

from pyspark.sql import functions as F

from lithoflow import cli
from lithoflow.sources import las, stores
from lithoflow.streaming import trends

LAS = """~VERSION
VERS. 2.0 : version
WRAP. NO : one line
~WELL
STRT.M 100.0 : start
WELL. Brent 7 : well
UWI.  123/45 : id
LAT.DEG 61.5 : latitude
LON.DEG none : longitude
# a comment
~CURVE
DEPT.M : depth
GR.GAPI : gamma: ray
RHOB.G/C3 : density
~ASCII
100.0 55.5 2.40
100.5 -999.25 2.41
bad row
"""


def test_las(spark, tmp_path):
    (tmp_path / "a.las").write_text(LAS)
    (tmp_path / "b.las").write_text("~WELL\n~CURVE\nDEPT.M : d\nGR.API : g\n~ASCII\n")
    (tmp_path / "c.las").write_text("~V\nWRAP. YES : w\n~C\nDEPT.M :\nGR.API :\nSP.MV :\n~A\n1\n2 3\n4\n5 6\n")
    path = f"{tmp_path}/*.las"
    w = {r.path.rsplit("/", 1)[1]: r for r in las.wells(spark, path).collect()}
    assert w["a.las"].well_name == "Brent 7" and w["a.las"].latitude == 61.5 and w["a.las"].longitude is None and w["b.las"].well_name == "Unknown"
    s = las.samples(spark, path)
    got = sorted((r.path[-5:], r.mnemonic, r.unit, r.idx, r.depth, r.value) for r in s.collect())
    assert ("a.las", "GR", "GAPI", 1, 100.5, -999.25) in got and ("c.las", "SP", "MV", 1, 4.0, 6.0) in got and len(got) == 8


def test_chunk_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "collection string, x int")
    stores.write_chunks(df, str(tmp_path / "s"))
    stores.write_chunks(spark.createDataFrame([("b", 3)], "collection string, x int"), str(tmp_path / "s"))
    assert sorted(r.x for r in stores.read_chunks(spark, str(tmp_path / "s")).collect()) == [1, 3]
    assert [r.x for r in stores.read_chunks(spark, str(tmp_path / "s"), "b").collect()] == [3]


def test_extraction(spark, tmp_path):
    doc = {"document_info": {"source_file": "x.pdf"}, "pages": [{"page_number": 2, "text_blocks": [{"id": "b", "text": "t"}], "images": [], "tables": [{"id": "t", "data": [["a", "b"], ["c", None]]}, {"id": "u", "data": [["a"]]}]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    d = stores.read_extraction(spark, str(tmp_path / "x.json"))
    assert d["text_blocks"].first().text == "t" and d["images"].count() == 0
    k = stores.kept_tables(d["tables"]).collect()
    assert len(k) == 1 and (k[0].row_count, k[0].col_count) == (2, 2) and k[0].text.strip() == "a b c"
    stores.write_json(d["text_blocks"].select("id", "page_number"), str(tmp_path / "out"), ["page_number"])
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_images(spark):
    images = spark.createDataFrame([("i", "s", 1, (0.0, 0.0, 10.0, 10.0), "a/b.JPEG"), ("j", "s", 2, (0.0, 0.0, 10.0, 10.0), "a/c.png")], "id string, source_file string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, file_path string")
    blocks = spark.createDataFrame([("b", "s", 1, "near", (0.0, 150.0, 9.0, 160.0)), ("c", "s", 1, "far", (0.0, 500.0, 9.0, 600.0)), ("d", "s", 2, None, (0.0, 0.0, 1.0, 1.0))], "id string, source_file string, page_number int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [tuple(r) for r in stores.nearby_text(images, blocks).collect()] == [("i", "near")]
    better = stores.with_enhanced(images, spark.createDataFrame([("e/b.png",)], "path string"))
    assert {r.id: r.file_path for r in better.collect()} == {"i": "e/b.png", "j": "a/c.png"}
    assert spark.range(1).select(stores.image_id(F.lit(3), F.lit(1), F.lit("x").cast("binary"))).first()[0] == "spem_img_003_001_9dd4e461"
    assert stores.pending(images, images.filter("id = 'i'"), "id").first().id == "j"
    assert tuple(stores.batch_stats(spark.createDataFrame([(None, 2.0), ("x", None), (None, 4.0)], "error string, scale double")).first()) == (2, 1, 3.0)


def test_structured_blocks(spark):
    span = "struct<text:string,font:string,size:double,color:int,flags:int>"
    raw = spark.createDataFrame([("a", 1, None, [([("He", "F", 9.0, 0, 16), ("llo", "G", 8.0, 0, 0)],), ([("x", "F", 1.0, 0, 0)],)]), ("b", 1, None, [])], f"id string, page_number int, bbox string, lines array<struct<spans:array<{span}>>>")
    r = stores.structured_blocks(raw).collect()
    assert len(r) == 1 and r[0].text == "Hello\nx" and r[0].font_info.font == "F"


def test_cli(spark, data):
    for args in (["-t", "stats"], ["-t", "list-images"], ["-t", "page", "-q", "1,2"], ["-q", "gamma ray"], ["-t", "geo", "-q", "sand, shale"], ["-t", "find-images", "-q", "sand"], ["-t", "image", "-q", "sand"]):
        assert cli.run(spark, [data, *args]).count() >= 0


def test_trend_stream(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/curve_samples.parquet")
    src.filter("idx < 60").write.parquet(str(tmp_path / "in/a"))

    def run():
        stream = spark.readStream.schema(src.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        trends.trend_stream(stream, str(tmp_path / "history"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    run()
    src.filter("idx >= 60").write.parquet(str(tmp_path / "in/b"))
    run()
    from lithoflow.operators import wells

    got, want = trends.latest(spark, str(tmp_path / "out")), wells.trend_windows(src)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_files_to_patterns(spark, tmp_path):
    """From a LAS file to trend windows, detectors and resolved patterns."""
    import math

    from lithoflow.operators import wells
    from lithoflow.plans import pipelines

    head = "~V\nVERS. 2.0 :\nWRAP. NO :\n~W\nWELL. One : name\nUWI. 42-1 : id\n~C\nDEPT.M : depth\nGR.API : gamma\nMD.M : measured\nRHOB.G/C3 : density\n~A\n"
    for k, shift in (("a", 0.0), ("b", 3.0)):
        rows = [f"{1000 + i} {60 + shift + 0.8 * i + math.sin(i):.3f} {1000 + i} {2.4 if i % 50 else -999.25}" for i in range(200)]
        (tmp_path / f"{k}.las").write_text(head + "\n".join(rows))
    s = las.samples(spark, str(tmp_path))
    assert {(x.well_id, x.mnemonic) for x in s.select("well_id", "mnemonic").distinct().collect()} == {("42-1", "GR"), ("42-1", "RHOB")}
    assert s.select("curve_id").distinct().count() == 4 and s.filter("loaded_at is null").count() == 0 and s.count() == 800
    assert wells.trend_windows(s).filter("type = 'bell'").count() == 0 and wells.trend_windows(s).count() > 10
    assert pipelines.patterns_of_files(spark, str(tmp_path)).count() > 0 and wells.log_summary(s, 0.5, True).filter("line like '%API'").count() == 2


def test_upsert_and_report(spark, tmp_path):
    path = str(tmp_path / "store")
    shape = "collection string, id string, content string"
    stores.upsert_chunks(spark.createDataFrame([("a", "1", "old"), ("a", "2", "old"), ("b", "1", "b")], shape), path)
    stores.upsert_chunks(spark.createDataFrame([("a", "2", "new"), ("a", "3", "new"), ("a", "3", "new")], shape), path)
    assert sorted((x.collection, x.id, x.content) for x in stores.read_chunks(spark, path).collect()) == [("a", "1", "old"), ("a", "2", "new"), ("a", "3", "new"), ("b", "1", "b")]
    pages = spark.createDataFrame([("d", 2, 1, 3, 0, ["sand"], "two"), ("d", 1, 0, 4, 1, ["bed", "sand"], None), ("e", 1, 9, 9, 9, [], "x")], "source_file string, page_number int, images int, blocks int, tables int, keywords array<string>, summary string")
    lines = [x.value for x in stores.page_report(pages, "d").collect()]
    assert lines == ["EXTRACTION SUMMARY", "Document: d", "Total Pages: 2", "- Total Images: 1", "- Total Text Blocks: 7", "- Total Tables: 1", "KEYWORDS FOUND:", "- bed", "- sand", "PAGE-BY-PAGE SUMMARY:", "Page 1: ", "Page 2: two"]
    stores.write_report(pages, "d", str(tmp_path / "report"))
    assert [x.value for x in spark.read.text(str(tmp_path / "report")).collect()] == lines


def test_first_of_several_enhanced_files(spark):
    images = spark.createDataFrame([("i", "in/a.jpg")], "id string, file_path string")
    enhanced = spark.createDataFrame([("z/a.png",), ("b/a.png",)], "path string")
    assert stores.with_enhanced(images, enhanced).first().file_path == "b/a.png"


def test_image_rows_and_sinks(spark, tmp_path):
    shape = "source_file string, page_number int, index int, content binary, width int, height int, rectangles array<struct<x0 double, y0 double, x1 double, y1 double>>, page_width double, page_height double, file_path string"
    raw = spark.createDataFrame([("a", 3, 1, b"x" * 200, 40, 30, [(10.0, 10.0, 50.0, 50.0)], 600.0, 800.0, "p.png"), ("a", 4, 1, b"y" * 200, 4, 3, None, 600.0, 800.0, "q.png"), ("a", 3, 2, b"small", 4, 3, None, 600.0, 800.0, "r.png")], shape)
    blocks = spark.createDataFrame([("a", 3, "b1", "Figure 2: gamma ray log of shale. More", (20.0, 60.0, 40.0, 70.0))], "source_file string, page_number int, id string, text string, bbox struct<x0 double, y0 double, x1 double, y1 double>")
    got = {x.file_path: x for x in stores.image_rows(raw, blocks).collect()}
    assert set(got) == {"p.png", "q.png"} and got["p.png"].caption == "Figure 2: gamma ray log of shale" and got["p.png"].image_type == "well_log" and got["p.png"].id.startswith("spem_img_003_001_")
    assert got["q.png"].context_text == "" and got["q.png"].image_type == "other" and got["q.png"].bbox.x0 == 60.0
    tables = spark.createDataFrame([("a", "t", [["x", "y"], ["1", None]]), ("a", "u", [["x"]])], "source_file string, id string, data array<array<string>>")
    stores.write_tables(tables, str(tmp_path / "t"))
    assert [(x.id, x.row_count, x.col_count) for x in spark.read.json(str(tmp_path / "t")).collect()] == [("t", 2, 2)]
    chunks = spark.createDataFrame([("a", [1.0]), ("a", None), ("b", [])], "collection string, embedding array<float>")
    stores.write_metadata(chunks, str(tmp_path / "m"))
    assert sorted((x.collection, x.chunks, x.vectors) for x in spark.read.json(str(tmp_path / "m")).collect()) == [("a", 2, 1), ("b", 1, 0)]
    for _ in range(2):
        stores.write_interpretations(spark.createDataFrame([("w", "sand")], "well_id string, text string"), str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "i")).filter("well_id = 'w' and written_at is not null").count() == 2


def test_knowledge_on(spark, data):
    from lithoflow.plans import pipelines, prompts

    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    for category in ("pattern", "surface", "environment"):
        assert {x.chunk_type for x in pipelines.knowledge_on(chunks.withColumn("embedding", F.transform("embedding", lambda v: v)), category, "funnel").collect()} <= {category}
    assert prompts.canned_query("surface", "MFS").startswith("maximum flooding") and prompts.canned_query("pattern", "odd") == "odd" and prompts.canned_query("environment", "deltaic") == "deltaic depositional environment facies characteristics"
