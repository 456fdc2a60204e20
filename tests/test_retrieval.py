import pytest
from pyspark.sql import functions as F

from lithoflow import cli
from lithoflow.operators import retrieval as r
from lithoflow.operators import search
from lithoflow.plans import models, pipelines

CHUNKS = "chunk_id bigint, collection string, id string, content string, content_type string, chunk_type string, page int, geological_terms array<string>, embedding array<float>"
IMAGES = "id string, source_file string, page_number int, image_type string, file_path string, caption string, context_text string, geological_content string, width int, height int, score int"
NEAR, FAR, NONE = [1.0, 0.0], [0.6, 0.8], None


def chunk(i, content, kind, page, vector, terms=None, collection="spem_text_content"):
    return (i, collection, f"c{i}", content, kind, "general", page, terms, vector)


def tables(spark, chunks, images):
    c = spark.createDataFrame(chunks, CHUNKS)
    rows = [(i, "a.pdf", p, "well_log", f"x/{i}.png", "Figure 1: sand", "near a log", "gamma ray; sand", 400, 900, 7) for i, p in images]
    return c, spark.createDataFrame(rows, IMAGES)


def some(spark):
    chunks = [
        chunk(1, "gamma ray of sand", "text", 3, NEAR, ["gamma ray", "sand"]), chunk(2, "gamma ray on no page", "text", 0, NEAR), chunk(3, "Gamma Ray curve", "combined", 4, FAR),
        chunk(4, "an image of a gamma ray log", "image_description", 5, NEAR, collection=search.IMAGES), chunk(5, "another gamma ray image", "image_description", 5, FAR, collection=search.IMAGES),
        chunk(6, "nothing", "image_description", 6, NEAR, collection=search.IMAGES), chunk(7, None, None, None, NONE), chunk(8, "gamma ray", "geological_keyword", None, NEAR, collection=None),
    ]
    return tables(spark, chunks, [("i3", 3), ("j3", 3), ("i5", 5), ("i9", 9)])


def links(spark, pairs=((4, "i5"), (5, "i5"), (6, "gone"))):
    return spark.createDataFrame(list(pairs), "chunk_id bigint, image_id string")


def test_by_kind(spark):
    chunks, _ = some(spark)
    assert [(x.chunk_id, x.rank, x.content_type) for x in r.by_kind(chunks, "gamma ray", NEAR, "text").orderBy("rank").collect()] == [(1, 1, "text"), (3, 2, "text")]
    assert {x.chunk_id for x in r.by_kind(chunks, "gamma ray", NEAR, "image").collect()} == {4, 5}
    assert {x.chunk_id for x in r.by_kind(chunks, "gamma ray", NEAR, "all").collect()} == {1, 2, 3, 4, 5, 8}
    assert r.by_kind(chunks.limit(0), "gamma ray", NEAR, "text").count() == 0
    with pytest.raises(ValueError):
        r.by_kind(chunks, "gamma ray", NEAR, "sound")


def test_images_by_concept(spark):
    chunks, images = some(spark)
    got = r.images_by_concept(chunks, images, links(spark), "gamma ray", NEAR, 5).orderBy("rank").collect()
    # of the two hits of i5 the first; the images of page 3 by a strong text hit; i9 by nothing
    assert [(x.id, round(x.score, 2), x.tier) for x in got] == [("i5", 1.19, 1), ("i3", 0.8, 1), ("j3", 0.8, 1)]
    assert [x.id for x in r.images_by_concept(chunks, images, links(spark), "gamma ray", NEAR, 1).collect()] == ["i5"]
    assert r.images_by_concept(chunks, images.limit(0), links(spark), "gamma ray", NEAR).count() == 0
    assert r.images_by_concept(chunks, images, links(spark, []), "gamma ray", NEAR).count() == 2


def test_a_name_has_no_poor_images(spark):
    chunks = [chunk(1, "Guarico log", "image_description", 5, [-1.0, 0.2], collection=search.IMAGES)]
    c, images = tables(spark, chunks, [("i5", 5)])
    assert r.images_by_concept(c, images, links(spark, [(1, "i5")]), "Guarico", NEAR).count() == 0


def test_choices(spark):
    chunks, images = some(spark)
    got = r.images_with_choice(chunks, images, links(spark), "gamma ray", NEAR, 4).collect()
    assert sorted((x.id, x.ambiguous, x.choice) for x in got if x.ambiguous) == [("i3", True, 1), ("j3", True, 2)] and [x.id for x in got if not x.ambiguous] == ["i5"]


def test_contexts(spark):
    chunks, images = some(spark)
    got = {x.id: x.context for x in r.page_contexts(chunks, images).collect()}
    assert got == {"i3": "Page 3: gamma ray of sand", "j3": "Page 3: gamma ray of sand", "i5": "Page 5: an image of a gamma ray log | Page 5: another gamma ray image"}
    one = r.image_context(chunks, {"page_number": 3, "geological_content": "gamma ray", "context_text": None}, "what is it", lambda t: NEAR).first().context
    assert one.startswith("Page 3: gamma ray of sand")
    assert r.image_context(chunks, {"page_number": 77, "geological_content": "", "context_text": None}, "", lambda t: NEAR).count() == 0


def test_related_context_leaves_itself_out(spark):
    chunks, _ = some(spark)
    got = {x.chunk_id for x in r.related_context(chunks, {"chunk_id": 1, "geological_terms": ["gamma ray"]}, "", lambda t: NEAR).collect()}
    assert 1 not in got and {3, 4, 5} <= got


def test_confidence_and_thresholds(spark):
    df = spark.createDataFrame([(0.5, None, 0.7), (None, None, None), (float("nan"), 0.2, None)], "a double, b double, c double")
    assert [round(x[0], 6) for x in df.select(r.interpretation_confidence([F.col(c) for c in "abc"])).collect()] == [0.6, 0.5, 0.2]
    sweep = spark.createDataFrame([(-0.3, 0.5), (-0.2, 0.5), (-0.4, 0.1)], "threshold double, mean_score double")
    assert [round(x, 6) for x in r.chosen_thresholds(sweep).first()] == [0.0, -0.2, -0.8]
    assert tuple(r.chosen_thresholds(sweep.limit(0)).first()) == (None, None, None)


def test_vocabulary(spark):
    rows = [chunk(1, "the Sand; Gamma, x2y bed: from", "t", 1, None, ["GR log", " Sand ", "SP"], "spem_geological_terms"), chunk(2, "shale", "t", 1, None)]
    assert {x.term for x in r.learned_vocabulary(spark.createDataFrame(rows, CHUNKS)).collect()} == {"sand", "gamma"}


def test_analyzed_image(spark):
    chunks, images = some(spark)
    x = pipelines.analyzed_image(chunks, images, "i5", "Which curve is it?", lambda path, q: f"{path} shows a Gamma curve").first()
    assert x.id == "i5" and x.answer == "x/i5.png shows a Gamma curve" and "gamma" in x.concepts and x.context.startswith("Page 5") and 0 < x.confidence <= 1
    assert pipelines.analyzed_image(chunks, images, "i5", "Which curve is it?").first().answer == "Well log types: gamma ray."
    assert pipelines.analyzed_image(chunks, images, "zz", "What?").first().id is None


def test_models_may_fail(spark):
    def broken(prompt):
        raise OSError("no route")

    df = spark.createDataFrame([("a", 1), (None, 2)], "prompt string, reply int")
    assert [x.reply for x in models.with_replies(df, broken).collect()] == ["Error: no route", None]
    assert models.seen(lambda p, q: "a log", "p", "q", None, broken) == ("a log", 0.4) and models.seen(lambda p, q: "a log", "p", "q", None, lambda t: "x" * 60)[1] == 0.8


def test_command_line(spark, data):
    assert cli.run(spark, [data, "-t", "text", "-q", "gamma ray"]).columns[0] == "chunk_id"
    assert cli.run(spark, [data, "-t", "find-images", "-q", "gamma ray"]).columns[0] == "id"
    name = spark.read.parquet(f"{data}/images.parquet").orderBy("id").first().id
    assert cli.run(spark, [data, "-t", "ask-image", "-i", name, "-q", "What is it?"]).first().id == name
    assert cli.run(spark, [data, "-t", "list-images"]).count() > 1
