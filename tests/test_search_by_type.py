from lithoflow.operators import search

SCHEMA = "chunk_id bigint, collection string, content string, content_type string, chunk_type string, page int, geological_terms array<string>, embedding array<float>"
TEXT = "spem_text_content"


def ranked(spark, rows, query="gamma ray", k=10):
    df = spark.createDataFrame([(i, c, t, kind, None, 1, None, v) for i, c, t, kind, v in rows], SCHEMA)
    return [(r.content_type, r["rank"], r.chunk_id, round(r.score, 6)) for r in search.search_by_type(df, query, [1.0, 0.0], ["text", "image_description"], k).orderBy("content_type", "rank").collect()]


def test_texts_by_vector_alone(spark):
    rows = [
        (1, TEXT, "gr only", "text", [1.0, 0.0]), (2, TEXT, "the gamma ray", "text", [0.6, 0.8]), (3, TEXT, "nothing", "text", [1.0, 0.0]),
        (4, TEXT, "ray, no vector", "text", None), (5, TEXT, "gamma, far off", "text", [-1.0, 0.0]), (6, TEXT, "gamma", "combined", [1.0, 0.0]),
    ]
    assert ranked(spark, rows) == [("text", 1, 1, 1.0), ("text", 2, 2, 0.6)]
    # the gate holds for long queries too
    assert ranked(spark, rows, "one gamma two") == [("text", 1, 2, 0.6)]


def test_images_by_their_match(spark):
    rows = [
        (1, search.IMAGES, "the gamma ray", "image_description", [0.6, 0.8]), (2, search.IMAGES, "a ray", "image_description", [0.6, 0.8]), (3, search.IMAGES, "gr of a well", "image_description", [1.0, 0.0]),
        (4, search.IMAGES, "gr alone", "image_description", [1.0, 0.0]), (5, search.IMAGES, "nothing", "image_description", [1.0, 0.0]),
    ]
    kind = "image_description"
    assert ranked(spark, rows) == [(kind, 1, 3, 1.14), (kind, 2, 1, 0.714), (kind, 3, 2, 0.702)]


def test_repeats_within_a_type(spark):
    rows = [(1, TEXT, "gamma ray", "text", [0.6, 0.8]), (2, TEXT, "gamma ray", "text", [1.0, 0.0]), (3, search.IMAGES, "gamma ray", "image_description", [1.0, 0.0])]
    assert [r[2] for r in ranked(spark, rows)] == [3, 2]
