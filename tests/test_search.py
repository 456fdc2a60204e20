from lithoflow.operators import search

SCHEMA = "chunk_id bigint, collection string, content string, content_type string, chunk_type string, page int, geological_terms array<string>, embedding array<float>"
ROWS = [
    (1, "spem_text_content", "A Gamma Ray log", "text", "geological_text", 1, ["gamma ray"], [1.0, 0.0]),
    (2, "spem_text_content", "the gamma ray again", "text", "geological_text", 2, None, [0.0, 1.0]),
    (3, "spem_image_metadata", "gamma ray picture", "image_description", None, 1, [], [1.0, 0.0]),
    (4, "spem_text_content", None, "text", None, None, None, None),
    (5, "spem_text_content", "", "text", None, 3, [], [0.0, 0.0]),
    (6, "spem_geological_knowledge", "gr of a ray", "text", "pattern", 1, ["gamma ray"], [0.6, 0.8]),
]


def chunks(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def test_variations():
    assert search.variations("Gamma Ray") == ["gamma", "gamma_ray", "gr", "ray"] and search.variations("sand") == []


def test_exact(spark):
    got = {r.chunk_id: r.score for r in search.exact(chunks(spark), "gamma ray").collect()}
    assert got == {1: 0.85, 2: 0.95, 6: 0.95}
    assert search.exact(chunks(spark), "one two three four").count() == 0 and search.exact(chunks(spark), "").count() == 0


def test_nearest_ties_and_unusable(spark):
    got = [(r.chunk_id, r["rank"]) for r in search.nearest(chunks(spark), [1.0, 0.0], 3).orderBy("rank").collect()]
    assert got == [(1, 1), (3, 2), (6, 3)]
    assert search.nearest(chunks(spark), [1.0, 0.0, 0.0], 3).count() == 0 and search.nearest(chunks(spark, []), [1.0, 0.0], 3).count() == 0


def test_knowledge_threshold_after_choice(spark):
    assert [r.chunk_id for r in search.knowledge(chunks(spark), [1.0, 0.0], 5, "pattern").collect()] == [6]
    assert search.knowledge(chunks(spark), [-1.0, 0.0], 5).count() == 0


def test_pages(spark):
    assert [tuple(r) for r in search.search_by_page(chunks(spark), [1]).collect()] == [(1, 1, 1.0), (3, 1, 1.0), (6, 1, 1.0)]
    # both full scores on page 1 are cut to 1, so the id decides
    got = [(r.chunk_id, r.page, round(r.score, 6)) for r in search.search_by_page(chunks(spark), [1, 2], "gamma ray", [1.0, 0.0]).collect()]
    assert got == [(1, 1, 1.0), (3, 1, 1.0), (2, 2, 0.7)]


def test_repeats(spark):
    rows = [(i, "c", "x" * 100 + str(i), "text", None, 1, None, None) for i in range(3)] + [(9, "c", "y", "text", None, 1, None, None)]
    assert sorted(r.chunk_id for r in search.without_repeats(chunks(spark, rows), ["chunk_id"]).collect()) == [0, 9]


def test_variety(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, "c", 4)], "chunk_id int, content_type string, rank int")
    assert [r.chunk_id for r in search.diversified(df, 3).orderBy("place").collect()] == [1, 3, 4]


def test_counts(spark):
    assert {r.collection: (r.chunks, r.vectors) for r in search.collection_counts(chunks(spark)).collect()}["all"] == (6, 5)
