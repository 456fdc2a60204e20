import random

import pytest

from lithoflow.functions import vocab
from lithoflow.operators import search

SCHEMA = "chunk_id bigint, collection string, content string, content_type string, chunk_type string, page int, geological_terms array<string>, embedding array<float>"


def rows(texts, collection=search.IMAGES, kind="image_description"):
    return [(i, collection, t, kind, None, 1, None, [1.0, 0.0]) for i, t in enumerate(texts)]


def by_rule(query, text):
    """The rule in plain Python, for a text in lower case."""
    q = query.strip().lower()
    if q in text:
        return 0.95
    for v in search.variations(query):
        if v in text:
            at = text.find(v)
            around = text[max(0, at - 30) : at + len(v) + 30]
            if len(v) > 2:
                return 0.85
            if any(w in around for w in vocab.INDICATOR_WORDS):
                return 0.70
    words = q.split()
    places = [text.find(w) for w in words if w in text]
    if len(words) > 1 and len(places) / len(words) >= 0.7:
        return 0.60 * len(places) / len(words)
    if len(words) > 1 and len(places) / len(words) >= 0.5 and len(places) >= 2 and max(places) - min(places) < 50:
        return 0.48
    return None


def test_exact_finds_images(spark):
    texts = ["A Sequence Boundary", "a boundary here", "the sb of a well", "the sb alone", "x" * 40 + "sb" + "y" * 30 + "well", "x" * 40 + "sb" + "y" * 26 + "well", "nothing", None, ""]
    got = {r.chunk_id: r.score for r in search.exact(spark.createDataFrame(rows(texts), SCHEMA), "sequence boundary").collect()}
    assert got == {0: 0.95, 1: 0.85, 2: 0.70, 5: 0.70}


def test_words_near_each_other(spark):
    # words of two letters alone aren't enough without an indicator; together they are
    texts = ["to be", "to" + " " * 60 + "be", "to", "to of", "to" + " " * 60 + "of"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert {r.chunk_id: r.score for r in search.exact(df, "be to").collect()} == {0: 0.60, 1: 0.60}
    assert {r.chunk_id: r.s for r in df.select("chunk_id", search.image_match("to be of if").alias("s")).collect()} == {0: 0.48, 1: None, 2: None, 3: 0.48, 4: None}


@pytest.mark.parametrize("query", ["sequence boundary", "gr", "of a log", "of to be is", "Gamma Ray"])
def test_against_the_rule(spark, query):
    rng = random.Random(4)
    pool = ["of", "to", "be", "is", "sb", "gr", "a", "log", "well", "sand", "sequence", "boundary", "gamma", "ray", "gamma ray", "q" * 35, "z" * 28]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(600)]
    got = [r.s for r in spark.createDataFrame(rows(texts), SCHEMA).select("chunk_id", search.image_match(query).alias("s")).orderBy("chunk_id").collect()]
    assert [x and round(x, 9) for x in got] == [x and round(x, 9) for x in (by_rule(query, t) for t in texts)]


def test_no_collection_is_no_image(spark):
    df = spark.createDataFrame(rows(["a Gamma Ray"], None), SCHEMA)
    assert [r.score for r in search.exact(df, "gamma ray").collect()] == [0.85]


def test_data_image_hits(spark, data):
    df = spark.read.parquet(f"{data}/chunks.parquet")
    want = {(r.chunk_id, by_rule("gamma ray", r.content.lower())) for r in df.filter(df.collection == search.IMAGES).collect() if r.content is not None}
    want = {x for x in want if x[1] is not None}
    got = {(r.chunk_id, r.score) for r in search.exact(df, "gamma ray").filter(df.collection == search.IMAGES).collect()}
    assert got == want
