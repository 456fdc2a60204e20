from pyspark.sql import functions as F

from lithoflow.functions import answers
from lithoflow.functions import text as tx
from lithoflow.operators import documents
from lithoflow.plans import models, pipelines, prompts


def value(spark, column, **kw):
    types = {str: "string", float: "double", int: "int", type(None): "string", list: "array<string>", bool: "boolean"}
    df = spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in kw.items())) if kw else spark.range(1)
    return df.select(column).first()[0]


def t(spark, f, text):
    return value(spark, f(F.col("t")), t=text)


def test_clean(spark):
    assert t(spark, tx.clean, "  a \n b • c – “d” Page 12 ") == 'a b *  c - "d"'
    assert t(spark, tx.clean, "17 \n") == "" and t(spark, tx.clean, None) is None


def test_sections(spark):
    rows = [(1, "before\nSequence Boundary here\nbody one\nPage 3\nDepositional Environment\n\n", 4), (2, "no header at all", 9), (3, None, 1), (4, "", 1)]
    got = documents.sections(spark.createDataFrame(rows, "k int, text string, page int"), "k", "text", "page")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "General", "before"), (1, 1, "Sequence Boundary here", "body one"), (2, 0, "Page 9", "no header at all")]


def test_overlapping_chunks(spark):
    def cuts(text):
        return [(r.start, r.stop) for r in t(spark, documents.overlapping_chunks, text)]

    assert cuts("") == [] and cuts("x" * 499) == [(0, 499)] and cuts("x" * 500) == [(0, 500)] and cuts("x" * 501) == [(0, 500), (450, 501)]
    assert cuts("x" * 1200) == [(0, 500), (450, 950), (900, 1200)]
    assert cuts("x" * 450 + "." + "y" * 200) == [(0, 451), (401, 651)]
    long = cuts("word. " * 20000)
    assert long[-1][1] == 120000 and all(b - a <= 500 for a, b in long) and all(y[0] < x[1] for x, y in zip(long, long[1:]))


def test_semantic_chunks(spark):
    f = lambda c: documents.semantic_chunks(c, ["sand", "shale"])
    assert t(spark, f, "Sand here. More of it! Shale there? End") == ["Sand here More of it", "Shale there End"]
    assert t(spark, f, None) == [] and t(spark, f, "...") == []
    assert [len(x) for x in t(spark, f, ("a" * 300 + ". ") * 3)] == [300, 300, 300]


def test_terms(spark):
    assert t(spark, lambda c: tx.terms_in(c, ["RS", "sand"]), "Shores of SANDSTONE") == ["sand"]
    assert t(spark, lambda c: tx.terms_in(c, ["RS", "sand"]), "first years") == ["RS"]
    assert t(spark, lambda c: tx.terms_in(c, ["TS", "sand"], whole_words=True), "boats, sand.") == ["sand"]


def test_kinds(spark):
    assert t(spark, tx.chunk_kind, "funnel and bell trend") == "pattern"
    assert value(spark, tx.image_kind(F.col("a"), F.col("b")), a="An outcrop", b=None) == "field_photo"
    assert value(spark, tx.block_kind(F.lit("x"), F.lit(15.0), F.lit(16))) == "header"
    assert value(spark, tx.block_kind(F.lit(" Fig. 3"), F.lit(None).cast("double"), F.lit(None).cast("int"))) == "caption"
    assert t(spark, tx.page_of, "| Page 12 |") == 12 and t(spark, tx.page_of, "none") == 0
    assert t(spark, tx.caption_in, "see Figure 3: a fold. Next") == "Figure 3: a fold"


def test_statements(spark):
    f = lambda c: tx.statements(c, ["evidence", "shown by"], 5, 5)
    assert t(spark, f, "Evidence of sand. It is shown by cores and evidence from logs") == ["Evidence of sand", "evidence from logs", "shown by cores and evidence from logs"]
    assert t(spark, f, "evidence cut by\na line. done") == []


def test_visual_indicators(spark):
    c = tx.visual_indicators(F.lit(120.0), F.lit(90.0), F.lit(80.0), F.lit(900), F.lit(200), F.lit("GR and resistivity"))
    assert value(spark, c) == ["reddish_coloration", "grayscale_pattern", "horizontal_log_pattern", "gamma_ray_log", "resistivity_log"]


def test_reply_cleaned(spark):
    reply = "The channel sand is clean and thick here.\n\nThe channel sand is clean and thick here!!\n\nshort\n\nAnother paragraph with ***** words that ends. And then breaks o"
    assert t(spark, answers.without_repetition, reply) == "The channel sand is clean and thick here.\n\nAnother paragraph with ** words that ends."


def test_question_enhanced(spark):
    c = answers.enhanced_question(F.lit("what does this image show"), F.array(F.lit("Sedimentary rocks from strata")), F.lit("sand; shale"), F.lit(None).cast("string"))
    assert value(spark, c) == "geological rocks sedimentary strata classification"
    c = answers.enhanced_question(F.lit("explain it"), F.lit(None).cast("array<string>"), F.lit("sand; shale; coal"), F.lit(None).cast("string"))
    assert value(spark, c) == "geological sand shale analysis"


def test_follow_ups():
    pages, kinds = [4, 9, None], ["text", "image_description", "text"]
    assert answers.referred("what does result 2 show", pages, kinds) == 1
    assert answers.referred("explain page 9", pages, kinds) == 1
    assert answers.referred("and number 1?", pages, kinds) == 0
    assert answers.referred("number 9", pages, kinds) == 1
    assert answers.referred("tell me more", pages, kinds) == 1 and answers.referred("x", [], []) is None
    assert answers.is_follow_up("what does this mean", True) and not answers.is_follow_up("sand", True)
    assert answers.is_specific("Guarico", {"sand"}) and not answers.is_specific("sand", {"sand"}) and answers.is_specific("xyz", set())


def test_images_resolved(spark):
    df = spark.createDataFrame([("img_7", 3), ("img_71", 7)], "id string, page_number int")
    assert answers.resolve_image(df, "img_7").first().id == "img_7" and answers.resolve_image(df, "page_3").first().id == "img_7" and answers.resolve_image(df, "zz").count() == 0


def test_answer_scores(spark):
    c = tx.answer_confidence(F.lit(False), F.array(F.lit("a")), F.lit("unknown"), F.lit("x" * 30), F.lit("what is sand"), F.lit("sand is what"))
    assert value(spark, c) == 0.8
    assert value(spark, answers.relevance_label(F.lit(0.5))) == "Moderate"
    assert value(spark, answers.content_description(F.lit("nothing"))) == "miscellaneous geological content"
    assert value(spark, answers.explanation(F.lit("a"), F.lit(None).cast("string"), F.array(F.lit("b")), F.lit(""))) == "Image description: a | Key geological concepts: b"


def test_knowledge_pipeline_and_interpretation(spark, data):
    pages = spark.createDataFrame([(1, "Sequence Boundary\n" + "Evidence of an erosive boundary in sand. " * 30, 5), (2, None, 1)], "doc_id int, text string, page int")
    chunks = pipelines.knowledge_chunks(pages, "doc_id", "text", "page").withColumn("chunk_id", F.xxhash64("id"))
    assert chunks.count() >= 3 and chunks.filter("size(embedding) = 384").count() == chunks.count()
    samples = spark.read.parquet(f"{data}/curve_samples.parquet")
    reply = "A lowstand tract in a shallow channel. Evidence from the cores is clear here. We recommend more logs soon."
    r = pipelines.interpretations(samples, chunks, "patterns", lambda prompt: reply if "Patterns:" in prompt else "").first()
    assert r.systems_tracts == ["LST"] and r.environment == "shallow channel" and len(r.evidence) == 1 and len(r.recommendations) == 1
    for mode in prompts.TASKS:
        assert pipelines.interpretations(samples, chunks, mode).columns[0] == "curve_id"


def test_embedder(spark):
    df = spark.createDataFrame([(1, "gamma ray"), (2, None), (3, "")], "k int, t string")
    r = {x.k: x.embedding for x in models.embedded(df, "k", "t").collect()}
    assert abs(sum(v * v for v in r[1]) - 1) < 1e-5 and r[2] is None and set(r[3]) == {0.0}


def test_whole_words_against_brute_force(spark):
    """In place of SQL, which takes a pattern for each text and term and doesn't end on whole tables."""
    import re

    terms = ["gamma ray", "ray", "Bed", "cross-bed", "SB", "p.u."]
    texts = ["Gamma Ray log", "gammaray x-ray", "bedded bed", "a cross-bed, cross-beds", "SB/sb2 _sb_", "p.u. pxu.", "", None, "RAY" * 5000 + " ray", "Ärayé ray\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.t for r in df.select("i", tx.terms_in(F.col("text"), terms, whole_words=True).alias("t")).collect()}
    want = {i: [] if x is None else [t for t in terms if re.search(rf"(?<![^\W_]){re.escape(t.lower())}(?![^\W_])", x.lower())] for i, x in enumerate(texts)}
    assert got == want
