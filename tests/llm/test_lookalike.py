import pickle
import unicodedata

from lithoflow.llm import lookalike as k

PLAIN = k.Rewriter({c: 1000 for c in map(chr, range(32, 127))})


def test_classes_are_disjoint_and_transitive():
    members = [m for c in k.look_alikes() for m in c]
    assert len(members) == len(set(members))
    by = {m: i for i, c in enumerate(k.look_alikes()) for m in c}
    assert by["a"] == by["а"] == by["ａ"] and by[" "] == by[" "] == by["　"] and by["é"] == by["é"] == by["е́"]


def test_same_look():
    for a, b in [("full １２", "ｆｕｌｌ 12"), ("café", "café"), ("a​b", "ab"), ("a b", "a b"), ("Коre", "Kоре"[:0] + "Kore"), ("5 µm", "5 μm"), ("⚠️", "⚠"), ("ё", "ё"), ("Ångström", "Ångström")]:
        assert PLAIN(a) == PLAIN(b), (a, b)


def test_another_look():
    for a, b in [("a", "A"), ("e", "é"), ("m3", "m³"), ("a  b", "a b"), ("a\nb", "a b"), ("a.", "a"), ("l", "I"), ("o", "0"), ("ﬁ", "fi"), ("-", "—"), ("'", "’")]:
        assert PLAIN(a) != PLAIN(b), (a, b)


def test_rewriting_is_stable_and_whole():
    for text in ["", "plain", "ｆｕｌｌ​ wіdth é é 漢字 🪨", "x" * 200_000 + "ѕ"]:
        form = PLAIN(text)
        assert PLAIN(form) == form and pickle.loads(pickle.dumps(PLAIN))(text) == form
    assert len(PLAIN("x" * 200_000 + "ѕ")) == 200_001


def test_representative_is_the_frequent_one(spark):
    cyrillic = spark.createDataFrame([("аааа a",), (None,), ("",)], "text string")
    assert k.fit(cyrillic, "text")("a") == "а"
    accents = spark.createDataFrame([("é é é",)], "text string")
    assert k.fit(accents, "text")("é") == "é" and unicodedata.normalize("NFC", k.fit(accents, "text")("é")) == "é"


def test_pairs(spark):
    rows = [(1, "a test", "x"), (2, "а test", "x"), (3, "a test", "x"), (4, "A test", "x"), (5, " ", "x"), (6, " ", "x"), (7, None, None), (8, "", ""), (9, "a​ test", "x"), (2, "а test", "x"), (None, "а​ test", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, look string")
    assert sorted(map(tuple, k.found(df).collect())) == [(1, 2), (1, 9), (2, 3), (2, 9), (3, 9)]
    assert k.found(df.limit(0)).count() == 0
    forms = k.one_form(df, "doc_id", "text").collect()
    assert len(forms) == len(rows) and {r.form for r in forms if r.doc_id in (1, 2, 3, 9)} == {"a test"} and [r.form for r in forms if r.doc_id == 7] == [None]


def test_every_member_is_spelled_like_its_class():
    for members in k.look_alikes():
        assert len({k.speller()(m) for m in members if m}) <= 1


def test_orders_of_accents():
    for texts in (["\u1ead", "a\u0302\u0323", "a\u0323\u0302", "\u00e2\u0323", "\u1ea1\u0302", "\u0430\u0302\u0323"], ["q\u0323\u0302", "q\u0302\u0323"], ["\u04d3\u0323", "a\u0308\u0323", "\u1ea1\u0308"], ["\ud55c", "\u1112\u1161\u11ab"], ["\uff76\uff9e", "\u30ac"]):
        assert len({PLAIN(x) for x in texts}) == 1, texts
    assert PLAIN("a\u0302\u0301") != PLAIN("a\u0301\u0302")  # one above the other


def test_shapes():
    for a, b in [("\u2160", "I"), ("\u13aa", "A"), ("\u2223", "|"), ("\U0001d400", "A"), ("\U0001d7ce", "0"), ("\u2206", "\u0394")]:
        assert PLAIN(a) == PLAIN(b), (a, b)
    for a, b in [("\U0001d434", "A"), ("\u2161", "II"), ("\u00b2", "2")]:
        assert PLAIN(a) != PLAIN(b), (a, b)


def test_forms_tell_looks_apart():
    """Texts have one form exactly if they are spelled alike, whatever the representatives are."""
    import random

    r = random.Random(4)
    some = [m for c in r.sample(k.look_alikes(), 60) for m in c[:4]] + ["a", "b", " ", "\u0301", "\u0323", "\u0308"]
    for counts in ({}, {m: r.randint(0, 9) for m in some}):
        w = k.Rewriter(counts)
        texts = ["".join(r.choice(some) for _ in range(r.randint(1, 4))) for _ in range(3000)]
        pairs = {(k.speller()(t), w(t)) for t in texts}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
        assert all(w(b) == b for _, b in pairs)


def test_longer_members_are_counted(spark):
    df = spark.createDataFrame([("a\u0323\u0302 " * 3 + "\u1ead",)], "text string")
    assert k.fit(df, "text")("\u1ead") == "a\u0323\u0302"


def test_classes(spark):
    df = spark.createDataFrame([(1, "a x"), (2, "\u0430 x"), (3, "a x"), (4, "b"), (5, None), (6, " "), (7, "b")], "doc_id bigint, text string")
    assert sorted(map(tuple, k.same_look_classes(df, "doc_id", "text").collect())) == [(1, 1, 3, 2), (2, 1, 3, 2), (3, 1, 3, 2), (4, 4, 2, 1), (7, 4, 2, 1)]
