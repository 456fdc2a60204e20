import pytest

from lithoflow.llm import repair as r

BLOCKS = "id string, source_file string, page_number int, text string, word string"
IMAGES = "id string, source_file string, page_number int, caption string, context_text string, pos int"
BODY = ["The sandstone drapes a boxcar pattern on the cross-bedding of the shelf.", "No claystone was seen between the markers and the cross-bedding.", "The sandstone contains claystone between the markers."]


def test_costs():
    for seen, true in [("c0ntains", "contains"), ("betvveen", "between"), ("anhyclrite", "anhydrite"), ("loggirig", "logging"), ("seqiience", "sequence"), ("caIiper", "caliper"), ("readin9", "reading")]:
        assert r.repair_cost(seen, true) == r.CONFUSION_COST, seen
        assert r.deletions(seen) & r.deletions(true)
    assert r.repair_cost("sand", "sand") == 0 and r.repair_cost("sand", "bend") > r.MOST_COST and r.repair_cost("sand", "sandstone") > r.MOST_COST


@pytest.mark.parametrize("line", ["[28]", "Page 28 of 90", "p. 28", "- 28 -", "— 28 —", "28", "28   Brae Block Review", "BRAE BLOCK REVIEW   28", "Brae Block Review  |  Chapter 3", "Chapter 3 - Brae Block Review"])
def test_running_lines(line):
    assert r.running_line(line, 28, set())


@pytest.mark.parametrize("line", ["4501 m, and the", "side.", "", "1.4 Funnel Pattern", "seen at 28", "97", "Brae Block Review", "Shale between 28"])
def test_body_lines(line):
    assert not r.running_line(line, 28, set())


def test_titles_read_alike():
    assert r.title_key("Brae B1ock Facies Review") == r.title_key("BRAE BLOCK FAClES REVIEW   12") == r.title_key("Chapter 1 - Brae Block Facies Review")
    assert r.title_key("the Brae sand below") is None


def test_reading():
    tokens, gone = r.read("A cross-\nbedding (wea¬\r\n[7]\r\nthered) base.\n\nNew 2-\n", 7, set())
    assert gone == ["[7]"]
    assert [(t.lead, t.word, t.trail, t.other) for t in tokens] == [("", "A", "", None), ("", "crossbedding", "", "cross-bedding"), ("(", "weathered", ")", "wea-thered"), ("", "base", ".", None), ("", "New", "", None), ("", "2", "-", None)]
    assert tokens[4].paragraph and r.read("", 1, set()) == ([], [])


def tables(spark, texts, images=()):
    blocks = [(f"c{i}", "s.pdf", 50 + i, BODY[i % 3], "z") for i in range(60)] + [(f"b{i}", "s.pdf", 1 + i, t, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(list(images), IMAGES)


def test_found(spark):
    texts = ["The c1aystone between\nBrae Block Review\nthe markcrs and the sand-\nstone", "No cross-\nbedding was seen on the Ithved0ven shelf\n2   BRAE B1OCK REVIEW", None, "", "Brae Block Review\nA clays-\ntone\n\n[5]", "The cr0ss-bed-\nding", "x" * 20_000]
    blocks, images = tables(spark, texts, [("i", "s.pdf", 3, "boxcor pattern", "clayst0ne bet-\nween", 1), ("j", None, None, None, "", 1), (None, "s.pdf", 1, "sandst0ne", None, 1)])
    got = {tuple(x) for x in r.found(blocks, images).collect()}
    assert got == {
        ("text_block", "b0", "word", "claystone"), ("text_block", "b0", "word", "markers"), ("text_block", "b0", "word", "sandstone"), ("text_block", "b0", "line", "Brae Block Review"),
        ("text_block", "b1", "word", "cross-bedding"), ("text_block", "b1", "word", "ithvedoven"), ("text_block", "b1", "line", "2   BRAE B1OCK REVIEW"),
        ("text_block", "b4", "word", "claystone"), ("text_block", "b4", "line", "Brae Block Review"), ("text_block", "b4", "line", "[5]"), ("text_block", "b5", "word", "cross-bedding"),
        ("image_caption", "i", "word", "boxcar"), ("image_context", "i", "word", "claystone"), ("image_context", "i", "word", "between"),
    }


def test_texts(spark):
    blocks, images = tables(spark, ["The C1aystone bet-\n\r[1]\nween.\n\nNo sandst0ne", None, ""])
    got = {x.id: x.text for x in r.repair_texts(r.scans(blocks.unionByName(blocks.filter("id = 'b0'")), images)).collect()}
    assert got["b0"] == "The Claystone between.\n\nNo sandstone" and got["b1"] is None and got["b2"] == "" and got["c0"] == BODY[0]


def test_empty(spark):
    blocks, images = spark.createDataFrame([], BLOCKS), spark.createDataFrame([], IMAGES)
    assert r.found(blocks, images).count() == 0 and r.repair_texts(r.scans(blocks, images)).count() == 0


CLEAN = "The zone1 and zone2 are type1 UTF8 sands.\n[12]\nChapter 3 - Deltaic Systems\nThe 1st 10m of well A1 and CO2."


def test_clean_text_stays(spark):
    blocks, images = tables(spark, [])
    blocks = blocks.unionByName(spark.createDataFrame([("k", "other.pdf", 40, CLEAN, "z")], BLOCKS))
    assert [tuple(x) for x in r.found(blocks, images).collect()] == []
    assert {x.text for x in r.repair_texts(r.scans(blocks, images)).filter("id = 'k'").collect()} == {CLEAN.replace("\n", " ")}


def test_only_candidates_repair(spark, monkeypatch):
    texts = ["The c1aystone between the markcrs and the sand-\nstone of Ithved0ven, no cl0y1 seen"]
    blocks, images = tables(spark, texts)
    real = r.candidates
    monkeypatch.setattr(r, "candidates", lambda forms: real(forms).limit(0))
    assert {x.restored for x in r.found(blocks, images).collect()} == {"sandstone"}


def test_recurrence_is_a_share_of_the_source(spark):
    page = [(f"p{i}", "big.pdf", i, f"{BODY[i % 3]}\nMore of it.", "z") for i in range(200)]
    often = [(f"q{i}", "big.pdf", i, f"Sand Ridge Atlas\n{BODY[i % 3]}", "z") for i in range(12)]
    few = [(f"r{i}", "big.pdf", i, f"Summary Of Results\n{BODY[i % 3]}", "z") for i in range(4)]
    got = r.found(spark.createDataFrame(page + often + few, BLOCKS), spark.createDataFrame([], IMAGES)).collect()
    assert {x.restored for x in got} == {"Sand Ridge Atlas"} and len(got) == 12


def test_keys_meet_for_any_two_confusions_at_any_length():
    import random

    rng = random.Random(3)
    for n in (3, 5, 9, 20, 26, 27, 40, 90):
        for _ in range(60):
            true = "".join(rng.choice("aeionrstlmdhbcu") for _ in range(n))
            at = sorted(rng.sample(range(0, n - 1, 2), min(2, n // 2)))
            seen, last = "", 0
            for i in at:
                units = [(u, t) for u, v in (*r.CONFUSIONS.items(), *((k, [g]) for k, g in r.CONFUSED_GROUPS.items())) for t in v if true.startswith(t, i) and i + len(t) <= n and len(t) < 3]
                if units:
                    u, t = rng.choice(units)
                    if i >= last:
                        seen, last = seen + true[last:i] + u, i + len(t)
            seen += true[last:]
            if seen != true:
                assert r.repair_cost(seen, true) <= r.MOST_COST and r.deletions(seen, r._READ_UNITS) & r.deletions(true, r._TRUE_UNITS), (seen, true)


def test_words_of_letters_and_signs():
    assert all(map(r.is_word, ("l0g", "0il", "0f", "c0a1", "5and", "zone1", "x" * 90))) and not any(map(r.is_word, ("10m", "5ft", "a1", "t0", "12", "m3", "1st")))
    assert "clay" in "".join(t.word for t in r.read("cl-\nay", 1, set())[0])
