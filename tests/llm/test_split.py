import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoflow.llm import split as s


def check(text, limit=s.LIMIT, overlap=s.OVERLAP):
    cut = s.pieces(text, limit, overlap)
    assert "".join(text[core:end] for _, core, end in cut) == text
    assert all(end - start <= limit for start, _, end in cut)
    assert all(b[1] == a[2] and b[0] > a[0] for a, b in zip(cut, cut[1:]))
    assert s.forced(text, cut) == bool(re.search(r"\S{%d}" % (limit + 1), text))
    return cut


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n;é ", max_size=300), st.integers(12, 40))
def test_any_text(text, limit):
    check(text, limit, 5)


def test_boundaries_are_preferred():
    text = ("One sentence here. " * 12 + "\n\n" + "Another sentence there. " * 12).strip()
    cut = check(text)
    assert all(text[core - 2] in ".\n" for _, core, _ in cut[1:])


def test_overlap_is_the_nearest_a_boundary_allows():
    text = " ".join("word%03d" % i for i in range(200))
    for start, core, _ in check(text)[1:]:
        assert 46 <= core - start <= 54 and text[start - 1] == " "
    assert {core - start for start, core, _ in check("x" * 2000)[1:]} == {50}


@pytest.mark.parametrize("text", ["x" * 499, "x" * 500, "y z " * 125])
def test_within_the_limit(text):
    assert s.pieces(text) == [(0, 0, len(text))]


def test_edges():
    assert s.pieces(None) == [] and s.pieces("") == []
    check(" " * 1500)
    check("a " + " " * 700 + "b" * 510)
    check("x" * 480 + " " + "y" * 490 + " z")
    r = random.Random(3)
    check("".join(r.choice("abc def. \n") for _ in range(60_000)))


def test_rows(spark):
    schema = "chunk_id bigint, content string, piece string, start int"
    df = spark.createDataFrame([(1, "w " * 400, "p", 1), (2, "x" * 501, "p", 1), (2, "x" * 501, "p", 1), (3, None, None, None), (4, "", "", 0), (5, "é" * 500, "", 0)], schema)
    assert sorted(map(tuple, s.found(df).collect())) == [(1, 0), (2, 1), (2, 1)]
    p = s.split_texts(df, "chunk_id", "content")
    assert {r.chunk_id for r in p.collect()} == {1, 2, 5} and s.split_texts(df.limit(0), "chunk_id", "content").count() == 0
    with pytest.raises(ValueError):
        s.split_texts(df, "chunk_id", "content", 50, 50)
