import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lithoflow.llm import encode as e

FOLDER = os.path.dirname(e.TOKENIZER)
pytestmark = pytest.mark.skipif(not os.path.exists(e.TOKENIZER), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def reference():
    with open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "a" * 100, " " * 90, "\n\n\t x", "<|endoftext|>", "ababab" * 30, "0000000001111", "don't we'll I'VE", "naïve Ωμέγα 漢字 🪨⚠️", "​z w", "x=1;y=2\r\n", "é" * 40, "=" * 65]


def test_hard_texts(reference):
    a = e.automaton()
    for text in HARD:
        assert a.encode(text) == reference.encode_ordinary(text) and a.decode(a.encode(text)) == text
    assert a.encode(None) == []


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(reference, text):
    a = e.automaton()
    ids = a.encode(text)
    assert ids == reference.encode_ordinary(text) and a.decode(ids) == text


def test_documents(spark, data, reference):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in e.encode_texts(docs, "doc_id", "text").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == {k: reference.encode_ordinary(t or "") for k, t in texts.items()}
    back = {r.doc_id: r.text for r in e.decode_ids(e.encode_texts(docs, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {k: t or "" for k, t in texts.items()}


def test_one_state_accepts_only_correct_pairs():
    a = e.automaton()
    by = a.ids
    assert not a.accepts(by[b"t"], by[b"h"]) and a.accepts(by[b"th"], by[b"z"])


def test_rows(spark, reference):
    df = spark.createDataFrame([("k", "a b", 1), ("k", "a b", 2), (None, None, None), ("e", "", 0), ("long", "word " * 50_000, 0)], "doc_id string, text string, ids int")
    got = sorted(((r.doc_id or "", tuple(r.ids)) for r in e.encode_texts(df, "doc_id", "text").collect()), key=lambda x: (x[0], len(x[1])))
    ab = tuple(reference.encode_ordinary("a b"))
    assert got[:4] == [("", ()), ("e", ()), ("k", ab), ("k", ab)] and len(got[4][1]) == 50_001
    assert e.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def written_out(merges, letters):
    """The gadgets carried out on explicit states with explicit arcs: of each token, the tokens its state accepts."""
    arcs, target = [{c: 0 for c in letters}], {c: 0 for c in letters}
    for u, v in merges:
        w, old = u + v, target[u]
        if w in target or v not in arcs[old]:
            continue
        arcs.append({k: t for k, t in arcs[old].items() if k != v})
        copy, after = len(arcs) - 1, arcs[old][v]
        for state in arcs:
            if u in state:
                state[w] = after
                state[u] = copy
        target[u], target[w] = copy, after
    return {token: set(arcs[t]) for token, t in target.items()}


def vocabulary(tmp_path, merges, letters):
    import json

    tokens = list(dict.fromkeys([*letters, *(u + v for u, v in merges)]))
    path = tmp_path / f"{len(merges)}-{hash(tuple(merges))}.json"
    path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges]}}))
    return e.Automaton(str(path)), tokens


def test_arcs_are_those_of_the_gadgets_for_every_pair_of_tokens(tmp_path):
    import json
    import random

    with open(e.TOKENIZER, encoding="utf-8") as f:
        real = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"][:250]]
    lists = [(real, sorted({c for m in real for t in m for c in t}))]
    r = random.Random(7)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(r.randint(3, 14)):
            u, v = r.choice(tokens), r.choice(tokens)
            # a merge of tokens that never stand side by side by then makes none
            if u + v not in tokens and len(u + v) < 9 and v in written_out(merges, "abc")[u]:
                merges.append((u, v))
                tokens.append(u + v)
        lists.append((merges, list("abc")))
    for merges, letters in lists:
        want = written_out(merges, letters)
        a, tokens = vocabulary(tmp_path, merges, letters)
        of = dict(zip(tokens, range(len(tokens))))
        for u in want:
            assert {v for v in want if a.accepts(of[u], of[v])} == want[u], (merges, u)


def test_executors_do_not_read_the_file(spark, tmp_path):
    merges = [("a", "b"), ("ab", "c")]
    _, tokens = vocabulary(tmp_path, merges, list("abc"))
    path = next(tmp_path.glob("2-*.json"))
    df = e.encode_texts(spark.createDataFrame([(1, "abcab"), (2, None)], "doc_id bigint, text string"), "doc_id", "text", str(path))
    path.unlink()
    assert {r.doc_id: r.ids for r in df.collect()} == {1: [4, 3], 2: []}
