import random

import numpy as np

from lithoflow.llm import leak

WORDS = ["sand", "shale", "coal", "bed", "fold", "dune", "bar", "lobe", "silt", "clay", "marl", "chalk", "slope", "shelf", "basin", "delta"]
ITEMS = "item_id bigint, passage string, run int"
DOCS = "doc_id bigint, text string, item_id string"


def brute(docs, items):
    def words(t):
        return leak.words(t, lambda x: x)

    seen = {}
    for i, p in items:
        w = words(p or "")
        for k in range(len(w) - 11):
            seen.setdefault(tuple(w[k : k + 12]), set()).add(i)
    return sorted({(d, i) for d, t in docs for w in [words(t or "")] for k in range(len(w) - 11) for i in seen.get(tuple(w[k : k + 12]), ())})


def found(spark, docs, items):
    df = leak.found(spark.createDataFrame([(d, t, "z") for d, t in docs], DOCS), spark.createDataFrame([(i, p, 1) for i, p in items], ITEMS))
    return sorted(map(tuple, df.collect()))


def test_against_brute_force(spark):
    r = random.Random(5)
    passages = [" ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n)) for n in (12, 13, 30, 60, 11, 5)]
    items = list(enumerate(passages)) + [(90, passages[2]), (91, None), (92, ""), (93, passages[2].upper() + "!")]
    docs = []
    for d in range(80):
        w = r.choice(passages).split()
        a = r.randrange(len(w))
        part = w[a : a + r.randint(8, 16)]
        docs.append((d, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 20))) + r.choice([" ", "\n", " ... "]) + r.choice([" ", "\n-", ", "]).join(part) + " end"))
    docs += [(200, None), (201, ""), (202, "…"), docs[3], (203, " ".join(passages) * 50)]
    got = found(spark, docs, items)
    assert got == brute(docs, items) and any(i == 90 for _, i in got)


def test_characters_and_documents_apart(spark):
    p = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, p.replace("o", "о")), (2, p.upper()), (3, "one two three four five six"), (4, "seven eight nine ten eleven twelve"), (5, p.replace(" ", " ​, "))]
    assert found(spark, docs, [(7, p)]) == [(1, 7), (2, 7), (5, 7)]


def test_substitutions_are_overlaps(spark):
    p = [f"w{i}" for i in range(40)]
    changed = [*p]
    for i in (8, 17, 26, 35):
        changed[i] = "zz"
    docs = spark.createDataFrame([(1, " ".join(changed), "z")], DOCS)
    r = leak.find_passages(docs, "doc_id", "text", spark.createDataFrame([(1, " ".join(p), 1)], ITEMS)).first()
    assert r.overlap == 40 and r.run == 8


def test_blocks_and_empty(spark):
    p = [" ".join(f"{c}{i}" for i in range(15)) for c in "abc"]
    docs, items = spark.createDataFrame([(1, " ".join(p), "z")], DOCS), spark.createDataFrame([(i, t, 1) for i, t in enumerate(p)], ITEMS)
    assert sorted(r.item_id for r in leak.find_passages(docs, "doc_id", "text", items, block_words=15).collect()) == [0, 1, 2]
    assert leak.found(docs, items.limit(0)).count() == 0 and leak.found(docs.limit(0), items).count() == 0


def test_the_join_finds_the_same(spark, monkeypatch):
    real = leak.find_passages
    monkeypatch.setattr(leak, "find_passages", lambda *a: real(*a, block_words=1))
    monkeypatch.setattr(leak, "MAP_BITS", 12)
    test_against_brute_force(spark)
    test_characters_and_documents_apart(spark)


def test_the_join_over_the_tables_and_repeated_rows(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    docs = docs.unionByName(docs)
    one, two = (sorted(map(tuple, leak.find_passages(docs, "doc_id", "text", items, b).collect())) for b in (leak.BLOCK_WORDS, 10))
    assert one == two and len(one) > len(set(one)) > 0


def test_many_passage_words(spark):
    """Over ten million passage words, with a sentence that a third of the passages share."""
    rng = np.random.default_rng(3)
    shared = " ".join(f"s{i}" for i in range(14))
    passages = spark.range(60_000, numPartitions=8).selectExpr("id as item_id", f"""concat(array_join(transform(sequence(1, 170), i -> concat('w', xxhash64(id, i) % 5000000)), ' '), if(id % 3 = 0, ' {shared}', '')) as passage""")
    some = {r.item_id: r.passage.split() for r in passages.filter("item_id % 20000 = 7").collect()}
    docs = [(i, " ".join(["x"] * int(rng.integers(0, 9)) + p[20 : 20 + n])) for i, p in some.items() for n in [12 + i % 5]] + [(900_001, "none of it"), (900_002, None)]
    got = leak.found(spark.createDataFrame([(i, t, "z") for i, t in docs], DOCS), passages)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in sorted(some)]
    assert leak.found(spark.createDataFrame([(1, shared, "z")], DOCS), passages).count() == 20_000
