import numpy as np
import pytest

from lithoflow.llm import vectors as v

SCHEMA = "chunk_id bigint, embedding array<float>, id string, rep int"


def rows(x, start=0):
    return [(start + i, [float(c) for c in r], "z", 1) for i, r in enumerate(x)]


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 48))
    near = base[:90] + 0.30 * rng.standard_normal((90, 48)) * np.linalg.norm(base[:90], axis=1, keepdims=True) / np.sqrt(48)
    return np.vstack([base, near, base[:10], 5 * base[10:15]]).astype(np.float32)


def cosines(x):
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_pairs_against_brute_force(spark, clouds):
    c = cosines(clouds)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(c >= 0.92, 1)))}
    got = {tuple(r) for r in v.found(spark.createDataFrame(rows(clouds), SCHEMA)).collect()}
    assert len(want) > 90 and not got - want and len(got & want) >= 0.98 * len(want)


def test_pairs_just_over_the_limit(spark):
    rng = np.random.default_rng(5)
    a, r = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 600, 384)))
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    c = np.linspace(0.9201, 0.94, 600)[:, None]
    x = np.vstack([a, c * a + np.sqrt(1 - c * c) * r])
    got = {tuple(p) for p in v.found(spark.createDataFrame(rows(x), SCHEMA)).collect()}
    want = {(i, i + 600) for i in range(600)}
    assert got <= want and len(got) >= 0.98 * len(want)
    # at the limit itself, where the scheme is weakest
    assert sum((i, i + 600) in got for i in range(150)) >= 0.98 * 150


def test_copies_make_all_their_pairs(spark):
    one = [0.1 * i for i in range(48)]
    df = spark.createDataFrame(rows([one] * 6) + rows([one])[:1], SCHEMA)
    assert v.found(df).count() == 15


def test_unusable_vectors(spark):
    one = [1.0] * 8
    df = spark.createDataFrame([(1, None, "", 0), (2, [], "", 0), (3, [0.0] * 8, "", 0), (4, [float("nan")] * 8, "", 0), (5, [float("inf")] * 8, "", 0), (6, [None] * 8, "", 0), (7, one, "", 0), (8, [2.0] * 8, "", 0), (9, [1.0] * 9, "", 0), (None, one, "", 0), (10, [1e38] * 8, "", 0)], SCHEMA)
    assert sorted(map(tuple, v.found(df).collect())) == [(7, 8), (7, 10), (8, 10)]
    assert v.found(df.limit(0)).count() == 0 and v.nearest(df.limit(0), "chunk_id", "embedding", df.limit(0)).count() == 0
    assert {r.other for r in v.nearest(df, "chunk_id", "embedding", df.filter("chunk_id = 7")).collect()} == {8, 10}


def test_nearest_recall(spark, clouds):
    df = spark.createDataFrame(rows(clouds), SCHEMA)
    c = cosines(clouds)
    np.fill_diagonal(c, -2)
    got = v.nearest(df, "chunk_id", "embedding", df.filter("chunk_id % 5 = 0"), 10).collect()
    hit = sum(r.other in set(np.argsort(-c[r.id])[:10]) for r in got)
    assert hit >= 0.9 * 10 * len({r.id for r in got})
    assert {(r.id, r.place) for r in got} == {(q, p) for q in range(0, len(clouds), 5) for p in range(1, 11)}
    blocks = v.nearest(df, "chunk_id", "embedding", df.filter("chunk_id % 5 = 0"), 10, block=7).collect()
    # sums of floats may differ in their last digits
    one, two = ({(r.id, r.place): r.cosine for r in x} for x in (got, blocks))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-5 for k in one)


def test_probe_sets():
    sets = v.probe_sets(4, 12)
    assert sets[0] == (0,) and len(set(sets)) == 12 and all(7 - r not in s for s in sets for r in s)


def test_data_recall(spark, data):
    df = spark.read.parquet(f"{data}/chunks.parquet")
    p = [(r.chunk_id, r.embedding) for r in df.select("chunk_id", "embedding").collect() if r.embedding and any(r.embedding)]
    ids, c = np.array([x[0] for x in p]), cosines(np.array([x[1] for x in p], dtype=np.float32))
    want = {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in zip(*np.nonzero(np.triu(c >= 0.92, 1)))}
    assert {tuple(r) for r in v.found(df).collect()} == want


def test_classes(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal(48)
    x = [a] * 4 + [a + 0.02 * rng.standard_normal(48)] + [rng.standard_normal(48)] * 3 + [-a]
    pairs, member = v.similar_classes(spark.createDataFrame(rows(x), SCHEMA), "chunk_id", "embedding")
    assert [tuple(r) for r in pairs.collect()] == [(0, 4)]
    assert sorted(map(tuple, member.collect())) == [(0, 0), (0, 1), (0, 2), (0, 3), (5, 5), (5, 6), (5, 7)]


def topics(n, seed, d=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    return (centres[rng.integers(0, 12, n)] + 1.2 * rng.standard_normal((n, d))).astype(np.float32)


def test_nearest_by_buckets_over_a_hot_bucket_and_blocks(spark, monkeypatch):
    """More rows than the sample, regions of few rows, buckets in parts: recall and share of all rows that are compared."""
    x = topics(3000, 11)
    x[:900] = x[0] + 0.01 * np.random.default_rng(2).standard_normal((900, 64))
    monkeypatch.setattr(v, "FIT_ROWS", 1000)
    monkeypatch.setattr(v, "REGION_ROWS", 200)
    df = spark.createDataFrame(rows(x), SCHEMA)
    c = cosines(x)
    np.fill_diagonal(c, -2)
    got = v.nearest(df, "chunk_id", "embedding", df.filter("chunk_id % 50 = 0"), 10, block=17).collect()
    least = {q: np.sort(c[q])[-10] for q in range(0, 3000, 50)}
    assert len(got) == 600 and sum(c[r.id][r.other] >= least[r.id] - 1e-6 for r in got) >= 0.9 * 600


def test_every_query_has_its_k_whatever_it_meets(spark):
    x = np.vstack([topics(2000, 5), -50 * topics(1, 6)])
    narrow = v.Scheme(tables=1, hashes=10, width=0.4, probes=2, subspace=10)
    df = spark.createDataFrame(rows(x), SCHEMA)
    real = v.Finder._recall
    v.Finder._recall = lambda *a: 1.0
    try:
        got = v.nearest(df, "chunk_id", "embedding", df.filter("chunk_id % 500 = 0"), 10, narrow).collect()
    finally:
        v.Finder._recall = real
    assert {(r.id, r.place) for r in got} == {(q, p) for q in (0, 500, 1000, 1500, 2000) for p in range(1, 11)}


def test_data_nearest(spark, data):
    """Over every id divisible by 50, against brute force."""
    df = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/chunks.parquet")
    p = [(r.chunk_id, r.embedding) for r in df.select("chunk_id", "embedding").collect() if r.embedding and any(r.embedding)]
    ids, c = np.array([a[0] for a in p]), cosines(np.array([a[1] for a in p], dtype=np.float32))
    np.fill_diagonal(c, -2)
    got = {(r.id, r.other) for r in v.nearest(df, "chunk_id", "embedding", df.filter("chunk_id % 50 = 0")).collect()}
    want = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 50 == 0) for j in np.argsort(-c[i])[:10]}
    assert len(got & want) >= 0.9 * len(want)
