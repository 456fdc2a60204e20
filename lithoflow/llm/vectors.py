"""Similar vectors (multiprobe p-stable hashing).

A vector of length 1 is hashed by ``hashes`` projections on Gaussian directions, cut into steps of ``width``;
the tuple of the steps is its bucket in a table.  A query visits, in each table, its own bucket and then those
that differ in the steps it is close to the edge of, in the order of their estimated chance of success: which
sets of edges to cross comes from their expected distances by rank, and each query has its own ranking.
Candidates of all tables are merged and ranked by exact distance.

Pairs over a threshold are found by joins on the bucket.  Copies of one vector are found first and hashed once;
a compact sketch in the joined rows drops most chance meetings before vectors are fetched.

The nearest of many queries are found by sending rows and queries to regions, each the buckets of one remainder:
a row goes to the region of its bucket, a query once to every region that has a bucket it visits, and the
vectors that meet in a bucket are compared there.  The directions are taken in the subspace in which a bounded
sample of the rows varies most, and as many of them as keep the sample's own neighbours in the visited buckets.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

SEED = 7919
SKETCH_BITS = 128


@dataclass(frozen=True)
class Scheme:
    """Parameters of the hash tables."""

    tables: int
    hashes: int
    width: float
    probes: int
    #: dimensions of the subspace that is hashed; 0 hashes the vectors as they are
    subspace: int = 0


#: For pairs of a cosine of 0.92 or more (distance 0.4 or less; at 0.92 itself some 6 in 1,000 are missed), and for the nearest
#: of vectors without near copies.
PAIRS = Scheme(tables=12, hashes=20, width=2.2, probes=14)
NEAREST = Scheme(tables=1, hashes=14, width=1.8, probes=700, subspace=14)
#: Bits of the sketch in which a pair may differ: at a cosine of 0.92 16.4 with a deviation of 3.8.
MOST_BITS = 36
#: Queries held at once in a region, and rows in one on average; of a bucket larger than this share of all rows, or than
#: a region, parts are regions of their own.
BLOCK_QUERIES, REGION_ROWS, HOT_SHARE = 32_768, 4096, 1 / 5000
#: Rows the hashing is fitted on; share of the sample's neighbours that have to stay in the visited buckets.
FIT_ROWS, FIT_RECALL = 4096, 0.93


def probe_sets(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` best sets of ranks of edges to cross, rank 0 being the nearest edge of a query."""
    m = hashes
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < probes:
        total, ranks = heapq.heappop(heap)
        # ranks r and 2m - 1 - r are the two edges of one step
        if all(2 * m - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return out


class Hasher:
    """The hash functions of one scheme for vectors of one dimension; the same everywhere."""

    def __init__(self, scheme: Scheme, dim: int):
        rng = np.random.default_rng([SEED, dim])
        n = scheme.tables * scheme.hashes
        self.scheme = scheme
        self.directions = rng.standard_normal((dim, n)).astype(np.float32)
        self.shifts = rng.uniform(0, scheme.width, n).astype(np.float32)
        self.odd = rng.integers(1, 2**61, size=(scheme.tables, scheme.hashes)) * 2 + 1
        self.salt = rng.integers(1, 2**62, size=scheme.tables)
        self.planes = rng.standard_normal((dim, SKETCH_BITS)).astype(np.float32)
        self.sets = probe_sets(scheme.hashes, scheme.probes)
        #: so many of the nearest edges are ever crossed
        self.depth = 1 + max((r for ranks in self.sets for r in ranks), default=0)

    def steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.scheme
        p = ((x @ self.directions + self.shifts) / s.width).reshape(len(x), s.tables, s.hashes)
        step = np.floor(p)
        return step.astype(np.int64), p - step

    def buckets(self, step: np.ndarray) -> np.ndarray:
        """One number a row and table."""
        with np.errstate(over="ignore"):
            return (step * self.odd).sum(axis=2) + self.salt

    def probes(self, step: np.ndarray, part: np.ndarray) -> np.ndarray:
        """For each row and table its bucket and those to visit after it, in order."""
        return self.visits(self.buckets(step), self.edges(part))

    def edges(self, part: np.ndarray) -> np.ndarray:
        """The edges each row is closest to, by table."""
        return np.concatenate([part, 1 - part], axis=2).argsort(axis=2)[:, :, : self.depth].astype(np.uint16)

    def visits(self, own: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The buckets to visit, from a row's own ones and its closest edges."""
        out = [own]
        with np.errstate(over="ignore"):
            change = np.concatenate([-self.odd, self.odd], axis=1)
            for ranks in self.sets:
                out.append(own + sum(np.take_along_axis(change[None].repeat(len(own), 0), edges[:, :, r, None], axis=2)[:, :, 0] for r in ranks))
        return np.stack(out, axis=2)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """``SKETCH_BITS`` sides of random planes, as 64-bit numbers."""
        return np.packbits(x @ self.planes > 0, axis=1).view(np.int64)


@lru_cache(maxsize=64)
def hasher(scheme: Scheme, dim: int) -> Hasher:
    return Hasher(scheme, dim)


def unit_rows(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` of the usable vectors of a column by their dimension, scaled to length 1.

    Null, empty and zero vectors and those with null or infinite parts or NaN are not usable.
    """
    size = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    flat = np.asarray(values.fill_null(np.nan) if values.null_count else values, dtype=np.float32)
    begin = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = flat[begin[rows][:, None] + np.arange(dim)] if len(rows) * dim != len(flat) else flat.reshape(-1, dim)
        # scaled by the largest part first, so that no length overflows
        with np.errstate(invalid="ignore"):
            top = np.abs(x).max(axis=1)
            ok = np.isfinite(top) & (top > 0)
            x = x[ok] / top[ok, None]
        if len(x):
            yield rows[ok], x / np.linalg.norm(x, axis=1, keepdims=True)


def _signatures(scheme: Scheme):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for rows, x in unit_rows(b.column(1)):
                for i in range(0, len(rows), 2000):
                    part, y = rows[i : i + 2000], x[i : i + 2000]
                    h = hasher(scheme, y.shape[1])
                    step, rest = h.steps(y)
                    sketch = h.sketch(y)
                    same = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in y]
                    edges = [e.tobytes() for e in h.edges(rest)]
                    dim = pa.array(np.full(len(y), y.shape[1], np.int32))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(part)), pa.array(same, pa.binary()), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), _lists(h.buckets(step)), dim, pa.array(edges, pa.binary())], names=["id", "same", "s1", "s2", "own", "dim", "edges"])

    return run


def _lists(z: np.ndarray) -> pa.ListArray:
    """One list a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * (z.size // max(1, len(z)))), pa.array(z.ravel()))


def _visits(scheme: Scheme):
    """The buckets to visit are made where they are joined: moved and kept before, they would be most of the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.asarray(b.column(4))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 2000):
                    x, h = b.take(pa.array(at[i : i + 2000])), hasher(scheme, dim)
                    own = np.asarray(x.column(3).flatten()).reshape(x.num_rows, scheme.tables)
                    edges = np.frombuffer(b"".join(x.column(5).to_pylist()), np.uint16).reshape(x.num_rows, scheme.tables, h.depth)
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), _lists(h.visits(own, edges))], names=["q", "q1", "q2", "probes"])

    return run


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            right = {}
            for rows, y in unit_rows(b.column(3)):
                right |= {int(r): v for r, v in zip(rows, y)}
            for rows, x in unit_rows(b.column(2)):
                both = [k for k, r in enumerate(rows) if int(r) in right and len(right[int(r)]) == x.shape[1]]
                if both:
                    y = np.stack([right[int(rows[k])] for k in both])
                    keep[rows[both]] = np.einsum("ij,ij->i", x[both].astype(np.float64), y.astype(np.float64)) >= least - 1e-7
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return run


def similar_classes(df: DataFrame, key: str, vector: str, least: float = 0.92, scheme: Scheme = PAIRS) -> tuple[DataFrame, DataFrame]:
    """``a, b`` and ``rep, id``: pairs of different vectors with a cosine of at least ``least``, and the copies of each vector.

    A vector with copies stands in the pairs by the least key of those that have it, and the second result has its
    rows, itself among them; other vectors stand for themselves.  Copies are not expanded into pairs.
    Vectors that are null, empty, zero or not finite have no pairs, nor have vectors of different dimension.
    ``key`` is a number of each row; rows repeated with their key count once.
    """
    src = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id is not null and v is not null")
    sig = cut(src.mapInArrow(_signatures(scheme), "id bigint, same binary, s1 bigint, s2 bigint, own array<bigint>, dim int, edges binary"))
    copies = sig.groupBy("same").agg(F.min("id").alias("rep"), F.max("id").alias("top")).filter("rep < top").select("same", "rep")
    member = sig.select("id", "same").join(copies, "same").select("rep", "id").distinct()
    single = sig.join(member.filter("id <> rep").select("id"), "id", "left_anti")
    own = single.select("id", "s1", "s2", F.explode("own").alias("bucket"))
    visit = single.select("id", "s1", "s2", "own", "dim", "edges").mapInArrow(_visits(scheme), "q bigint, q1 bigint, q2 bigint, probes array<bigint>").select("q", "q1", "q2", F.explode("probes").alias("bucket"))
    bits = F.bit_count(F.col("s1").bitwiseXOR(F.col("q1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("q2")))
    near = own.hint("merge").join(visit, "bucket").filter((F.col("id") != F.col("q")) & (bits <= MOST_BITS))
    pairs = near.select(F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b")).distinct()
    va = src.select(F.col("id").alias("a"), F.col("v").alias("va"))
    vb = src.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(_verify(least), "a bigint, b bigint"), member


def similar_pairs(df: DataFrame, key: str, vector: str, least: float = 0.92, scheme: Scheme = PAIRS) -> DataFrame:
    """``a, b`` (a < b): rows whose vectors have a cosine of at least ``least``, copies among them, as ``similar_classes`` finds them."""
    close, member = similar_classes(df, key, vector, least, scheme)
    # what holds for a vector holds for its copies
    ma, mb = member.select(F.col("rep").alias("a"), F.col("id").alias("__a")), member.select(F.col("rep").alias("b"), F.col("id").alias("__b"))
    spread = close.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("__a", "a").alias("x"), F.coalesce("__b", "b").alias("y"))
    twins = member.select("rep", F.col("id").alias("x")).join(member.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    return spread.unionByName(twins).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


class Finder:
    """The hash functions of a nearest search for vectors of one dimension, fitted on a sample; picklable.

    The sample's mean and its directions of most variance span the subspace; positions in it are scaled to length 1.
    Of the scheme's hashes as many are kept as leave ``FIT_RECALL`` of the sample's nearest rows in the visited
    buckets, those nearest that stand for the ``k`` nearest of all rows; with none left every row is visited.
    """

    def __init__(self, sample: np.ndarray, rows: int, k: int, scheme: Scheme):
        self.scheme, self.dim = scheme, sample.shape[1]
        d = min(scheme.subspace or self.dim, self.dim)
        self.centre = sample.mean(axis=0)
        spread = (sample - self.centre).T @ (sample - self.centre)
        self.basis = np.linalg.eigh(spread.astype(np.float64))[1][:, ::-1][:, :d].astype(np.float32)
        rng = np.random.default_rng([SEED, self.dim])
        turned = [np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(scheme.tables)]
        most = min(scheme.hashes, d)
        self.directions = np.stack([t[:, :most] for t in turned]).astype(np.float32)
        place = self.place(sample)
        self.width = float(scheme.width * max(1e-6, np.std(np.einsum("nd,tdh->nth", place, self.directions))))
        self.shifts = rng.uniform(0, self.width, (scheme.tables, most)).astype(np.float32)
        self.odd = rng.integers(1, 2**61, size=(scheme.tables, most)) * 2 + 1
        self.salt = rng.integers(1, 2**62, size=scheme.tables)
        self.hashes = next((h for h in range(most, 0, -1) if self._recall(sample, rows, k, h) >= FIT_RECALL), 0)

    def place(self, x: np.ndarray) -> np.ndarray:
        p = (x - self.centre) @ self.basis
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)

    def _steps(self, x: np.ndarray, hashes: int):
        p = np.einsum("nd,tdh->nth", self.place(x), self.directions[:, :, :hashes])
        p = (p + self.shifts[:, :hashes]) / self.width
        step = np.floor(p)
        return step.astype(np.int64), p - step

    def buckets(self, x: np.ndarray, hashes: int | None = None) -> np.ndarray:
        """The bucket of each row in each table."""
        h = self.hashes if hashes is None else hashes
        with np.errstate(over="ignore"):
            return (self._steps(x, h)[0] * self.odd[:, :h]).sum(axis=2) + self.salt

    def visits(self, x: np.ndarray, hashes: int | None = None) -> np.ndarray:
        """The buckets each query visits, of all tables, in the order of their estimated chance."""
        h = self.hashes if hashes is None else hashes
        step, part = self._steps(x, h)
        with np.errstate(over="ignore"):
            out = [(step * self.odd[:, :h]).sum(axis=2) + self.salt]
            edges = np.concatenate([part, 1 - part], axis=2).argsort(axis=2)
            change = np.concatenate([-self.odd[:, :h], self.odd[:, :h]], axis=1)
            crossed = np.take_along_axis(np.broadcast_to(change, (len(x), *change.shape)), edges, axis=2)
            for ranks in probe_sets(h, self.scheme.probes - 1) if h else ():
                out.append(out[0] + crossed[:, :, list(ranks)].sum(axis=2))
        return np.stack(out, axis=2).reshape(len(x), -1)

    def _recall(self, sample: np.ndarray, rows: int, k: int, hashes: int) -> float:
        ask = sample[:256]
        near = max(1, round(k * len(sample) / max(rows, 1)))
        score = ask @ sample.T
        score[np.arange(len(ask)), np.arange(len(ask))] = -2
        near = min(near, len(sample) - 1)
        if near < 1:
            return 1.0
        best = np.argpartition(-score, near - 1, axis=1)[:, :near]
        own, seen = self.buckets(sample, hashes), self.visits(ask, hashes).reshape(len(ask), self.scheme.tables, -1)
        return float(np.mean([(own[b][:, :, None] == v[None]).any(axis=(1, 2)).mean() for b, v in zip(best, seen)]))


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in unit_rows(b.column(0)):
                dim = x.shape[1]
                f = shared.value.get(dim)
                own = f.buckets(x).ravel() if f else np.zeros(len(x), np.int64)
                bucket, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim, np.int32)), pa.array(bucket), pa.array(n)], names=["dim", "bucket", "n"])

    return run


_MEET = "region bigint, block bigint, kind int, bucket bigint, id bigint, v binary, visits array<bigint>"


def _region(bucket: np.ndarray, part, regions: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (bucket + part * 0x5851F42D4C957F2D).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((z >> np.uint64(33)) % np.uint64(regions)).astype(np.int64)


def _meet_batch(region, block, kind, bucket, ids, x, visits):
    n = len(region)
    return pa.RecordBatch.from_arrays(
        [pa.array(region), pa.array(block), pa.array(np.full(n, kind, np.int32)), pa.array(bucket), ids, pa.array([v.tobytes() for v in x], pa.binary()), visits],
        names=["region", "block", "kind", "bucket", "id", "v", "visits"],
    )


def _rows_to_regions(shared, regions: int, hot: dict, blocks: int):
    """Each row to the region of its bucket in each table, once for each block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in unit_rows(b.column(1)):
                f, ids = shared.value.get(x.shape[1]), np.asarray(b.column(0))[rows]
                own = f.buckets(x) if f else np.zeros((len(x), 1), np.int64)
                for t in range(own.shape[1]):
                    parts = np.array([hot.get((x.shape[1], k), 1) for k in own[:, t].tolist()])
                    region = _region(own[:, t], (ids * 2654435761 >> 7) % parts, regions)
                    for i in range(0, len(x), 2000):
                        c = slice(i, i + 2000)
                        for block in range(blocks):
                            none = pa.nulls(len(x[c]), pa.list_(pa.int64()))
                            yield _meet_batch(region[c], np.full(len(x[c]), block), 1, own[c, t], pa.array(ids[c]), x[c], none)

    return run


def _queries_to_regions(shared, regions: int, hot: dict, blocks: int, all_of: bool):
    """Each query once to every region with a bucket it visits, with these buckets; with ``all_of`` to all regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in unit_rows(b.column(1)):
                f, ids = shared.value.get(x.shape[1]), np.asarray(b.column(0))[rows]
                for i in range(0, len(x), 200):
                    y, name = x[i : i + 200], ids[i : i + 200]
                    if all_of:
                        who, at, visits = np.repeat(np.arange(len(y)), regions), np.tile(np.arange(regions), len(y)), None
                    else:
                        seen = f.visits(y) if f else np.zeros((len(y), 1), np.int64)
                        who, bucket = np.repeat(np.arange(len(y)), seen.shape[1]), seen.ravel()
                        at = _region(bucket, 0, regions)
                        # the parts of hot buckets
                        more = [(j, k, p) for j, k in enumerate(bucket.tolist()) for p in range(1, hot.get((x.shape[1], k), 1))] if hot else []
                        if more:
                            j, k, p = (np.array(c) for c in zip(*more))
                            who, bucket, at = np.r_[who, who[j]], np.r_[bucket, k], np.r_[at, _region(k, p, regions)]
                        order = np.lexsort((bucket, at, who))
                        who, bucket, at = who[order], bucket[order], at[order]
                        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (at[1:] != at[:-1])])
                        visits = pa.ListArray.from_arrays(pa.array(np.r_[first, len(who)].astype(np.int32)), pa.array(bucket))
                        who, at = who[first], at[first]
                    for j in range(0, len(who), 2000):
                        c = slice(j, j + 2000)
                        lists = pa.nulls(len(who[c]), pa.list_(pa.int64())) if visits is None else visits.slice(j, len(who[c]))
                        yield _meet_batch(at[c], (name[who[c]] * 2654435761 >> 9) % blocks, 0, np.zeros(len(who[c]), np.int64), pa.array(name[who[c]]), y[who[c]], lists)

    return run


class _Region:
    """The queries of one region and block, and the best rows of each so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.visits = k, [], [], []
        self.matrix = None

    def add(self, ids, vectors, visits):
        self.ids += ids
        self.vectors += vectors
        self.visits += visits

    def ready(self):
        size = np.array([len(v) for v in self.vectors])
        self.name = np.array(self.ids, np.int64)
        self.best = np.full((len(size), self.k), -2.0, np.float32)
        self.who = np.full((len(size), self.k), -1, np.int64)
        self.matrix = {}
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            x = np.frombuffer(b"".join(self.vectors[i] for i in at), np.float32).reshape(len(at), -1)
            every = np.array([i for i, a in enumerate(at) if self.visits[a] is None], np.int64)
            listed = [(i, self.visits[a]) for i, a in enumerate(at) if self.visits[a] is not None]
            who = np.repeat(np.array([i for i, _ in listed], np.int64), [len(v) for _, v in listed]) if listed else np.zeros(0, np.int64)
            bucket = np.array([k for _, v in listed for k in v], np.int64)
            order = np.argsort(bucket, kind="stable")
            self.matrix[n] = (at, x, every, bucket[order], who[order])
        self.vectors = self.visits = None

    def compare(self, size: int, bucket: int, ids: np.ndarray, x: np.ndarray):
        if size not in self.matrix:
            return
        at, queries, every, keys, who = self.matrix[size]
        a, b = np.searchsorted(keys, bucket, "left"), np.searchsorted(keys, bucket, "right")
        q = np.r_[every, who[a:b]]
        for i in range(0, len(q), 4096):
            part = q[i : i + 4096]
            mine = at[part]
            score = queries[part] @ x.T
            score[self.name[mine][:, None] == ids[None]] = -2.0
            both = np.concatenate([self.best[mine], score], axis=1)
            names = np.concatenate([self.who[mine], np.broadcast_to(ids, score.shape)], axis=1)
            # equal ones in the order of their names
            order = np.lexsort((names, -np.round(both, 6)), axis=1)[:, : self.k]
            self.best[mine], self.who[mine] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def result(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.best > -2) if self.matrix is not None else (np.zeros(0, int),) * 2
        name = self.name if self.matrix is not None else np.zeros(0, np.int64)
        values = [name[q], self.who[q, j], self.best[q, j].astype(np.float64)] if len(q) else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["id", "other", "cosine"])


def _search_regions(k: int):
    """Of batches sorted by region, block, kind and bucket: the ``k`` best rows of each query in each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, region, last = None, None, None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in (0, 1, 2, 3)], axis=1)
            ids, vectors = np.asarray(b.column(4)), b.column(5)
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for i, j in zip(edge, np.r_[edge[1:], b.num_rows]):
                at = (int(keys[i, 0]), int(keys[i, 1]))
                if at != here:
                    if region is not None:
                        yield region.result()
                    here, region, last = at, _Region(k), None
                if keys[i, 2] == 0:
                    region.add(ids[i:j].tolist(), vectors.slice(i, j - i).to_pylist(), b.column(6).slice(i, j - i).to_pylist())
                    continue
                if region.matrix is None:
                    region.ready()
                bucket, held = int(keys[i, 3]), vectors.slice(i, j - i).to_pylist()
                size = np.array([len(v) for v in held])
                for n in np.unique(size).tolist():
                    rows = np.flatnonzero(size == n)
                    for r in range(0, len(rows), 2000):
                        c = rows[r : r + 2000]
                        # a row repeated with its name counts once; they stand together
                        kept = []
                        for x, name in zip(c.tolist(), ids[i:j][c].tolist()):
                            if last != (bucket, name, held[x]):
                                kept.append(x)
                            last = (bucket, name, held[x])
                        if not kept:
                            continue
                        c = np.array(kept)
                        region.compare(n, bucket, ids[i:j][c], np.frombuffer(b"".join(held[x] for x in c), np.float32).reshape(len(c), -1))
        if region is not None:
            yield region.result()

    return run


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, scheme: Scheme = NEAREST, block: int = BLOCK_QUERIES) -> DataFrame:
    """``id, other, cosine, place``: for each row of ``queries`` the ``k`` other rows of ``df`` most similar to it.

    Equal cosines are placed by ``other``.  Unusable vectors are neither asked nor found.  The hashing is fitted on
    ``FIT_ROWS`` rows; every row is indexed and every query compared with all rows of the buckets it visits, whatever
    their size.  A query that meets fewer than ``k`` rows visits all.  Neither rows nor queries pass through the
    driver; what does is the sample, and the buckets that hold more than a region, less than 1 / ``HOT_SHARE``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    shape = "id bigint, other bigint, cosine double"

    def usable(x):
        return x.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id is not null and v is not null")

    src, asked = usable(df), usable(queries).distinct() if queries.columns == [key, vector] else usable(queries)
    rows, ask = src.count(), asked.count()
    if not rows or not ask:
        return spark.createDataFrame([], shape + ", place int")
    sample = src.filter("size(v) > 0").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow()["v"].combine_chunks()
    fitted = {x.shape[1]: Finder(x, rows, k, scheme) for _, x in unit_rows(sample) if len(x)}
    shared = sc.broadcast(fitted)
    regions = max(1, -(-rows * scheme.tables // REGION_ROWS))
    limit = max(REGION_ROWS, rows * HOT_SHARE)
    sizes = src.select("v").mapInArrow(_counts(shared), "dim int, bucket bigint, n bigint").groupBy("dim", "bucket").agg(F.sum("n").alias("n"))
    hot = {(r.dim, r.bucket): int(-(-r.n // limit)) for r in sizes.filter(F.col("n") > limit).collect()}
    blocks = max(1, -(-ask // block))
    moved = src.mapInArrow(_rows_to_regions(shared, regions, hot, blocks), _MEET)

    def search(some: DataFrame, all_of: bool) -> DataFrame:
        both = some.mapInArrow(_queries_to_regions(shared, regions, hot, blocks, all_of), _MEET).unionByName(moved)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism)
        met = both.repartition(parts, "region", "block").sortWithinPartitions("region", "block", "kind", "bucket", "id")
        # a region sends its k best of each query, so a query's rows are bounded by k and the regions it visits
        best = met.mapInArrow(_search_regions(k), shape).groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
        w = Window.partitionBy("id").orderBy(F.round("cosine", 6).desc(), "other")
        return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)

    out = search(asked, False)
    if any(f.hashes for f in fitted.values()):
        out = cut(out)
        enough = out.filter(F.col("place") == min(k, rows - 1)).select("id")
        short = asked.join(enough, "id", "left_anti")
        if not short.isEmpty():
            out = out.join(short.select("id").distinct(), "id", "left_anti").unionByName(search(short, True))
    return out


def found(chunks: DataFrame) -> DataFrame:
    """``chunk_id_a, chunk_id_b``: chunks whose embeddings have a cosine of at least 0.92."""
    return similar_pairs(chunks, "chunk_id", "embedding").withColumnsRenamed({"a": "chunk_id_a", "b": "chunk_id_b"})
