"""Finding evaluation passages inside a corpus (spaced-seed hashing).

Texts are compared as sequences of words in the one form of look-alike texts.  A mask looks at some of
``SPAN`` successive words and ignores the others, so its hash survives substitutions at the ignored places.
The hashes of all windows of the passages are a small index that meets the hashes of all windows of the
corpus in place; around each hit the two texts are laid side by side, which gives the longest overlap with
substitutions and the longest run of equal words.  Any ``SPAN`` equal words make every mask hit.

More passages than one index may hold meet the corpus in a join of seeds: a map of bits of all seeds, of fixed size,
goes round, only windows that are in it move, and only documents with such windows are laid beside passages.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import lookalike

SPAN = 12
# The masks, 1 where a word counts.
MASKS = ("110110010111", "101011101101")
#: Runs of at least so many equal words, at most so many substitutions apart, make one overlap.
ANCHOR, SUBSTITUTIONS = 4, 2
#: Passage words in one index; more are joined.  Bits of the map of seeds, as a power of two.
BLOCK_WORDS, MAP_BITS = 2_000_000, 27

_WORD = re.compile(r"[^\W_]+")


def words(text: str, rewrite) -> list[str]:
    """The words of ``text``: runs of letters or digits, in the one form and without case."""
    return _WORD.findall(rewrite(text).casefold())


@dataclass
class SeedIndex:
    """Hashes of the masked windows of passages; ``items[p]`` are the items with passage ``p``."""

    vocabulary: dict[str, int]
    passages: list[np.ndarray]
    items: list[list[int]]

    def __post_init__(self):
        rng = np.random.default_rng(20240607)
        self.weights = rng.integers(1, 2**63, size=len(self.vocabulary) + 1, dtype=np.uint64)
        self.places = rng.integers(0, 2**62, size=SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seeds = []
        owner = np.repeat(np.arange(len(self.passages)), [len(p) for p in self.passages])
        place = np.concatenate([np.arange(len(p)) for p in self.passages]) if self.passages else np.zeros(0, int)
        text = np.concatenate(self.passages) if self.passages else np.zeros(0, np.int64)
        for mask in MASKS:
            key, at = self.hashes(text, mask)
            inside = owner[at] == owner[at + SPAN - 1] if len(at) else np.zeros(0, bool)
            key, at = key[inside], at[inside]
            order = np.argsort(key, kind="stable")
            self.seeds.append((key[order], owner[at][order], place[at][order]))

    @classmethod
    def build(cls, rows, rewrite) -> SeedIndex:
        """Of ``(item_id, passage)``; equal word sequences are one passage, those under ``SPAN`` words can't be found."""
        by: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, passage in rows:
            if passage and len(w := tuple(words(passage, rewrite))) >= SPAN:
                by[w].append(item)
        vocabulary: dict[str, int] = {}
        passages = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in p], dtype=np.int64) for p in by]
        return cls(vocabulary, passages, [sorted(set(i)) for i in by.values()])

    def hashes(self, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the windows whose counted words are all known, and where these windows begin."""
        n = len(text) - SPAN + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        counted = [j for j, c in enumerate(mask) if c == "1"]
        known = text > 0
        at = np.flatnonzero(np.logical_and.reduce([known[j : j + n] for j in counted]))
        key = np.zeros(len(at), np.uint64)
        for j in counted:
            key += self.weights[text[at + j]] * self.places[j]
        return key, at

    def search(self, text: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(document, passage, overlap, run)`` of the documents ``owner`` whose word numbers stand in ``text``, 0 unknown."""
        lanes = set()
        for mask, (keys, passage, place) in zip(MASKS, self.seeds):
            key, at = self.hashes(text, mask)
            first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for i in np.flatnonzero(last > first):
                a = int(at[i])
                lanes.update((int(owner[a]), int(passage[s]), a - int(place[s])) for s in range(first[i], last[i]))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, p, shift in lanes:
            low, high = max(0, -shift), min(len(self.passages[p]), len(text) - shift)
            side = slice(shift + low, shift + high)
            equal = (text[side] == self.passages[p][low:high]) & (owner[side] == doc)
            overlap, run = self._overlap(equal)
            old = best.get((doc, p), (0, 0))
            best[doc, p] = (max(overlap, old[0]), max(run, old[1]))
        for (doc, p), (overlap, run) in best.items():
            yield doc, p, overlap, run

    @staticmethod
    def _overlap(equal: np.ndarray) -> tuple[int, int]:
        """The longest chain of runs a few substitutions apart, and the longest run."""
        edge = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8)))
        runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        longest, chain = 0, None
        for a, b in runs:
            if b - a < ANCHOR:
                continue
            chain = (chain[0], b) if chain and a - chain[1] <= SUBSTITUTIONS else (a, b)
            longest = max(longest, chain[1] - chain[0])
        return longest, max((b - a for a, b in runs), default=0)


def _search_batches(shared_index, shared_form, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, rewrite = shared_index.value, shared_form.value
    number = index.vocabulary
    gap = [0] * SPAN
    for b in batches:
        keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows: list[tuple] = []
        for i in range(0, len(texts), 500):
            flat: list[int] = []
            size = []
            for t in texts[i : i + 500]:
                before = len(flat)
                if t:
                    flat += [number.get(w, 0) for w in words(t, rewrite)]
                flat += gap
                size.append(len(flat) - before)
            owner = np.repeat(np.arange(len(size)), size)
            for doc, p, overlap, run in index.search(np.array(flat, dtype=np.int64), owner):
                rows += [(keys[i + doc], item, overlap, run) for item in index.items[p]]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["key", "item_id", "overlap", "run"])


# --- the join --------------------------------------------------------------------------------------------

_PLACES = np.random.default_rng(20240608).integers(0, 2**62, size=(len(MASKS), SPAN), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBERS: dict[str, int] = {}


def numbers(text: str, rewrite) -> np.ndarray:
    """The words of ``text`` as hashes, the same everywhere."""
    out = []
    for w in words(text, rewrite):
        n = _NUMBERS.get(w)
        if n is None:
            if len(_NUMBERS) >= 500_000:
                _NUMBERS.clear()
            n = _NUMBERS[w] = xxhash.xxh64_intdigest(w)
        out.append(n)
    return np.array(out, np.uint64)


def seeds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all masked windows of a text of word hashes, and where these begin."""
    n = len(text) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys = [sum((text[j : j + n] * places[j] for j, c in enumerate(mask) if c == "1"), np.zeros(n, np.uint64)) for mask, places in zip(MASKS, _PLACES)]
    return np.concatenate(keys), np.tile(np.arange(n, dtype=np.int32), len(MASKS))


def _passage_batches(shared_form):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = shared_form.value
        for b in batches:
            rows = [(i, n) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(n := numbers(p, rewrite)) >= SPAN]
            held = [n.tobytes() for _, n in rows]
            names = [hashlib.blake2b(h, digest_size=16).digest() for h in held]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(names, pa.binary()), pa.array(held, pa.binary())], names=["item_id", "passage", "words"])

    return run


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            key, at = seeds(np.frombuffer(held, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([name] * len(key), pa.binary()), pa.array(at)], names=["seed", "passage", "place"])


def _document_batches(shared_map, shared_form, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rewrite = shared_map.value, shared_form.value
        hit = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                text = numbers(t, rewrite) if t else np.zeros(0, np.uint64)
                key, at = seeds(text)
                bucket = key >> np.uint64(64 - bits)
                inside = np.flatnonzero(seen[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1)
                if len(inside):
                    rows.append((i, text.tobytes(), [{"seed": k, "at": a} for k, a in zip(key[inside].view(np.int64).tolist(), at[inside].tolist())]))
            at, held, hits = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(held, pa.binary()), pa.array(hits, hit)], names=["key", "words", "hits"])

    return run


def _lay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The longest overlap and run of each document and passage over the ways they were hit."""
    for b in batches:
        out = []
        for text, passage, shifts in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            x, p, best = np.frombuffer(text, np.uint64), np.frombuffer(passage, np.uint64), (0, 0)
            for shift in shifts:
                low, high = max(0, -shift), min(len(p), len(x) - shift)
                overlap, run = SeedIndex._overlap(x[shift + low : shift + high] == p[low:high])
                best = (max(best[0], overlap), max(best[1], run))
            out.append(best)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o for o, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], names=["uid", "passage", "overlap", "run"])


def _joined(src: DataFrame, items: DataFrame, form, kind: str, bits: int = MAP_BITS) -> DataFrame:
    """``find_passages`` for any number of passages; nothing but the map of seeds passes through the driver."""
    sc = src.sparkSession.sparkContext
    passages = cut(items.mapInArrow(_passage_batches(form), "item_id bigint, passage binary, words binary"))
    # equal passages are one, whose items all count
    one = passages.groupBy("passage").agg(F.first("words").alias("words"))
    own = one.mapInArrow(_seed_batches, "seed bigint, passage binary, place int")
    marks = own.select(F.shiftrightunsigned("seed", 64 - bits + 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) % 64 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    seen = np.zeros(max(1, 2**bits // 64), np.int64)
    seen[marks["w"].to_numpy()] = marks["bits"].to_numpy()
    shared = sc.broadcast(seen.view(np.uint8))
    docs = cut(src.mapInArrow(_document_batches(shared, form, bits), f"key {kind}, words binary, hits array<struct<seed: bigint, at: int>>")).withColumn("uid", F.monotonically_increasing_id())
    shared.unpersist()
    # seeds are many times the bytes Spark takes the passages for, so no side is to be sent round
    hits = docs.select("uid", F.expr("inline(hits)")).join(own.hint("merge"), "seed").select("uid", "passage", (F.col("at") - F.col("place")).alias("shift"))
    lanes = hits.groupBy("uid", "passage").agg(F.collect_set("shift").alias("shifts"))
    laid = lanes.join(docs.select("uid", "words").hint("merge"), "uid").join(one.withColumnRenamed("words", "own").hint("merge"), "passage").select("uid", "passage", "words", "own", "shifts")
    best = laid.mapInArrow(_lay_batches, "uid bigint, passage binary, overlap bigint, run bigint")
    every = best.join(passages.select("passage", "item_id").distinct(), "passage").join(docs.select("uid", "key"), "uid")
    return every.select("key", "item_id", "overlap", "run")


def find_passages(df: DataFrame, key: str, text: str, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, item_id, overlap, run``: where passages of ``items`` (item_id, passage) occur in the texts of ``df``.

    ``run`` is the longest run of equal words, ``overlap`` the longest overlap with some words substituted; a
    row comes out where a mask hits.  All items with a passage count.  Null and empty texts and passages hold
    nothing; passages under ``SPAN`` words can't be found.  Repeated rows come out repeated.  Passages of up to
    ``block_words`` words (of four letters) are one index that goes to the texts, which don't move; more are joined.
    The texts are read once to choose representatives and once to search, however many passages there are.
    """
    sc = df.sparkSession.sparkContext
    asked = items.select(F.col("item_id").cast("bigint"), F.col("passage").cast("string")).filter("item_id is not null and passage is not null")
    rewriter = lookalike.fit(df, text)
    form = sc.broadcast(rewriter)
    kind = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    if (asked.agg(F.sum(F.length("passage"))).first()[0] or 0) // 4 > block_words:
        return _joined(src, asked, form, kind).withColumnRenamed("key", key)
    index = sc.broadcast(SeedIndex.build([(r.item_id, r.passage) for r in asked.collect()], rewriter))
    found = src.mapInArrow(lambda batches: _search_batches(index, form, batches), f"key {kind}, item_id bigint, overlap bigint, run bigint")
    return found.withColumnRenamed("key", key)


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: documents with at least ``SPAN`` successive words of an item's passage."""
    return find_passages(documents, "doc_id", "text", items).filter(F.col("run") >= SPAN).select("doc_id", "item_id").distinct()
