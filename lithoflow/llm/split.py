"""Cutting long texts into overlapping pieces at natural boundaries (agglomerative merging).

A text starts as its atomic segments, words with the white space after them.  Adjacent segments wait in a
heap; the weakest boundary is merged first, as long as the merged segment and the overlap fit the limit.  What
is left are the cores of the pieces; each piece is its core and the end of the piece before.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 500, 50

_ATOM = re.compile(r"\s*\S+\s*|\s+")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s*$")
_CLAUSE = re.compile(r"[;:,|)\]—–]\s*$")

#: Strength of the boundary after a segment.
FORCED, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)


def strength(segment: str) -> int:
    """How good the place after ``segment`` is for a cut."""
    if not segment[-1].isspace():
        return FORCED
    if _PARAGRAPH.search(segment):
        return PARAGRAPH
    if "\n" in segment or "\r" in segment:
        return LINE
    if _SENTENCE.search(segment):
        return SENTENCE
    return CLAUSE if _CLAUSE.search(segment) else WORD


def atoms(text: str, limit: int, overlap: int) -> list[str]:
    """The words of ``text`` with their white space, in order; what is longer than ``limit`` is cut."""
    out = []
    for m in _ATOM.finditer(text):
        a = m.group()
        if len(a) <= limit:
            out.append(a)
            continue
        lead = len(a) - len(a.lstrip())
        body = len(a.rstrip())
        for part in (a[:lead], a[lead:body] if body > lead else "", a[max(lead, body) :]):
            size = limit if len(part) <= limit else limit - overlap
            out += [part[i : i + size] for i in range(0, len(part), size)]
    return out


def cores(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The limits of the merged segments; together they are the whole text."""
    parts = atoms(text, limit, overlap)
    n = len(parts)
    size = [len(a) for a in parts]
    begin = [0] * n
    for i in range(1, n):
        begin[i] = begin[i - 1] + size[i - 1]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    room = limit - overlap
    weak = [strength(a) for a in parts]
    heap = [(weak[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1) if size[i] + size[i + 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, total, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or size[i] + size[j] != total:
            continue
        size[i], weak[i], alive[j], after[i] = total, weak[j], False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if total + size[after[i]] <= room:
                heapq.heappush(heap, (weak[i], total + size[after[i]], i, after[i]))
        if before[i] >= 0 and size[before[i]] + total <= room:
            heapq.heappush(heap, (weak[before[i]], size[before[i]] + total, before[i], i))
    return [(begin[i], begin[i] + size[i]) for i in range(n) if alive[i]]


def overlap_start(text: str, low: int, core: int, most: int, overlap: int) -> int:
    """Where the piece of the core at ``core`` begins: at the boundary nearest to ``overlap`` characters before it.

    At most ``most`` characters before it and not before ``low``; where no boundary is in reach, exactly there.
    """
    floor = max(low, core - most)
    ideal = max(floor, core - overlap)

    def boundary(p):
        return p == 0 or text[p - 1].isspace()

    for d in range(max(core - ideal, ideal - floor)):
        for p in (ideal - d, ideal + d):
            if floor <= p < core and boundary(p) and not text[p].isspace():
                return p
    return core if core - floor < overlap else ideal


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """``(start, core, end)`` of the pieces of ``text``; a text within the limit is one piece, an empty or null one none."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    out: list[tuple[int, int, int]] = []
    for a, b in cores(text, limit, overlap):
        start = overlap_start(text, out[-1][0] + 1, a, limit - (b - a), overlap) if out else a
        out.append((start, a, b))
    return out


def forced(text: str, cut: list[tuple[int, int, int]]) -> bool:
    """Whether a cut stands inside a run without white space."""
    return any(not text[a - 1].isspace() and not text[a].isspace() for _, a, _ in cut[1:])


def _split(limit: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            cut = pieces(text, limit, overlap)
            hard = forced(text, cut) if cut else False
            rows += [(key, i, start, core, end, text[start:end], int(hard)) for i, (start, core, end) in enumerate(cut)]
        cols = list(zip(*rows)) or [()] * 7
        types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "piece_no", "start", "core", "end", "piece", "forced"])


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of each text: ``key, piece_no, start, core, end, piece, forced``.

    Lengths and places are in code points.  ``piece`` is text[start:end], the cores text[core:end] of a row
    joined are its text.  ``forced`` is 1 for all pieces of a text that had to be cut inside a run without
    white space.  Null and empty texts have no pieces; equal rows are split each for itself; texts of any
    length are taken whole.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    kind = df.schema[key].dataType.simpleString()
    shape = f"key {kind}, piece_no int, start int, core int, end int, piece string, forced int"
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(partial(_split, limit, overlap), shape).withColumnRenamed("key", key)


def found(chunks: DataFrame) -> DataFrame:
    """``chunk_id, forced`` of the chunks longer than the limit, from their pieces."""
    long = chunks.filter(F.char_length("content") > LIMIT)
    return split_texts(long, "chunk_id", "content").filter("piece_no = 0").select("chunk_id", "forced")
