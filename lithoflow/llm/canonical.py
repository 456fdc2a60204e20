"""Mapping typed curve names to a canonical list (symmetric-delete dictionary, weighted edit distance).

The dictionary holds the words of the canonical titles and what loaders make of them: words cut short and words
without their vowels.  Every entry is filed under itself and under all its forms with up to ``DISTANCE``
letters deleted; a typed word is looked up with its own deletions, and the hits are ranked by a weighted
Damerau-Levenshtein distance less a little for the use of the code.  A typed name means the title whose words, in
order, cost least; only titles that have one of the words found are compared.  A title typed as one word is looked up
whole, with one letter deleted on either side; short words may have one slip.

Codes are filed and looked up alike, with one letter deleted: as they stand, once what loaders add to them is taken
off, and, where neither codes nor titles say anything, with a slip that costs at most ``CODE_COST`` (a letter doubled or
dropped beside its like, two letters exchanged, a vowel).  Another letter in a code makes another code as often as a slip
(ILD and ILM, DTC and DTS), so such a text stays unmatched.

A list of more than ``PART`` entries is taken in parts, each a dictionary of its own, whose findings are merged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters deleted at most, on either side; cost of a word at most, absolute and a letter; of a code; entries in one dictionary.
DISTANCE, WORD_COST, LETTER_COST, CODE_COST = 2, 2.2, 0.34, 0.8
PART = 5_000
#: What ten times the use of a code is worth against the cost of an edit.
USE_WORTH = 0.03
KEEP = 200_000

# Words that decorate a name; costs of an edit, 1 where none is given.
DECORATION = {"log", "curve", "run", "final"}
_DECORATION = frozenset(w.upper() for w in DECORATION)
SWAP_COST, DOUBLE_COST, VOWEL_COST, SHORT_COST, SKELETON_COST = 0.7, 0.5, 0.8, 0.25, 0.5
VOWELS = set("aeiou")

_NOT_WORD = re.compile(r"[\W_]+")
_IN_BRACKETS = re.compile(r"\(\s*run\s*\d*\s*\)", re.IGNORECASE)


def deletions(word: str, most: int = DISTANCE) -> set[str]:
    """``word`` and all its forms with up to ``most`` letters deleted."""
    most = min(most, max(0, len(word) - 1))
    return {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in map(set, combinations(range(len(word)), k))}


def weighted_distance(a: str, b: str, most: float = 99.0) -> float:
    """Damerau-Levenshtein distance (adjacent letters swapped count as one edit) with weights by kind of slip."""

    def lone(s, i):
        if i and s[i] == s[i - 1] or i + 1 < len(s) and s[i] == s[i + 1]:
            return DOUBLE_COST
        return VOWEL_COST if s[i] in VOWELS else 1.0

    old: list[float] = []
    row = [0.0]
    for j in range(len(b)):
        row.append(row[-1] + lone(b, j))
    for i, x in enumerate(a):
        older, old, row = old, row, [row[0] + lone(a, i)]
        for j, y in enumerate(b):
            change = 0.0 if x == y else VOWEL_COST if x in VOWELS and y in VOWELS else 1.0
            cost = min(old[j] + change, old[j + 1] + lone(a, i), row[j] + lone(b, j))
            if i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                cost = min(cost, older[j - 1] + SWAP_COST)
            row.append(cost)
        if min(row) > most:
            return 99.0
    return row[-1]


def words_of(typed: str) -> list[str]:
    words = [w for w in _NOT_WORD.split(_IN_BRACKETS.sub(" ", typed).lower()) if w]
    return [w for w in words if w not in DECORATION and not w.isdigit()]


@dataclass
class Dictionary:
    """Symmetric-delete index of a canonical list ``(ref_id, code, title)`` with the number of uses of each code."""

    codes: dict[str, set[tuple[str, int]]] = field(default_factory=lambda: defaultdict(set))
    places: dict[tuple[int, int, str], list[int]] = field(default_factory=lambda: defaultdict(list))
    titles: list[tuple[int, list[str]]] = field(default_factory=list)
    index: dict[str, set[tuple[str, str, float]]] = field(default_factory=lambda: defaultdict(set))
    uses: dict[int, int] = field(default_factory=dict)
    known: dict[str, dict[str, float]] = field(default_factory=dict)
    longest: int = 0
    whole: dict[str, set[tuple[str, int]]] = field(default_factory=lambda: defaultdict(set))
    most_words: int = 0
    most_letters: int = 0

    @classmethod
    def build(cls, entries, uses: dict[int, int]) -> Dictionary:
        self, taken = cls(uses=uses), set()
        for ref_id, code, title in sorted(entries, key=lambda e: (-uses.get(e[0], 0), e[0])):
            if code and code.upper() not in taken:
                taken.add(code.upper())
                for d in deletions(code.upper(), 1):
                    self.codes[d].add((code.upper(), ref_id))
            words = words_of(title or "")
            if words:
                self.titles.append((ref_id, words))
                for i, w in enumerate(words):
                    self.places[len(words), i, w].append(len(self.titles) - 1)
                self.most_words = max(self.most_words, len(words))
                if len(words) > 1:
                    self.most_letters = max(self.most_letters, len("".join(words)))
                    for d in deletions("".join(words), 1):
                        self.whole[d].add(("".join(words), len(self.titles) - 1))
            for w in words:
                self.longest = max(self.longest, len(w))
                for form, cost in self._forms(w):
                    for d in deletions(form):
                        self.index[d].add((form, w, cost))
        self.index, self.whole, self.codes, self.places = dict(self.index), dict(self.whole), dict(self.codes), dict(self.places)
        return self

    @staticmethod
    def _forms(word: str):
        yield word, 0.0
        for n in range(3, len(word)):
            yield word[:n], SHORT_COST
        skeleton = word[0] + "".join(c for c in word[1:] if c not in VOWELS)
        if 3 <= len(skeleton) < len(word):
            yield skeleton, SKELETON_COST

    def word(self, typed: str) -> dict[str, float]:
        """The title words that ``typed`` can mean, with their costs; worked out once for each word."""
        found = self.known.get(typed)
        if found is None:
            if len(self.known) >= KEEP:
                self.known.clear()
            found = self.known[typed] = self._word(typed)
        return found

    def _word(self, typed: str) -> dict[str, float]:
        best: dict[str, float] = {}
        seen: dict[str, float] = {}
        if len(typed) > self.longest + DISTANCE:
            return {}
        if len(typed) <= DISTANCE + 1:  # so short that only title words as they stand may have a slip, and only one
            best = {word: extra for form, word, extra in self.index.get(typed, ()) if form == typed}
            for d in deletions(typed, 1) if len(typed) > 1 else ():
                for form, word, _ in self.index.get(d, ()):
                    if form == word and len(word) <= DISTANCE + 2 and word not in best and (cost := weighted_distance(typed, word)) <= min(1.0, LETTER_COST * len(word)):
                        best[word] = cost
            return best
        for d in deletions(typed):
            for form, word, extra in self.index.get(d, ()):
                if form not in seen:
                    seen[form] = weighted_distance(typed, form, WORD_COST)
                    if seen[form] > LETTER_COST * len(form):
                        seen[form] = 99.0
                cost = seen[form] + extra
                if cost <= WORD_COST and cost < best.get(word, 99.0):
                    best[word] = cost
        return best

    def worth(self, ref_id: int) -> float:
        return USE_WORTH * log10(1 + self.uses.get(ref_id, 0))

    def title(self, typed: str | None) -> tuple[int, float] | None:
        """The entry whose title ``typed`` means, and its cost."""
        words = words_of(typed or "")
        if not words:
            return None
        readings = []
        if len(words) <= self.most_words + 1:
            # a word may be typed in two parts
            readings = [words] + [words[:i] + [words[i] + words[i + 1]] + words[i + 2 :] for i in range(len(words) - 1)]
        joined = "".join(words)
        if max(map(len, words)) > 1:
            readings.append([joined])
        best: tuple | None = None

        def better(cost, rank):
            nonlocal best
            # what is typed as it stands is meant as it stands
            ref_id = self.titles[rank][0]
            key = (cost and max(1e-9, cost - self.worth(ref_id)), rank)
            if best is None or key < best[0]:
                best = (key, ref_id, cost)

        # or all of them as one
        near: set[tuple[str, int]] = set()
        if len(joined) <= self.most_letters + 1:
            near.update(*(self.whole.get(d, ()) for d in {joined, *(joined[:i] + joined[i + 1 :] for i in range(len(joined)))}))
        for title, rank in near:
            cost = 0.0 if joined == title else weighted_distance(joined, title, 1.0)
            if cost <= 1.0:
                better(cost, rank)
        for reading in readings:
            found = [self.word(w) for w in reading]
            if not all(found):
                continue
            # the titles that have, at the place of the word with the fewest of them, one of the words found
            near = min(([r for w in f for r in self.places.get((len(reading), i, w), ())] for i, f in enumerate(found)), key=len)
            for rank in near:
                title = self.titles[rank][1]
                if all(t in f for t, f in zip(title, found)):
                    better(sum(f[t] for t, f in zip(title, found)), rank)
        return best and (best[1], best[2])

    def code_hits(self, typed: str | None) -> set[int]:
        """The entries whose codes stand in ``typed`` as they are: among its words, or spelled letter by letter."""
        tokens = [t for t in _NOT_WORD.split((typed or "").upper()) if t]
        if len(tokens) > 1 and all(len(t) == 1 for t in tokens):
            tokens.append("".join(tokens))
        return {ref_id for t in tokens for code, ref_id in self.codes.get(t, ()) if code == t}

    def code(self, typed: str | None) -> int | None:
        """The entry whose code is the only one that stands in ``typed``."""
        hits = self.code_hits(typed)
        return hits.pop() if len(hits) == 1 else None

    def near_code(self, typed: str | None) -> tuple[int, float] | None:
        """The entry whose code ``typed``, one word of three letters or more, is but for a slip, and its cost."""
        word = "".join(t for t in _NOT_WORD.split((typed or "").upper()) if t not in _DECORATION)
        if len(word) < 3 or not word.isalpha():
            return None
        near = {hit for d in deletions(word, 1) for hit in self.codes.get(d, ())} if len(word) <= 40 else ()
        costs = [(cost - self.worth(ref_id), code, ref_id, cost) for code, ref_id in near if (cost := weighted_distance(word.lower(), code.lower(), 1.0)) <= CODE_COST]
        return (lambda b: (b[2], b[3]))(min(costs)) if costs else None

    def entry(self, mnemonic: str | None, name: str | None) -> tuple[int, str, float]:
        """``(ref_id, how, cost)`` of a curve; ref_id 0 where no entry is meant."""
        for what, typed in (("mnemonic", mnemonic), ("name", name)):
            if (ref_id := self.code(typed)) is not None:
                return ref_id, f"{what} code", 0.0
            if (hit := self.title(typed)) is not None:
                return hit[0], f"{what} title", hit[1]
        for what, typed in (("mnemonic", mnemonic), ("name", name)):
            if (hit := self.near_code(typed)) is not None:
                return hit[0], f"near {what} code", hit[1]
        return 0, "none", 0.0

    def readings(self, mnemonic: str | None, name: str | None):
        """``(step, entry, use, cost)`` of all that this dictionary finds, by the step of ``entry`` that would take it."""
        for step, typed in ((0, mnemonic), (2, name)):
            for ref_id in self.code_hits(typed):
                yield step, ref_id, self.uses.get(ref_id, 0), 0.0
            if (hit := self.title(typed)) is not None:
                yield step + 1, hit[0], self.uses.get(hit[0], 0), hit[1]
        for step, typed in ((4, mnemonic), (5, name)):
            if (hit := self.near_code(typed)) is not None:
                yield step, hit[0], self.uses.get(hit[0], 0), hit[1]


STEPS = ("mnemonic code", "mnemonic title", "name code", "name title", "near mnemonic code", "near name code")
_SHAPE = "curve_id bigint, mnemonic string, name string, ref_id bigint, how string, cost double"


def _used(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``ref_id, code, title, uses``: the list with the uses of each code over all of ``curves``."""
    used = curves.groupBy(F.col("mnemonic").alias("__m")).count().withColumnRenamed("count", "uses")
    x = ref.select("ref_id", "code", "title").filter("ref_id is not null")
    return x.join(used, F.col("code") == F.col("__m"), "left").groupBy("ref_id", "code", "title").agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"))


def dictionaries(curves: DataFrame, ref: DataFrame) -> Iterator[Dictionary]:
    """Dictionaries of up to ``PART`` entries each, of the whole list ``ref``, with the uses of each code; at least one."""
    part: list = []

    def built():
        uses: dict[int, int] = {}
        for r in part:
            uses[r.ref_id] = uses.get(r.ref_id, 0) + r.uses
        return Dictionary.build([(r.ref_id, r.code, r.title) for r in part], uses)

    some = False
    for r in _used(curves, ref).orderBy("ref_id", "code", "title").toLocalIterator():
        part.append(r)
        if len(part) == PART:
            some = True
            yield built()
            part = []
    if part or not some:
        yield built()


def map_curves(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``curve_id, mnemonic, name, ref_id, how, cost`` of every row of ``curves``; ref_id 0 where no entry is meant.

    The mnemonic counts before the name, a code before a title.  Null, blank and place-holder texts mean
    nothing.  Repeated rows come out repeated, an empty list maps all to 0.  Each distinct pair of texts is
    worked out once a task; no row is moved unless the list has several parts, which are merged by pair of texts.
    """
    src = curves.select(F.col("curve_id").cast("bigint"), F.col("mnemonic").cast("string"), F.col("name").cast("string"))
    shared = [curves.sparkSession.sparkContext.broadcast(d) for d in dictionaries(curves, ref)]
    if len(shared) > 1:
        return _map_by_parts(src, shared)
    lookup = shared[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[int, str, float]] = {}
        d = lookup.value
        for b in batches:
            out = []
            for pair in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                hit = known.get(pair)
                if hit is None:
                    if len(known) >= KEEP:
                        known.clear()
                    hit = known[pair] = d.entry(*pair)
                out.append(hit)
            ids, how, cost = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.int64()), pa.array(how, pa.string()), pa.array(cost, pa.float64())], names=["curve_id", "mnemonic", "name", "ref_id", "how", "cost"])

    return src.mapInArrow(run, _SHAPE)


def _map_by_parts(src: DataFrame, shared: list) -> DataFrame:
    """``map_curves`` over the dictionaries of several parts: what each finds of a pair of texts, then the first step of which one entry is left."""

    def finder(lookup):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(m, n, *r) for m, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in lookup.value.readings(m, n)]
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["m", "n", "step", "ref_id", "uses", "cost"])

        return run

    pairs, every = src.select("mnemonic", "name").distinct(), None
    for lookup in shared:
        part = pairs.mapInArrow(finder(lookup), "m string, n string, step int, ref_id bigint, uses bigint, cost double")
        every = part if every is None else every.unionByName(part)
    key = F.struct(F.when(F.col("cost") == 0, 0.0).otherwise(F.greatest(F.lit(1e-9), F.col("cost") - USE_WORTH * F.log10(1 + F.col("uses")))), -F.col("uses"), F.col("ref_id"))
    steps = every.groupBy("m", "n", "step").agg(F.min_by(F.struct("ref_id", "cost"), key).alias("hit"), F.count_distinct("ref_id").alias("ids"))
    # several codes in one text say nothing
    steps = steps.filter(~F.col("step").isin(0, 2) | (F.col("ids") == 1))
    best = steps.groupBy("m", "n").agg(F.min_by(F.struct("step", "hit"), "step").alias("best"))
    j = src.join(best, F.col("mnemonic").eqNullSafe(F.col("m")) & F.col("name").eqNullSafe(F.col("n")), "left")
    how = F.coalesce(*[F.when(F.col("best.step") == i, name) for i, name in enumerate(STEPS)], F.lit("none"))
    return j.select("curve_id", "mnemonic", "name", F.coalesce("best.hit.ref_id", F.lit(0)).cast("bigint").alias("ref_id"), how.alias("how"), F.coalesce("best.hit.cost", F.lit(0.0)).alias("cost"))


def misses(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``mnemonic, name, n``: the texts that match no entry, and how many curves have them."""
    return map_curves(curves, ref).filter("ref_id = 0").groupBy("mnemonic", "name").agg(F.count("*").alias("n"))


def found(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``curve_id, ref_id`` of the curves whose mnemonic is not a code as it stands."""
    codes = F.broadcast(ref.select(F.col("code").alias("__code")).distinct())
    mapped = map_curves(curves, ref)
    return mapped.join(codes, F.col("mnemonic") == F.col("__code"), "left_anti").select("curve_id", "ref_id").distinct()
