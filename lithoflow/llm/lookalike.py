"""One form for texts that look the same (look-alike classes, frequent representatives, multi-pattern rewriting).

Which strings look alike is given by pairs: fixed pairs of letters and signs, and rules over the Unicode
character database (width forms, letters of other weight, kinds of blank, invisible characters, composed and combining
accents).  Union-find makes the pairs transitive.  Texts are first spelled out: accents taken off their letters and put
in canonical order, and each character as the first of its class; texts look the same when they are spelled
alike.  The spelling is then rewritten from left to right, the longest pattern first, by one automaton over the
spellings of all members, each class as its member most frequent in the corpus.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

# Letters and signs of the same shape, each group in one string.
SAME_SHAPE = """
AΑА BΒВ CСϹ EΕЕ FϜ GԌ HΗН IΙІӀ JЈͿ KΚКK MΜМ NΝ OΟОՕ PΡР QԚ SЅՏ TΤТ WԜ XΧХ YΥҮ ZΖ
aаɑ cсϲ dԁ eе gɡ hһ iі jјϳ lӏ oοоօ pр qԛ sѕ uս vνѵ wԝ xх yуү
ÄӒ äӓ ËЁ ëё ÏЇ ïї ÖӦ öӧ ĂӐ ăӑ ĔӖ ĕӗ ÈЀ èѐ ÆӔ æӕ ƏӘ əә
AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ SᏚ TᎢ VᏙ WᎳ ZᏃ
|∣ǀ /⁄∕ :∶ !ǃ *∗ ~∼ Δ∆
μµ ΩΩ ÅÅ βϐ ‐‑- ·‧∙⋅· ;; ʹʹ ΓГ ΠП ΦФ
"""
# Characters without a glyph beside those of the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))

#: Where characters with properties stand: the first three planes and the tags; what lies between are ideographs, private or nothing.
CODE_POINTS = (*range(0x30000), *range(0xE0000, 0xE1000))
# Styles of letters that change their shape.
OTHER_SHAPE = ("ITALIC", "SCRIPT", "FRAKTUR", "DOUBLE-STRUCK")


class UnionFind:
    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in self.parent:
            by.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in by.values() if len(v) > 1]


def look_alikes() -> list[list[str]]:
    """The classes of strings that look the same; the class of the empty string is that of invisible characters."""
    u = UnionFind()
    for group in SAME_SHAPE.split():
        for c in group[1:]:
            u.union(group[0], c)
    composed = []
    for c in map(chr, CODE_POINTS):
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if kind == "Zs":
            u.union(" ", c)
        elif kind == "Cf" or c in INVISIBLE:
            u.union("", c)
        parts = unicodedata.decomposition(c).split()
        if parts and parts[0] in ("<wide>", "<narrow>"):
            u.union(c, chr(int(parts[1], 16)))
        elif parts and parts[0] == "<font>" and len(parts) == 2 and unicodedata.name(c, "").startswith("MATHEMATICAL") and not any(w in unicodedata.name(c) for w in OTHER_SHAPE):
            u.union(c, chr(int(parts[1], 16)))
        elif parts and parts[0] == "<compat>" and len(parts) == 2 and "ROMAN NUMERAL" in unicodedata.name(c, ""):
            u.union(c, chr(int(parts[1], 16)))
        elif parts and not parts[0].startswith("<"):
            whole = unicodedata.normalize("NFD", c)
            if len(parts) == 1:
                u.union(c, chr(int(parts[0], 16)))
            else:
                composed.append((c, whole))
    # an accented letter looks like any look-alike of its letter with the accent
    alike: dict[str, list[str]] = {}
    for members in u.classes():
        for m in members:
            alike[m] = [x for x in members if len(x) == 1]
    for c, whole in composed:
        base, marks = whole[0], whole[1:]
        for b in alike.get(base, [base]):
            u.union(c, b + marks)
            if len(marks) == 1 and (one := unicodedata.normalize("NFC", b + marks)) and len(one) == 1:
                u.union(c, one)
    return u.classes()


class Speller:
    """Spells texts so that those that look the same are spelled alike."""

    def __init__(self):
        self.classes = look_alikes()
        own: dict[str, str] = {}
        for members in self.classes:
            singles = [m for m in members if len(m) == 1 and len(unicodedata.normalize("NFD", m)) == 1]
            plain = [m for m in singles if not unicodedata.combining(m)]
            first = "" if "" in members else min(plain or singles, default=None)
            own |= {m: first for m in singles if first is not None and m != first}
        self.table = str.maketrans(own)
        self.invisible = frozenset(m for m, t in own.items() if not t)
        #: spelling of each member but the invisible ones, and the members of each spelling
        self.members: dict[str, list[str]] = {}
        for members in self.classes:
            for m in members:
                if m and (spelled := self(m)):
                    self.members.setdefault(spelled, []).append(m)

    def __call__(self, text: str) -> str:
        # a character may stand for an accent, so the order is made again
        return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(self.table))


@lru_cache(maxsize=1)
def speller() -> Speller:
    return Speller()


_HANGUL = re.compile("[\u1100-\u11ff]+")


@dataclass
class Rewriter:
    """Rewrites every member of a class to the member that is most frequent by ``counts``; picklable."""

    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self._build()

    def _build(self):
        spell = speller()
        self.to: dict[str, str] = {}
        patterns = ahocorasick.Automaton()
        stays = set()
        for spelled, members in spell.members.items():
            best = min(members, key=lambda m: (-self.counts.get(m, 0), len(m), m))
            self.to |= dict.fromkeys(members, best)
            stays.add(best)
            patterns.add_word(spelled, (len(spelled), best))
        patterns.make_automaton()
        self.patterns = patterns
        # a text of none of these stays as it is: members that change, accents, and what is taken apart in spelling
        self.ascii_stays = all(self.to.get(chr(n), chr(n)) == chr(n) and chr(n) not in spell.invisible for n in range(128))
        self.changing = frozenset(m for m, t in self.to.items() if len(m) == 1 and m != t) | spell.invisible | (_taken_apart()[1] - stays) | _taken_apart()[0] | {c for spelled in spell.members for c in spelled[1:]}

    def __getstate__(self):
        return {"counts": self.counts}

    def __setstate__(self, state):
        self.counts = state["counts"]
        self._build()

    def __call__(self, text: str) -> str:
        """``text`` in the one form of all texts that look like it."""
        if text.isascii() and self.ascii_stays or self.changing.isdisjoint(set(text)):
            return text
        text = speller()(text)
        out, at = [], 0
        for end, (size, to) in self.patterns.iter_long(text):
            begin = end + 1 - size
            if begin > at:
                out.append(text[at:begin])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        text = "".join(out)
        return _HANGUL.sub(lambda m: unicodedata.normalize("NFC", m[0]), text) if _HANGUL.search(text) else text


@lru_cache(maxsize=1)
def _taken_apart() -> tuple[frozenset[str], frozenset[str]]:
    """Characters that spelling may put in order or together, and those that it takes apart."""
    every = [chr(n) for n in CODE_POINTS if not 0xD800 <= n <= 0xDFFF]
    ordered = frozenset(c for c in every if unicodedata.combining(c) or 0x1100 <= ord(c) <= 0x11FF)
    return ordered, frozenset(c for c in every if not 0xAC00 <= ord(c) <= 0xD7A3 and unicodedata.normalize("NFD", c) != c)


@lru_cache(maxsize=1)
def _clusters() -> tuple[re.Pattern, frozenset[str]]:
    """A pattern of a character and the accents after it, and the members of more than one code point."""
    members = frozenset(m for c in speller().classes for m in c if len(m) > 1)
    after = "".join(sorted({c for m in members for c in m[1:]}))
    return re.compile(f"[^{re.escape(after)}][{re.escape(after)}]+"), members


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses of each class member over the batches; of a letter with accents, of the letter with each number of them."""
    singles = np.zeros(sys.maxunicode + 1, np.int64)
    longer: Counter[str] = Counter()
    known = {m for c in speller().classes for m in c if len(m) == 1}
    pattern, members = _clusters()
    after = frozenset(c for m in members for c in m[1:])
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        for i in range(0, len(texts), 256):
            joined = "\n".join(texts[i : i + 256])
            code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
            low = np.bincount(code, minlength=0)
            singles[: len(low)] += low
            if not after.isdisjoint(map(chr, np.flatnonzero(low))):
                for cluster, n in Counter(pattern.findall(joined)).items():
                    for size in range(2, len(cluster) + 1):
                        if cluster[:size] in members:
                            longer[cluster[:size]] += n
    counts = {c: int(singles[i]) for i in np.flatnonzero(singles) if not 0xD800 <= i <= 0xDFFF and (c := chr(i)) in known}
    counts |= longer
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["s", "n"])


def fit(df: DataFrame, text: str) -> Rewriter:
    """The rewriter for the texts of ``df``; what reaches the driver is one count for each member of a class."""
    counts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    return Rewriter({r.s: r.n for r in counts.collect()})


def one_form(df: DataFrame, key: str, text: str, rewriter: Rewriter | None = None) -> DataFrame:
    """``key, form``: every text in the form in which texts that look the same are equal.

    Null stays null, an empty text empty; texts are taken whole, repeated rows each for itself.
    """
    shared = df.sparkSession.sparkContext.broadcast(rewriter or fit(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else rewrite(t) for t in b.column(1).to_pylist()], pa.string())], names=["key", "form"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, form string").withColumnRenamed("key", key)


def _marks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, look, own``: hashes of the form and of the text itself, of the texts that are not blank."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, text))

    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = shared.value
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is not None and (form := rewrite(t)).strip():
                    rows.append((k, digest(form), digest(t)))
            ids, look, own = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(look, pa.binary()), pa.array(own, pa.binary())], names=["key", "look", "own"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, look binary, own binary")


def same_look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``a, b`` (a < b): rows whose texts are not blank, differ, and look the same.

    Texts equal code point by code point make no pair, so a group of exact copies costs nothing.
    """
    m = cut(_marks(df, key, text))
    # a look with one text only has no pairs; the aggregate is combined before the shuffle
    several = m.groupBy("look").agg(F.min("own").alias("o1"), F.max("own").alias("o2")).filter("o1 <> o2").select("look")
    part = m.join(several, "look", "left_semi")
    a, b = part.withColumnsRenamed({"key": "a", "own": "__oa"}), part.withColumnsRenamed({"key": "b", "own": "__ob"})
    return a.join(b, "look").filter("a < b and __oa <> __ob").select("a", "b").distinct()


def same_look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class, copies, forms``: a row a text that isn't blank, the least key of those that look like it, how many these are, and how many different texts they have.

    Nothing is expanded: the texts that look the same are counted before they are joined back.
    """
    m = cut(_marks(df, key, text))
    texts = m.groupBy("look", "own").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    per = texts.groupBy("look").agg(F.min("first").alias("class"), F.sum("n").alias("copies"), F.count("*").alias("forms"))
    return m.join(per, "look").select(F.col("key").alias(key), "class", "copies", "forms")


def found(documents: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b``: documents that look the same without being the same."""
    return same_look_pairs(documents, "doc_id", "text").withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})
