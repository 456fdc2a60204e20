"""Repairing text of scanned pages (symmetric-delete candidates, weighted edit distance, bigram context).

1. Running lines go: page-number lines by their shape and the number of their page, titles because lines that
   read alike (characters that scanners confuse folded together) recur over a share of the scans of one source.
2. Lines are joined; a word ended by a hyphen at the end of a line is put together, with or without the
   hyphen, whichever the corpus knows.
3. The lexicon is every unbroken word of the corpus with its count.  Every word form is filed under its forms
   with up to two confusable letters or pairs of letters deleted, a mark kept in their place; forms that meet under
   one key are compared by an edit distance in which only what scanners confuse is cheap, and a form gives way
   to a far more frequent one, or to any known one if it holds signs that stand in no word.  Of several, the
   count and the neighbours' bigram counts decide.  A word without candidate stays as it is.

Forms under one key differ only in what stands at its marks, so a key's group is bounded by the table of
confusions, however large the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

# What a scanner reads, and what it may stand for.
CONFUSIONS = {
    "0": "o", "1": "il", "5": "s", "9": "g", "8": "b", "6": "b", "I": "l", "c": "e", "e": "c", "o": "a", "a": "o", "f": "t", "t": "f", "l": "i",
    "i": "l", "b": "h", "h": "b", "u": "n", "n": "u", "q": "g", "g": "q", "y": "v", "v": "y",
}
# The same for more than one letter.
CONFUSED_GROUPS = {"ri": "n", "rn": "m", "cl": "d", "ii": "u", "vv": "w", "li": "h", "ci": "a", "h": "li", "m": "rn", "d": "cl", "n": "ri", "w": "vv", "u": "ii", "tl": "d", "nn": "m", "lc": "k"}
# Signs that no word holds, with their likeliest letter for names that stand once; hyphens at the end of a line.
ODD = {"0": "o", "1": "l", "5": "s", "9": "g", "8": "b", "6": "b", "I": "l"}
HYPHENS = "-­¬‐‑"

#: Times more frequent a form has to be to replace another; cost of a repair at most; cost of one confusion.
RATIO, MOST_COST, CONFUSION_COST, OTHER_COST = 8, 1.0, 0.5, 1.5
#: Scans of a source on which a title has to recur: so many, and this share of them.
RECUR, RECUR_SHARE = 3, 0.03
#: Words kept worked out in a worker.
KEEP = 200_000
#: Forms to repair that are sent to every executor at most; more are joined by a shuffle.
SENT_FORMS = 100_000
#: Longer words are filed by their ends: so many letters of either end hold at most one of two confusions.
LONG_WORD, END = 26, 12

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_PAGE_LINE = re.compile(r"[\s\[\](){}|.\-–—_*·•]*(?:(?:page|pag\.?|p\.?|pg\.?|seite|s\.)\s*)?(\d{1,5})(?:\s*(?:of|/|von|de)\s*\d{1,5})?[\s\[\](){}|.\-–—_*·•]*", re.IGNORECASE)
# a small word of four letters or more; a line without '|' that has one is no title
_PLAIN_WORD = re.compile(r"(?<![\w'-])(?!chapter)[a-z][\w'-]{3}")
_CALLED = re.compile(r"page|pag|pg|seite", re.IGNORECASE)
_NUMBERED_TITLE = re.compile(r"\s*(?:(\d{1,5})(?:\s{2,}|\s*\|\s*)(\S.*?)|(\S.*?)(?:\s{2,}|\s*\|\s*)(\d{1,5}))\s*")
_CHAPTER = re.compile(r"^\s*chapter\s+\w{1,4}\s*[-–—|:]\s*(?=\S)|\s*[-–—|:]\s*chapter\s+\w{1,4}\s*$", re.IGNORECASE)
_CORE = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.DOTALL)


# What reads alike, as one letter each; then groups of these letters.
_FOLDED = str.maketrans({"0": "a", "o": "a", "1": "i", "l": "i", "5": "s", "9": "g", "q": "g", "8": "n", "6": "n", "b": "n", "h": "n", "u": "n", "c": "e", "f": "t", "y": "v"})
_FOLDED_GROUPS = (("rn", "m"), ("ri", "n"), ("ei", "d"), ("ii", "n"), ("vv", "w"))


def fold(text: str) -> str:
    """A key that is the same for texts that scanners may confuse: letters and digits only, without case."""
    if sum(map(str.isupper, text)) > 2 * sum(map(str.islower, text)):
        text = text.replace("l", "I")  # a small letter among capitals
    t = "".join(c for c in text.lower() if c.isalnum()).translate(_FOLDED)
    for group, one in _FOLDED_GROUPS:
        t = t.replace(group, one)
    return t


def is_title(text: str) -> bool:
    """Whether ``text`` is set like a title: two words or more, those of four letters or more with a capital, no full stop."""
    words = re.findall(r"[^\W_][\w'-]*", text)
    long = [w for w in words if len(w) > 3 and not w.isdigit()]
    return len(words) >= 2 and len(long) >= 1 and all(not w[0].islower() for w in long) and not re.search(r"[.,;:?!]\s*$", text) and sum(c.isalpha() for c in text) >= 6


def title_key(line: str) -> str | None:
    """The fold of a line's title, without page number and chapter; None if it is no title."""
    if "|" not in line and _PLAIN_WORD.search(line):
        return None
    m = _NUMBERED_TITLE.fullmatch(line)
    body = (m.group(2) or m.group(3)) if m else line
    body = _CHAPTER.sub("", body).split("|")[0].strip()
    return fold(body) if is_title(body) else None


@dataclass
class Token:
    """A word between its punctuation; ``other`` is the reading with a hyphen of a word broken at the end of a line."""

    lead: str
    word: str
    trail: str
    other: str | None = None
    paragraph: bool = False

    @property
    def broken(self) -> bool:
        return self.other is not None


def running_line(line: str, page: int | None, titles: frozenset[str] | set[str], alone: bool = True) -> bool:
    """Whether a line is a page-number line or a running title.

    A number counts if it is that of the page or a neighbour's; where the page isn't known, if it is called a page.
    A title is one of ``titles`` or stands beside such a number; ``alone`` is whether one with a chapter is, too.
    """
    if not line.strip():
        return False

    def near(number):
        return page is not None and abs(number - page) <= 2

    m = _PAGE_LINE.fullmatch(line)
    if m and (near(int(m.group(1))) or page is None and _CALLED.search(line)):
        return True
    key = title_key(line)
    if key is None:
        return False
    if key in titles or alone and _CHAPTER.search(line):
        return True
    m = _NUMBERED_TITLE.fullmatch(line)
    return bool(m) and near(int(m.group(1) or m.group(4))) and re.search(r"\s{2,}|\|", line.strip()) is not None


def read(text: str, page: int | None, titles) -> tuple[list[Token], list[str]]:
    """The words of a scan in order, and its running lines as they stand."""
    lines = _LINE.split(text)
    gone: list[str] = []
    kept: list[str] = []
    for line in lines:
        if len(lines) > 1 and running_line(line, page, titles, False):
            gone.append(line.strip())
        else:
            kept.append(line)
    tokens: list[Token] = []
    open_half: tuple[str, str, bool] | None = None
    paragraph = False
    for line in kept:
        parts = line.split()
        if not parts:
            paragraph = bool(tokens)
            continue
        if open_half:
            lead, half, para = open_half
            _, word, trail = _CORE.match(parts[0]).groups()
            if word and not parts[0][0].isspace() and parts[0].startswith(word):
                end = parts[0][-1] in HYPHENS and len(parts) == 1
                tokens.append(Token(lead, half + word, "" if end else trail, f"{half}-{word}", para))
                parts = parts[1:]
            else:
                tokens.append(Token(lead, half, "-", None, para))
            open_half, paragraph = None, False
        for i, p in enumerate(parts):
            lead, word, trail = _CORE.match(p).groups()
            if i == len(parts) - 1 and word and trail and trail[-1] in HYPHENS and not trail[:-1] and word[-1].isalnum() and any(c.isalpha() for c in word):
                open_half = (lead, word, paragraph)
            else:
                tokens.append(Token(lead, word, trail, None, paragraph))
            paragraph = False
    if open_half:
        tokens.append(Token(open_half[0], open_half[1], "-", None, open_half[2]))
    return tokens, gone


@lru_cache(maxsize=KEEP)
def word_key(word: str) -> str:
    """A word without case; a capital I behind a small letter stays, as it is none."""
    if word.isupper():
        return word.lower()
    return "".join("I" if c == "I" and i and (word[i - 1].islower() or word[i - 1] == "I" and i > 1) else c.lower() for i, c in enumerate(word))


_NUMBER_OR_LABEL = re.compile(r"[1-9]\d*[^\W\d]+|[^\W\d]+\d+")


@lru_cache(maxsize=KEEP)
def is_word(key: str) -> bool:
    """Whether a key may be a word: mostly letters, or letters and signs read for letters (``l0g``), but no number with a unit."""
    letters, digits = sum(c.isalpha() for c in key), sum(c.isdigit() for c in key)
    if not all(c.isalnum() or c in "-'’" for c in key):
        return False
    if letters >= 2 and letters > 2 * digits:
        return True
    return letters >= 1 and digits >= 1 and len(key) >= (2 if key[0] == "0" else 3) and all(c in ODD for c in key if c.isdigit()) and not _NUMBER_OR_LABEL.fullmatch(key)


# the units that a confusion may have read, and those that may have stood there
_READ_UNITS = frozenset(CONFUSIONS) | frozenset(CONFUSED_GROUPS)
_TRUE_UNITS = frozenset(c for v in CONFUSIONS.values() for c in v) | frozenset(CONFUSED_GROUPS.values())
_MARK = "*"


def _units(word: str, units: frozenset[str], upto: int) -> list[tuple[int, int]]:
    return [(i, i + n) for i in range(min(len(word), upto)) for n in (1, 2) if i + n <= len(word) and word[i : i + n] in units]


def deletions(word: str, units: frozenset[str] = _READ_UNITS | _TRUE_UNITS) -> set[str]:
    """The keys of ``word``: its forms with one or two of ``units`` deleted and marked.

    Of a word over ``LONG_WORD`` letters the first and the last ``END`` letters, with one unit deleted at most: of
    two confusions one end holds at most one.  A word that a confusion may make as long is filed in both ways.
    """
    out = set()
    if len(word) > LONG_WORD - 2:
        for side, end, of in (("<", word[: END + 2], units), (">", word[: -END - 3 : -1], frozenset(u[::-1] for u in units))):
            out.add(side + end[:END])
            out |= {side + (end[:a] + _MARK + end[b:])[:END] for a, b in _units(end, of, END)}
    if len(word) <= LONG_WORD:
        at = _units(word, units, len(word))
        out |= {word[:a] + _MARK + word[b:] for a, b in at}
        out |= {word[:a] + _MARK + word[b:c] + _MARK + word[d:] for i, (a, b) in enumerate(at) for c, d in at[i + 1 :] if c >= b}
    return out


def repair_cost(seen: str, true: str, most: float = MOST_COST) -> float:
    """Weighted edit distance of what was read to what may have stood there; confusions of letters and groups are cheap."""
    # equal ends cost nothing, but for one letter that a confused group may take in
    a, b = 0, 0
    least = min(len(seen), len(true))
    while a < least and seen[a] == true[a]:
        a += 1
    while b < least - a and seen[-1 - b] == true[-1 - b]:
        b += 1
    a, b = max(0, a - 1), max(0, b - 1)
    seen, true = seen[a : len(seen) - b], true[a : len(true) - b]
    n, m = len(seen), len(true)
    if abs(n - m) > 2:
        return 99.0
    # what is left is worked out on a band around the diagonal
    row = [[99.0] * (m + 1) for _ in range(n + 1)]
    row[0][0] = 0.0
    for i in range(n + 1):
        # within the cost no path strays further from the diagonal
        for j in range(max(0, i - 3), min(m, i + 3) + 1):
            here = row[i][j]
            if here > most:
                continue
            if i < n and j < m:
                step = 0.0 if seen[i] == true[j] else CONFUSION_COST if true[j] in CONFUSIONS.get(seen[i], "") else OTHER_COST
                row[i + 1][j + 1] = min(row[i + 1][j + 1], here + step)
            if i < n:
                row[i + 1][j] = min(row[i + 1][j], here + OTHER_COST)
            if j < m:
                row[i][j + 1] = min(row[i][j + 1], here + OTHER_COST)
            for size in (1, 2):
                group = CONFUSED_GROUPS.get(seen[i : i + size]) if i + size <= n else None
                if group and true.startswith(group, j):
                    k = j + len(group)
                    row[i + size][k] = min(row[i + size][k], here + CONFUSION_COST)
    return row[n][m]


# --- stages ----------------------------------------------------------------------------------------------


def scans(text_blocks: DataFrame, images: DataFrame) -> DataFrame:
    """``rec, id, source, page, text`` of all scanned texts; rows without id are left out."""

    def of(df, rec, text):
        return df.select(F.lit(rec).alias("rec"), F.col("id").cast("string").alias("id"), F.col("source_file").cast("string").alias("source"), F.col("page_number").cast("int").alias("page"), F.col(text).cast("string").alias("text"))

    every = of(text_blocks, "text_block", "text").unionByName(of(images, "image_context", "context_text")).unionByName(of(images, "image_caption", "caption"))
    return every.filter("id is not null").dropDuplicates(["rec", "id"])


def _title_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["rec", "id", "source", "key"]
    for b in batches:
        rows: list[tuple] = []
        for rec, name, source, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            lines = _LINE.split(text or "")
            if len(lines) > 1:
                rows += [(rec, name, source, key) for key in {title_key(line) for line in lines} if key]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)


def with_titles(df: DataFrame) -> DataFrame:
    """The scans with ``titles``, the folds of their lines that recur in their source."""
    seen = df.select("rec", "id", "source", "text").mapInArrow(_title_batches, "rec string, id string, source string, key string")
    # counted with partial sums, and joined back line by line: neither a source nor a title makes a group
    size = df.groupBy(F.col("source").alias("__of")).agg(F.count("*").alias("size"))
    often = seen.groupBy("source", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= RECUR).join(size, F.col("source").eqNullSafe(F.col("__of")))
    often = often.filter(F.col("n") >= RECUR_SHARE * F.col("size")).select(F.col("source").alias("__s"), F.col("key").alias("__t"))
    own = seen.join(often, F.col("source").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__t")), "left_semi")
    titles = own.groupBy("rec", "id").agg(F.collect_set("key").alias("titles"))
    return df.join(titles, ["rec", "id"], "left")


_READ = "rec string, id string, lines array<string>, tokens array<struct<w: string, word: boolean>>, broken array<struct<pos: int, word: string, other: string, before: string, after: string>>"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    token = pa.struct([("w", pa.string()), ("word", pa.bool_())])
    halves = pa.struct([("pos", pa.int32()), *[(n, pa.string()) for n in ("word", "other", "before", "after")]])
    for b in batches:
        lines, size, flat, plain, broken = [], [0], [], [], []
        for page, text, titles in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
            tokens, gone = read(text or "", page, set(titles or ()))
            keys = [word_key(t.word) for t in tokens]
            lines.append(gone)
            flat += keys
            plain += [not t.broken and is_word(k) for t, k in zip(tokens, keys)]
            size.append(len(flat))
            broken.append([
                {"pos": i, "word": k, "other": word_key(t.other), "before": keys[i - 1] if i else "", "after": keys[i + 1] if i + 1 < len(keys) else ""}
                for i, (t, k) in enumerate(zip(tokens, keys)) if t.broken and is_word(k)
            ])
        words = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays([pa.array(flat, pa.string()), pa.array(plain, pa.bool_())], fields=list(token)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.string())), words, pa.array(broken, pa.list_(halves))], names=["rec", "id", "lines", "tokens", "broken"])


_SIGN = "[" + "".join(ODD) + "]"
#: Forms with signs, of which any known word may stand for them: no labels, and more letters than twice the digits.
_ODD_FORM = rf"^(?=.*{_SIGN})(?!\D+\d+$)[^2347]*$"
#: Names that may stand once: one sign between small letters of a longer word.
_ONE_SIGN = rf"^\p{{Ll}}+{_SIGN}\p{{Ll}}+$"
_LEAST_NAME = 7


def _file(units: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[str] = []
            at: list[int] = []
            for i, w in enumerate(b.column(0).to_pylist()):
                forms = deletions(w, units)
                if any(c in ODD for c in w):
                    # all signs have to give way
                    forms = [f for f in forms if f[0] in "<>" or not any(c in ODD for c in f)]
                keys += forms
                at += [i] * len(forms)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[c.take(at) for c in b.columns]], names=["key", *b.schema.names])

    return run


def _cost_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cost = pa.array([repair_cost(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.float64())
        yield pa.RecordBatch.from_arrays([*b.columns, cost], names=["word", "to", "n_to", "cost"])


def candidates(forms: DataFrame) -> DataFrame:
    """``word, found``: what each of ``forms`` (word, n; 0 for one the corpus doesn't know) may stand for, an array of ``to, n_to, cost``.

    A form with one sign between the letters of a longer word, of which no other reading is known, may stand for its
    likeliest spelling, which is filed with a count of 0.
    """
    odd = F.col("word").rlike(_ODD_FORM) & (F.length(F.regexp_replace("word", r"[\d]", "")) > 2 * F.length(F.regexp_replace("word", r"[^\d]", "")))
    guess = F.col("word")
    for sign, letter in ODD.items():
        guess = F.replace(guess, F.lit(sign), F.lit(letter))
    names = forms.filter(F.col("word").rlike(_ONE_SIGN) & (F.length("word") >= _LEAST_NAME)).select(guess.alias("to"), F.lit(0).cast("bigint").alias("n_to"))
    # only forms without signs are what others stand for, and before the join
    true = forms.filter((F.col("n") > 0) & ~F.col("word").rlike("[0-9I]")).select(F.col("word").alias("to"), F.col("n").alias("n_to")).unionByName(names)
    true = true.mapInArrow(_file(_TRUE_UNITS), "key string, to string, n_to bigint")
    read_as = forms.filter(~F.col("word").rlike("[2347]")).select("word", F.when(odd, 0).otherwise(F.greatest(RATIO * F.col("n"), F.lit(RATIO // 2))).alias("least"))
    read_as = read_as.mapInArrow(_file(_READ_UNITS), "key string, word string, least bigint")
    # keys are many times the bytes Spark takes the forms for, so no side is to be sent round
    met = read_as.join(true.hint("merge"), "key").filter((F.col("word") != F.col("to")) & (F.col("n_to") >= F.col("least"))).select("word", "to", "n_to").distinct()
    costed = met.mapInArrow(_cost_batches, "word string, to string, n_to bigint, cost double").filter(F.col("cost") <= MOST_COST)
    one = F.struct("to", "n_to", "cost")
    found = costed.groupBy("word").agg(F.array_sort(F.collect_set(one)).alias("found"))
    known = F.filter("found", lambda x: x["n_to"] > 0)
    return found.select("word", F.when(F.size(known) > 0, known).otherwise(F.col("found")).alias("found"))


def repairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rec, id, source, page, text``: the repaired words ``rec, id, pos, restored``, and the running lines ``rec, id, line``.

    A word is repaired if it was broken or has a candidate; others stay and don't come out.
    """
    src = with_titles(df.filter("text is not null")).select("rec", "id", "page", "text", "titles")
    texts = cut(src.mapInArrow(_read_batches, _READ))
    beside = "inline(transform(tokens, (t, i) -> struct(i as pos, t.w as word, t.word as known, if(i > 0, tokens[i - 1].w, '') as before, coalesce(get(tokens, i + 1).w, '') as after)))"
    words = texts.select("rec", "id", F.expr(beside)).filter("known").drop("known")
    lexicon = cut(texts.select(F.explode("tokens").alias("t")).filter("t.word").groupBy(F.col("t.w").alias("word")).agg(F.count("*").alias("n")))
    # a broken word is read with or without its hyphen, as the corpus has it
    broken = texts.select("rec", "id", F.expr("inline(broken)"))
    halves = broken.select("word", "other").distinct()
    either = halves.select("word", "other", F.expr("inline(array(struct(word as w, 0 as r), struct(other as w, 1 as r)))")).join(lexicon.withColumnRenamed("word", "w"), "w", "left")
    seen = either.groupBy("word", "other").agg(F.coalesce(F.max(F.when(F.col("r") == 0, F.col("n"))), F.lit(0)).alias("n0"), F.coalesce(F.max(F.when(F.col("r") == 1, F.col("n"))), F.lit(0)).alias("n1"))
    settled = cut(seen.select("word", "other", F.when(F.col("n1") > F.col("n0"), F.col("other")).otherwise(F.col("word")).alias("base"), ((F.col("n0") == 0) & (F.col("n1") == 0)).alias("unknown")))
    both = settled.filter("unknown").select(F.explode(F.array("word", "other")).alias("word"), F.lit(0).cast("bigint").alias("n"))
    found = cut(candidates(lexicon.unionByName(both.distinct())))
    # the words of the corpus only move where the forms to repair are too many to send round
    few = found.count() <= SENT_FORMS
    hits = words.join(F.broadcast(found) if few else found, "word").select("rec", "id", "pos", "before", "after", F.lit(None).cast("string").alias("base"), "found")
    # of a broken word that the corpus doesn't know, the reading with the hyphen is asked for too
    asked = settled.select("word", "other", "base", F.expr("explode(if(unknown, array(word, other), array(base))) as w")).join(found.withColumnRenamed("word", "w"), "w", "left")
    asked = asked.groupBy("word", "other", "base").agg(F.flatten(F.collect_list("found")).alias("found"))
    hits = hits.unionByName(broken.join(asked, ["word", "other"]).select(*hits.columns))
    hits = cut(hits)
    plain = hits.filter("size(found) <= 1").select("rec", "id", "pos", F.coalesce(F.expr("get(found, 0).to"), "base").alias("restored"))
    # where several may stand, the neighbours' bigrams count; these are counted before they move
    several = hits.filter("size(found) > 1").select("rec", "id", "pos", "before", "after", F.expr("inline(found)"))
    beside = several.select("rec", "id", "pos", "to", "n_to", "cost", F.expr("inline(array(struct(before as w1, to as w2), struct(to as w1, after as w2)))"))
    pairs = words.filter("after <> ''").groupBy(F.col("word").alias("w1"), F.col("after").alias("w2")).agg(F.count("*").alias("c"))
    scored = beside.join(pairs, ["w1", "w2"], "left").groupBy("rec", "id", "pos", "to", "n_to", "cost").agg(F.sum(F.log1p(F.coalesce("c", F.lit(0)))).alias("context"))
    score = F.log1p("n_to") - 6 * F.col("cost") + F.col("context")
    chosen = scored.groupBy("rec", "id", "pos").agg(F.min_by("to", F.struct((-score).alias("s"), F.col("to").alias("t"))).alias("restored"))
    return plain.unionByName(chosen), texts.select("rec", "id", F.explode("lines").alias("line"))


def _like(word: str, restored: str) -> str:
    """``restored`` with the capitals of ``word``."""
    if word.isupper() and len(word) > 1:
        return restored.upper()
    return restored[:1].upper() + restored[1:] if word[:1].isupper() else restored


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for page, text, titles, fixes in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
            if text is None:
                out.append(None)
                continue
            tokens, _ = read(text, page, set(titles or ()))
            fix = {f["pos"]: f["restored"] for f in fixes or ()}
            words = []
            for i, t in enumerate(tokens):
                word = _like(t.word, fix[i]) if i in fix else t.word
                words.append(("\n\n" if t.paragraph else " " if i else "") + t.lead + word + t.trail)
            out.append("".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["rec", "id", "text"])


def repair_texts(df: DataFrame) -> DataFrame:
    """``rec, id, text``: the scans as continuous paragraphs; null stays null, an empty text empty."""
    fixed, _ = repairs(df)
    by = fixed.groupBy("rec", "id").agg(F.collect_list(F.struct("pos", "restored")).alias("fixes"))
    src = with_titles(df).join(by, ["rec", "id"], "left").select("rec", "id", "page", "text", "titles", "fixes")
    return src.mapInArrow(_write_batches, "rec string, id string, text string")


def found(text_blocks: DataFrame, images: DataFrame) -> DataFrame:
    """``rec, id, kind, restored``: the words restored, in lower case, and the running lines that go."""
    words, lines = repairs(scans(text_blocks, images))
    return words.select("rec", "id", F.lit("word").alias("kind"), "restored").unionByName(lines.select("rec", "id", F.lit("line").alias("kind"), F.col("line").alias("restored"))).distinct()
