"""Column expressions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab

#: Unicode white space, in a form that Java and RE2 read alike.
WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def clean(text: Column) -> Column:
    """White space run together, page numbers taken out, bullets, dashes and curly quotes plain."""
    t = F.regexp_replace(text, WS + "+", " ")
    t = F.regexp_replace(F.regexp_replace(t, "Page [0-9]+", ""), "^[0-9]+ *$", "")
    t = F.replace(F.replace(t, F.lit("•"), F.lit("* ")), F.lit("–"), F.lit("-"))
    return F.trim(F.translate(t, "“”‘’", "\"\"''"))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def terms_in(text: Column, terms: list[str], whole_words: bool = False) -> Column:
    """Those of ``terms`` that stand in ``text`` in any case, in order; as part of words too, unless ``whole_words``."""
    if whole_words:
        # constant patterns are made once; one is only tried where its term stands at all
        def within(low):
            return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())) & F.rlike(low, F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{t.lower()}\E(?![\p{{L}}\p{{N}}])")), F.lit(t)) for t in terms]))
    else:
        pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(t.lower()).alias("low")) for t in terms])

        def within(low):
            return F.transform(F.filter(pairs, lambda p: F.contains(low, p["low"])), lambda p: p["term"])

    # the lower case is made once a text, not once a term
    return F.get(F.transform(F.array(F.lower(text)), within), F.lit(0))


def density(text: Column, terms: list[str]) -> Column:
    """Distinct terms a word."""
    return F.size(terms_in(text, terms)) / F.greatest(F.size(words(text)), F.lit(1))


def first_match(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found in ``text``."""
    out = None
    for pattern, label in cases:
        hit = F.rlike(text, F.lit(pattern))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def chunk_kind(text: Column) -> Column:
    """pattern, surface, environment or general, by the number of keywords of each kind."""
    p, s, e = (F.size(terms_in(text, k)) for k in (vocab.PATTERN_KEYWORDS, vocab.SURFACE_KEYWORDS, vocab.ENVIRONMENT_KEYWORDS))
    return F.when((p > s) & (p > e), "pattern").when(s > e, "surface").when(e > 0, "environment").otherwise("general")


# What the words of a caption and its context say about an image, in order.
IMAGE_CASES = [
    ("log|curve|track|gr|resistivity", "well_log"), ("seismic|reflection|amplitude", "seismic"), ("core|sample|thin section", "core_photo"),
    ("map|contour|structure|isopach", "geological_map"), ("chart|diagram|schematic|model", "diagram"), ("table|data|list", "table"),
    ("outcrop|field|exposure", "field_photo"), ("figure|fig", "figure"),
]


def image_kind(caption: Column, context: Column) -> Column:
    return first_match(F.lower(F.concat_ws(" ", caption, context)), IMAGE_CASES, "other")


def block_kind(text: Column, size: Column, flags: Column) -> Column:
    """header (large and bold), caption, list or paragraph."""
    low = F.trim(F.lower(text))
    big = (F.coalesce(size, F.lit(0)) > 14) & (F.coalesce(flags, F.lit(0)).bitwiseAND(16) != 0)
    return F.when(big, "header").when(low.rlike(r"^(figure|fig\.|table|plate)"), "caption").when(low.rlike(r"^(•|-|1\.|a\)|i\))"), "list").otherwise("paragraph")


def structure_level(kind: Column, size: Column) -> Column:
    """1 to 3 for headers by size, 4 for captions, 5 for the rest."""
    s = F.coalesce(size, F.lit(0))
    return F.when(kind == "header", F.when(s > 18, 1).when(s > 14, 2).otherwise(3)).when(kind == "caption", 4).otherwise(5)


def page_of(content: Column) -> Column:
    """The page number a text names, else 0."""
    found = [F.regexp_extract(content, p, 1) for p in vocab.PAGE_PATTERNS]
    return F.coalesce(*[F.when(x != "", x.try_cast("int")) for x in found], F.lit(0))


def caption_in(text: Column) -> Column:
    """The first caption in a text, by kind: figure, fig., table, plate; null if none."""
    found = [F.regexp_extract(text, "(?i)" + p, 0) for p in vocab.CAPTION_PATTERNS]
    return F.coalesce(*[F.when(x != "", F.trim(x)) for x in found])


def caption_of(around: Column, below: Column) -> Column:
    """The caption named in the text around an image, else what stands below it if that is short, else the empty text."""
    under = F.trim(below)
    return F.coalesce(caption_in(around), F.when(F.length(under) < 200, under), F.lit(""))


def first_terms(terms: Column, most: int = 3) -> Column:
    """The first ``most`` of a list, and how many more there are."""
    kept = F.array_join(F.slice(terms, 1, most), ", ")
    return F.when(F.size(terms) > most, F.concat(kept, F.format_string(" (+%d more)", F.size(terms) - most))).otherwise(kept)


def result_line(content: Column, page: Column, score: Column, terms: Column, width: int = 200) -> Column:
    """A search result in one line: page, score to three places, shortened content, first terms."""
    return F.concat_ws(" | ", F.format_string("Page %d", F.coalesce(page, F.lit(0))), F.format_string("%.3f", score), shortened(F.regexp_replace(content, WS + "+", " "), width), F.nullif(first_terms(terms), F.lit("")))


def shortened(text: Column, n: int) -> Column:
    """``text``, or its first ``n`` characters and three points."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def concepts(answer: Column, most: int = 10) -> Column:
    """Up to ``most`` concept words of an answer, in alphabetical order."""
    found = F.filter(F.split(answer, r"[^\p{L}\p{N}_]+"), lambda w: F.rlike(w, F.lit(r"^([A-Z][a-z]+|[a-z]{4,})$")))
    found = F.transform(found, lambda w: F.lower(w))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda w: ~w.isin(vocab.ANSWER_COMMON_WORDS)))), 1, most)


def visual_indicators(red: Column, green: Column, blue: Column, width: Column, height: Column, caption: Column) -> Column:
    """What colour, shape and caption of an image hint at."""
    mean = (red + green + blue) / 3
    spread = F.sqrt(((red - mean) * (red - mean) + (green - mean) * (green - mean) + (blue - mean) * (blue - mean)) / 3)
    ratio, low = F.try_divide(width, height), F.lower(caption)
    return F.array_compact(F.array(
        F.when((red > green) & (red > blue), F.lit("reddish_coloration")), F.when(spread < 20, F.lit("grayscale_pattern")),
        F.when(ratio > 3, F.lit("horizontal_log_pattern")).when(ratio < 0.5, F.lit("vertical_log_pattern")),
        F.when(low.rlike("gamma ray|gr"), F.lit("gamma_ray_log")),
        F.when(low.rlike("resistivity"), F.lit("resistivity_log")), F.when(low.rlike("sequence"), F.lit("sequence_stratigraphic_content")),
    ))


def systems_tracts(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(t)) for w, t in (("lowstand", "LST"), ("transgressive", "TST"), ("highstand", "HST"))]))


def key_surfaces(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(t)) for w, t in (("maximum flooding", "MFS"), ("transgressive surface", "TS"), ("sequence boundary", "SB"))]))


def environment(text: Column) -> Column:
    """The first environment of the list named in the text, else Undetermined."""
    return F.coalesce(F.initcap(F.get(terms_in(text, vocab.ENVIRONMENTS), F.lit(0))), F.lit("Undetermined"))


# Words that modify an environment.
MODIFIERS = ["shallow", "deep", "high energy", "low energy", "progradational", "transgressive"]


def detailed_environment(text: Column) -> Column:
    found = terms_in(text, MODIFIERS)
    return F.when(F.size(found) > 0, F.concat_ws(" ", F.array_join(found, " "), F.lower(environment(text)))).otherwise(environment(text))


def statements(text: Column, starts: list[str], longer_than: int, most: int) -> Column:
    """What follows each of ``starts`` up to a full stop or the end of a line, by start, then place."""
    # a run may not begin inside the one before; what a line break ends within the text is none
    runs = [F.regexp_extract_all(text, F.lit(rf"(?i)({s}[^.\n]*)(?:\.|\z|\n\z)"), F.lit(1)) for s in starts]
    return F.slice(F.filter(F.transform(F.flatten(F.array(*runs)), lambda x: F.trim(x)), lambda x: F.length(x) > longer_than), 1, most)


def scale_factor(width: Column, height: Column) -> Column:
    """How much an image may be enlarged: by its lesser side, and so that it fits 1600 x 1200."""
    side = F.least(width, height)
    most = F.when(side < 200, 10.0).when(side < 400, 6.0).when(side < 600, 4.0).when(side < 800, 2.0)
    fit = F.least(F.try_divide(F.lit(1600.0), width), F.try_divide(F.lit(1200.0), height))
    return F.when(most.isNotNull(), F.greatest(F.least(fit, most), F.lit(1.0))).otherwise(F.greatest(fit, F.lit(1.0)))


def lanczos_size(width: Column, height: Column) -> Column:
    """``struct<width, height>`` of an image enlarged to fit 1600 x 1200, 8 times at most; one that needn't grow stays as it is."""
    scale = F.least(F.try_divide(F.lit(1600.0), width), F.try_divide(F.lit(1200.0), height), F.lit(8.0))
    grown = lambda side: F.when(scale > 1, F.floor(side * scale)).otherwise(side).cast("int")
    return F.struct(grown(width).alias("width"), grown(height).alias("height"))


def improvement(old: Column, new: Column) -> Column:
    """How many times ``old`` a measure of an image became; 0 where there was nothing."""
    return F.when(old > 0, new / old).otherwise(0.0)


def answer_confidence(failed: Column, concepts_found: Column, pattern: Column, interpretation: Column, question: Column, analysis: Column) -> Column:
    """The share of five signs of a good answer."""
    shared = F.size(F.array_intersect(words(F.lower(question)), words(F.lower(analysis))))
    signs = [~failed, F.size(concepts_found) > 0, F.coalesce(pattern, F.lit("unknown")) != "unknown", F.length(interpretation) > 20, shared >= 2]
    return sum(F.coalesce(s, F.lit(False)).cast("int") for s in signs) / 5


def analysis_confidence(question: Column, content: Column, description: Column, analysis: Column, context: Column, terms: list[str], quality: float = 0.8) -> Column:
    """Weighted mean of image quality, agreement with the question, technical terms, context and completeness."""
    low = [t.lower() for t in terms]
    in_q, in_c = terms_in(question, low), terms_in(content, low)
    both = F.size(F.array_intersect(in_q, in_c))
    one = F.size(F.array_union(in_q, in_c)) - both
    alignment = F.least(0.3 * both + 0.1 * one, F.lit(1.0))
    technical = F.size(F.array_union(terms_in(description, low), terms_in(analysis, low))) / max(len(low), 1)
    around = F.when(F.length(context) > 100, 0.8).when(F.length(context) > 50, 0.6).otherwise(0.5)
    whole = F.when((F.length(analysis) > 200) & (F.size(terms_in(analysis, low)) > 0), 0.9).when(F.length(analysis) > 100, 0.8).otherwise(0.7)
    return quality * 0.20 + alignment * 0.25 + F.least(technical, F.lit(1.0)) * 0.20 + around * 0.15 + whole * 0.20


def term_words(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """``key, term``: those of the terms of one word that stand in a text as whole words, in lower case, each once a row.

    A text is split into its words, which are looked up, so the work doesn't grow with the list.  Null texts hold none.
    """
    single = sorted({t.lower() for t in terms if re.fullmatch(r"[^\W_]+", t)})
    found = F.array_intersect(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))), literals(single))
    return df.select(key, F.explode(found).alias("term")).distinct()
