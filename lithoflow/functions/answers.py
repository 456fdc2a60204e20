"""Expressions and small driver-side rules around questions and answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from . import vocab


def without_repetition(reply: Column, alike: float = 0.8, least: int = 20, enough: int = 1500) -> Column:
    """A model's reply without paragraphs that repeat one kept, up to ``enough`` characters, ended at a sentence.

    Two paragraphs are alike when they share more than ``alike`` of the larger one's words.
    """
    parts = F.filter(F.transform(F.split(reply, "\n\n"), lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"\*{3,}", "**")), lambda p: F.length(p) > least)

    def bag(p):
        return F.array_distinct(tx.words(F.lower(p)))

    def step(kept, p):
        same = F.exists(kept, lambda k: F.size(F.array_intersect(bag(k), bag(p))) > alike * F.greatest(F.size(bag(k)), F.size(bag(p))))
        full = F.length(F.array_join(kept, "\n\n")) > enough
        return F.when(same | full, kept).otherwise(F.concat(kept, F.array(p)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "\n\n")
    upto = F.regexp_extract(joined, r"(?s)^(.*[.!?])", 1)
    return F.when(~joined.rlike(r"[.!?]\z") & (F.length(upto) - 1 > F.floor(F.length(joined) / 2)), upto).otherwise(joined)


# Questions that point at a result, words left out, and word parts that mark geology.
POINTING = ["result", "figure", "image", "show", "display"]
LEFT_OUT = ["the", "and", "for", "with", "this", "that", "from"]
MARKS = ["rock", "sed", "geo", "strat", "pale", "meso", "cret", "tert", "quat"]
CONTEXT_MARKS = ["geo", "rock", "sed", "strat", "form"]


def enhanced_question(question: Column, page_texts: Column, content: Column, context: Column) -> Column:
    """A vague question put in terms of what is around it: page texts (an array), an image's content and context; terms in alphabetical order."""
    any_of = lambda c, parts: F.exists(tx.literals(parts), lambda p: F.contains(c, p))
    alpha = lambda w: F.rlike(w, F.lit(r"^\p{L}+$"))
    none = F.array().cast("array<string>")
    page = F.flatten(F.transform(F.slice(F.coalesce(page_texts, none), 1, 3), lambda t: F.filter(tx.words(F.lower(t)), lambda w: (F.length(w) > 3) & alpha(w) & ~w.isin(LEFT_OUT))))
    own = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")
    around = F.filter(tx.words(F.lower(F.coalesce(context, F.lit("")))), lambda w: (F.length(w) > 4) & alpha(w) & any_of(w, CONTEXT_MARKS))
    terms = F.array_sort(F.array_distinct(F.concat(page, F.transform(F.slice(own, 1, 5), lambda t: F.lower(t)), around)))
    best = F.filter(terms, lambda t: any_of(t, MARKS))
    pointing = any_of(F.lower(question), POINTING)
    join = lambda c, n: F.array_join(F.slice(c, 1, n), " ")
    return (
        F.when(pointing & (F.size(best) > 0), F.concat(F.lit("geological "), join(best, 3), F.lit(" classification")))
        .when(pointing & (F.size(terms) > 0), F.concat(F.lit("geological "), join(terms, 3)))
        .when((F.size(tx.words(question)) <= 4) & (F.size(own) > 0), F.concat(F.lit("geological "), join(own, 2), F.lit(" analysis")))
        .otherwise(question)
    )


def relevance_label(score: Column, high: float = 0.7, middle: float = 0.4) -> Column:
    return F.when(score >= high, "High").when(score >= middle, "Moderate").otherwise("Low")


def content_description(kind: Column) -> Column:
    """What a type of content is, in words."""
    table = F.create_map(*[F.lit(x) for kv in vocab.CONTENT_DESCRIPTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(vocab.CONTENT_DESCRIPTIONS["other"]))


# Words of the diagrams that can be told apart.
LOG_WORDS = ["gamma ray", "resistivity", "neutron", "density", "sp", "log", "curve"]
SEQUENCE_WORDS = ["sequence", "tst", "lst", "hst", "systems tract", "mfs", "sb", "boundary"]
ENVIRONMENT_WORDS = ["depositional", "environment", "facies", "marine", "fluvial", "deltaic"]


def diagram_kinds(context: Column, width: Column, height: Column) -> Column:
    """``struct<well_log, sequence, depositional>``: what an image may be, by its context and shape."""
    n = lambda words: F.size(tx.terms_in(F.coalesce(context, F.lit("")), words))
    tall = F.coalesce(F.try_divide(height, width) > 1.5, F.lit(False))
    return F.struct(((n(LOG_WORDS) >= 2) | tall).alias("well_log"), (n(SEQUENCE_WORDS) >= 2).alias("sequence"), (n(ENVIRONMENT_WORDS) >= 1).alias("depositional"))


def explanation(caption: Column, interpretation: Column, concepts: Column, scanned: Column) -> Column:
    """An image in words: what there is of description, interpretation, concepts and text in it."""
    some = lambda label, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(label), c))
    names = F.array_join(F.slice(F.coalesce(concepts, F.array().cast("array<string>")), 1, 5), ", ")
    parts = F.concat_ws(" | ", some("Image description: ", caption), some("Geological interpretation: ", interpretation), some("Key geological concepts: ", names), some("Text in image: ", tx.shortened(scanned, 100)))
    return F.when(parts != "", parts).otherwise("No explanation without a closer analysis.")


# Words of a question and what it asks about, in order.
ASKED = [
    ("what|describe|explain", "content"), ("pattern|signature|shape", "pattern"), ("environment|depositional", "environment"),
    ("sequence|stratigraphy|systems tract", "sequence"), ("log|curve|gamma ray|resistivity", "logs"),
]
# The concepts that tell of each.
ENVIRONMENT_CONCEPTS = ["marine", "fluvial", "deltaic", "aeolian"]
SEQUENCE_CONCEPTS = ["LST", "TST", "HST", "SB", "MFS", "TS"]
LOG_CONCEPTS = ["gamma ray", "resistivity", "neutron", "density", "SP"]


def asked_about(question: Column) -> Column:
    """What a question asks about: content, pattern, environment, sequence, logs or, if none of these, general."""
    return tx.first_match(F.lower(question), ASKED, "general")


def explained(question: Column, caption: Column, interpretation: Column, concepts: Column, scanned: Column, pattern: Column) -> Column:
    """An answer to a question about an image, from what is known of it, by what the question asks about."""
    said, about = F.coalesce(interpretation, F.lit("")), asked_about(question)
    tells = F.coalesce(concepts, F.array().cast("array<string>"))
    some = lambda known: F.filter(tells, lambda c: c.isin(known))
    named = lambda known: F.array_join(some(known), ", ")
    or_else = lambda text: F.when(said != "", said).otherwise(F.lit(text))
    kind = F.coalesce(pattern, F.lit("unknown"))
    shape = (
        F.when(kind == "well_log", F.concat(F.lit("Well log patterns. "), or_else("They tell of the deposition.")))
        .when(kind == "sequence_stratigraphy", F.concat(F.lit("Sequence stratigraphic patterns. "), or_else("They show systems tracts and sequence boundaries.")))
        .otherwise(F.concat(F.lit("Geological pattern type: "), kind, F.lit(". "), or_else("It needs a closer analysis.")))
    )
    place = (
        F.when(said.rlike("environment|depositional"), said)
        .when(F.size(some(ENVIRONMENT_CONCEPTS)) > 0, F.concat(F.lit("It relates to a depositional environment: "), named(ENVIRONMENT_CONCEPTS), F.lit(".")))
        .otherwise("Depositional features stand in the patterns.")
    )
    sequence = F.when(F.size(some(SEQUENCE_CONCEPTS)) > 0, F.concat(F.lit("Sequence stratigraphic elements: "), named(SEQUENCE_CONCEPTS), F.lit(". "), or_else("They are phases of sea level and supply."))).otherwise(or_else("A framework of systems tracts and key surfaces."))
    logs = (
        F.when(said.rlike("log|curve"), said)
        .when(F.size(some(LOG_CONCEPTS)) > 0, F.concat(F.lit("Well log types: "), named(LOG_CONCEPTS), F.lit(".")))
        .otherwise("Well log patterns of certain rock properties.")
    )
    return F.when(about == "pattern", shape).when(about == "environment", place).when(about == "sequence", sequence).when(about == "logs", logs).otherwise(explanation(caption, said, concepts, scanned))


def is_specific(query: str, known: set[str]) -> bool:
    """Whether a query is a proper name or another term the vocabulary doesn't know."""
    q = query.strip()
    words = q.split()
    if len(words) <= 2 and any(w[0].isupper() and w.lower() not in known for w in words):
        return True
    if q.lower() not in known and (re.match(r"[A-Z][a-z]+[A-Z][a-z]+", q) or re.fullmatch(r"[A-Z][a-z]+", q)):
        return True
    return len(q) <= 4 and q.lower() not in known


# Words of questions and of references to results.
QUESTION_WORDS = ["what", "how", "why", "explain", "describe", "show", "convey", "mean", "tell"]
REFERENCE_WORDS = ["result", "image", "page", "first", "second", "third", "that", "this"]


def is_follow_up(text: str, has_results: bool) -> bool:
    """Whether a text asks about earlier results."""
    low = text.lower()
    return has_results and any(w in low for w in QUESTION_WORDS) and (any(w in low for w in REFERENCE_WORDS) or len(text.split()) > 3)


def referred(text: str, pages: list[int | None], kinds: list[str]) -> int | None:
    """The place, from 0, of the result that a follow-up means; results are given by page and content type."""
    low = text.lower()

    def by_place(n):
        return n - 1 if 1 <= n <= len(pages) else None

    def by_page(n):
        return next((i for i, p in enumerate(pages) if p == n), None)

    if m := re.search(r"result\s+(\d+)", low):
        return by_place(int(m[1]))
    if m := re.search(r"page\s+(\d+)", low):
        return by_page(int(m[1]))
    if m := re.search(r"\b(\d+)\s+(result|page)", low):
        return (by_place if m[2] == "result" else by_page)(int(m[1]))
    if m := re.search(r"\b(\d+)\b", low):
        place = by_place(int(m[1])) if len(pages) <= 10 else None
        return by_page(int(m[1])) if place is None else place
    return next((i for i, k in enumerate(kinds) if k.lower().startswith("image")), 0 if pages else None)


def resolve_image(images: DataFrame, name: str) -> DataFrame:
    """The image meant: by its whole id, else by a part of id or page number; one row or none."""
    low = name.strip().lower()
    rank = F.when(F.lower("id") == low, 0).when(F.contains(F.lower("id"), F.lit(low)) | F.contains(F.col("page_number").cast("string"), F.lit(low.removeprefix("page_"))), 1)
    return images.withColumn("__r", rank).filter("__r is not null").orderBy("__r", "id").limit(1).drop("__r")


def options(results: DataFrame, group: str, rank: str, most: int = 100) -> DataFrame:
    """Numbered choices over groups of results: ``number, label``, the content's beginning or a default; the first ``most``, as a list to choose from."""
    results = results.orderBy(group, rank).limit(most)
    n = F.row_number().over(Window.orderBy(group, rank))
    label = F.when(F.length(F.trim("content")) > 0, F.substring("content", 1, 100)).otherwise("no description")
    return results.withColumn("number", n).select("number", group, F.format_string("%d. %s", "number", label).alias("label"))
