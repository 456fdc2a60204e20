"""Prompts of an interpretation, put together from pattern, log and knowledge rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocab

# What each kind of prompt asks for.
TASKS = {
    "comprehensive": ["the log patterns and the processes that made them", "systems tracts and key surfaces", "the depositional environment", "reservoir and seal", "confidence and its evidence", "recommendations"],
    "pattern": ["what the shape means", "the grain sizes and contacts it stands for", "where such a pattern forms"],
    "patterns": ["each pattern's shape, contacts and lithology", "the processes behind it"],
    "sequence": ["systems tracts", "key surfaces", "relative sea level"],
    "environment": ["the likeliest environment", "energy and water depth", "sediment supply"],
}


def pattern_lines(patterns: DataFrame, key: str = "curve_id") -> DataFrame:
    """``key, patterns``: one line a pattern, by depth."""
    line = F.format_string("- %s pattern from %.1f to %.1f", "type", "start_depth", "end_depth")
    return patterns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_depth", "end_depth", line.alias("l")))), lambda x: x["l"]), "\n").alias("patterns"))


def context_lines(found: DataFrame, most: int = 5) -> DataFrame:
    """One row ``context``: a line for each of the best ``most`` knowledge chunks."""
    top = found.orderBy(F.desc("score"), "chunk_id").limit(most)
    line = F.concat(F.lit("- "), tx.shortened(F.coalesce("content", F.lit("")), 200), F.lit(" (page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(")"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def prompts(patterns: DataFrame, logs: DataFrame, context: DataFrame, mode: str, key: str = "curve_id") -> DataFrame:
    """``key, prompt`` for each curve with patterns."""
    if mode not in TASKS:
        raise ValueError(f"mode must be one of {', '.join(TASKS)}")
    tasks = "\n".join(f"{i}. {t}" for i, t in enumerate(TASKS[mode], 1))
    x = pattern_lines(patterns, key).join(logs.select(key, "line"), key, "left").join(F.broadcast(context_lines(context)))
    text = F.concat_ws(
        "\n\n", F.lit("Interpret this well log by the knowledge given, and by nothing else."), F.concat(F.lit("Log:\n"), F.coalesce("line", F.lit("no summary"))),
        F.concat(F.lit("Patterns:\n"), "patterns"), F.concat(F.lit("Knowledge:\n"), "context"), F.lit("Say:\n" + tasks),
    )
    return x.select(key, text.alias("prompt"))


def canned_query(category: str, name: str) -> str:
    """The search text for a pattern, surface or environment."""
    if category == "pattern":
        return vocab.PATTERN_QUERIES.get(name, name)
    if category == "surface":
        return vocab.SURFACE_QUERIES.get(name.lower(), name)
    return f"{name} depositional environment facies characteristics"


def sequence_query(types: list[str]) -> str:
    return " ".join(["sequence stratigraphy systems tract", *[vocab.PATTERN_TERMS[t] for t in types if t in vocab.PATTERN_TERMS]])


def environment_query(types: list[str]) -> str:
    return " ".join(["depositional environment", *[vocab.ENVIRONMENT_TERMS[t] for t in types if t in vocab.ENVIRONMENT_TERMS]])
