"""Which canonical curve a typed mnemonic and name stand for, as SQL expressions over a small reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries in one literal of the plan; a longer list is taken in several, one after the other.
ENTRIES = 5000
# Words that decorate a typed name.
_DECOR = r"\(\s*run\s*\d+\s*\)|\b(?:log|curve|run\s*\d+|final)\b"


def reference_literals(ref: DataFrame) -> list[Column]:
    """The list ``ref_id, code, title`` as array literals ``struct<id, code, words, flat>`` of up to ``ENTRIES`` entries."""

    def one(r):
        words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in r.title or "").split() if w not in ("log", "curve")]
        return F.struct(
            F.lit(int(r.ref_id)).cast("bigint").alias("id"), F.lit((r.code or "").upper()).alias("code"),
            F.array(*map(F.lit, words)).cast("array<string>").alias("words"), F.lit("".join(words)).alias("flat"),
        )

    rows = ref.select("ref_id", "code", "title").filter("ref_id is not null").orderBy("ref_id").collect()
    return [F.array(*map(one, rows[i : i + ENTRIES])) for i in range(0, len(rows), ENTRIES)] or [F.array().cast("array<struct<id:bigint,code:string,words:array<string>,flat:string>>")]


def code_entry(typed: Column, literals: list[Column]) -> Column:
    """The entry whose code stands in ``typed``: as the only code among its tokens, or spelled letter by letter."""
    tokens = F.filter(F.split(F.upper(typed), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    spelled = F.array_join(tokens, "")
    letters = (F.size(tokens) > 1) & F.forall(tokens, lambda t: F.length(t) == 1)
    hits = F.concat(*[F.filter(refs, lambda r: F.array_contains(tokens, r["code"]) | (letters & (r["code"] == spelled))) for refs in literals])
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["id"])


def title_words(typed: Column) -> Column:
    """The words of a typed title in lower case, without decoration."""
    clean = F.regexp_replace(F.lower(typed), r"[^\p{L}\p{N}()]+", " ")
    clean = F.regexp_replace(F.regexp_replace(clean, _DECOR, " "), r"[()]", " ")
    return F.filter(F.split(clean, " "), lambda t: t != "")


def _within(short: Column, whole: Column) -> Column:
    """Whether ``whole`` begins like ``short`` and holds its letters in order; the pattern is only made where that may be."""
    fits = (F.length(short) <= F.length(whole)) & (F.substring(short, 1, 1) == F.substring(whole, 1, 1))
    return fits & F.rlike(whole, F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*")))


def title_entry(words: Column, flat: Column, literals: list[Column]) -> Column:
    """The entry whose title ``words`` (``flat`` joined) mean: words may be cut short, stripped of letters or misspelled."""

    def word_cost(t, w):
        # no more than three edits count
        d = F.levenshtein(t, w, 3)
        d = F.when(d < 0, 99).otherwise(d)
        swapped = (d <= 2) & (F.length(w) >= 4) & (F.array_sort(F.split(t, "")) == F.array_sort(F.split(w, "")))
        return (
            F.when(t == w, F.lit(0.0))
            .when((F.length(t) >= 3) & F.startswith(w, t), F.lit(0.3))
            .when((F.length(t) >= 3) & _within(t, w), F.lit(0.6))
            .when(swapped, F.lit(1.0))
            .when((F.length(t) < 4) & (F.length(w) > 3), F.lit(99.0))  # too short to be misspelled
            .when((d <= 1) | ((F.length(w) >= 6) & (d <= 2)) | ((F.length(w) >= 9) & (d <= 3)), d.cast("double"))
            .when((F.length(t) >= 3) & (F.levenshtein(t, F.substring(w, F.lit(1), F.length(t)), 1) >= 0), F.lit(1.3))
            .otherwise(F.lit(99.0))
        )

    def cost(r):
        by_word = F.aggregate(F.zip_with(words, r["words"], word_cost), F.lit(0.0), lambda a, x: a + x)
        d = F.levenshtein(flat, r["flat"]).cast("double")
        cut = (F.length(flat) >= F.length(r["flat"]) * 0.5) & _within(flat, r["flat"])
        slack = F.when(F.length(r["flat"]) >= 20, F.lit(0.32)).otherwise(F.lit(0.2))
        most = F.greatest(F.lit(1.0), F.length(r["flat"]) * slack)
        # lengths further apart than that are no fewer edits
        whole = F.when((F.abs(F.length(flat) - F.length(r["flat"])) <= most) & (d <= most), d).when(cut, F.lit(2.0)).otherwise(F.lit(99.0))
        return F.when(F.size(words) == F.size(r["words"]), F.least(by_word, whole)).otherwise(whole)

    best = F.array_min(F.array(*[F.array_min(F.transform(refs, lambda r: F.struct(cost(r).alias("c"), r["id"].alias("id")))) for refs in literals]))
    return F.when((F.length(flat) >= 3) & (best["c"] < 9), best["id"])


def curve_entries(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``mnemonic, name, ref_id`` for each distinct pair of typed texts; ref_id is 0 where none is meant.

    The mnemonic counts before the name and a code before a title.  Null and blank texts mean nothing.
    """
    refs = reference_literals(ref)
    # the pairs are few bytes but much work, so they are spread over all cores
    spark = curves.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pair = curves.select("mnemonic", "name").distinct().repartition(parts, F.xxhash64("mnemonic", "name"))
    words = {"__mw": title_words(F.col("mnemonic")), "__nw": title_words(F.col("name"))}
    pair = pair.withColumns(words).withColumns({"__mf": F.array_join("__mw", ""), "__nf": F.array_join("__nw", "")})
    by_code = [code_entry(F.col(c), refs) for c in ("mnemonic", "name")]
    by_title = [title_entry(F.col(f"__{c}w"), F.col(f"__{c}f"), refs) for c in "mn"]
    return pair.select("mnemonic", "name", F.coalesce(by_code[0], by_title[0], by_code[1], by_title[1], F.lit(0)).alias("ref_id"))
