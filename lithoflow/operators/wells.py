"""Well-log curves: cleaning, quality, smoothing, trend windows, pattern detectors, overlap resolution.

A series is one curve's readings in order of ``idx``; readings that stand for missing are null.  All window
operators cut a series into hop windows: rows [i, i + w) for i = 0, h, 2h, ... below n - w, h = w // 2.  The
rows of a series are shuffled once, by ``curve_id``; the windows are grouped where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab

# What stands for a missing reading.
MISSING = [-999.25, -9999.0]
DEPTH_MNEMONICS = ["DEPT", "DEPTH", "MD", "MDEPTH"]
EPS = 1e-10


def clean_value(c: str) -> Column:
    """A reading, null where it is missing."""
    v = F.col(c).cast("double")
    return F.when(~(F.isnan(v) | v.isin(float("inf"), float("-inf"), *MISSING)), v)


def readings(samples: DataFrame) -> DataFrame:
    """``well_id, curve_id, mnemonic, idx, depth, value``: one row a reading, of repeated deliveries the latest; missing ones are null."""
    w = Window.partitionBy("curve_id", "idx").orderBy(F.col("loaded_at").desc(), F.col("value").desc())
    kept = samples.select("well_id", "curve_id", "mnemonic", "idx", "depth", "value", "loaded_at").withColumn("__k", F.row_number().over(w)).filter("__k = 1")
    return kept.select("well_id", "curve_id", "mnemonic", "idx", F.col("depth").cast("double").alias("depth"), clean_value("value").alias("value"))


def series(samples: DataFrame) -> DataFrame:
    """The present readings with their place ``i`` in the curve and its length ``n``, both from 0."""
    # the readings of a curve stay where the removal of repeats would scatter them: one shuffle by curve
    by = samples.repartition("curve_id")
    kept = readings(by).filter("value is not null")
    w = Window.partitionBy("curve_id")
    return kept.withColumn("i", F.row_number().over(w.orderBy("idx")) - 1).withColumn("n", F.count("*").over(w))


def curve_quality(samples: DataFrame) -> DataFrame:
    """Quality 0.8 x share of present readings + 0.2 x range / 100 (1 at most), and the share missing in percent."""
    agg = readings(samples).groupBy("curve_id").agg(F.count("*").alias("n"), F.count("value").alias("valid"), (F.max("value") - F.min("value")).alias("span"))
    quality = 0.8 * F.col("valid") / F.col("n") + 0.2 * F.when(F.col("span").isNull(), 0.0).otherwise(F.least(F.col("span") / 100, F.lit(1.0)))
    return agg.select("curve_id", "n", "valid", quality.alias("quality"), (100.0 * (F.col("n") - F.col("valid")) / F.col("n")).alias("missing_pct"))


def depth_stats(samples: DataFrame) -> DataFrame:
    """First and last depth of a curve and the median of its positive steps."""
    r = readings(samples)
    step = F.col("depth") - F.lag("depth").over(Window.partitionBy("curve_id").orderBy("idx"))
    r = r.withColumn("step", step)
    return r.groupBy("curve_id").agg(F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"), F.percentile(F.when(F.col("step") > 0, F.col("step")), 0.5).alias("step"))


def curve_type(mnemonic: Column) -> Column:
    """The first type one of whose names is contained in the mnemonic; else null."""
    up = F.upper(mnemonic)
    out = None
    for kind, names in vocab.CURVE_TYPES.items():
        hit = up.rlike("|".join(names))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def quality_report(samples: DataFrame) -> DataFrame:
    """Per well: mean quality and its label, and what to warn of."""
    kinds = readings(samples).groupBy("curve_id").agg(F.first("well_id").alias("well_id"), F.max(F.coalesce((curve_type(F.col("mnemonic")) == "GR"), F.lit(False))).alias("gr"))
    q = curve_quality(samples).join(kinds, "curve_id")
    agg = q.groupBy("well_id").agg(F.avg("quality").alias("overall"), F.count("*").alias("curves"), F.count_if(F.col("quality") < 0.5).alias("poor"), F.count_if(F.col("missing_pct") > 20).alias("gappy"), F.max("gr").alias("has_gr"))
    o = F.col("overall")
    label = F.when(o > 0.8, "Excellent").when(o > 0.6, "Good").when(o > 0.4, "Fair").otherwise("Poor")
    notes = F.array_compact(F.array(
        F.when(F.col("poor") > 0, F.format_string("%d curves of low quality", "poor")),
        F.when(F.col("gappy") > 0, F.format_string("%d curves with many readings missing", "gappy")),
        F.when(~F.col("has_gr"), F.lit("no gamma ray curve")),
        F.when(F.col("curves") < 3, F.lit("fewer than three curves")),
    ))
    return agg.select("well_id", o.alias("overall"), "curves", label.alias("label"), F.array_join(notes, "; ").alias("notes"))


def primary_curves(curves: DataFrame) -> DataFrame:
    """Of each well's curves one per type, the last; and whether it is the primary one: gamma ray, else the first."""
    kept = curves.withColumn("kind", curve_type(F.col("mnemonic"))).filter(F.col("kind").isNotNull() & ~F.upper(F.trim("mnemonic")).isin(DEPTH_MNEMONICS))
    last = Window.partitionBy("well_id", "kind").orderBy(F.col("curve_id").desc())
    one = kept.withColumn("__k", F.row_number().over(last)).filter("__k = 1")
    first = Window.partitionBy("well_id").orderBy((F.col("kind") != "GR").cast("int"), "curve_id")
    return one.select("well_id", "kind", "curve_id", (F.row_number().over(first) == 1).alias("is_primary"))


def _at(k: int) -> Column:
    w = Window.partitionBy("curve_id").orderBy("i")
    return F.lag("value", -k).over(w) if k < 0 else F.lead("value", k).over(w)


def savgol(s: DataFrame) -> DataFrame:
    """Savitzky-Golay smoothing over 5 readings with a parabola; the ends take the parabola of the first or last 5."""

    def mix(weights, at):
        return sum(w * _at(k) for w, k in zip(weights, at)) / 35.0

    i, n = F.col("i"), F.col("n")
    smooth = (
        F.when(n < 5, F.col("value"))
        .when(i == 0, mix([31, 9, -3, -5, 3], range(5)))
        .when(i == 1, mix([9, 13, 12, 6, -5], range(-1, 4)))
        .when(i == n - 2, mix([-5, 6, 12, 13, 9], range(-3, 2)))
        .when(i == n - 1, mix([3, -5, -3, 9, 31], range(-4, 1)))
        .otherwise(mix([-3, 12, 17, 12, -3], range(-2, 3)))
    )
    return s.withColumn("smooth", smooth)


def gradient(s: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``gradient``, the derivative by depth: second order inside, one-sided at the ends; null where depths repeat."""
    w = Window.partitionBy("curve_id").orderBy("i")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = F.col("depth") - F.lag("depth").over(w), F.lead("depth").over(w) - F.col("depth")
    inner = F.try_divide(hs * hs * after + (hd * hd - hs * hs) * F.col(value) - hd * hd * before, hs * hd * (hs + hd))
    g = F.when(before.isNull() & after.isNull(), None).when(before.isNull(), F.try_divide(after - F.col(value), hd)).when(after.isNull(), F.try_divide(F.col(value) - before, hs)).otherwise(inner)
    return s.withColumn("gradient", g)


def hop_windows(s: DataFrame, size: Column | int) -> DataFrame:
    """The rows of ``s`` once for each hop window ``k`` of ``size`` they lie in; a curve of ``size`` rows has none."""
    size = F.lit(size) if isinstance(size, int) else size
    x = s.withColumn("__w", size.cast("bigint")).withColumn("__h", F.floor(F.col("__w") / 2))
    x = x.withColumn("__lo", F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("__w") + 1) / F.col("__h"))))
    x = x.withColumn("__hi", F.least(F.floor(F.col("i") / F.col("__h")), F.ceil((F.col("n") - F.col("__w")) / F.col("__h")) - 1))
    x = x.filter("__hi >= __lo").withColumn("k", F.explode(F.sequence("__lo", "__hi")))
    return x.withColumn("pos", F.col("i") - F.col("k") * F.col("__h")).drop("__lo", "__hi", "__h")


def _clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def trend_windows(samples: DataFrame, size: int = 20) -> DataFrame:
    """Windows of ``size`` readings called boxcar, funnel or bell by slope over range, with a confidence of 0 to 1."""
    v = "value"
    g = hop_windows(series(samples), size).groupBy("curve_id", "k").agg(
        F.min("depth").alias("depth_start"), F.max("depth").alias("depth_end"), F.min(v).alias("data_min"), F.max(v).alias("data_max"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.regr_slope(v, "pos").alias("slope"), F.regr_r2(v, "pos").alias("r2"),
    )
    rel = F.col("slope") / (F.col("data_max") - F.col("data_min") + EPS)
    kind = F.when(F.abs(rel) < 0.1, "boxcar").when(rel < -0.1, "funnel").when(rel > 0.1, "bell").otherwise("irregular")
    r2 = F.when(F.col("data_max") == F.col("data_min"), 0.0).otherwise(F.col("r2"))
    conf = F.when(kind.isin("funnel", "bell"), _clamp(r2, 0.0, 1.0)).otherwise(_clamp(1 - F.col("std") / (F.col("mean") + EPS), 0.0, 1.0))
    return g.select("curve_id", "k", kind.alias("type"), "depth_start", "depth_end", (F.col("depth_end") - F.col("depth_start")).alias("thickness"), "data_min", "data_max", conf.alias("confidence"))


MIN_POINTS, MIN_THICKNESS = 10, 5.0


def _spans(x: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    g = x.groupBy(*keys).agg(F.min("depth").alias("start_depth"), F.max("depth").alias("end_depth"), *aggs)
    return g.withColumn("thickness", F.col("end_depth") - F.col("start_depth")).filter(F.col("thickness") >= MIN_THICKNESS)


def _part_of(n: int, least: int) -> Column:
    """A window of one of ``n`` parts of the curve, of ``least`` readings at least."""
    return F.greatest(F.lit(least), F.floor(F.col("n") / n))


# of each method the window, what it takes of one, and its type and confidence
_PARTS = {"gradient": (20, 10), "correlation": (15, 15), "statistical": (12, 12)}


def _taken(method: str) -> list[Column]:
    return {
        "gradient": [F.avg("gradient").alias("g_mean"), F.stddev_pop("gradient").alias("g_sd")],
        "correlation": [
            F.regr_sxy("value", "depth").alias("sxy"), F.regr_sxx("value", "depth").alias("sxx"), F.regr_syy("value", "depth").alias("syy"), F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("span"),
        ],
        "statistical": [F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.regr_slope("value", "pos").alias("slope"), F.skewness("value").alias("skew")],
    }[method]


def _by_gradient() -> tuple[Column, Column]:
    m, sd = F.col("g_mean"), F.col("g_sd")
    c = 1 - sd / (F.abs(m) + 1e-6)
    raw = _clamp(100 * c, 0.0, 100.0)
    strong = (F.abs(m) > 0.1) & (c > 0.3)
    kind = F.when(strong & (m > 0), "funnel").when(strong, "bell").when(sd < 0.5, "boxcar").otherwise("irregular")
    return kind, F.when(strong, raw).when(sd < 0.5, F.greatest(raw, F.lit(60.0))).otherwise(F.greatest(raw, F.lit(40.0)))


def _by_correlation() -> tuple[Column, Column]:
    r = F.coalesce(F.abs(F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))), F.lit(0.0))
    flat = 1 - F.col("sd") / (F.col("span") + 1e-6)
    return F.when(r >= flat, "funnel").otherwise("boxcar"), _clamp(100 * F.greatest(r, flat), 0.0, 100.0)


def _by_statistics() -> tuple[Column, Column]:
    sd = F.col("sd")
    cv = sd / (F.abs("m") + 1e-6)
    skew = F.abs(F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0)))
    steep = F.abs("slope") > 0.1 * sd
    kind = F.when(cv < 0.15, "boxcar").when(steep & (F.col("slope") > 0), "funnel").when(steep, "bell").otherwise("irregular")
    conf = F.when(cv < 0.15, _clamp((1 - cv) * 100, 60.0, 90.0)).when(steep, _clamp(F.try_divide(F.abs("slope"), sd) * 50, 40.0, 85.0)).when(skew > 1, _clamp(skew * 30, 30.0, 70.0)).otherwise(50.0)
    return kind, conf


_JUDGED = {"gradient": _by_gradient, "correlation": _by_correlation, "statistical": _by_statistics}
LEAST_CORRELATION = 30


def _detected(s: DataFrame, method: str) -> DataFrame:
    g = _spans(hop_windows(s, _part_of(*_PARTS[method])), ["curve_id", "k"], *_taken(method))
    kind, conf = _JUDGED[method]()
    out = g.select("curve_id", "k", F.lit(method).alias("method"), kind.alias("type"), "start_depth", "end_depth", "thickness", conf.alias("confidence"))
    return out.filter(F.col("confidence") > LEAST_CORRELATION) if method == "correlation" else out


def _long_enough(samples: DataFrame) -> DataFrame:
    return series(samples).filter(F.col("n") >= MIN_POINTS)


def detect_gradient(samples: DataFrame) -> DataFrame:
    """Patterns by the mean and the consistency of the smoothed gradient."""
    return _detected(gradient(savgol(_long_enough(samples)), "smooth"), "gradient")


def detect_correlation(samples: DataFrame) -> DataFrame:
    """Patterns by the correlation with a ramp; a constant window is a boxcar, ties count as funnel."""
    return _detected(_long_enough(samples), "correlation")


def detect_statistical(samples: DataFrame) -> DataFrame:
    """Patterns by coefficient of variation, slope and skewness."""
    return _detected(_long_enough(samples), "statistical")


def patterns(samples: DataFrame) -> DataFrame:
    """The patterns of all three detectors, in one reading of the samples: a row goes to the windows of each."""
    s = gradient(savgol(_long_enough(samples)), "smooth").select("curve_id", "i", "n", "depth", "value", "gradient")
    sized = s.select("*", F.explode(F.create_map(*[x for m in _PARTS for x in (F.lit(m), _part_of(*_PARTS[m]).cast("bigint"))])).alias("method", "size"))
    # what two methods take is taken once
    taken = {str(a): a for m in _PARTS for a in _taken(m)}
    g = _spans(hop_windows(sized, F.col("size")), ["curve_id", "method", "k"], *taken.values())
    by = {m: f() for m, f in _JUDGED.items()}
    pick = lambda j: F.coalesce(*[F.when(F.col("method") == m, by[m][j]) for m in by])
    out = g.select("curve_id", "k", "method", pick(0).alias("type"), "start_depth", "end_depth", "thickness", pick(1).alias("confidence"))
    return out.filter((F.col("method") != "correlation") | (F.col("confidence") > LEAST_CORRELATION))


def resolve_overlaps(found: DataFrame) -> DataFrame:
    """Per curve the patterns that do not overlap a more confident one; touching is no overlap.

    Taken in order of confidence, then method, then window.  A curve's patterns are one group, of bounded size: windows are a part
    of their curve, so however long it is, the three methods have less than 2 * (20 + 15 + 12) of them.
    """
    order = F.when(F.col("method") == "gradient", 0).when(F.col("method") == "correlation", 1).otherwise(2)
    # confidences are compared as they are shown, so that equal ones stay in the order of the methods
    one = F.struct((-F.round("confidence", 6)).alias("c"), order.alias("o"), F.col("k").alias("k"), F.col("start_depth").alias("s"), F.col("end_depth").alias("e"), F.col("method").alias("method"), F.col("type").alias("type"), F.col("confidence").alias("confidence"))
    g = found.groupBy("curve_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = F.expr("aggregate(slice(all, 2, size(all)), slice(all, 1, 1), (acc, x) -> if(exists(acc, y -> not (x.e <= y.s or x.s >= y.e)), acc, concat(acc, array(x))))")
    return g.select("curve_id", F.explode(kept).alias("p")).select("curve_id", F.col("p.k").alias("k"), "p.method", "p.type", F.col("p.s").alias("start_depth"), F.col("p.e").alias("end_depth"), (F.col("p.e") - F.col("p.s")).alias("thickness"), "p.confidence")


def pattern_summary(found: DataFrame) -> DataFrame:
    """Per type the number of patterns, their mean and total thickness and mean confidence."""
    return found.groupBy("type").agg(F.count("*").alias("n"), F.avg("thickness").alias("mean_thickness"), F.sum("thickness").alias("total_thickness"), F.avg("confidence").alias("mean_confidence"))


def systems_tracts(found: DataFrame) -> DataFrame:
    """The patterns that stand for a systems tract, with it."""
    tract = None
    for kind, name in vocab.PATTERN_TRACTS.items():
        tract = F.when(F.col("type") == kind, name) if tract is None else tract.when(F.col("type") == kind, name)
    return found.withColumn("tract", tract).filter("tract is not null")


def log_summary(samples: DataFrame, least: float = 0.7, units: bool = False) -> DataFrame:
    """A line of text for each curve better than ``least``: mnemonic, least, greatest and mean value, and, if asked for, the unit."""
    good = curve_quality(samples).filter(F.col("quality") > least).select("curve_id")
    g = readings(samples).join(good, "curve_id").groupBy("curve_id").agg(F.max("mnemonic").alias("mnemonic"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
    line = F.format_string("%s: %.1f to %.1f (avg: %.1f)", F.coalesce(F.col("mnemonic"), F.lit("")), *[F.round(F.round(c, 6), 1) + 0.0 for c in ("lo", "hi", "mean")])
    if units:
        unit = samples.groupBy("curve_id").agg(F.max("unit").alias("unit"))
        g, line = g.join(unit, "curve_id", "left"), F.rtrim(F.concat_ws(" ", line, F.trim("unit")))
    return g.filter("lo is not null").select("curve_id", line.alias("line"))
