"""Implausible readings and scores, each judged against its own curve or run.

A reading is flagged for one of three reasons:

* it stands off from the readings just before and just after.  The stand-off is what is left of the curve
  after its slowly varying course (depth logs have levels, not seasons) is taken away by an opening and a
  closing over ``REACH + 1`` readings, so up to ``REACH`` readings together can stand off, a lasting change of
  level cannot.  It is measured in the curve's usual change.  What exceeds ``THRESHOLD`` is fitted by a generalised
  Pareto tail, shape and scale by probability-weighted moments: over all curves, without what an exponential tail
  of the same median would hardly hold, so that the spikes themselves do not move the fit; over the curves of a
  quantity, whose excesses weigh against ``QUANTITY_PRIOR`` of all; and a curve's own mean excess and share of
  excesses weigh against ``PRIOR`` of its quantity.  Its cutoff is the stand-off of risk ``READING_RISK``.
* it belongs to a run of ``STUCK`` or more equal present readings;
* it cannot occur for the curve's quantity in its unit.

Readings of a curve are handled together, in one shuffle.  A curve longer than ``BLOCK`` readings is cut into
blocks with a margin.  Both ways use the same counts of changes by size class, which add up over blocks, and the
same fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import UNITS
from ..plans.lineage import cut
from .unit_conversion import with_entry, with_factors
from .wells import MISSING

REACH = 3
STUCK = 10
#: Of readings: the threshold in usual changes, the risk a reading, and how many pooled excesses a curve's own weigh against.
THRESHOLD, READING_RISK, PRIOR = 2.0, 1e-8, 30
#: Excesses of all curves, of which an exponential tail stands in for the first, that those of a quantity weigh against.
QUANTITY_PRIOR = 200
#: Of scores: the quantile whose excesses are fitted, and the risk.
TAIL, RISK = 0.7, 1e-5
#: Size classes in a doubling.
OCTAVE = 64
#: Fewer changes than this say nothing about what is usual.
LEAST_CHANGES = 5
#: Positions apart from which readings are no neighbours; positions of a block; margin of a block.
GAP, BLOCK = 32, 4096
MARGIN = GAP * STUCK
#: Curves whose cutoffs are sent to every executor at most; more are joined by a shuffle.
SENT_CURVES = 200_000
#: Rows handled at once in Python.
BUFFER = 200_000
# Least and greatest value that can occur, by common unit of the quantity.
LIMITS = {
    "API": (0.0, 5000.0), "mV": (-2000.0, 2000.0), "ohm.m": (0.0, 1e6), "v/v": (-0.2, 1.0), "g/cm3": (0.0, 6.0),
    "us/ft": (0.0, 2000.0), "in": (0.0, 100.0), "b/e": (0.0, 100.0), "%": (0.0, 100.0), "ppm": (0.0, 1e6),
}


def present(samples: DataFrame) -> DataFrame:
    """``curve_id, idx, value, at``: the rows with a finite reading; ``at`` orders repeated deliveries of one reading."""
    v = F.col("value").cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"), *MISSING)
    return samples.filter(ok & F.col("curve_id").isNotNull() & F.col("idx").isNotNull()).select(
        F.col("curve_id").cast("bigint").alias("curve_id"), F.col("idx").cast("bigint").alias("idx"), v.alias("value"), F.coalesce(F.unix_micros("loaded_at"), F.lit(0)).alias("at")
    )


def curve_limits(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``curve_id, ref_id, lo, hi``: the canonical entry of each curve, and what can occur for it in its own unit, null where that isn't known."""
    per = with_entry(curves.select("curve_id", "mnemonic", "name", "unit", "description"), ref).filter("common_unit is not null and curve_id is not null")
    per = with_factors(per, F.col("unit"), F.col("description"), F.col("common_unit"))
    cases = [(unit, lo, hi) for unit, (lo, hi) in LIMITS.items() if unit in UNITS]
    lo = F.coalesce(*[F.when(F.col("common_unit") == u, F.lit(a)) for u, a, _ in cases])
    hi = F.coalesce(*[F.when(F.col("common_unit") == u, F.lit(b)) for u, _, b in cases])
    own = [((c - F.col("offset")) / F.col("factor")).alias(name) for c, name in ((lo, "lo"), (hi, "hi"))]
    return per.select("curve_id", "ref_id", *own).groupBy("curve_id").agg(F.min("ref_id").alias("ref_id"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


# --- arrays over many curves at once ---------------------------------------------------------------------


def stand_off(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How far each reading stands off from what lies before and after it; ``starts`` begin the stretches."""
    n = len(value)
    lengths = np.diff(np.r_[starts, n])
    w = REACH + 1
    padded = lengths + 2 * REACH
    first = np.cumsum(padded) - padded
    at = np.arange(padded.sum()) - np.repeat(first, padded) - REACH
    src = np.clip(at, 0, np.repeat(lengths - 1, padded)) + np.repeat(starts, padded)
    p = np.r_[value[src], np.repeat(value[-1:], 2 * REACH)]
    size = len(src)
    lo, hi = p[:size].copy(), p[:size].copy()
    for k in range(1, w):
        np.minimum(lo, p[k : size + k], out=lo)
        np.maximum(hi, p[k : size + k], out=hi)
    here = np.arange(n) - np.repeat(starts, lengths) + REACH + np.repeat(first, lengths)
    opened, closed = lo[here].copy(), hi[here].copy()
    for k in range(1, w):
        np.maximum(opened, lo[here - k], out=opened)
        np.minimum(closed, hi[here - k], out=closed)
    return np.maximum(value - opened, closed - value)


def run_lengths(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each reading, the length of the run of equal readings it lies in."""
    new = np.zeros(len(value), bool)
    new[starts] = True
    new[1:] |= value[1:] != value[:-1]
    begin = np.flatnonzero(new)
    lengths = np.diff(np.r_[begin, len(value)])
    return np.repeat(lengths, lengths)


def _by_rank(sorted_values: np.ndarray, first: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    """The value at quantile ``q`` of each group of an array sorted within groups; groups are not empty."""
    return sorted_values[first + np.ceil(q * count).astype(int).clip(1) - 1]


def size_class(x):
    """The class of a positive size: ``OCTAVE`` classes double it."""
    return np.floor(OCTAVE * np.log2(x)).astype(np.int64)


def usual_change(c50, c75):
    """A curve's usual change between readings, from the classes of its median and upper quartile: the median, or the quartile brought to its level if that is more."""
    return np.maximum(2.0 ** ((c50 + 0.5) / OCTAVE), 2.0 ** ((c75 + 0.5) / OCTAVE) / 1.7)


def beyond(share, shape):
    """By how many scales the tail reaches over the threshold at the risk."""
    return np.log(share / READING_RISK) if abs(shape) < 1e-6 else ((share / READING_RISK) ** shape - 1) / shape


def fitted_tail(size: np.ndarray, count: np.ndarray, readings: int, base: tuple | None = None) -> tuple[float, float, float, float]:
    """``shape, scale, share, limit`` of the excesses over ``THRESHOLD``, ``count`` of each class ``size``, among so many readings.

    ``base`` is the tail they belong to; without one they are the whole.
    """
    order = np.argsort(size)
    y, n = np.maximum(2.0 ** ((size[order] + 0.5) / OCTAVE) - THRESHOLD, 0.0), count[order].astype(float)
    share = n.sum() / readings
    if base is None:
        scale = y[np.searchsorted(np.cumsum(n), n.sum() / 2)] / np.log(2.0)
        base = (0.0, scale, share, THRESHOLD + scale * np.log(share / READING_RISK))
    within = y <= base[3] - THRESHOLD
    y, n = y[within], n[within]
    total, weight = n.sum(), n.sum() + QUANTITY_PRIOR
    a0 = (n * y).sum() / max(total, 1.0)
    a1 = (n * y * (1 - (np.cumsum(n) - n / 2) / max(total, 1.0))).sum() / max(total, 1.0)
    shape = 2 - a0 / (a0 - 2 * a1) if a0 > 2 * a1 else 0.0
    shape = (total * shape + QUANTITY_PRIOR * base[0]) / weight
    scale = (total * a0 * (1 - shape) + QUANTITY_PRIOR * base[1]) / weight
    share = (readings * share + QUANTITY_PRIOR) / (readings + QUANTITY_PRIOR / base[2])
    return float(shape), float(scale), float(share), float(THRESHOLD + scale * beyond(share, shape))


def standing(curve: np.ndarray, idx: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole curves, sorted by curve and idx, without repeats: stand-offs in usual changes, and whether a reading is stuck or can't occur.

    ``lo`` and ``hi`` are NaN where nothing is known.  A curve of fewer than ``LEAST_CHANGES`` changes has no stand-offs.
    """
    n = len(value)
    if not n:
        return np.zeros(0), np.zeros(0, bool)
    other = np.r_[True, curve[1:] != curve[:-1]]
    apart = other | np.r_[True, (idx[1:] - idx[:-1]) > GAP]
    starts = np.flatnonzero(apart)
    sure = (run_lengths(value, starts) >= STUCK) | (value < lo) | (value > hi)
    group = np.cumsum(other) - 1
    groups = int(group[-1]) + 1
    change = np.abs(np.diff(value, prepend=value[0]))
    has = ~apart & (change > 0)
    g, c = group[has], size_class(change[has])
    order = np.lexsort((c, g))
    count = np.bincount(g, minlength=groups)
    known = count >= LEAST_CHANGES
    first = np.cumsum(count) - count
    usual = np.full(groups, np.inf)
    usual[known] = usual_change(_by_rank(c[order], first[known], count[known], 0.5), _by_rank(c[order], first[known], count[known], 0.75))
    return stand_off(value, starts) / usual[group], sure


_MARKS = {"lo": -(2**62), "hi": -(2**62) + 1, "ref_id": -(2**62) + 2}
_STANDING = "curve_id bigint, ref_id bigint, idx bigint, off double, sure boolean, n bigint"


def _stand_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of whole curves sorted by curve, idx and delivery: the readings that exceed the threshold or are sure, and a row a curve with its length.

    Rows at the lowest idx hold the limits and the entry of a curve.
    """
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def done(last: bool):
        nonlocal held, size
        curve, idx, value = (np.concatenate(x) for x in zip(*held))
        end = len(curve) if last else int(np.searchsorted(curve, curve[-1]))
        keep = np.ones(len(curve), bool)
        keep[:-1] = (curve[1:] != curve[:-1]) | (idx[1:] != idx[:-1])  # the latest delivery counts
        rest = keep.copy()
        rest[:end] = False
        held = [] if last else [(curve[rest], idx[rest], value[rest])]
        size = 0 if last else int(rest.sum())
        keep[end:] = False
        curve, idx, value = curve[keep], idx[keep], value[keep]
        real = idx > max(_MARKS.values())
        number = np.cumsum(np.r_[True, curve[1:] != curve[:-1]]) - 1 if len(curve) else np.zeros(0, int)
        marks = {name: np.full(int(number[-1]) + 1 if len(number) else 0, np.nan) for name in _MARKS}
        for name, key in _MARKS.items():
            marks[name][number[idx == key]] = value[idx == key]
        curve, idx, value, number = curve[real], idx[real], value[real], number[real]
        off, sure = standing(curve, idx, value, marks["lo"][number], marks["hi"][number])
        ref = np.nan_to_num(marks["ref_id"]).astype(np.int64)
        out = sure | (off > THRESHOLD)
        at, lengths = np.unique(number, return_counts=True)
        ids = curve[np.r_[True, number[1:] != number[:-1]]] if len(number) else curve
        k, m = int(out.sum()), len(at)
        one = lambda a, kind: pa.array(np.r_[a, np.zeros(m, a.dtype)], kind, mask=np.r_[np.zeros(k, bool), np.ones(m, bool)])
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[curve[out], ids]), pa.array(np.r_[ref[number[out]], ref[at]]), one(idx[out], pa.int64()), one(off[out], pa.float64()),
            pa.array(np.r_[sure[out], np.zeros(m, bool)]), pa.array(np.r_[np.zeros(k, np.int64), lengths], pa.int64(), mask=np.r_[np.ones(k, bool), np.zeros(m, bool)]),
        ], names=["curve_id", "ref_id", "idx", "off", "sure", "n"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("curve_id", "idx", "value")))
            size += b.num_rows
        if size >= BUFFER:
            yield done(False)
    if held:
        yield done(True)


_MEASURED = "curve_id bigint, idx bigint, value double, off double, class bigint, run bigint"


def _measure_batches(block_size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by curve, block, idx and delivery: stand-off, class of the change and run length of each reading of a long curve."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def done(last: bool):
        nonlocal held, size
        curve, block, idx, value = (np.concatenate(x) for x in zip(*held))
        key = np.r_[True, (curve[1:] != curve[:-1]) | (block[1:] != block[:-1])]
        end = len(curve) if last else int(np.flatnonzero(key)[-1])
        keep = np.ones(len(curve), bool)
        keep[:-1] = key[1:] | (idx[1:] != idx[:-1])
        rest = keep.copy()
        rest[:end] = False
        held = [] if last else [tuple(x[rest] for x in (curve, block, idx, value))]
        size = 0 if last else int(rest.sum())
        keep[end:] = False
        curve, block, idx, value = (x[keep] for x in (curve, block, idx, value))
        apart = np.ones(len(curve), bool)
        apart[1:] = (curve[1:] != curve[:-1]) | (block[1:] != block[:-1]) | (idx[1:] - idx[:-1] > GAP)
        off, run = np.zeros(0), np.zeros(0, int)
        if len(curve):
            off, run = stand_off(value, np.flatnonzero(apart)), run_lengths(value, np.flatnonzero(apart))
        change = np.abs(np.diff(value, prepend=value[:1]))
        none = apart | (change == 0)
        change[none] = 1
        own = idx // block_size == block
        classes = pa.array(size_class(change)[own], pa.int64(), mask=none[own])
        return pa.RecordBatch.from_arrays([*[pa.array(x[own]) for x in (curve, idx, value, off)], classes, pa.array(run[own].astype(np.int64))], names=["curve_id", "idx", "value", "off", "class", "run"])

    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("curve_id", "block", "idx", "value")))
            size += b.num_rows
        if size >= BUFFER:
            yield done(False)
    if held:
        yield done(True)


def _long(readings: DataFrame, limits: DataFrame, block_size: int) -> DataFrame:
    """The same as ``_stand_batches`` of curves longer than a block: counts of changes by class are added up over the blocks."""
    blocks = F.expr(f"sequence(floor((idx - {MARGIN}) / {block_size}), floor((idx + {MARGIN}) / {block_size}))")
    spread = readings.withColumn("block", F.explode(blocks)).select("curve_id", "block", "idx", "value", "at")
    spread = spread.repartition("curve_id", "block").sortWithinPartitions("curve_id", "block", "idx", "at")
    m = cut(spread.select("curve_id", "block", "idx", "value").mapInArrow(partial(_measure_batches, block_size), _MEASURED))
    # a curve has at most as many classes as numbers have sizes
    classes = m.filter("class is not null").groupBy("curve_id", "class").agg(F.count("*").alias("k"))
    w = Window.partitionBy("curve_id")
    ranked = classes.withColumns({"upto": F.sum("k").over(w.orderBy("class")), "all": F.sum("k").over(w)})

    def at(q):
        return F.min(F.when(F.col("upto") >= F.greatest(F.ceil(q * F.col("all")), F.lit(1)), F.col("class")))

    def size(c):
        return F.pow(F.lit(2.0), (c + 0.5) / OCTAVE)

    usual = ranked.groupBy("curve_id").agg(at(0.5).alias("c50"), at(0.75).alias("c75"), F.max("all").alias("all")).filter(F.col("all") >= LEAST_CHANGES)
    usual = usual.select("curve_id", F.greatest(size(F.col("c50")), size(F.col("c75")) / 1.7).alias("usual"))
    per = limits.select("curve_id", "ref_id", "lo", "hi")
    x = m.join(usual, "curve_id", "left").join(per, "curve_id", "left")
    sure = (F.col("run") >= STUCK) | F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False))
    ref = F.coalesce("ref_id", F.lit(0)).cast("bigint")
    rows = x.select("curve_id", ref.alias("ref_id"), "idx", F.coalesce(F.col("off") / F.col("usual"), F.lit(0.0)).alias("off"), sure.alias("sure"), F.lit(None).cast("bigint").alias("n")).filter(F.col("sure") | (F.col("off") > THRESHOLD))
    lengths = m.groupBy("curve_id").agg(F.count("*").alias("n")).join(per, "curve_id", "left")
    return rows.unionByName(lengths.select("curve_id", ref.alias("ref_id"), F.lit(None).cast("bigint").alias("idx"), F.lit(None).cast("double").alias("off"), F.lit(False).alias("sure"), "n"))


_TAIL = "shape double, scale double, share double, most double"


def _fit_all(pdf):
    pdf = pdf.groupby("class", as_index=False).agg({"k": "sum", "all_readings": "max"})
    return pd.DataFrame([fitted_tail(pdf["class"].to_numpy(), pdf["k"].to_numpy(), int(pdf["all_readings"].iloc[0]))], columns=["shape", "scale", "share", "most"])


def _fit_quantity(key, pdf):
    base = tuple(pdf[["shape", "scale", "share", "most"]].iloc[0])
    return pd.DataFrame([(key[0], *fitted_tail(pdf["class"].to_numpy(), pdf["k"].to_numpy(), int(pdf["readings"].iloc[0]), base))], columns=["ref_id", "shape", "scale", "share", "most"])


def cutoffs(standing: DataFrame) -> DataFrame:
    """``curve_id, ref_id, shape, limit``: the cutoff of each curve in usual changes, from the tail of its quantity and its own excesses.

    Curves that mean no entry are one quantity.
    """
    curves = standing.filter("idx is null")
    over = standing.filter((F.col("off") > THRESHOLD) & (F.col("off") < 1e15)).select("curve_id", "ref_id", "off")
    classes = over.groupBy("ref_id", F.floor(OCTAVE * F.log2("off")).alias("class")).agg(F.count("*").alias("k"))
    # groups of size classes: of all readings, and of one quantity
    readings = curves.groupBy("ref_id").agg(F.sum("n").alias("readings"))
    every = classes.groupBy("class").agg(F.sum("k").alias("k")).join(F.broadcast(curves.agg(F.sum("n").alias("all_readings")).withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    whole = every.groupBy("one").applyInPandas(_fit_all, _TAIL)
    known = classes.join(readings, "ref_id").withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one")
    pools = known.groupBy("ref_id").applyInPandas(_fit_quantity, "ref_id bigint, " + _TAIL)
    tails = F.broadcast(pools)
    own = over.join(tails.select("ref_id", "most"), "ref_id").filter("off <= most").groupBy("curve_id").agg(F.count("*").alias("k"), F.sum(F.col("off") - THRESHOLD).alias("sum"))
    x = curves.select("curve_id", "ref_id", "n").join(tails, "ref_id").join(own, "curve_id", "left")
    k, total, shape = F.coalesce("k", F.lit(0)), F.coalesce("sum", F.lit(0.0)), F.col("shape")
    scale = (total * (1 - shape) + PRIOR * F.col("scale")) / (k + PRIOR)
    risks = (k + PRIOR * F.col("share")) / (F.col("n") + PRIOR) / READING_RISK
    beyond = F.when(F.abs(shape) < 1e-6, F.log(risks)).otherwise((F.pow(risks, shape) - 1) / shape)
    return x.select("curve_id", "ref_id", "shape", (THRESHOLD + scale * beyond).alias("limit"))


def flag_readings(samples: DataFrame, curves: DataFrame, ref: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """``curve_id, idx`` of the implausible readings, one row each.

    Missing readings (null, NaN, infinite, the missing-value marks) are no cases and break no run.  Of a
    reading delivered more than once the latest present delivery counts.  Rows without curve_id or idx are
    left out.  A curve with fewer than ``LEAST_CHANGES`` changes has no stand-offs.  Empty tables give no rows.
    """
    seen = cut(stand_offs(samples, curves, ref, block_size))
    limits = cut(cutoffs(seen).select("curve_id", "limit"))
    asked = seen.filter("idx is not null")
    limits = F.broadcast(limits) if limits.count() <= SENT_CURVES else limits
    return asked.join(limits, "curve_id", "left").filter("sure or off > limit").select("curve_id", "idx")


def stand_offs(samples: DataFrame, curves: DataFrame, ref: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """``curve_id, ref_id, idx, off, sure, n``: the readings over the threshold and the sure ones, and for each curve a row without idx that has its length."""
    readings, limits = present(samples), curve_limits(curves, ref)
    far = (F.col("idx") >= block_size) | (F.col("idx") < 0)
    # statistics of the file leave little to read here, unless there are long curves
    long = readings.filter(far).select("curve_id").distinct()
    out = None
    if not long.isEmpty():
        out = _long(readings.join(long, "curve_id", "left_semi"), limits, block_size)
        readings, limits = readings.join(long, "curve_id", "left_anti"), limits.join(long, "curve_id", "left_anti")
    marks = [F.struct(F.lit(key).alias("idx"), F.col(name).cast("double").alias("value")) for name, key in _MARKS.items()]
    marks = limits.select("curve_id", F.explode(F.array(*marks)).alias("m")).select("curve_id", "m.idx", "m.value", F.lit(0).cast("bigint").alias("at")).filter("value is not null")
    rows = readings.unionByName(marks).repartition("curve_id").sortWithinPartitions("curve_id", "idx", "at")
    short = rows.select("curve_id", "idx", "value").mapInArrow(_stand_batches, _STANDING)
    return short if out is None else short.unionByName(out)


def flag_scores(curves: DataFrame) -> DataFrame:
    """``curve_id`` of the scores outside 0 to 1 or far from the other scores of their run.

    The residual is the distance to the run's median; its tail over the whole table is fitted as for readings
    and gives the cutoff of risk ``RISK``.  Missing scores are no cases; runs of fewer than three scores, and
    curves without a run, have only the range.
    """
    q = F.col("quality_score").cast("double")
    scores = curves.select("curve_id", "run_id", q.alias("q")).filter("q is not null and not isnan(q)")
    sane = scores.filter("q between 0 and 1")
    centre = sane.filter("run_id is not null").groupBy("run_id").agg(F.percentile_approx("q", 0.5, 10000).alias("mid"), F.count("*").alias("n")).filter("n >= 3").drop("n")
    off = sane.join(centre, "run_id").select("curve_id", F.abs(F.col("q") - F.col("mid")).alias("off"))
    t = off.agg(F.percentile_approx("off", [TAIL, (1 + TAIL) / 2], 10000).alias("p"))
    limit = F.col("p")[0] + (F.col("p")[1] - F.col("p")[0]) / float(np.log(2.0)) * float(np.log((1 - TAIL) / RISK))
    far = off.join(F.broadcast(t.select(limit.alias("limit"))), F.col("off") > F.col("limit")).select("curve_id")
    return scores.filter("q < 0 or q > 1").select("curve_id").unionByName(far).distinct()


def found(samples: DataFrame, curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``rec, curve_id, idx``: the implausible readings and, at idx -1, the implausible scores."""
    readings = flag_readings(samples, curves, ref).select(F.lit("reading").alias("rec"), "curve_id", F.col("idx").cast("int").alias("idx"))
    return readings.unionByName(flag_scores(curves).select(F.lit("score").alias("rec"), "curve_id", F.lit(-1).alias("idx")))
