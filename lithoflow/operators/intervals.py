"""Merging overlapping intervals and listing the gaps between them (dyadic blocks).

Closed intervals with integer limits are decomposed into canonical dyadic blocks of all levels, so a row makes at
most two blocks a level however long it is.  Blocks covered by an ancestor are removed, sibling pairs are merged
upward, and adjacent blocks are coalesced.  Work is grouped by (entity, cell), a cell being one block of level
``cell_level``; what a cell leaves open, its first and last run, goes on to the cell of ``TIER`` levels above,
with the blocks of the levels between, and so on to the top.  A group has a bounded number of rows however many
intervals an entity has, so neither a hot entity nor repeated rows can make a large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

CELL_LEVEL = 12
#: Levels between the cells of one tier and those of the next; limits are within so many bits.
TIER, BITS = 17, 60
#: The level of the topmost cells: all that is below 0, and the rest.
TOP = 63


def dyadic_blocks(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """The distinct canonical dyadic blocks ``keys, k, i`` of the half-open intervals ``[lo, hi)``: block i of level k is ``[i * 2**k, (i + 1) * 2**k)``."""
    # what is left at a level begins at the next whole block and ends at the last
    pieces = """
      flatten(transform(sequence(0, cast(floor(log2(__hi - __lo)) as int) + 1), k -> filter(array(
        if(-shiftright(-__lo, k) < shiftright(__hi, k) and -shiftright(-__lo, k) % 2 != 0, struct(k as k, -shiftright(-__lo, k) as i), null),
        if(-shiftright(-__lo, k) < shiftright(__hi, k) and shiftright(__hi, k) % 2 != 0, struct(k as k, shiftright(__hi, k) - 1 as i), null)),
        x -> x is not null)))
    """
    x = df.select(*keys, F.col(lo).cast("bigint").alias("__lo"), F.col(hi).cast("bigint").alias("__hi")).filter("__lo < __hi").distinct()
    return x.select(*keys, F.expr(f"inline({pieces})")).distinct()


def covered(x: DataFrame, level: Column, above_by: int, high: DataFrame) -> DataFrame:
    """The distinct rows of ``x`` (key, i) whose block, of ``level``, has an ancestor ``above_by`` levels up or more among the blocks ``high``."""
    # ancestors are looked up at the levels there are
    levels = F.broadcast(high.agg(F.collect_set("k").alias("levels")).withColumn("one", F.lit(1)))
    above = high.select(F.col("key").alias("__key"), F.col("k").alias("__k"), F.col("i").alias("__i"))
    up = x.withColumns({"one": F.lit(1), "__level": level}).join(levels, "one").select(*x.columns, "__level", F.explode("levels").alias("up")).filter(F.col("up") >= F.col("__level") + above_by)
    at = F.expr("shiftright(i, up - __level)")
    return up.join(above, (F.col("key") == F.col("__key")) & (F.col("up") == F.col("__k")) & (at == F.col("__i")), "left_semi").select(*x.columns).distinct()


def cell_runs(left: np.ndarray, right: np.ndarray, row: np.ndarray, node: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, start, end`` of the sorted, disjoint, non-adjacent runs of cells of level ``c``, in offsets.

    A cell holds what begins at ``left`` and goes on (-1 for nothing), what ends at ``right`` (-1 for nothing), and the blocks
    ``node`` of the cells ``row``, numbered as a heap: 1 is the whole cell, 2n and 2n + 1 are the halves of n.
    """
    size, every = 1 << c, np.arange(len(left))
    rows, nodes = [row], [node]

    def add(some, blocks):
        rows.append(every[some])
        nodes.append(blocks[some])

    # canonical blocks of [left, size) and of [0, right)
    add(left == 0, np.ones_like(left))
    add(right == size, np.ones_like(right))
    for k in range(c):
        begin, end, first = -(-left >> k), right >> k, size >> k
        add((left > 0) & (begin < first) & (begin & 1 == 1), first + begin)
        add((right > 0) & (right < size) & (end & 1 == 1), first + end - 1)
    row, node = np.concatenate(rows), np.concatenate(nodes).astype(np.int64)
    # blocks in order of their start, the longer first: a block is covered where an earlier one of its cell reaches its end
    depth = np.frexp(node.astype(np.float64))[1] - 1
    start, end = (node << (c - depth)) - size, ((node + 1) << (c - depth)) - size
    order = np.lexsort((-end, start, row))
    row, node, end, depth = row[order], node[order], end[order], depth[order]
    reach = np.maximum.accumulate(row * (2 * size) + end)
    keep = np.r_[True, row[1:] * (2 * size) + end[1:] > reach[:-1]][: len(row)]
    row, node, depth = row[keep], node[keep], depth[keep]
    # from the lowest level up, both halves of a block become the block
    done, up = [], np.zeros((2, 0), np.int64)
    for d in range(c, -1, -1):
        at = depth == d
        here = np.concatenate([np.stack([row[at], node[at]]), up], axis=1)
        here = here[:, np.lexsort((here[1], here[0]))]
        pair = np.zeros(here.shape[1] + 1, bool)
        pair[:-2] = (here[0, 1:] == here[0, :-1]) & (here[1, 1:] == here[1, :-1] + 1) & (here[1, :-1] & 1 == 0)
        second = np.r_[False, pair[:-2]] if len(pair) > 1 else pair[:-1]
        pair = pair[:-1]
        up = np.stack([here[0, pair], here[1, pair] >> 1]) if d else np.zeros((2, 0), np.int64)
        done.append(np.concatenate([here[:, ~(pair | second)] if d else here, np.full((1, here.shape[1] - (2 * pair.sum() if d else 0)), d)]))
    row, node, depth = np.concatenate(done, axis=1)
    start, end = (node << (c - depth)) - size, ((node + 1) << (c - depth)) - size
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # adjacent blocks are one run
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != end[:-1])][: len(row)]
    last = np.r_[new[1:], True][: len(row)]
    return row[new], start[new], end[last]


def _run_batches(c: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        edge = [np.asarray(b.column(i).fill_null(-1)).astype(np.int64) for i in (2, 3)]
        lists = b.column(4)
        row = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
        row, start, end = cell_runs(*edge, row, np.asarray(lists.flatten()).astype(np.int64), c)
        at = np.asarray(b.column(1))[row] << c
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(at + start), pa.array(at + end)], names=["key", "s", "e"])


def runs_of_cells(src: DataFrame, c: int) -> tuple[DataFrame, DataFrame]:
    """Of the half-open intervals ``key, __s, __e``: the runs ``key, s, e`` within cells of level ``c``, and the distinct blocks ``key, k, i`` of whole cells.

    An interval over several cells leaves, in its first and last cell, what only the least start and the greatest end
    of the cell tell of; these are taken before anything moves.
    """
    x = src.withColumns({"cs": F.shiftright("__s", c), "ce": F.shiftright(F.col("__e") - 1, c)})
    ends = x.filter("cs < ce").select("key", F.expr(f"""inline(array(
        struct(cs as cell, cast(__s - shiftleft(cs, {c}) as int) as l, cast(null as int) as r),
        struct(ce as cell, cast(null as int) as l, cast(__e - shiftleft(ce, {c}) as int) as r)))"""))
    edges = ends.groupBy("key", "cell").agg(F.min("l").alias("l"), F.max("r").alias("r"))
    within = x.filter("cs = ce").select(F.struct("key", F.col("cs").alias("cell")).alias("at"), F.expr(f"__s - shiftleft(cs, {c})").alias("lo"), F.expr(f"__e - shiftleft(cs, {c})").alias("hi"))
    inner = dyadic_blocks(within, ["at"], "lo", "hi").select("at.key", "at.cell", F.expr(f"cast(shiftleft(1L, {c} - k) + i as int)").alias("node")).groupBy("key", "cell").agg(F.collect_set("node").alias("nodes"))
    cells = edges.join(inner, ["key", "cell"], "full_outer")
    middle = dyadic_blocks(x.select("key", (F.col("cs") + 1).alias("lo"), F.col("ce").alias("hi")), ["key"], "lo", "hi")
    high = middle.select("key", (F.col("k") + c).alias("k"), "i")
    key = src.schema["key"].dataType.simpleString()
    return cells.select("key", "cell", "l", "r", "nodes").mapInArrow(partial(_run_batches, c), f"key {key}, s bigint, e bigint"), high


def _tier(items: DataFrame, level: int, longer: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Of the runs and blocks ``key, s, e, inner`` in cells of ``level``: the pieces ``key, piece, s, e`` that are settled, and the open runs.

    What a block covers goes: cells under one of the blocks ``longer``, and within a cell what an earlier one reaches the end
    of.  The first and the last run of a cell are open, the rest are periods, and the space between two is a gap.
    ``inner`` is whether the space before a run is settled already.
    """
    x = items.withColumn("cell", F.expr(f"shiftright(s, {level})"))
    if longer is not None:
        under = covered(x.select("key", F.col("cell").alias("i")).distinct(), F.lit(level), 0, longer)
        x = x.join(under.withColumnRenamed("i", "cell"), ["key", "cell"], "left_anti")
    w = Window.partitionBy("key", "cell").orderBy("s")
    before = Window.partitionBy("key", "cell").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("reach", F.max("e").over(before)).filter("reach is null or reach < e").drop("reach")
    joined = F.coalesce(F.lag("e").over(w) == F.col("s"), F.lit(False)) & ~F.col("inner")
    x = x.withColumn("run", F.sum((~joined).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("key", "cell", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("inner", "s").alias("inner"))
    runs = runs.withColumns({"before": F.lag("e").over(w), "first": F.lag("s").over(w).isNull(), "last": F.lead("s").over(w).isNull()})
    piece = "struct('{}' as piece, {} as s, {} as e)"
    gap, period = piece.format("gap", "before", "s"), piece.format("period", "s", "e")
    settled = runs.select("key", F.expr(f"inline(filter(array(if(inner or first, null, {gap}), if(first or last, null, {period})), x -> x is not null))"))
    return settled, runs.filter("first or last").select("key", "s", "e", (~F.col("first")).alias("inner"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, cell_level: int = CELL_LEVEL) -> DataFrame:
    """Continuous periods and the gaps between successive periods, for each value of ``keys``.

    ``start`` and ``end`` are integers, both limits belong to the interval, exchanged limits mean the same
    interval, and a row with a missing limit does not count.  Intervals that overlap, nest, repeat or share a
    limit make one period; an interval of length 0 is a period of its own unless it lies in another.  Null
    keys are a key like any other.  An empty table gives an empty result.  Other columns are ignored.  Limits beyond
    2 ** ``BITS`` either way count as that.

    Returns ``keys, piece ('period' or 'gap'), start, end``.
    """
    c, far = cell_level, F.lit(2**BITS)
    a, b = (F.least(F.greatest(F.col(x).cast("bigint"), -far), far) for x in (start, end))
    a, b = F.when(F.col(start).isNotNull(), a), F.when(F.col(end).isNotNull(), b)
    src = df.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"), a.alias("__a"), b.alias("__b")).filter("__a is not null and __b is not null")
    # doubled limits make closed intervals half-open: [a, b] is [2a, 2b + 1), and b + 1 does not touch b
    src = src.select("key", (2 * F.least("__a", "__b")).alias("__s"), (2 * F.greatest("__a", "__b") + 1).alias("__e"))
    runs, high = runs_of_cells(src, c)
    # the runs and the long blocks are read by every tier
    level, items, high, out = c, cut(runs.withColumn("inner", F.lit(False))), cut(high), None
    while True:
        up = min(level + TIER, TOP)
        blocks = high.filter((F.col("k") >= level) & (F.col("k") < up)).select("key", F.expr("shiftleft(i, k)").alias("s"), F.expr("shiftleft(i + 1, k)").alias("e"), F.lit(False).alias("inner"))
        settled, items = _tier(items.unionByName(blocks), up, high.filter(F.col("k") >= up) if up < TOP else None)
        out = settled if out is None else out.unionByName(settled)
        if up == TOP:
            break
        level = up
    # at the top two cells are left, below and from 0 on
    w = Window.partitionBy("key").orderBy("s")
    x = items.withColumn("run", F.sum((~(F.coalesce(F.lag("e").over(w) == F.col("s"), F.lit(False)) & ~F.col("inner"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("inner", "s").alias("inner")).withColumn("before", F.lag("e").over(w))
    out = out.unionByName(x.select("key", F.expr("inline(filter(array(struct('period' as piece, s as s, e as e), if(inner or before is null, null, struct('gap' as piece, before as s, s as e))), x -> x is not null))")))
    period = F.col("piece") == "period"
    return out.select(
        *[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)],
        "piece",
        F.when(period, F.shiftright("s", 1)).otherwise(F.shiftright(F.col("s") - 1, 1)).alias("start"),
        F.when(period, F.shiftright(F.col("e") - 1, 1)).otherwise(F.shiftright("e", 1)).alias("end"),
    )


def found(interpretations: DataFrame, log_runs: DataFrame) -> DataFrame:
    """Periods and gaps of both depth-interval tables in centimetres: ``src, well_id, piece, start_cm, end_cm``; what no integer holds counts as the greatest."""

    def cm(c):
        v = F.round(F.col(c).cast("double") * 100)
        return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(-(2.0**BITS))), F.lit(2.0**BITS)).cast("bigint"))

    def of(df, src, top, base):
        return df.select(F.lit(src).alias("src"), "well_id", cm(top).alias("a"), cm(base).alias("b"))

    both = of(interpretations, "interpretation", "depth_top", "depth_base").unionByName(of(log_runs, "run", "depth_min", "depth_max"))
    return merge_intervals(both, ["src", "well_id"], "a", "b").withColumnsRenamed({"start": "start_cm", "end": "end_cm"})
