import random

import pytest

from lithoflow.operators import intervals

SCHEMA = "well_id string, a bigint, b bigint, cell int, node string"


def merged(spark, rows, level=intervals.CELL_LEVEL):
    df = spark.createDataFrame([(w, a, b, 7, "x") for w, a, b in rows], SCHEMA)
    return sorted(map(tuple, intervals.merge_intervals(df, ["well_id"], "a", "b", level).collect()), key=repr)


def brute(rows):
    by = {}
    for w, a, b in rows:
        if a is not None and b is not None:
            by.setdefault(w, []).append((min(a, b), max(a, b)))
    out = []
    for w, spans in by.items():
        periods = []
        for a, b in sorted(spans):
            if periods and a <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out += [(w, "period", a, b) for a, b in periods]
        out += [(w, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:])]
    return sorted(out, key=repr)


def test_overlap_nest_touch_gap(spark):
    rows = [("w", 0, 10), ("w", 10, 20), ("w", 3, 5), ("w", 21, 30), ("w", 40, 35), ("v", 5, 5), ("w", 0, 10)]
    assert merged(spark, rows) == [("v", "period", 5, 5), ("w", "gap", 20, 21), ("w", "gap", 30, 35), ("w", "period", 0, 20), ("w", "period", 21, 30), ("w", "period", 35, 40)]


def test_missing_limits_null_keys_and_empty(spark):
    assert merged(spark, [("w", None, 3), ("w", 1, None), (None, 1, 2), (None, 5, 6)]) == [(None, "gap", 2, 5), (None, "period", 1, 2), (None, "period", 5, 6)]
    assert merged(spark, []) == []


@pytest.mark.parametrize("level", [2, 4, 12])
def test_against_brute_force(spark, level):
    r = random.Random(level)
    rows = []
    for w in "abc":
        for _ in range(60):
            a = r.randint(-300, 900)
            rows.append((w, a, a + r.choice([0, 0, 1, 2, 5, 40])))
    rows += rows[:20]
    assert merged(spark, rows, level) == brute(rows)


def test_long_intervals_against_brute_force(spark):
    r = random.Random(6)
    rows = []
    for w in "abcd":
        for _ in range(80):
            size = r.choice([0, 1, 7, 900, 2**13, 2**20, 2**31, 2**44, 2**50])
            a = r.choice([0, 2**r.randint(0, 52), -(2 ** r.randint(0, 52)), r.randint(-(2**55), 2**55)])
            rows.append((w, a, a + r.randint(0, size)))
        rows += [(w, 2**58, 2**58 + 2**50), (w, 2**58 + 2**50, 2**58 + 2**51), (w, 2**58 + 2**51 + 1, 2**58 + 2**52)]
    assert merged(spark, rows) == brute(rows)


def test_tiers_against_brute_force(spark, monkeypatch):
    """Cells of all tiers hold several runs."""
    monkeypatch.setattr(intervals, "TIER", 4)
    monkeypatch.setattr(intervals, "TOP", 13)
    test_against_brute_force(spark, 1)


def test_blocks_a_row_are_few_and_cover_it(spark):
    df = spark.createDataFrame([("w", -(2**55) + 3, 2**55 - 5)], "key string, lo bigint, hi bigint")
    got = sorted((b.i << b.k, (b.i + 1) << b.k) for b in intervals.dyadic_blocks(df, ["key"], "lo", "hi").collect())
    assert len(got) <= 2 * 62 and got[0][0] == -(2**55) + 3 and got[-1][1] == 2**55 - 5 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_limits_beyond_the_bits(spark):
    assert merged(spark, [("w", -(2**63), 2**63 - 1), ("w", 5, 6)]) == [("w", "period", -(2**60), 2**60)]


def test_infinite_depths(spark):
    i = spark.createDataFrame([("w", 1.0, float("inf")), ("w", float("nan"), 3.0), ("w", -5.0, 0.0)], "well_id string, depth_top double, depth_base double")
    runs = spark.createDataFrame([], "well_id string, depth_min double, depth_max double")
    assert sorted((r.piece, r.start_cm, r.end_cm) for r in intervals.found(i, runs).collect()) == [("gap", 0, 100), ("period", -500, 0), ("period", 100, 2**60)]


def test_runs_of_cells_against_brute_force():
    import numpy as np

    r, c = random.Random(2), 5
    left, right, row, node, want = [], [], [], [], []
    for k in range(300):
        held = set()
        left.append(r.choice([-1, -1, 0, r.randint(0, 31)]))
        right.append(r.choice([-1, -1, 32, r.randint(1, 32)]))
        held |= set(range(left[-1], 32)) if left[-1] >= 0 else set()
        held |= set(range(right[-1])) if right[-1] >= 0 else set()
        for n in {r.randint(1, 63) for _ in range(r.choice([0, 1, 5, 20]))}:
            row.append(k)
            node.append(n)
            d = n.bit_length() - 1
            held |= set(range((n << (c - d)) - 32, ((n + 1) << (c - d)) - 32))
        want += [(k, i, next(j for j in range(i, 34) if j not in held)) for i in sorted(held) if i - 1 not in held]
    got = intervals.cell_runs(np.array(left), np.array(right), np.array(row), np.array(node), c)
    assert list(zip(*(x.tolist() for x in got))) == want
