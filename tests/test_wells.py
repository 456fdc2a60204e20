import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from lithoflow.operators import wells

T = datetime.datetime(2024, 1, 1)
SCHEMA = "well_id string, curve_id bigint, mnemonic string, idx int, depth double, value double, loaded_at timestamp"


def samples(spark, values, depth=lambda i: float(i), curve=1, mnemonic="GR"):
    return spark.createDataFrame([("w", curve, mnemonic, i, depth(i), v, T) for i, v in enumerate(values)], SCHEMA)


def test_no_window_where_curve_is_one_window_long(spark):
    assert wells.trend_windows(samples(spark, range(20) and [float(i) for i in range(20)])).count() == 0
    assert wells.trend_windows(samples(spark, [float(i) for i in range(21)])).count() == 1


def test_window_numbers_as_a_loop(spark):
    for n, w in ((25, 10), (40, 12), (31, 15)):
        got = wells.hop_windows(wells.series(samples(spark, [float(i) for i in range(n)])), w).groupBy("k").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()
        assert sorted((r.a, r.b) for r in got) == [(i, i + w - 1) for i in range(0, n - w, w // 2)]


def test_short_windows_reach_all_types(spark):
    up, down = [float(i) for i in range(7)], [float(-i) for i in range(7)]
    assert wells.trend_windows(samples(spark, up), 6).first().type == "bell"
    assert wells.trend_windows(samples(spark, down), 6).first().type == "funnel"
    assert wells.trend_windows(samples(spark, [5.0] * 7), 6).first().type == "boxcar"


def test_missing_readings_and_quality(spark):
    q = wells.curve_quality(samples(spark, [1.0, None, -999.25, -9999.0, float("inf"), float("nan"), 51.0])).first()
    assert (q.n, q.valid) == (7, 2) and math.isclose(q.quality, 0.8 * 2 / 7 + 0.1) and math.isclose(q.missing_pct, 500 / 7)
    assert wells.curve_quality(samples(spark, [None, -999.25])).first().quality == 0
    assert wells.curve_quality(samples(spark, [])).count() == 0


def test_smoothing_keeps_parabolas(spark):
    v = [0.5 * i * i - 3 * i for i in range(12)]
    r = wells.savgol(wells.series(samples(spark, v))).orderBy("i").collect()
    assert all(math.isclose(x.smooth, y, abs_tol=1e-9) for x, y in zip(r, v))


def test_gradient_as_numpy(spark):
    d = np.cumsum([0.5, 1, 0.25, 2, 1, 1, 0.5, 0.5])
    v = np.sin(d)
    r = wells.gradient(wells.series(samples(spark, v.tolist(), lambda i: float(d[i])))).orderBy("i").collect()
    assert np.allclose([x.gradient for x in r], np.gradient(v, d))


def test_constant_curve_is_boxcar(spark):
    flat = samples(spark, [5.0] * 40)
    for f in (wells.detect_gradient, wells.detect_correlation, wells.detect_statistical):
        assert {r.type for r in f(flat).collect()} == {"boxcar"}


def test_overlaps(spark):
    cols = "curve_id bigint, k bigint, method string, type string, start_depth double, end_depth double, thickness double, confidence double"
    rows = [(1, 0, "statistical", "bell", 0.0, 10.0, 10.0, 50.0), (1, 1, "gradient", "funnel", 10.0, 20.0, 10.0, 50.0), (1, 0, "correlation", "boxcar", 5.0, 15.0, 10.0, 50.0), (1, 3, "gradient", "boxcar", 12.0, 14.0, 2.0, 40.0)]
    got = sorted((r.start_depth, r.method) for r in wells.resolve_overlaps(spark.createDataFrame(rows, cols)).collect())
    assert got == [(0.0, "statistical"), (10.0, "gradient")]


def test_types_in_order(spark):
    df = spark.createDataFrame([("SPHI",), ("ACAL",), ("GAPI",), ("XYZ",), (None,)], "m string")
    assert [r[0] for r in df.select(wells.curve_type(F.col("m"))).collect()] == ["SP", "DT", "GR", None, None]


def test_last_curve_of_a_type_wins(spark):
    df = spark.createDataFrame([("w", 1, "GR"), ("w", 2, "GRC"), ("w", 3, "NPHI"), ("w", 4, "DEPT"), ("v", 5, "RT"), ("v", 6, None)], "well_id string, curve_id bigint, mnemonic string")
    assert sorted(map(tuple, wells.primary_curves(df).collect())) == [("v", "RES", 5, True), ("w", "GR", 2, True), ("w", "NPHI", 3, False)]
