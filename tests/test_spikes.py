import datetime
import random

from lithoflow.operators import spikes

REF = [(1, "GR", "Gamma Ray", "API"), (2, "NPHI", "Neutron Porosity", "v/v")]
T0, T1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 6, 1)
SAMPLES = "curve_id bigint, idx int, value double, loaded_at timestamp, at string"
CURVES = "curve_id bigint, run_id bigint, mnemonic string, name string, unit string, description string, quality_score double"


def flags(spark, values, curves=((1, 1, "GR", None, "API", None, 0.9),), **kw):
    rows = [(c, i, v, T0, "x") for c, vs in values.items() for i, v in enumerate(vs)]
    df = spikes.flag_readings(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(list(curves), CURVES), spark.createDataFrame(REF, "ref_id bigint, code string, title string, common_unit string"), **kw)
    return sorted(map(tuple, df.collect()))


def noise(n, seed=1, level=60.0, width=1.0):
    r = random.Random(seed)
    return [level + r.gauss(0, width) for _ in range(n)]


def test_spikes_levels_and_groups(spark):
    v = noise(50) + noise(50, 2, 90.0)
    v[20] += 40
    v[30:33] = [x - 40 for x in v[30:33]]
    assert flags(spark, {1: v}) == [(1, 20), (1, 30), (1, 31), (1, 32)]


def test_stuck_and_missing(spark):
    v = noise(60)
    v[10:19] = [50.0] * 9
    v[30:40] = [61.5] * 10
    v[33] = None
    v[34] = -999.25
    v[41] = float("nan")
    v[42] = float("inf")
    v[40] = 61.5
    assert flags(spark, {1: v}) == []
    v[41] = 61.5
    assert flags(spark, {1: v}) == [(1, i) for i in (30, 31, 32, 35, 36, 37, 38, 39, 40, 41)]


def test_impossible_values(spark):
    v = noise(40, 3, 0.2, 0.01)
    v[10:17] = [1.5] * 7
    curves = [(1, 1, "NPHI", None, "v/v", None, 0.9), (2, 1, "?", None, "v/v", None, 0.9), (1, 1, "NPHI", None, "v/v", None, 0.9)]
    assert flags(spark, {1: v, 2: v}, curves) == [(1, i) for i in range(10, 17)]


def test_latest_delivery_counts_and_empty(spark):
    v = noise(40)
    rows = [(1, i, x, T0, "x") for i, x in enumerate(v)] + [(1, 5, 500.0, T1, "x"), (1, 7, 500.0, datetime.datetime(2023, 1, 1), "x"), (None, 1, 1.0, T0, "x"), (1, None, 1.0, T0, "x")]
    curves, ref = spark.createDataFrame([], CURVES), spark.createDataFrame(REF, "ref_id bigint, code string, title string, common_unit string")
    assert list(map(tuple, spikes.flag_readings(spark.createDataFrame(rows, SAMPLES), curves, ref).collect())) == [(1, 5)]
    assert spikes.found(spark.createDataFrame([], SAMPLES), curves, ref).count() == 0


def test_long_curves_alike(spark):
    r = random.Random(4)
    v = noise(3000, 5)
    for i in r.sample(range(3000), 40):
        v[i] += r.choice([-60, 60])
    v[895:915] = [55.0] * 20
    v[2000:2400] = [None] * 400
    assert flags(spark, {1: v}) == flags(spark, {1: v}, block_size=450)


def test_scores(spark):
    rows = [(i, i // 10, "GR", None, None, None, 0.8 + (i % 7) * 0.003 + (i // 10) * 0.001) for i in range(200)]
    rows += [(900, 3, "GR", None, None, None, 0.3), (901, 4, "GR", None, None, None, 1.2), (902, 5, "GR", None, None, None, None), (903, None, "GR", None, None, None, 0.1), (904, 99, "GR", None, None, None, 0.1), (905, 3, "GR", None, None, None, float("nan"))]
    assert sorted(r[0] for r in spikes.flag_scores(spark.createDataFrame(rows, CURVES)).collect()) == [900, 901]


def test_tail_of_a_known_distribution(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    for shape in (0.0, 0.2):
        e = rng.exponential(1.0, 200_000)
        y = 0.5 * (e if not shape else (np.exp(shape * e) - 1) / shape)
        classes, count = np.unique(spikes.size_class(y + spikes.THRESHOLD), return_counts=True)
        base = (shape, 0.5, 0.1, 1e9)
        got = spikes.fitted_tail(classes, count, 2_000_000, base)
        assert abs(got[0] - shape) < 0.03 and abs(got[1] - 0.5) < 0.03 and abs(got[2] - 0.1) < 0.001
    # spikes hardly move it
    with_spikes = np.r_[rng.exponential(0.5, 10_000), rng.uniform(20, 90, 1500)]
    classes, count = np.unique(spikes.size_class(with_spikes + spikes.THRESHOLD), return_counts=True)
    shape, scale, _, most = spikes.fitted_tail(classes, count, 100_000)
    assert abs(shape) < 0.2 and 0.35 < scale < 0.75 and 6 < most < 22


def test_long_and_short_curves_have_the_same_cutoffs(spark):
    r = random.Random(9)
    rows, curves = [], []
    for c in range(6):
        v = noise(900, c, 60.0, 1.0 + c)
        for i in r.sample(range(900), 8):
            v[i] += r.choice([-40, 40]) * (1 + c)
        rows += [(c, i, x, T0, "x") for i, x in enumerate(v)]
        curves.append((c, 1, "GR" if c % 2 else "?", None, "API", None, 0.9))
    ref = spark.createDataFrame(REF, "ref_id bigint, code string, title string, common_unit string")
    samples, curves = spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(curves, CURVES)
    short, long = ({x.curve_id: x.limit for x in spikes.cutoffs(spikes.stand_offs(samples, curves, ref, b)).collect()} for b in (4096, 300))
    assert short.keys() == long.keys() == set(range(6)) and all(abs(short[c] - long[c]) < 1e-9 for c in short)


def test_limits_in_a_unit_with_an_offset(spark, monkeypatch):
    monkeypatch.setitem(spikes.LIMITS, "degC", (-50.0, 300.0))
    curves = spark.createDataFrame([(1, 1, "TEMP", None, "degF", None, 0.9)], CURVES)
    got = spikes.curve_limits(curves, spark.createDataFrame([(1, "TEMP", "Temperature", "degC")], "ref_id bigint, code string, title string, common_unit string")).first()
    assert abs(got.lo + 58.0) < 1e-9 and abs(got.hi - 572.0) < 1e-9
