import math

import pytest
from pyspark.sql import functions as F

from lithoflow.functions import units
from lithoflow.functions.curve_codes import curve_entries
from lithoflow.operators import unit_conversion as u

REF = [(1, "GR", "Gamma Ray", "API"), (2, "RHOB", "Bulk Density", "g/cm3"), (3, "NPHI", "Neutron Porosity", "v/v"), (4, "DTC", "Compressional Slowness", "us/ft"), (5, "ILD", "Induction Deep Resistivity", "ohm.m")]
REF_SCHEMA = "ref_id bigint, code string, title string, common_unit string"
CURVES = "curve_id bigint, run_id bigint, mnemonic string, name string, unit string, description string, depth_start double, depth_stop double, check_value double, ref_id string"
RUNS = "run_id bigint, depth_unit string, header_note string, depth_interval double, extra int"


@pytest.mark.parametrize(
    ("text", "unit", "scale"),
    [("FT", "ft", 1), ("feet.", "ft", 1), ("'", "ft", 1), (".1IN", "in", 0.1), ("0.1 in", "in", 0.1), ("tenths of an inch", "in", 0.1), (" Ω·m", "ohm.m", 1), ("KOHMM", "kohm.m", 1), ("µs/ft", "us/ft", 1),
     ("μs/m", "us/m", 1), ("kg/m³", "kg/m3", 1), ("G.API", "API", 1), ("p.u.", "%", 1), ("?", None, None), ("", None, None), (None, None, None), ("furlong", None, None)],
)
def test_spellings(spark, text, unit, scale):
    df = spark.createDataFrame([(text,)], "t string").select(units.unit_key(F.col("t")).alias("k"), units.unit_scale(F.col("t")).alias("s"))
    r = df.join(units.alias_table(spark), F.col("k") == F.col("alias"), "left").first()
    assert r.unit == unit and (unit is None or math.isclose(r.s, scale))


@pytest.mark.parametrize(
    ("note", "unit"),
    [("all depths in ft MD", "ft"), ("Depth ref: metres below KB.", "metres"), ("DEPTH (m MD) spliced", "m"), ("[ohm-m] main pass", "ohm-m"), ("values in in.", "in."), ("gAPI, env. corrected", "gAPI"), ("spliced main pass", None), (None, None), ("", None)],
)
def test_units_in_notes(spark, note, unit):
    assert spark.createDataFrame([(note,)], "t string").select(units.text_unit(F.col("t"))).first()[0] == unit


def found(spark, runs, curves):
    df = u.found(spark.createDataFrame(runs, RUNS), spark.createDataFrame(curves, CURVES), spark.createDataFrame(REF, REF_SCHEMA))
    return sorted(map(tuple, df.collect()))


def test_found(spark):
    runs = [(1, "FT", None, 0.5, 1), (2, "M", "all depths in ft", 0.1, 1), (3, "?", "all depths in cm", 10.0, 1), (4, None, None, 1.0, 1), (5, "KM", None, None, 1), (1, "FT", None, 0.5, 2)]
    curves = [
        (10, 1, "RHOB", None, "kg/m3", None, 100.0, None, 2500.0, "x"), (11, 2, "R.H.O.B", None, "", "units: g/cc", 1.0, 2.0, 2.5, "x"), (12, 9, None, "Nuetron Por", "PU", None, 5.0, 6.0, 30.0, "x"),
        (13, 1, "?", "?", "kg/m3", None, None, None, 7.0, "x"), (14, 3, "gr final", None, None, None, float("nan"), None, 50.0, "x"), (10, 1, "RHOB", None, "kg/m3", None, 100.0, None, 2500.0, "x"),
    ]
    assert found(spark, runs, curves) == [("check_value", 10, 2500), ("check_value", 12, 300), ("curve_start", 10, 3048), ("run_step", 1, 1524), ("run_step", 3, 1000)]


def test_empty(spark):
    assert found(spark, [], []) == []


def test_entries(spark):
    typed = [("LWD:GR", None), ("G-R", None), (None, "gamma  ray (run 2)"), ("CRV_2", "Gmama Ray log"), ("bulk_dnsty", None), ("", "Induct Deep Rstvty"), ("PUMP", "Pump Strokes"), (None, None)]
    e = curve_entries(spark.createDataFrame(typed, "mnemonic string, name string"), spark.createDataFrame(REF, REF_SCHEMA))
    assert {(r.mnemonic, r.name): r.ref_id for r in e.collect()} == dict(zip(typed, [1, 1, 1, 1, 2, 5, 0, 0]))


def test_samples(spark):
    samples = spark.createDataFrame([(10, 0, 10.0, 2500.0, "u"), (99, 0, 1.0, 2.0, "u"), (10, 0, 10.0, 2500.0, "u")], "curve_id bigint, idx int, depth double, value double, common_unit string")
    curves = spark.createDataFrame([(10, 1, "RHOB", None, "kg/m3", None, 1.0, 1.0, 1.0, "x")] * 2, CURVES)
    r = sorted(u.samples_in_common_units(samples, curves, spark.createDataFrame([(1, "ft", None, 1.0, 1)], RUNS), spark.createDataFrame(REF, REF_SCHEMA)).collect(), key=lambda r: r.curve_id)
    assert len(r) == 3 and math.isclose(r[0].depth_m, 3.048) and math.isclose(r[0].common_value, 2.5) and r[2].common_value is None


def test_offset(spark):
    df = spark.createDataFrame([(50.0, "degF")], "v double, u string")
    assert math.isclose(u.convert(df, "v", F.col("u"), F.lit(None).cast("string"), "degC").first().common_value, 10.0)


def test_samples_with_an_offset(spark):
    ref = [(1, "TEMP", "Temperature", "degC")]
    curves = spark.createDataFrame([(10, 1, "TEMP", None, "degF", None, 1.0, 1.0, 1.0, "x"), (11, 1, "TEMP", None, "degC", None, 1.0, 1.0, 1.0, "x"), (12, 1, "TEMP", None, "ft", None, 1.0, 1.0, 1.0, "x")], CURVES)
    samples = spark.createDataFrame([(10, 0, 3.0, 212.0), (10, 1, None, 32.0), (11, 0, 3.0, 50.0), (12, 0, 3.0, 50.0)], "curve_id bigint, idx int, depth double, value double")
    got = {(r.curve_id, r.idx): (r.depth_m, r.common_value) for r in u.samples_in_common_units(samples, curves, spark.createDataFrame([], RUNS), spark.createDataFrame(ref, REF_SCHEMA)).collect()}
    assert math.isclose(got[10, 0][1], 100.0) and abs(got[10, 1][1]) < 1e-9 and got[11, 0] == (3.0, 50.0) and got[12, 0][1] is None and got[10, 1][0] is None


def test_huge_values_stay(spark):
    assert found(spark, [(1, "km", None, 1e30, 1), (2, "km", None, -1e30, 1), (3, "km", None, float("inf"), 1)], []) == [("run_step", 1, 2**63 - 1), ("run_step", 2, -(2**63)), ("run_step", 3, 2**63 - 1)]


def test_a_long_list_is_taken_in_parts(spark, monkeypatch):
    from lithoflow.functions import curve_codes

    monkeypatch.setattr(curve_codes, "ENTRIES", 2)
    test_entries(spark)
