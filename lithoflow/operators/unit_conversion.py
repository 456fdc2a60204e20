"""Bringing quantities recorded in different units to common units.

One pass of SQL: the unit is the unit field's, else the one a note names, else the source default; its
leading number and its spelling are taken apart, the spelling is looked up in the alias table, and factor and
offset give the value in the common unit.  The alias table and the canonical list are small literals; every
other join is on a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curve_codes import curve_entries
from ..functions.units import UNITS, alias_table, text_unit, unit_key, unit_scale

DEPTH_UNIT = "m"


def _looked_up(x: DataFrame, prefix: str, text: Column | str, names: DataFrame) -> DataFrame:
    """Adds unit, dimension, factor and offset, named with ``prefix``, of the spelling ``text`` (a column, or one spelling)."""
    columns = ["unit", "dimension", "factor", "offset"]
    if isinstance(text, str):
        unit = next((u for u, (_, _, _, spellings) in UNITS.items() if u == text or text.lower() in spellings.split()), None)
        known = (unit, *UNITS[unit][:3]) if unit else (None,) * 4
        kinds = ["string", "string", "double", "double"]
        return x.withColumns({f"{prefix}{c}": F.lit(v).cast(k) for c, v, k in zip(columns, known, kinds)} | {f"{prefix}scale": F.lit(1.0)})
    x = x.withColumns({f"{prefix}key": unit_key(text), f"{prefix}scale": unit_scale(text)})
    alias = F.broadcast(names.select(F.col("alias").alias(f"{prefix}alias"), *[F.col(c).alias(f"{prefix}{c}") for c in columns]))
    return x.join(alias, F.col(f"{prefix}key") == F.col(f"{prefix}alias"), "left")


def with_factors(df: DataFrame, unit: Column, note: Column, common: Column | str, default: Column | str | None = None) -> DataFrame:
    """Adds ``factor``, ``offset``, ``recorded_unit`` and ``other_unit`` to ``df``: a value is value * factor + offset in the common unit.

    ``unit`` and ``note`` name the recorded unit, in this order; where neither does, ``default`` (the common
    unit if not given) holds.  ``common`` is the unit wanted.  An unknown common unit or units of different dimensions
    give a null factor and offset.  ``other_unit`` is whether the recorded unit is another one than ``common``;
    another spelling is not another unit, and its factor is 1.
    """
    names = alias_table(df.sparkSession)
    x = df.withColumns({"__unit": unit, "__note": text_unit(note)})
    x = _looked_up(_looked_up(x, "__u_", F.col("__unit"), names), "__t_", F.col("__note"), names)
    x = _looked_up(x, "__c_", common, names)
    if default is not None:
        x = _looked_up(x, "__d_", default, names)
    last = "__c_" if default is None else "__d_"

    def pick(c):
        return F.when(F.col("__u_unit").isNotNull(), F.col(f"__u_{c}")).when(F.col("__t_unit").isNotNull(), F.col(f"__t_{c}")).otherwise(F.col(last + c))

    x = x.withColumns({f"__{c}": pick(c) for c in ("unit", "dimension", "factor", "offset", "scale")})
    factor, wanted = F.col("__factor") * F.col("__scale"), F.col("__c_factor") * F.col("__c_scale")
    same = (F.col("__unit") == F.col("__c_unit")) & (F.col("__scale") == F.col("__c_scale"))
    fits = F.col("__dimension") == F.col("__c_dimension")
    shift = F.when(same | (F.col("__offset") == F.col("__c_offset")) & (F.col("__offset") == 0), 0.0).otherwise((F.col("__offset") - F.col("__c_offset")) / wanted)
    x = x.withColumns({"__f": F.when(fits, F.when(same, 1.0).otherwise(factor / wanted)), "__o": F.when(fits, shift), "__r": F.col("__unit"), "__x": ~same})
    kept = [c for c in df.columns if c not in ("factor", "offset", "recorded_unit", "other_unit")]
    return x.select(*kept, F.col("__f").alias("factor"), F.col("__o").alias("offset"), F.col("__r").alias("recorded_unit"), F.col("__x").alias("other_unit"))


def convert(df: DataFrame, value: str, unit: Column, note: Column, common: Column | str, default: Column | str | None = None) -> DataFrame:
    """Adds ``common_value`` (double), ``recorded_unit`` and ``other_unit`` (boolean) to ``df``.

    The units are those of ``with_factors``.  A null value or units that don't go together give a null ``common_value``; NaN stays NaN.
    """
    x = with_factors(df, unit, note, common, default)
    return x.withColumn("common_value", F.col(value) * F.col("factor") + F.col("offset")).drop("factor", "offset")


def with_entry(curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``curves`` with the common unit ``common_unit`` and ``ref_id`` of the canonical curve each means; null and 0 where it means none."""
    e = curve_entries(curves, ref).withColumnsRenamed({"mnemonic": "__m", "name": "__n", "ref_id": "__r"})
    r = F.broadcast(ref.select(F.col("ref_id").alias("__id"), F.col("common_unit").alias("__cu")))
    known = curves.drop("ref_id", "common_unit")
    j = known.join(e, known["mnemonic"].eqNullSafe(e["__m"]) & known["name"].eqNullSafe(e["__n"]), "left").join(r, F.col("__r") == F.col("__id"), "left")
    return j.select(*known.columns, F.col("__r").alias("ref_id"), F.col("__cu").alias("common_unit"))


def _run_units(log_runs: DataFrame) -> DataFrame:
    """``run_id, depth_unit, header_note``, one row a run whatever is repeated."""
    one = log_runs.filter("run_id is not null").groupBy("run_id").agg(F.min(F.struct("depth_unit", "header_note")).alias("u"))
    return one.select("run_id", "u.depth_unit", "u.header_note")


def common_values(log_runs: DataFrame, curves: DataFrame, ref: DataFrame) -> DataFrame:
    """Every quantity of both tables in its common unit: ``quantity, rec_id, value, recorded_unit, common_unit, common_value, other_unit``.

    A curve's depths are in the unit of its run; curves without a run get the source default, metres.
    Repeated rows come out repeated, null values with a null result; empty tables give no rows.
    """
    m = DEPTH_UNIT
    runs = log_runs.select("run_id", "depth_unit", "header_note", "depth_interval")
    step = convert(runs.select(F.lit("run_step").alias("quantity"), F.col("run_id").alias("rec_id"), F.col("depth_interval").cast("double").alias("value"), "depth_unit", "header_note", F.lit(m).alias("common_unit")), "value", F.col("depth_unit"), F.col("header_note"), m)
    depths = (
        curves.select("curve_id", "run_id", F.explode(F.array(
            F.struct(F.lit("curve_start").alias("quantity"), F.col("depth_start").cast("double").alias("value")),
            F.struct(F.lit("curve_stop").alias("quantity"), F.col("depth_stop").cast("double").alias("value")),
        )).alias("d"))
        .join(_run_units(log_runs), "run_id", "left")
        .select("d.quantity", F.col("curve_id").alias("rec_id"), "d.value", "depth_unit", "header_note", F.lit(m).alias("common_unit"))
    )
    depths = convert(depths, "value", F.col("depth_unit"), F.col("header_note"), m)
    known = with_entry(curves.select("curve_id", "mnemonic", "name", "unit", "description", "check_value"), ref).filter("common_unit is not null")
    check = known.select(F.lit("check_value").alias("quantity"), F.col("curve_id").alias("rec_id"), F.col("check_value").cast("double").alias("value"), "unit", "description", "common_unit")
    check = convert(check, "value", F.col("unit"), F.col("description"), F.col("common_unit"))
    out = ["quantity", "rec_id", "value", "recorded_unit", "common_unit", "common_value", "other_unit"]
    return step.select(*out).unionByName(depths.select(*out)).unionByName(check.select(*out))


# How many of the result's units make one common unit.
_PER_COMMON = {"curve_start": 100.0, "curve_stop": 100.0, "run_step": 10000.0, "check_value": 1000.0}


def found(log_runs: DataFrame, curves: DataFrame, ref: DataFrame) -> DataFrame:
    """``quantity, rec_id, common_value``: the present quantities recorded in another unit, as whole parts of the common one."""
    v = F.round(F.col("common_value") * F.create_map(*[F.lit(x) for kv in _PER_COMMON.items() for x in kv])[F.col("quantity")])
    # what no bigint holds comes out as the nearest one
    ok = F.col("other_unit") & v.isNotNull() & ~F.isnan(v)
    return common_values(log_runs, curves, ref).filter(ok).select("quantity", "rec_id", F.least(F.greatest(v, F.lit(-(2.0**63))), F.lit(2.0**63)).cast("bigint").alias("common_value")).distinct()


def samples_in_common_units(samples: DataFrame, curves: DataFrame, log_runs: DataFrame, ref: DataFrame) -> DataFrame:
    """Each row of ``curve_samples`` with ``depth_m`` and ``common_value``; null where the curve has no canonical entry.

    Unit, scale and offset are settled once a curve; a reading is only multiplied and shifted, after one join on ``curve_id``.
    Readings without curve_id, or of a curve or run that is not there, keep null.
    """
    columns = ["run_id", "mnemonic", "name", "unit", "description"]
    one = curves.filter("curve_id is not null").groupBy("curve_id").agg(F.min(F.struct(*columns)).alias("c")).select("curve_id", "c.*")
    per = with_entry(one, ref).join(_run_units(log_runs), "run_id", "left")
    per = with_factors(per, F.col("depth_unit"), F.col("header_note"), DEPTH_UNIT).withColumnsRenamed({"factor": "__df", "offset": "__do"}).drop("recorded_unit", "other_unit")
    per = with_factors(per, F.col("unit"), F.col("description"), F.col("common_unit"))
    per = per.select("curve_id", "ref_id", "common_unit", "__df", "__do", F.col("factor").alias("__vf"), F.col("offset").alias("__vo"))
    kept = samples.drop("ref_id", "common_unit", "depth_m", "common_value")
    j = kept.join(per, "curve_id", "left")
    return j.withColumns({"depth_m": F.col("depth") * F.col("__df") + F.col("__do"), "common_value": F.col("value") * F.col("__vf") + F.col("__vo")}).drop("__df", "__do", "__vf", "__vo")
