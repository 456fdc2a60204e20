"""Reading LAS well-log files (versions 1.2 and 2.0, unwrapped or wrapped) as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.wells import DEPTH_MNEMONICS

# The header mnemonics of a well's columns.
WELL_COLUMNS = {"WELL": "well_name", "UWI": "uwi", "FLD": "field", "CTRY": "country", "COMP": "operator", "API": "api_number", "LAT": "latitude", "LON": "longitude", "EKB": "kb_elevation", "EGL": "ground_elevation"}
_NUMBERS = {"latitude", "longitude", "kb_elevation", "ground_elevation"}


def parse_line(line: str) -> tuple[str, str, str, str]:
    """``mnemonic, unit, value, description`` of a header line ``MNEM.UNIT value : description``."""
    head, _, description = line.rpartition(":") if ":" in line else (line, "", "")
    name, _, rest = head.partition(".")
    unit, _, value = rest.partition(" ") if not rest.startswith(" ") else ("", "", rest)
    return name.strip(), unit.strip(), value.strip(), description.strip()


def parse(text: str):
    """Headers and curves of one file: ``(well header, curve headers, rows)``; a file without data has no rows."""
    well, curves, values, section, wrapped = {}, [], [], "", False
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("~"):
            section = s[1:2].upper()
        elif section in "VW" and section:
            m, unit, value, _ = parse_line(s)
            if section == "V" and m.upper() == "WRAP":
                wrapped = value.upper().startswith("Y")
            well.setdefault(m.upper(), value)
        elif section == "C":
            curves.append(parse_line(s))
        elif section == "A":
            values.append(s.replace(",", " ").split())
    if wrapped:
        flat = [v for row in values for v in row]
        values = [flat[i : i + len(curves)] for i in range(0, len(flat), len(curves))] if curves else []
    return well, curves, [r for r in values if curves and len(r) == len(curves)]


def number(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of the files; one file is one row, the files are spread over the tasks."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def wells(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: the well's header; a missing name is 'Unknown', what is no number is null."""
    names = list(WELL_COLUMNS.values())
    types = {n: pa.float64() if n in _NUMBERS else pa.string() for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, _, _ = parse(text)
                row = [w.get(k) or None for k in WELL_COLUMNS]
                rows.append((name, row[0] or "Unknown", *[number(v) if n in _NUMBERS else v for n, v in zip(names[1:], row[1:])]))
            cols = list(zip(*rows)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, types[n]) for n, c in zip(names, cols[1:])]], names=["path", *names])

    shape = "path string, " + ", ".join(f"{n} {'double' if n in _NUMBERS else 'string'}" for n in names)
    return files(spark, path).mapInArrow(run, shape)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """One row a reading: ``path, well_id, curve_id, mnemonic, unit, description, idx, depth, value, loaded_at``, as the well operators take it.

    The first curve is the depth; other depth curves are left out.  A well is known by its UWI, else its API number, its name, or
    the file; a curve by file, place and mnemonic; a file is loaded when it was last changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "loaded_at", "well_id", "place", "mnemonic", "unit", "description", "idx", "depth", "value"]
        types = [pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.float64(), pa.float64()]
        for b in batches:
            for name, loaded, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                well, curves, rows = parse(text)
                known = next((well[k] for k in ("UWI", "API", "WELL") if well.get(k)), name)
                depth = [number(r[0]) for r in rows]
                for k, (m, unit, _, description) in enumerate(curves[1:], 1):
                    if m.upper() in DEPTH_MNEMONICS:
                        continue
                    n = len(rows)
                    cols = [[name] * n, [loaded] * n, [known] * n, [k] * n, [m] * n, [unit] * n, [description] * n, list(range(n)), depth, [number(r[k]) for r in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    src = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("loaded_at"), F.col("value").alias("text"))
    shape = "path string, loaded_at timestamp, well_id string, place int, mnemonic string, unit string, description string, idx int, depth double, value double"
    return src.mapInArrow(run, shape).select("path", "well_id", F.xxhash64("path", "place", "mnemonic").alias("curve_id"), "mnemonic", "unit", "description", "idx", "depth", "value", "loaded_at")
