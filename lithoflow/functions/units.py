"""Spellings of units, and the factors to one base unit per dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical unit -> (dimension, factor and offset to the dimension's base unit, spellings in the
# normal form of unit_key: lower case, without blanks, points, hyphens and underscores).
UNITS = {
    "m": ("length", 1.0, 0.0, "m mtr mtrs meter meters metre metres"),
    "cm": ("length", 0.01, 0.0, "cm centimetre centimetres centimeter centimeters centim"),
    "mm": ("length", 0.001, 0.0, "mm millimetre millimetres millimeter millimeters millim"),
    "km": ("length", 1000.0, 0.0, "km kilometre kilometres kilometer kilometers"),
    "ft": ("length", 0.3048, 0.0, "f ft ft' feet foot '"),
    "in": ("length", 0.0254, 0.0, 'in ins inch inches "'),
    "API": ("gamma", 1.0, 0.0, "api gapi apiunit apiunits gammaapi"),
    "mV": ("potential", 0.001, 0.0, "mv millivolt millivolts mvolt"),
    "V": ("potential", 1.0, 0.0, "v volt volts"),
    "ohm.m": ("resistivity", 1.0, 0.0, "ohmm ohmmeter ohmmeters ohmmetre ohmmetres"),
    "ohm.cm": ("resistivity", 0.01, 0.0, "ohmcm ohmcentimetre ohmcentimetres ohmcentimeter ohmcentimeters"),
    "kohm.m": ("resistivity", 1000.0, 0.0, "kohmm kiloohmm kiloohmmetre kiloohmmetres kohmmetre kohmmetres kilohmm kilohmmetre kilohmmetres"),
    "v/v": ("fraction", 1.0, 0.0, "v/v m3/m3 cfcf cf/cf ft3/ft3 frac fraction dec decimal decimalfraction volumefraction w/w kg/kg g/g weightfraction massfraction"),
    "%": ("fraction", 0.01, 0.0, "% pct percent percents pu porosityunit porosityunits wt% wtpct weight% weightpercent vol% volumepercent"),
    "ppm": ("fraction", 1e-6, 0.0, "ppm ug/g mg/kg g/t partspermillion"),
    "g/cm3": ("density", 1.0, 0.0, "g/cm3 gm/cm3 g/cc gm/cc g/c3 gpercc gpercm3 gramspercc gramspercm3 grampercc gramspercubiccentimetre"),
    "kg/m3": ("density", 0.001, 0.0, "kg/m3 k/m3 kgperm3 kilogramsperm3 kilogramspercubicmetre kgpercubicmetre"),
    "lb/ft3": ("density", 0.45359237 / 0.3048**3 / 1000, 0.0, "lb/ft3 lb/f3 lbs/ft3 pcf lbperft3 poundspercubicfoot lbpercubicfoot lbspercubicfoot"),
    "us/ft": ("slowness", 1.0, 0.0, "us/ft us/f usec/ft usec/f microsecondsperfoot microsecperfoot usperft usecperft"),
    "us/m": ("slowness", 0.3048, 0.0, "us/m usec/m microsecondspermetre microsecondspermeter usperm usecperm"),
    "b/e": ("photoelectric", 1.0, 0.0, "b/e barns/e barn/e barns/electron barnsperelectron bpere"),
    "degC": ("temperature", 1.0, 0.0, "degc c celsius"),
    "degF": ("temperature", 5.0 / 9.0, -160.0 / 9.0, "degf fahrenheit"),
}

# Phrases of notes that name a unit, the unit in group 1.
TEXT_UNIT = [
    r"(?i)\[\s*([^\]]+?)\s*\]",
    r"(?i)\(\s*([^)]+?)\s*\)",
    r"(?i)\bunits?\s*[:=]\s*(.+?)\s*\.?$",
    r"(?i)\b(?:values|depths?)\s+in\s+(.+?)\s*$",
    r"(?i)\bgiven\s+as\s+(.+?)\s*(?:;|$)",
    r"(?i)\bscaled\s+to\s+(.+?)\s*$",
    r"(?i)\bref\s*[:=]\s*(.+?)\s*\.?$",
    r"(?i)^\s*(.+?)\s*,\s*env\.",
]
_DATUM = r"(?i)\s+(?:md|tvd|tvdss|below\s+kb|below\s+rt|rkb)\s*$"


def unit_key(text):
    """Column: a unit's spelling in normal form, without its leading number; blank and '-' or '?' alone give null."""
    # Greek letters, superscripts and the middle dot as what they stand for
    t = F.trim(F.lower(F.translate(text, "\u03a9\u03c9\u2126\u03bc\u00b5\u00b3\u00b2\u00b7", "ooouu32 ")))
    t = F.regexp_replace(t, r"^\s*(?:\d+(?:\.\d*)?|\.\d+)\s*", "")
    t = F.regexp_replace(t, r"^\s*tenths?\s+of\s+(?:an?\s+)?", "")
    # the Greek letter stands for the word
    t = F.regexp_replace(t, r"^(k?)o(?=[\s.\-*]*c?m$)", "$1ohm")
    t = F.regexp_replace(t, r"[\s._\-*^]+", "")
    return F.when(~t.isin("", "?", "n/a", "na", "none", "null", "unknown", "unk"), t)


def unit_scale(text):
    """Column: the leading number of a unit ('0.1 in' is 0.1, 'tenths of an inch' is 0.1), 1 where there is none."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d*)?|\.\d+)", 1)
    return F.when(F.lower(text).rlike(r"^\s*tenths?\s+of\b"), F.lit(0.1)).otherwise(F.coalesce(F.when(number != "", number.try_cast("double")), F.lit(1.0)))


def text_unit(text):
    """Column: what a note names as the unit, as it stands there, or null."""
    found = [F.regexp_extract(text, p, 1) for p in TEXT_UNIT]
    return F.coalesce(*[F.when(x != "", F.regexp_replace(x, _DATUM, "")) for x in found])


def alias_table(spark: SparkSession) -> DataFrame:
    """``alias, unit, dimension, factor, offset``: one row a spelling; its size is that of the literal above."""
    rows = [(a, u, d, f, o) for u, (d, f, o, names) in UNITS.items() for a in dict.fromkeys(names.split())]
    return spark.createDataFrame(rows, "alias string, unit string, dimension string, factor double, offset double")
