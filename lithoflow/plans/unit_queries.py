"""Queries on units and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..operators import unit_conversion as u
from ..sources.tables import table


def _tables(spark, d, *names):
    return [table(spark, d, n) for n in names]


QUERIES = {
    "p2_found": lambda spark, d: u.found(*_tables(spark, d, "log_runs", "curves", "mnemonic_ref")),
    "p2_samples": lambda spark, d: u.samples_in_common_units(*_tables(spark, d, "curve_samples", "curves", "log_runs", "mnemonic_ref")).select(
        "curve_id", "idx", F.unix_micros("loaded_at").alias("loaded_us"), "ref_id", "common_unit", "depth_m", "common_value"
    ),
}

_NUMBER = r"(\d+(?:\.\d*)?|\.\d+)"
_UNKNOWN = "('', '?', 'n/a', 'na', 'none', 'null', 'unknown', 'unk')"


def _key(x: str) -> str:
    t = f"trim(lower(translate({x}, 'Ωω' || chr(8486) || 'μµ³²·', 'ooouu32 ')), ' ')"
    t = f"regexp_replace(regexp_replace({t}, '^\\s*{_NUMBER}\\s*', ''), '^\\s*tenths?\\s+of\\s+(?:an?\\s+)?', '')"
    return f"regexp_replace(regexp_replace({t}, '^(k?)o([\\s.\\-*]*c?m)$', '\\1ohm\\2'), '[\\s._\\-*^]+', '', 'g')"


def _scale(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower({x}), '^\\s*tenths?\\s+of\\b') THEN 0.1::DOUBLE ELSE coalesce(TRY_CAST(nullif(regexp_extract({x}, '^\\s*{_NUMBER}', 1), '') AS DOUBLE), 1) END"


def _noted(x: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({x}, '{p}', 1), '')" for p in units.TEXT_UNIT)
    return f"regexp_replace(coalesce({found}), '(?i)\\s+(?:md|tvd|tvdss|below\\s+kb|below\\s+rt|rkb)\\s*$', '')"


_ALIASES = ", ".join("('{}', '{}', '{}', {!r}::DOUBLE, {!r}::DOUBLE)".format(a.replace("'", "''"), unit, dim, f, o) for unit, (dim, f, o, names) in units.UNITS.items() for a in dict.fromkeys(names.split()))
_SKELETON = "'^' || regexp_replace({}, '(.)', '\\1.*', 'g')"
_WORD = f"""CASE WHEN t = w THEN 0 WHEN length(t) >= 3 AND starts_with(w, t) THEN 0.3 WHEN length(t) >= 3 AND regexp_matches(w, {_SKELETON.format("t")}) THEN 0.6
  WHEN d <= 2 AND length(w) >= 4 AND list_sort(string_split(t, '')) = list_sort(string_split(w, '')) THEN 1 WHEN length(t) < 4 AND length(w) > 3 THEN 99
  WHEN d <= 1 OR (length(w) >= 6 AND d <= 2) OR (length(w) >= 9 AND d <= 3) THEN d WHEN length(t) >= 3 AND levenshtein(t, substring(w, 1, length(t))) <= 1 THEN 1.3 ELSE 99 END::DOUBLE"""

#: CTEs: ``entry(typed, by_code, by_title)`` of each typed text, and ``known(curve_id, common_unit)``.
ENTRY = rf"""
ref AS (SELECT ref_id, upper(code) AS code, common_unit, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x NOT IN ('', 'log', 'curve')) AS words FROM mnemonic_ref),
typed AS (SELECT DISTINCT typed FROM (SELECT mnemonic AS typed FROM curves UNION ALL SELECT name FROM curves) WHERE typed IS NOT NULL),
tok AS (SELECT typed, list_filter(regexp_split_to_array(upper(typed), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS tokens,
  list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(lower(typed), '[^\p{{L}}\p{{N}}()]+', ' ', 'g'), '\(\s*run\s*\d+\s*\)|\b(?:log|curve|run\s*\d+|final)\b', ' ', 'g'), '[()]', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM typed),
code AS (SELECT typed, min(ref_id) AS id FROM tok, ref WHERE list_contains(tokens, code) OR (len(tokens) > 1 AND list_max(list_transform(tokens, lambda x: length(x))) = 1 AND array_to_string(tokens, '') = code) GROUP BY typed HAVING count(*) = 1),
pair AS (SELECT typed, ref_id, t.words AS a, r.words AS b, array_to_string(t.words, '') AS fa, array_to_string(r.words, '') AS fb FROM tok t, ref r WHERE len(t.words) > 0),
word AS (SELECT typed, ref_id, sum({_WORD}) AS c FROM (SELECT typed, ref_id, t, w, levenshtein(t, w) AS d FROM (SELECT typed, ref_id, unnest(a) AS t, unnest(b) AS w FROM pair WHERE len(a) = len(b))) GROUP BY typed, ref_id),
cost AS (SELECT p.typed, p.ref_id, fa, least(coalesce(word.c, 99), CASE WHEN levenshtein(fa, fb) <= greatest(1, length(fb) * CASE WHEN length(fb) >= 20 THEN 0.32 ELSE 0.2 END::DOUBLE) THEN levenshtein(fa, fb)
  WHEN regexp_matches(fb, {_SKELETON.format("fa")}) AND length(fa) >= length(fb) * 0.5 THEN 2 ELSE 99 END) AS c FROM pair p LEFT JOIN word USING (typed, ref_id)),
title AS (SELECT typed, ref_id AS id FROM cost WHERE length(fa) >= 3 QUALIFY row_number() OVER (PARTITION BY typed ORDER BY c, ref_id) = 1 AND c < 9),
known AS (SELECT c.curve_id, ref.common_unit FROM curves c LEFT JOIN code cm ON cm.typed = c.mnemonic LEFT JOIN title tm ON tm.typed = c.mnemonic LEFT JOIN code cn ON cn.typed = c.name LEFT JOIN title tn ON tn.typed = c.name
  JOIN ref ON ref.ref_id = coalesce(cm.id, tm.id, cn.id, tn.id))"""

ORACLE_SQL = {
    "p2_found": f"""WITH {ENTRY},
alias AS (SELECT * FROM (VALUES {_ALIASES}) AS x(alias, unit, dim, f, o)),
q AS (SELECT 'run_step' AS quantity, run_id AS rec_id, depth_interval AS v, depth_unit AS un, header_note AS note, 'm' AS common, 10000 AS per FROM log_runs
  UNION ALL SELECT 'curve_start', curve_id, depth_start, depth_unit, header_note, 'm', 100 FROM curves LEFT JOIN log_runs USING (run_id)
  UNION ALL SELECT 'curve_stop', curve_id, depth_stop, depth_unit, header_note, 'm', 100 FROM curves LEFT JOIN log_runs USING (run_id)
  UNION ALL SELECT 'check_value', curve_id, check_value, unit, description, common_unit, 1000 FROM curves JOIN known USING (curve_id)),
k AS (SELECT *, CASE WHEN {_key("un")} NOT IN {_UNKNOWN} THEN {_key("un")} END AS uk, {_scale("un")} AS us, {_noted("note")} AS nt FROM q WHERE v IS NOT NULL AND NOT isnan(v)),
l AS (SELECT k.*, CASE WHEN {_key("nt")} NOT IN {_UNKNOWN} THEN {_key("nt")} END AS nk, {_scale("nt")} AS ns, {_key("common")} AS ck FROM k),
j AS (SELECT l.quantity, l.rec_id, l.v, l.per, c.unit AS cu, c.dim AS cd, c.f AS cf, CASE WHEN a.unit IS NOT NULL THEN a.unit WHEN n.unit IS NOT NULL THEN n.unit ELSE c.unit END AS unit,
  CASE WHEN a.unit IS NOT NULL THEN a.dim WHEN n.unit IS NOT NULL THEN n.dim ELSE c.dim END AS dim, CASE WHEN a.unit IS NOT NULL THEN a.f WHEN n.unit IS NOT NULL THEN n.f ELSE c.f END AS f,
  CASE WHEN a.unit IS NOT NULL THEN us WHEN n.unit IS NOT NULL THEN ns ELSE 1 END AS sc FROM l LEFT JOIN alias a ON a.alias = l.uk LEFT JOIN alias n ON n.alias = l.nk LEFT JOIN alias c ON c.alias = l.ck)
SELECT DISTINCT quantity, rec_id, CAST(round(v * (f * sc / cf) * per) AS BIGINT) AS common_value FROM j WHERE NOT (unit = cu AND sc = 1) AND dim = cd
""",
    "p2_samples": f"""WITH {ENTRY},
alias AS (SELECT * FROM (VALUES {_ALIASES}) AS x(alias, unit, dim, f, o)),
e AS (SELECT c.curve_id, c.run_id, c.unit, c.description, coalesce(cm.id, tm.id, cn.id, tn.id, 0) AS ref_id FROM curves c
  LEFT JOIN code cm ON cm.typed = c.mnemonic LEFT JOIN title tm ON tm.typed = c.mnemonic LEFT JOIN code cn ON cn.typed = c.name LEFT JOIN title tn ON tn.typed = c.name),
q AS (SELECT curve_id, 'depth' AS what, depth_unit AS un, header_note AS note, 'm' AS common FROM e LEFT JOIN log_runs USING (run_id)
  UNION ALL SELECT curve_id, 'value', unit, description, common_unit FROM e LEFT JOIN mnemonic_ref USING (ref_id)),
k AS (SELECT *, CASE WHEN {_key("un")} NOT IN {_UNKNOWN} THEN {_key("un")} END AS uk, {_scale("un")} AS us, {_noted("note")} AS nt, {_key("common")} AS ck FROM q),
l AS (SELECT *, CASE WHEN {_key("nt")} NOT IN {_UNKNOWN} THEN {_key("nt")} END AS nk, {_scale("nt")} AS ns FROM k),
j AS (SELECT l.curve_id, l.what, c.unit AS cu, c.dim AS cd, c.f AS cf, c.o AS co, CASE WHEN a.unit IS NOT NULL THEN a.unit WHEN n.unit IS NOT NULL THEN n.unit ELSE c.unit END AS unit,
  CASE WHEN a.unit IS NOT NULL THEN a.dim WHEN n.unit IS NOT NULL THEN n.dim ELSE c.dim END AS dim, CASE WHEN a.unit IS NOT NULL THEN a.f WHEN n.unit IS NOT NULL THEN n.f ELSE c.f END AS f,
  CASE WHEN a.unit IS NOT NULL THEN a.o WHEN n.unit IS NOT NULL THEN n.o ELSE c.o END AS o, CASE WHEN a.unit IS NOT NULL THEN us WHEN n.unit IS NOT NULL THEN ns ELSE 1 END AS sc
  FROM l LEFT JOIN alias a ON a.alias = l.uk LEFT JOIN alias n ON n.alias = l.nk LEFT JOIN alias c ON c.alias = l.ck),
r AS (SELECT curve_id, what, CASE WHEN dim = cd THEN CASE WHEN unit = cu AND sc = 1 THEN 1::DOUBLE ELSE f * sc / cf END END AS f, CASE WHEN dim = cd THEN CASE WHEN unit = cu AND sc = 1 THEN 0::DOUBLE ELSE (o - co) / cf END END AS o FROM j)
SELECT s.curve_id, s.idx, epoch_us(s.loaded_at) AS loaded_us, e.ref_id, m.common_unit, s.depth * d.f + d.o AS depth_m, s.value * v.f + v.o AS common_value
FROM curve_samples s LEFT JOIN e USING (curve_id) LEFT JOIN mnemonic_ref m USING (ref_id) LEFT JOIN r d ON d.curve_id = s.curve_id AND d.what = 'depth' LEFT JOIN r v ON v.curve_id = s.curve_id AND v.what = 'value'
""",
}
