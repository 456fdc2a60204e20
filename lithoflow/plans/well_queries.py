"""Queries on well-log curves and the SQL they are checked against.  Compared doubles are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import wells
from ..sources.tables import table


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, negative zero as zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on(f, *names, **kw):
    return lambda spark, d: rounded(f(*[table(spark, d, n) for n in names], **kw))


def _smooth(samples):
    s = wells.savgol(wells.series(samples))
    return wells.gradient(s, "smooth").select("curve_id", "idx", "smooth", "gradient")


QUERIES = {
    "las_trend_windows": _on(wells.trend_windows, "curve_samples"),
    "las_trend_windows_6": _on(wells.trend_windows, "curve_samples", size=6),
    "curve_quality": _on(wells.curve_quality, "curve_samples"),
    "depth_stats": _on(wells.depth_stats, "curve_samples"),
    "quality_report": _on(wells.quality_report, "curve_samples"),
    "mnemonic_type": lambda spark, d: table(spark, d, "curves").select("curve_id", wells.curve_type(F.col("mnemonic")).alias("kind")),
    "primary_curves": _on(wells.primary_curves, "curves"),
    "savgol_gradient": _on(_smooth, "curve_samples"),
    "detect_gradient": _on(wells.detect_gradient, "curve_samples"),
    "detect_correlation": _on(wells.detect_correlation, "curve_samples"),
    "detect_statistical": _on(wells.detect_statistical, "curve_samples"),
    "deoverlap_patterns": lambda spark, d: rounded(wells.resolve_overlaps(wells.patterns(table(spark, d, "curve_samples")))),
    "pattern_summary": lambda spark, d: rounded(wells.pattern_summary(wells.resolve_overlaps(wells.patterns(table(spark, d, "curve_samples"))))),
    "systems_tracts": lambda spark, d: rounded(wells.systems_tracts(wells.resolve_overlaps(wells.patterns(table(spark, d, "curve_samples"))))),
    "log_summary": _on(wells.log_summary, "curve_samples"),
    "log_summary_units": _on(wells.log_summary, "curve_samples", units=True),
}

_READINGS = """
r AS (SELECT well_id, curve_id, mnemonic, idx, depth, CASE WHEN NOT (isnan(value) OR isinf(value) OR value IN (-999.25, -9999)) THEN value END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY curve_id, idx ORDER BY loaded_at DESC, value DESC NULLS LAST) AS rn FROM curve_samples) WHERE rn = 1)"""
_SERIES = _READINGS + """,
s AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY curve_id) AS n FROM r WHERE v IS NOT NULL)"""
_SMOOTH = _SERIES + """,
sm AS (SELECT *, CASE WHEN n < 5 THEN v
    WHEN i = 0 THEN (31 * v + 9 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w - 5 * lead(v, 3) OVER w + 3 * lead(v, 4) OVER w) / 35.0
    WHEN i = 1 THEN (9 * lag(v, 1) OVER w + 13 * v + 12 * lead(v, 1) OVER w + 6 * lead(v, 2) OVER w - 5 * lead(v, 3) OVER w) / 35.0
    WHEN i = n - 2 THEN (-5 * lag(v, 3) OVER w + 6 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 13 * v + 9 * lead(v, 1) OVER w) / 35.0
    WHEN i = n - 1 THEN (3 * lag(v, 4) OVER w - 5 * lag(v, 3) OVER w - 3 * lag(v, 2) OVER w + 9 * lag(v, 1) OVER w + 31 * v) / 35.0
    ELSE (-3 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 17 * v + 12 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w) / 35.0 END AS smooth
  FROM s WINDOW w AS (PARTITION BY curve_id ORDER BY i)),
ga AS (SELECT *, lag(smooth) OVER w AS b, lead(smooth) OVER w AS a, depth - lag(depth) OVER w AS hs, lead(depth) OVER w - depth AS hd
  FROM sm WINDOW w AS (PARTITION BY curve_id ORDER BY i)),
gr AS (SELECT *, CASE WHEN b IS NULL AND a IS NULL THEN NULL
    WHEN b IS NULL THEN CASE WHEN hd <> 0 THEN (a - smooth) / hd END
    WHEN a IS NULL THEN CASE WHEN hs <> 0 THEN (smooth - b) / hs END
    WHEN hs * hd * (hs + hd) <> 0 THEN (hs * hs * a + (hd * hd - hs * hs) * smooth - hd * hd * b) / (hs * hd * (hs + hd)) END AS g FROM ga)"""


def _hop(source: str, size: str) -> str:
    return f"""
h AS (SELECT *, CAST({size} AS BIGINT) AS w FROM {source}),
x AS (SELECT h.*, u.k, i - u.k * (w // 2) AS pos FROM h, LATERAL (
  SELECT unnest(generate_series(greatest(0, CAST(ceil((i - w + 1) / (w // 2)) AS BIGINT)), least(i // (w // 2), CAST(ceil((n - w) / (w // 2)) AS BIGINT) - 1))) AS k) u)"""


def _trend(size: int) -> str:
    return f"""WITH {_SERIES},{_hop("s", str(size))},
g AS (SELECT curve_id, k, min(depth) AS ds, max(depth) AS de, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sd, regr_slope(v, pos) AS sl, regr_r2(v, pos) AS r2 FROM x GROUP BY curve_id, k),
c AS (SELECT *, sl / (hi - lo + 1e-10) AS rel FROM g),
t AS (SELECT *, CASE WHEN abs(rel) < 0.1 THEN 'boxcar' WHEN rel < -0.1 THEN 'funnel' WHEN rel > 0.1 THEN 'bell' ELSE 'irregular' END AS type FROM c)
SELECT curve_id, k, type, round(ds, 6) AS depth_start, round(de, 6) AS depth_end, round(de - ds, 6) AS thickness, round(lo, 6) + 0.0 AS data_min, round(hi, 6) + 0.0 AS data_max,
  round(CASE WHEN type IN ('funnel', 'bell') THEN least(greatest(CASE WHEN hi = lo THEN 0 ELSE r2 END, 0), 1) ELSE least(greatest(1 - sd / (m + 1e-10), 0), 1) END, 6) AS confidence FROM t"""


_QUALITY = _READINGS + """,
q0 AS (SELECT curve_id, any_value(well_id) AS well_id, any_value(mnemonic) AS mnemonic, count(*) AS n, count(v) AS valid, max(v) - min(v) AS span FROM r GROUP BY curve_id),
q AS (SELECT *, 0.8::DOUBLE * valid / n + 0.2::DOUBLE * CASE WHEN span IS NULL THEN 0 ELSE least(span / 100, 1) END AS quality, 100.0::DOUBLE * (n - valid) / n AS missing FROM q0)"""
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(upper(mnemonic), '{'|'.join(names)}') THEN '{kind}'" for kind, names in vocab.CURVE_TYPES.items()) + " END"


def _one(x: str) -> str:
    """``x`` with one place, halves away from zero."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 6)), 1) AS VARCHAR)"


_OUT = "curve_id, k, method, type, round(start_depth, 6) AS start_depth, round(end_depth, 6) AS end_depth, round(end_depth - start_depth, 6) AS thickness, round(confidence, 6) AS confidence"

_DETECT = {
    "gradient": (
        _hop("(SELECT * FROM gr WHERE n >= 10)", "greatest(10, n // 20)"),
        "avg(g) AS m, stddev_pop(g) AS sd",
        """SELECT *, 'gradient' AS method, CASE WHEN abs(m) > 0.1 AND c > 0.3 AND m > 0 THEN 'funnel' WHEN abs(m) > 0.1 AND c > 0.3 THEN 'bell' WHEN sd < 0.5 THEN 'boxcar' ELSE 'irregular' END AS type,
  CASE WHEN abs(m) > 0.1 AND c > 0.3 THEN raw WHEN sd < 0.5 THEN greatest(raw, 60) ELSE greatest(raw, 40) END AS confidence
  FROM (SELECT *, least(greatest(100 * c, 0), 100) AS raw FROM (SELECT *, 1 - sd / (abs(m) + 1e-6) AS c FROM {g}))""",
    ),
    "correlation": (
        _hop("(SELECT * FROM s WHERE n >= 10)", "greatest(15, n // 15)"),
        "regr_sxy(v, depth) AS sxy, regr_sxx(v, depth) AS sxx, regr_syy(v, depth) AS syy, stddev_pop(v) AS sd, max(v) - min(v) AS span",
        """SELECT *, 'correlation' AS method, CASE WHEN r >= flat THEN 'funnel' ELSE 'boxcar' END AS type, least(greatest(100 * greatest(r, flat), 0), 100) AS confidence
  FROM (SELECT *, CASE WHEN sxx * syy > 0 THEN abs(sxy / sqrt(sxx * syy)) ELSE 0 END AS r, 1 - sd / (span + 1e-6) AS flat FROM {g}) WHERE least(greatest(100 * greatest(r, flat), 0), 100) > 30""",
    ),
    "statistical": (
        _hop("(SELECT * FROM s WHERE n >= 10)", "greatest(12, n // 12)"),
        "avg(v) AS m, stddev_pop(v) AS sd, regr_slope(v, pos) AS sl, count(*) AS c, sum(v) AS s1, sum(v * v) AS s2, sum(v * v * v) AS s3, list(v) AS vs",
        """SELECT *, 'statistical' AS method, CASE WHEN cv < 0.15 THEN 'boxcar' WHEN abs(sl) > 0.1 * sd AND sl > 0 THEN 'funnel' WHEN abs(sl) > 0.1 * sd THEN 'bell' ELSE 'irregular' END AS type,
  CASE WHEN cv < 0.15 THEN least(greatest((1 - cv) * 100, 60), 90) WHEN abs(sl) > 0.1 * sd THEN least(greatest(abs(sl) / sd * 50, 40), 85) WHEN sk > 1 THEN least(greatest(sk * 30, 30), 70) ELSE 50 END AS confidence
  FROM (SELECT *, sd / (abs(m) + 1e-6) AS cv, CASE WHEN sd > 0 THEN abs(list_sum(list_transform(vs, lambda y: (y - m) ** 3)) / c / sd ** 3) ELSE 0 END AS sk FROM {g})""",
    ),
}


def _detector(name: str, prefix: str = "") -> str:
    """CTEs ``{prefix}p`` with the patterns of one detector, after the CTEs of the series."""
    hop, aggs, select = _DETECT[name]
    hop = hop.replace("\nh AS", f"\n{prefix}h AS").replace("\nx AS", f"\n{prefix}x AS").replace("h.*", f"{prefix}h.*").replace("FROM h,", f"FROM {prefix}h,")
    g = f"{prefix}g AS (SELECT * FROM (SELECT curve_id, k, min(depth) AS start_depth, max(depth) AS end_depth, {aggs} FROM {prefix}x GROUP BY curve_id, k) WHERE end_depth - start_depth >= 5)"
    return f"{hop},\n{g},\n{prefix}p AS ({select.format(g=prefix + 'g')})"


_ALL = f"""WITH RECURSIVE {_SMOOTH},{_detector("gradient", "a")},{_detector("correlation", "b")},{_detector("statistical", "c")},
pt AS (SELECT curve_id, k, method, type, start_depth, end_depth, confidence, 0 AS o FROM ap UNION ALL SELECT curve_id, k, method, type, start_depth, end_depth, confidence, 1 FROM bp
  UNION ALL SELECT curve_id, k, method, type, start_depth, end_depth, confidence, 2 FROM cp),
l AS (SELECT curve_id, list(struct_pack(k := k, method := method, type := type, s := start_depth, e := end_depth, confidence := confidence) ORDER BY -round(confidence, 6), o, k) AS a FROM pt GROUP BY curve_id),
f AS (SELECT curve_id, list_reduce(list_transform(a, lambda y: [y]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: NOT (y[1].e <= z.s OR y[1].s >= z.e))) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM l),
d AS (SELECT curve_id, u.p.k AS k, u.p.method AS method, u.p.type AS type, u.p.s AS start_depth, u.p.e AS end_depth, u.p.confidence AS confidence FROM f, LATERAL (SELECT unnest(kept) AS p) u)
"""

ORACLE_SQL = {
    "las_trend_windows": _trend(20),
    "las_trend_windows_6": _trend(6),
    "curve_quality": f"WITH {_QUALITY} SELECT curve_id, n, valid, round(quality, 6) AS quality, round(missing, 6) AS missing_pct FROM q",
    "depth_stats": f"""WITH {_READINGS}, t AS (SELECT *, depth - lag(depth) OVER (PARTITION BY curve_id ORDER BY idx) AS step FROM r)
SELECT curve_id, round(min(depth), 6) AS depth_min, round(max(depth), 6) AS depth_max, round(median(step) FILTER (step > 0), 6) AS step FROM t GROUP BY curve_id""",
    "quality_report": f"""WITH {_QUALITY}, k AS (SELECT curve_id, max(CASE WHEN {_TYPE} = 'GR' THEN 1 ELSE 0 END) AS gr FROM r GROUP BY curve_id),
a AS (SELECT well_id, avg(quality) AS o, count(*) AS curves, count(*) FILTER (quality < 0.5) AS poor, count(*) FILTER (missing > 20) AS gappy, max(gr) AS gr FROM q JOIN k USING (curve_id) GROUP BY well_id)
SELECT well_id, round(o, 6) AS overall, curves, CASE WHEN o > 0.8 THEN 'Excellent' WHEN o > 0.6 THEN 'Good' WHEN o > 0.4 THEN 'Fair' ELSE 'Poor' END AS label,
  concat_ws('; ', CASE WHEN poor > 0 THEN poor || ' curves of low quality' END, CASE WHEN gappy > 0 THEN gappy || ' curves with many readings missing' END, CASE WHEN gr = 0 THEN 'no gamma ray curve' END, CASE WHEN curves < 3 THEN 'fewer than three curves' END) AS notes FROM a""",
    "mnemonic_type": f"SELECT curve_id, {_TYPE} AS kind FROM curves",
    "primary_curves": f"""WITH k AS (SELECT *, {_TYPE} AS kind FROM curves), o AS (SELECT *, row_number() OVER (PARTITION BY well_id, kind ORDER BY curve_id DESC) AS rn FROM k
  WHERE kind IS NOT NULL AND upper(trim(mnemonic, ' ')) NOT IN ('DEPT', 'DEPTH', 'MD', 'MDEPTH'))
SELECT well_id, kind, curve_id, row_number() OVER (PARTITION BY well_id ORDER BY CASE WHEN kind = 'GR' THEN 0 ELSE 1 END, curve_id) = 1 AS is_primary FROM o WHERE rn = 1""",
    "savgol_gradient": f"WITH {_SMOOTH} SELECT curve_id, idx, round(smooth, 6) + 0.0 AS smooth, round(g, 6) + 0.0 AS gradient FROM gr",
    "detect_gradient": f"WITH {_SMOOTH},{_detector('gradient')} SELECT {_OUT} FROM p",
    "detect_correlation": f"WITH {_SERIES},{_detector('correlation')} SELECT {_OUT} FROM p",
    "detect_statistical": f"WITH {_SERIES},{_detector('statistical')} SELECT {_OUT} FROM p",
    "deoverlap_patterns": f"{_ALL} SELECT {_OUT} FROM d",
    "pattern_summary": f"{_ALL} SELECT type, count(*) AS n, round(avg(end_depth - start_depth), 6) AS mean_thickness, round(sum(end_depth - start_depth), 6) AS total_thickness, round(avg(confidence), 6) AS mean_confidence FROM d GROUP BY type",
    "systems_tracts": f"{_ALL} SELECT {_OUT}, CASE type WHEN 'funnel' THEN 'LST/Forced Regression' WHEN 'bell' THEN 'TST' ELSE 'HST/LST Channel' END AS tract FROM d WHERE type IN ('funnel', 'bell', 'boxcar')",
    "log_summary": f"""WITH {_QUALITY} SELECT curve_id, format('{{}}: {{}} to {{}} (avg: {{}})', coalesce(max(r.mnemonic), ''), {_one('min(v)')}, {_one('max(v)')}, {_one('avg(v)')}) AS line
FROM r JOIN (SELECT curve_id FROM q WHERE quality > 0.7) USING (curve_id) GROUP BY curve_id HAVING min(v) IS NOT NULL""",
    "log_summary_units": f"""WITH {_QUALITY}, u AS (SELECT curve_id, max(unit) AS unit FROM curve_samples GROUP BY curve_id),
s AS (SELECT curve_id, format('{{}}: {{}} to {{}} (avg: {{}})', coalesce(max(r.mnemonic), ''), {_one('min(v)')}, {_one('max(v)')}, {_one('avg(v)')}) AS line
FROM r JOIN (SELECT curve_id FROM q WHERE quality > 0.7) USING (curve_id) GROUP BY curve_id HAVING min(v) IS NOT NULL)
SELECT curve_id, rtrim(line || ' ' || coalesce(trim(unit, ' '), ''), ' ') AS line FROM s LEFT JOIN u USING (curve_id)""",
}
