"""Queries on implausible readings and scores, and the SQL they are checked against."""

from __future__ import annotations

from math import log

from ..operators import spikes as s
from ..sources.tables import table
from . import unit_queries as uq

QUERIES = {"p5_found": lambda spark, d: s.found(*[table(spark, d, n) for n in ("curve_samples", "curves", "mnemonic_ref")])}


# The SQL decides another way, by the size of a curve's usual change alone: between so many times of it.
_CUTOFF = (6.5, 8.0)


def _windows(f: str) -> list[str]:
    return [f"{f}(v) OVER (PARTITION BY curve_id, st ORDER BY idx ROWS BETWEEN {k} PRECEDING AND {s.REACH - k} FOLLOWING)" for k in range(s.REACH + 1)]


def _rank(source: str, value: str, name: str, *quantiles: float) -> str:
    """A CTE with values of each curve at the ranks of some quantiles."""
    picked = ", ".join(f"max(CASE WHEN rn = greatest(CAST(ceil({q!r}::DOUBLE * n) AS BIGINT), 1) THEN x END) AS q{i}" for i, q in enumerate(quantiles))
    return f"{name} AS (SELECT curve_id, max(n) AS n, {picked} FROM (SELECT curve_id, {value} AS x, row_number() OVER (PARTITION BY curve_id ORDER BY {value}) AS rn, count(*) OVER (PARTITION BY curve_id) AS n FROM {source}) GROUP BY curve_id)"


_LIMITS = ", ".join(f"('{unit}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for unit, (lo, hi) in s.LIMITS.items())

ORACLE_SQL = {
    "p5_found": f"""WITH {uq.ENTRY},
alias AS (SELECT * FROM (VALUES {uq._ALIASES}) AS x(alias, unit, dim, f, o)),
cu AS (SELECT c.curve_id, c.unit AS un, c.description AS note, k.common_unit AS common FROM curves c JOIN known k USING (curve_id)),
ck AS (SELECT *, {uq._key("un")} AS uk, {uq._noted("note")} AS nt, {uq._key("common")} AS ck FROM cu),
cl AS (SELECT ck.*, {uq._key("nt")} AS nk FROM ck),
cf AS (SELECT curve_id, common, CASE WHEN a.unit IS NOT NULL THEN a.dim WHEN n.unit IS NOT NULL THEN n.dim ELSE c.dim END AS dim, c.dim AS cd, CASE WHEN a.unit IS NOT NULL THEN a.f WHEN n.unit IS NOT NULL THEN n.f ELSE c.f END / c.f AS factor
  FROM cl LEFT JOIN alias a ON a.alias = cl.uk LEFT JOIN alias n ON n.alias = cl.nk LEFT JOIN alias c ON c.alias = cl.ck),
lim AS (SELECT curve_id, min(lo / factor) AS lo, max(hi / factor) AS hi FROM cf JOIN (VALUES {_LIMITS}) AS x(common, lo, hi) USING (common) WHERE dim = cd GROUP BY curve_id),
r AS (SELECT curve_id, idx, arg_max(value, loaded_at) AS v FROM curve_samples WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AND value NOT IN (-999.25, -9999) GROUP BY curve_id, idx),
g AS (SELECT *, lag(idx) OVER w AS pi, lag(v) OVER w AS pv FROM r WINDOW w AS (PARTITION BY curve_id ORDER BY idx)),
t AS (SELECT *, sum(CASE WHEN pi IS NULL OR idx - pi > {s.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY curve_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS st, CASE WHEN idx - pi <= {s.GAP} THEN abs(v - pv) END AS ch FROM g),
e AS (SELECT *, greatest(v - greatest({", ".join(_windows("min"))}), least({", ".join(_windows("max"))}) - v) AS off, sum(CASE WHEN ch = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY curve_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM t),
{_rank("(SELECT * FROM e WHERE ch > 0)", "ch", "uc", 0.5, 0.75)},
{_rank("e", "off", "oc", s.TAIL, (1 + s.TAIL) / 2)},
cut AS (SELECT curve_id, least(greatest(oc.q0 + (oc.q1 - oc.q0) / {log(2)!r} * {log((1 - s.TAIL) / s.RISK)!r}, {_CUTOFF[0]} * greatest(uc.q0, uc.q1 / 1.7::DOUBLE)), {_CUTOFF[1]}::DOUBLE * greatest(uc.q0, uc.q1 / 1.7::DOUBLE)) AS cutoff FROM oc JOIN uc USING (curve_id) WHERE uc.n >= {s.LEAST_CHANGES}),
z AS (SELECT e.*, count(*) OVER (PARTITION BY curve_id, run) AS len FROM e),
q AS (SELECT curve_id, run_id, quality_score AS q FROM curves WHERE quality_score IS NOT NULL AND NOT isnan(quality_score)),
mid AS (SELECT run_id, quantile_disc(q, 0.5) AS mid FROM q WHERE q BETWEEN 0 AND 1 AND run_id IS NOT NULL GROUP BY run_id HAVING count(*) >= 3),
qo AS (SELECT curve_id, abs(q - mid) AS off FROM q JOIN mid USING (run_id) WHERE q BETWEEN 0 AND 1),
qt AS (SELECT quantile_disc(off, {s.TAIL}) AS a, quantile_disc(off, {(1 + s.TAIL) / 2}) AS b FROM qo)
SELECT 'reading' AS rec, curve_id, idx FROM z LEFT JOIN lim USING (curve_id) LEFT JOIN cut USING (curve_id) WHERE len >= {s.STUCK} OR v < lo OR v > hi OR off > cutoff
UNION ALL (SELECT 'score', curve_id, -1 FROM q WHERE q < 0 OR q > 1 UNION SELECT 'score', curve_id, -1 FROM qo, qt WHERE off > a + (b - a) / {log(2)!r} * {log((1 - s.TAIL) / s.RISK)!r})
""",
}
