"""Queries on depth intervals."""

from ..operators import intervals
from ..sources.tables import table

QUERIES = {"p7_found": lambda spark, d: intervals.found(table(spark, d, "interpretations"), table(spark, d, "log_runs"))}

ORACLE_SQL = {
    "p7_found": """
WITH i AS (
  SELECT 'interpretation' AS src, well_id, CAST(round(least(depth_top, depth_base) * 100) AS BIGINT) AS a, CAST(round(greatest(depth_top, depth_base) * 100) AS BIGINT) AS b
  FROM interpretations WHERE depth_top IS NOT NULL AND depth_base IS NOT NULL
  UNION ALL
  SELECT 'run', well_id, CAST(round(least(depth_min, depth_max) * 100) AS BIGINT), CAST(round(greatest(depth_min, depth_max) * 100) AS BIGINT)
  FROM log_runs WHERE depth_min IS NOT NULL AND depth_max IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY src, well_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY src, well_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT src, well_id, min(a) AS s, max(b) AS e FROM g GROUP BY src, well_id, k),
n AS (SELECT *, lead(s) OVER (PARTITION BY src, well_id ORDER BY s) AS nx FROM p)
SELECT src, well_id, 'period' AS piece, s AS start_cm, e AS end_cm FROM n
UNION ALL SELECT src, well_id, 'gap', e, nx FROM n WHERE nx IS NOT NULL
""",
}
