"""Queries and SQL of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.operators.rolling import activity, rolling_totals
from nichelens.session import table


def p1_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's and day's total and average over the trailing 7 and 30 days."""
    r = rolling_totals(activity(table(spark, d, "chunk_texts"), table(spark, d, "ranked_scores")))
    return r.select("entity_kind", "entity_key", F.col("day").cast("string").alias("day_utc"), "total", "total_7", F.round("avg_7", 6).alias("avg_7"), "total_30", F.round("avg_30", 6).alias("avg_30"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Silent weeks inside an active month, between an entity's first and last day with a total above 0."""
    r = rolling_totals(activity(table(spark, d, "chunk_texts"), table(spark, d, "ranked_scores")), active_bounds=True)
    return r.where("total_7 = 0 and total_30 > 0").select("entity_kind", "entity_key", F.col("day").cast("string").alias("day_utc"))


_DAILY = """
WITH ev AS (
  SELECT 'source' k, source_id e, CAST(ts AT TIME ZONE 'UTC' AS DATE) d, 1 n FROM (SELECT DISTINCT id, source_id, ts FROM chunk_texts)
  UNION ALL SELECT 'category', category, CAST(scored_at AT TIME ZONE 'UTC' AS DATE), coalesce(mentions, 0) FROM (SELECT DISTINCT * FROM ranked_scores)
  UNION ALL SELECT 'candidate', CAST(candidate_id AS VARCHAR), CAST(scored_at AT TIME ZONE 'UTC' AS DATE), coalesce(mentions, 0) FROM (SELECT DISTINCT * FROM ranked_scores)),
daily AS (SELECT k, e, d, sum(n) t FROM ev WHERE d IS NOT NULL AND e IS NOT NULL GROUP BY ALL),
bounds AS (SELECT k, e, min(d) a, max(d) b FROM daily {where} GROUP BY ALL),
cal AS (SELECT k, e, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) d FROM bounds),
full_days AS (SELECT coalesce(c.k, y.k) k, coalesce(c.e, y.e) e, coalesce(c.d, y.d) d, coalesce(t, 0) t, c.d IS NOT NULL shown
  FROM cal c FULL JOIN daily y ON c.k = y.k AND c.e = y.e AND c.d = y.d),
rolled AS (SELECT *, sum(t) OVER (PARTITION BY k, e ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) t7,
  sum(t) OVER (PARTITION BY k, e ORDER BY d RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) t30 FROM full_days)
"""

QUERIES = {"p1_rolling_totals": p1_rolling_totals, "p1_found": p1_found}
SQL = {
    "p1_rolling_totals": _DAILY.format(where="")
    + """SELECT k AS entity_kind, e AS entity_key, CAST(d AS VARCHAR) AS day_utc, CAST(t AS BIGINT) AS total, CAST(t7 AS BIGINT) AS total_7,
  round(t7 / 7.0::DOUBLE, 6) AS avg_7, CAST(t30 AS BIGINT) AS total_30, round(t30 / 30.0::DOUBLE, 6) AS avg_30 FROM rolled WHERE shown""",
    "p1_found": _DAILY.format(where="WHERE t > 0") + "SELECT k AS entity_kind, e AS entity_key, CAST(d AS VARCHAR) AS day_utc FROM rolled WHERE shown AND t7 = 0 AND t30 > 0",
}
