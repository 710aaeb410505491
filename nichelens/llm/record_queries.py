"""Queries and SQL of problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.llm.format_dups import collapse_formats, repeated_records
from nichelens.llm.top_n import top_n
from nichelens.session import table

FIELDS = ["phrase", "category"]


def p2_format_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each kind of record once, with its number of copies."""
    return collapse_formats(table(spark, d, "extracted_products"), "product_id", FIELDS, "record")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_records(table(spark, d, "extracted_products"), "product_id", FIELDS, "record").withColumnRenamed("id", "product_id")


def p3_top_ten(spark: SparkSession, d: str) -> DataFrame:
    """The ten best candidates of each run and category, with their score."""
    return top_n(table(spark, d, "ranked_scores"), ["run_id", "category"], "candidate_id", "mgs")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    r = top_n(table(spark, d, "ranked_scores"), ["run_id", "category"], "candidate_id", "mgs")
    return r.select("run_id", "category", F.col("rank_no").cast("int").alias("rank_no"), "candidate_id")


_KIND = """
WITH r AS (SELECT product_id,
    coalesce(phrase, CASE WHEN ltrim(record) LIKE '{%' THEN json_extract_string(record, '$.phrase') ELSE trim(regexp_extract(record, '(?:^|[|])\\s*phrase: ([^|]*)', 1)) END) p,
    coalesce(category, CASE WHEN ltrim(record) LIKE '{%' THEN json_extract_string(record, '$.category') ELSE trim(regexp_extract(record, '(?:^|[|])\\s*category: ([^|]*)', 1)) END) c
  FROM extracted_products),
k AS (SELECT product_id, lower(regexp_replace(p, '[^\\p{L}\\p{N}]+', '', 'g')) p, lower(regexp_replace(c, '[^\\p{L}\\p{N}]+', '', 'g')) c FROM r),
g AS (SELECT p, c, min(product_id) keep_id, count(*) n_rows, count(DISTINCT product_id) n_copies FROM k GROUP BY p, c)
"""
_RANK = """
WITH b AS (SELECT run_id, category, candidate_id, max(mgs) mgs FROM ranked_scores
  WHERE run_id IS NOT NULL AND category IS NOT NULL AND candidate_id IS NOT NULL AND mgs IS NOT NULL AND NOT isnan(mgs) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, category ORDER BY mgs DESC, candidate_id) AS INTEGER) rank_no FROM b)
"""

QUERIES = {"p2_format_copies": p2_format_copies, "p2_found": p2_found, "p3_top_ten": p3_top_ten, "p3_found": p3_found}
SQL = {
    "p2_format_copies": _KIND + "SELECT keep_id, n_rows, n_copies, 0 AS collisions FROM g",
    "p2_found": _KIND + "SELECT DISTINCT g.keep_id, k.product_id FROM k JOIN g ON k.p IS NOT DISTINCT FROM g.p AND k.c IS NOT DISTINCT FROM g.c WHERE k.product_id > g.keep_id",
    "p3_top_ten": _RANK + "SELECT run_id, category, candidate_id, mgs, rank_no FROM r WHERE rank_no <= 10",
    "p3_found": _RANK + "SELECT run_id, category, rank_no, candidate_id FROM r WHERE rank_no <= 10",
}
