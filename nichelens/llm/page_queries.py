"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nichelens.llm.line_shapes import page_shapes
from nichelens.session import table


def p8_page_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every page with the share of its words outside sentence shapes."""
    return page_shapes(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return page_shapes(table(spark, d, "documents")).where("flagged").select("doc_id")


QUERIES = {"p8_page_shapes": p8_page_shapes, "p8_found": p8_found}
SQL: dict[str, str] = {}
