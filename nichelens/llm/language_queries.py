"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.llm.languages import fit, labelled_sample, text_passages
from nichelens.session import table


def _passages(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "chunk_texts")
    return text_passages(texts, fit(labelled_sample(texts, "id", "text", "lang")))


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every passage of every text."""
    return _passages(spark, d).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The passages of texts whose label is missing or wrong, or which are in several languages."""
    r = _passages(spark, d)
    return r.where((F.col("n_langs") > 1) | F.col("label_code").isNull() | (F.col("label_code") != F.col("lang"))).select("chunk_id", "seg_no", "lang").distinct()


QUERIES = {"p5_passages": p5_passages, "p5_found": p5_found}
SQL: dict[str, str] = {}
