"""Queries of problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichelens.llm.eval_leaks import leaks
from nichelens.llm.mixing import shares, token_sizes
from nichelens.session import table


def p6_longest_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of every leaked item and document, with its place."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of every mixture."""
    r = shares(token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))
    return r.select("mix_id", "source", "target_share", F.round("actual_share", 6).alias("actual_share"), "taken", "copies", "exhausted", "short")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their share with every document used as often as allowed."""
    return shares(token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets")).where("short").select("mix_id", "source")


QUERIES = {"p6_longest_leaks": p6_longest_leaks, "p6_found": p6_found, "p7_mix_shares": p7_mix_shares, "p7_found": p7_found}
SQL: dict[str, str] = {}
