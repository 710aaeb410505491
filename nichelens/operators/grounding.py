"""Answers of models: parsing, grounding of quotes and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "url", "source_id")]))
PRODUCTS = T.StructType([T.StructField("products", T.ArrayType(T.StructType([T.StructField("phrase", T.StringType()), T.StructField("category", T.StringType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("reason", T.StringType())])))])


def unfenced(answer: Column) -> Column:
    """The JSON of an answer, without a code fence and what stands around the outermost braces."""
    inner = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.regexp_extract(F.when(inner != "", inner).otherwise(answer), r"(?s)(\{.*\}|\[.*\])", 1)


def parse_products(answer: Column, categories: Sequence[str]) -> Column:
    """The products of an answer, or NULL: one unknown category, empty phrase or missing reference fails the whole answer."""
    p = F.from_json(unfenced(answer), PRODUCTS)["products"]
    good = F.forall(p, lambda x: F.coalesce(x["category"].isin(list(categories)) & (F.trim(x["phrase"]) != "") & (F.size(x["doc_ids"]) > 0), F.lit(False)))
    return F.when(p.isNotNull() & good, p)


def ground_quotes(df: DataFrame, quotes: str = "quotes", allowed: str = "allowed") -> DataFrame:
    """``df`` with its quotes grounded: blank ones go, and those whose link is not allowed unless the allow-list is empty; adds dropped_quotes and ungrounded."""
    q, a = F.coalesce(F.col(quotes), F.array().cast(QUOTES)), F.coalesce(F.col(allowed), F.array().cast("array<string>"))
    keep = F.filter(q, lambda x: (F.trim(F.coalesce(x["text"], F.lit(""))) != "") & ((F.size(a) == 0) | F.coalesce(F.array_contains(a, x["url"]), F.lit(False))))
    return df.withColumn("_kept", keep).withColumn("dropped_quotes", F.size(q) - F.size("_kept")).withColumn("ungrounded", F.size("_kept") == 0).withColumn(quotes, F.col("_kept")).drop("_kept")


def coverage(batch: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(phrase, state): judged, missing (no verdict) or unknown (a verdict for no candidate), by lower-cased phrase."""
    b = batch.select(F.lower("phrase").alias("phrase"), F.lit(True).alias("_b")).distinct()
    v = verdicts.select(F.lower("phrase").alias("phrase"), F.lit(True).alias("_v")).distinct()
    return b.join(v, "phrase", "full_outer").select("phrase", F.when(F.col("_v").isNull(), "missing").when(F.col("_b").isNull(), "unknown").otherwise("judged").alias("state"))
