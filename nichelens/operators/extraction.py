"""Chunks of texts, extracted products, their grounding and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.constants import ALPHA, CHUNK_SIZE, KEEP_LEAST, KEEP_SHARE, MAX_AGE_DAYS, SHOWN_CHARS
from nichelens.functions.text import canonical_phrase, collapse
from nichelens.operators.ordering import global_row_number, percentile_ranks, zscores
from nichelens.operators.series import ewma_weight
from nichelens.operators.skew import broadcast_if_small
from nichelens.session import materialize, utc_day


def dedup_texts(texts: DataFrame) -> DataFrame:
    """One id (the smallest) per (source_id, text with single spaces, ts). The text goes through the shuffle as a 128-bit hash beside its length."""
    c = collapse(F.col("text"))
    return texts.where("text is not null").select("id", "source_id", "ts", F.md5(c).alias("_h"), F.length(c).alias("_n")).groupBy("source_id", "ts", "_h", "_n").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "source_id", "ts", "copies")


def assign_chunks(texts: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """Non-empty texts numbered from 0 in the order (ts, source_id, text, id), with their chunk. NULL times come first."""
    rows = texts.where(F.length(F.trim("text")) > 0)
    d = global_row_number(rows, [F.asc_nulls_first("ts"), F.asc_nulls_first("source_id"), "text", "id"], "_no")
    return d.withColumn("text_no", F.col("_no") - 1).withColumn("chunk_no", F.floor((F.col("_no") - 1) / size)).drop("_no")


def chunk_prompts(chunks: DataFrame, shown: int = SHOWN_CHARS) -> DataFrame:
    """One prompt per chunk: a line '[no] (source, date) text' per text, at most the chunk's size of lines."""
    line = F.concat(F.lit("["), F.col("text_no").cast("string"), F.lit("] ("), F.coalesce("source_id", F.lit("")), F.lit(", "), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("")), F.lit(") "), F.substring(collapse(F.col("text")), 1, shown))
    lines = chunks.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("text_no", line.alias("line")))).alias("l"))
    return lines.select("chunk_no", F.size("l").alias("n_texts"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))


def stand_in_products(chunks: DataFrame, categories: Sequence[str]) -> DataFrame:
    """The offline extractor: every tenth text of a chunk, three at most, names a product after its number."""
    rn = F.row_number().over(Window.partitionBy("chunk_no").orderBy("text_no")) - 1  # a chunk is bounded
    d = chunks.withColumn("_r", rn).where("_r % 10 = 0 and _r < 30").withColumn("_i", (F.col("_r") / 10).cast("int"))
    return d.select("chunk_no", F.concat(F.lit("offline product "), F.col("text_no").cast("string")).alias("phrase"), F.element_at(F.array(*[F.lit(c) for c in categories]), F.col("_i") + 1).alias("category"), F.array("text_no").alias("doc_ids"))


def ground_refs(products: DataFrame, texts: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, phrase, doc_id) of references that exist, each once; products of unknown categories are left out. Phrases are canonical."""
    known = products.join(broadcast_if_small(categories.select(F.col("id").alias("category")).distinct()), "category", "left_semi")
    refs = known.select("product_id", canonical_phrase(F.col("phrase")).alias("phrase"), "category", F.explode("doc_ids").alias("doc_id")).where("phrase <> ''")
    return refs.join(texts.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("category", "phrase", "doc_id").distinct()


def invented_refs(products: DataFrame, texts: DataFrame) -> DataFrame:
    """Per product: refs, kept (existing, each once), invented (the rest, repeated ones included)."""
    refs = products.select("product_id", F.explode("doc_ids").alias("doc_id"))
    found = refs.distinct().join(texts.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("kept"))
    d = products.select("product_id", F.size("doc_ids").alias("refs")).join(found, "product_id", "left").fillna(0, ["kept"])
    return d.withColumn("invented", F.col("refs") - F.col("kept"))


def union_products(products: DataFrame) -> DataFrame:
    """Products of one (category, canonical phrase) as one: the first wording (smallest product_id) and all references, sorted."""
    rows = products.where("phrase is not null and category is not null").withColumn("canon", canonical_phrase(F.col("phrase"))).where("canon <> ''")
    names = rows.groupBy("category", "canon").agg(F.min(F.struct("product_id", "phrase")).getField("phrase").alias("phrase"), F.count_distinct("product_id").alias("n_products"))
    refs = rows.select("category", "canon", F.explode("doc_ids").alias("doc_id")).distinct().groupBy("category", "canon").agg(F.count("*").alias("n_refs"), F.min("doc_id").alias("first_ref"), F.max("doc_id").alias("last_ref"))
    return names.join(refs, ["category", "canon"], "left").fillna(0, ["n_refs"])


def rank_products(refs: DataFrame, texts: DataFrame, as_of: datetime, days: int = 365, share: float = KEEP_SHARE, least: int = KEEP_LEAST, max_age: int = MAX_AGE_DAYS) -> DataFrame:
    """Products ranked by the velocity of their mentions within their category.

    ``refs`` (category, phrase, doc_id), ``texts`` (id, source_id, ts). Columns: mentions, n_sources, first_seen, last_seen, stale, level,
    z, velocity, rank_no and kept (stale products have NULL from level on). The order is: two mentions or more first, then velocity, mentions, phrase,
    category; the best max(share of all, least) are kept and the others stay in the result.
    """
    points = materialize(refs.join(texts.where("ts is not null").select(F.col("id").alias("doc_id"), "source_id", "ts").dropDuplicates(["doc_id"]), "doc_id"), "mentions")
    key = ["category", "phrase"]
    seen = points.groupBy(*key).agg(F.count("*").alias("mentions"), F.count_distinct("source_id").alias("n_sources"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    seen = seen.withColumn("stale", F.col("last_seen") < F.lit(as_of) - F.make_dt_interval(F.lit(min(max_age, days))))
    age = F.datediff(F.lit(as_of.date()), utc_day(points, "ts"))
    levels = points.withColumn("_age", age).where(F.col("_age").between(0, days - 1)).groupBy(*key).agg(F.round(F.sum(ewma_weight(F.col("_age"), ALPHA, days)), 12).alias("level"))
    fresh = materialize(seen.where("not stale").join(levels, key, "left").fillna(0.0, ["level"]), "fresh")
    ranked = percentile_ranks(zscores(fresh, ["category"], "level", "z"), ["category"], "level", "velocity")
    order = [F.desc(F.col("mentions") >= 2), F.desc("velocity"), F.desc("mentions"), F.asc("phrase"), F.asc("category")]
    ranked = global_row_number(ranked, order, "rank_no")
    n = fresh.count()
    ranked = ranked.withColumn("kept", F.col("rank_no") <= min(max(-(-n * round(share * 10_000) // 10_000), least), n))
    return ranked.unionByName(seen.where("stale"), allowMissingColumns=True)
