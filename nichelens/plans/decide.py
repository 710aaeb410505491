"""The whole decision over one lake: ground, rank, score, classify, simulate, append."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.constants import EXCLUDED_SOURCES
from nichelens.functions.text import normalize_phrase
from nichelens.operators import extraction, scoring
from nichelens.operators.ordering import percentile_ranks
from nichelens.operators.series import entity_features
from nichelens.operators.store import write_append
from nichelens.session import materialize, table_exists


def decide(texts: DataFrame, products: DataFrame, categories: DataFrame, signals: DataFrame, as_of: datetime, version: str = "v2", days: int = 365, excluded: tuple[str, ...] = EXCLUDED_SOURCES) -> DataFrame:
    """One row per product that was mentioned: shortlist (rank_no, kept), sub-scores, mgs, fad_probability, fad_label and the revenue range.

    ``texts`` (id, source_id, ts, text), ``products`` (product_id, phrase, category, doc_ids), ``categories`` as the taxonomy, ``signals`` for interest. A
    phrase's evidence is that of all its categories; mentions count 1 each. One lazy plan but for the written intermediate tables.
    """
    texts = texts.where(F.col("source_id").isNull() | ~F.col("source_id").isin(*excluded)) if excluded else texts  # counts of page views are no texts
    refs = materialize(extraction.ground_refs(products, texts, categories), "refs")
    ranked = materialize(extraction.rank_products(refs, texts, as_of, days).where("not stale"), "ranked")
    own = texts.where("ts is not null").dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "source_id", "ts", "text")
    cited = refs.select("phrase", "doc_id").distinct().join(own, "doc_id")  # evidence merges over the categories of a phrase
    points = ranked.select("category", F.col("phrase").alias("entity")).join(cited.withColumnRenamed("phrase", "entity"), "entity")
    points = materialize(points.where(F.col("ts") >= scoring.since(as_of, days)).withColumn("value", F.lit(1.0)), "points")
    features = materialize(entity_features(points, ["category", "entity"], as_of.date()), "vectors")
    by = Window.partitionBy("category", "entity").orderBy("ts", "doc_id")  # a limit of the window: no entity's points are gathered
    first = points.withColumn("_r", F.row_number().over(by)).where("_r <= 5").select("category", "entity", "doc_id")
    sample = first.join(own.select("doc_id", "ts", "text"), "doc_id").groupBy("category", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "doc_id", "text"))), lambda x: F.lower(x["text"])), " ").alias("sample"))
    interest = scoring.phrase_interest(signals, features.select(normalize_phrase(F.col("entity")).alias("needle")), as_of) if version == "v2" else None
    scores = scoring.mgs(features, categories, sample, interest, version)
    shape = scoring.fad(features).select("category", "entity", "fad_probability", "fad_label")
    money = scoring.revenue(features, categories)
    out = scores.join(shape, ["category", "entity"]).join(money, ["category", "entity"])
    place = ranked.select("category", F.col("phrase").alias("entity"), "mentions", "rank_no", "kept")
    out = out.join(place, ["category", "entity"]).withColumn("weights_version", F.lit(version))
    return out.withColumn("ci", F.when(F.lit(version == "v1"), None).otherwise(F.col("ci")))  # interest is unmeasured under v1, never 0


def write_snapshot(scored: DataFrame, path: str, run_id: str) -> None:
    """Append the rows of a run that are not there yet; the table is partitioned by run and never updated."""
    rows = scored.withColumn("run_id", F.lit(run_id))
    key = ["run_id", "category", "entity", "weights_version"]
    there = table_exists(scored.sparkSession, path)
    old = scored.sparkSession.read.parquet(path).where(F.col("run_id") == run_id).select(key) if there else rows.select(key).limit(0)
    write_append(rows.join(old, key, "left_anti"), path, ["run_id"])


def niche_ranks(momentum: DataFrame, passion: DataFrame, pain: DataFrame) -> DataFrame:
    """(category, score, place): 0.4 pain + 0.3 passion + 0.3 momentum; where pain was not measured, the mean of the other two. Categories of either side count."""
    d = momentum.join(passion, "category", "full_outer").join(pain, "category", "left")
    p, m = F.coalesce("passion", F.lit(0.0)), F.coalesce("momentum", F.lit(0.0))
    d = d.withColumn("score", F.when(F.col("pain").isNull(), (0.3 * p + 0.3 * m) / 0.6).otherwise(0.4 * F.col("pain") + 0.3 * p + 0.3 * m))
    return percentile_ranks(d, [], "score", "standing").select("category", "score", "standing")


def check_cases(cases: DataFrame, newest: DataFrame) -> DataFrame:
    """Golden cases (case_id, candidate_id, low, high, label) against the newest scores: (case_id, state) with state unchecked, failed, partial or verified.

    A case without a score is unchecked; one check passed of two is partial.
    """
    d = cases.join(newest.select("candidate_id", F.col("mgs").alias("_m"), F.col("fad_label").alias("_l")), "candidate_id", "left")
    good = F.col("_m").between(F.col("low"), F.col("high")).cast("int") + F.col("_l").eqNullSafe(F.col("label")).cast("int")
    return d.select("case_id", F.when(F.col("_m").isNull(), "unchecked").when(good == 2, "verified").when(good == 1, "partial").otherwise("failed").alias("state"))


def chosen_run(runs: DataFrame) -> DataFrame:
    """The newest nightly run that ended well or empty and has its first layer; without such a run the newest of all."""
    fit = (F.col("trigger_kind") == "nightly") & F.col("status").isin("ok", "degraded", "empty") & F.col("layer_status").contains('"L1"')
    return runs.withColumn("fits", F.coalesce(fit, F.lit(False))).orderBy(F.desc("fits"), F.desc_nulls_last("started_at"), F.desc("id")).limit(1)
