"""Queries of the whole decision, of niches, golden cases and run choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from nichelens.functions.constants import PAIN_MARKERS
from nichelens.functions.text import has_marker
from nichelens.operators import scoring
from nichelens.operators.ordering import first_per
from nichelens.plans.decide import check_cases, chosen_run, decide, niche_ranks
from nichelens.plans.lake_queries import products, texts
from nichelens.plans.score_queries import SQL as SCORES
from nichelens.plans.score_queries import _S, ORDER, category_momentum, newest, scores
from nichelens.plans.signal_queries import _LAKE, _TALK, _MARK, _re, lake
from nichelens.plans.signal_queries import newest as latest
from nichelens.session import table


def decide_scores(spark, d):
    """Shortlist, scores, shape and revenue range of every product in one run."""
    t = texts(spark, d)
    p = products(spark, d).where("phrase is not null and category is not null")
    cats = table(spark, d, "categories").select("id", "price_low", "price_high", "feasibility_prior")
    r = decide(t, p, cats, lake(spark, d), latest(t))
    num = ("dv", "ss", "sp", "mp", "fe", "ci", "mgs", "fad_probability", "p10", "p50", "p90")
    return r.select("category", "entity", "mentions", "rank_no", "kept", "fad_label", *[F.round(c, 4).alias(c) for c in num])


def niche_score_rank(spark, d):
    s = lake(spark, d)
    docs = table(spark, d, "documents").where("category is not null")
    pain = docs.groupBy("category").agg((100.0 * F.count_if(has_marker(F.col("text"), PAIN_MARKERS)) / F.count("*")).alias("pain"))
    passion = scoring.category_passion(s, latest(s)).select("category", "passion")
    r = niche_ranks(category_momentum(spark, d).select("category", "momentum"), passion, pain)
    return r.select("category", F.round("score", 4).alias("score"), F.round("standing", 4).alias("standing"))


def eval_checks(spark, d):
    """Golden cases from each candidate's first snapshot, five points either way, against its newest."""
    first = first_per(scores(spark, d), ["candidate_id"], [*ORDER, "category"])
    cases = first.select(F.col("candidate_id").alias("case_id"), "candidate_id", F.greatest(F.col("mgs") - 5, F.lit(0.0)).alias("low"), F.least(F.col("mgs") + 5, F.lit(100.0)).alias("high"), F.col("fad_label").alias("label"))
    return check_cases(cases, newest(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


def run_choice(spark, d):
    return chosen_run(table(spark, d, "runs")).select("id", "fits")


QUERIES = {f.__name__: f for f in (decide_scores, niche_score_rank, eval_checks, run_choice)}
_MOM = SCORES["category_momentum"].split(" SELECT *, CAST")[0]
SQL = {
    "niche_score_rank": f"""{_MOM}, {_LAKE.strip()},
      tk AS (SELECT category, sum({_TALK}) talk FROM s WHERE category <> '' AND ts >= (SELECT t FROM ref) - INTERVAL 90 DAY GROUP BY 1), pa AS (SELECT category, CASE WHEN max(talk) OVER () > 0 THEN 100 * talk / max(talk) OVER () ELSE 0 END passion FROM tk),
      pn AS (SELECT category, 100.0::DOUBLE * count(*) FILTER ({_MARK.format('text', _re(PAIN_MARKERS))}) / count(*) pain FROM documents WHERE category IS NOT NULL GROUP BY 1),
      z AS (SELECT coalesce(g.category, pa.category) category, CASE WHEN pain IS NULL THEN (.3::DOUBLE * coalesce(passion, 0) + .3::DOUBLE * coalesce(momentum, 0)) / .6::DOUBLE ELSE .4::DOUBLE * pain + .3::DOUBLE * coalesce(passion, 0) + .3::DOUBLE * coalesce(momentum, 0) END score
        FROM g FULL JOIN pa ON g.category = pa.category LEFT JOIN pn ON pn.category = coalesce(g.category, pa.category)),
      v AS (SELECT *, round(score, 9) q, count(*) OVER () n FROM z)
      SELECT category, round(score, 4) score, round(100 * (rank() OVER (ORDER BY q) - 1 + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE) / (n - 1), 4) standing FROM v""",
    "eval_checks": _S + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at, run_id NULLS FIRST, weights_version NULLS FIRST, category NULLS FIRST) q FROM sc) WHERE q = 1),
      c AS (SELECT CAST(nw.mgs BETWEEN greatest(f.mgs - 5, 0) AND least(f.mgs + 5, 100) AS INT) + CAST(nw.fad_label IS NOT DISTINCT FROM f.fad_label AS INT) g FROM f JOIN nw USING (candidate_id))
      SELECT CASE g WHEN 2 THEN 'verified' WHEN 1 THEN 'partial' ELSE 'failed' END state, count(*) n FROM c GROUP BY 1""",
    "run_choice": """SELECT id, coalesce(trigger_kind = 'nightly' AND status IN ('ok', 'degraded', 'empty') AND contains(layer_status, '"L1"'), false) fits FROM runs ORDER BY fits DESC, started_at DESC NULLS LAST, id DESC LIMIT 1""",
}
