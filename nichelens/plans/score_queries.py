"""Queries and SQL over score history, candidates, runs and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichelens.functions.text import canonical_phrase
from nichelens.operators.flow import group_running_total, streaks
from nichelens.operators.history import deltas, moves, tree_hash
from nichelens.operators.ordering import latest_per
from nichelens.operators.store import append_new, forward_cursor, sync_diff, upsert_candidates
from nichelens.session import materialize, table
from nichelens.sources import registry

ORDER = ["scored_at", "run_id", "weights_version"]


def scores(spark, d) -> DataFrame:
    """Valid snapshots, each once per (candidate, run, version, time, category): of a repeated key the row of the highest score, ties by phrase, label and mentions."""
    s = table(spark, d, "ranked_scores").where("mgs is not null and not isnan(mgs) and candidate_id is not null and scored_at is not null")
    best = F.max(F.struct("mgs", "phrase", "fad_label", "mentions")).alias("b")
    return s.groupBy("candidate_id", "category", *ORDER).agg(best).select("candidate_id", "category", *ORDER, "b.mgs", "b.phrase", "b.fad_label", "b.mentions")


def newest(spark, d) -> DataFrame:
    return latest_per(scores(spark, d), ["candidate_id"], [*ORDER, "category"])


def ranked_table(spark, d):
    """The fifty best candidates by their newest snapshot."""
    return newest(spark, d).orderBy(F.desc("mgs"), "phrase", "candidate_id").limit(50).select("candidate_id", "phrase", "category", "mgs", "weights_version")


def latest_per_candidate(spark, d):
    return newest(spark, d).select("candidate_id", "run_id", "weights_version", "mgs")


def latest_ties(spark, d):
    """All snapshots at a candidate's newest time, ties included."""
    s = scores(spark, d)
    top = s.groupBy("candidate_id").agg(F.max("scored_at").alias("scored_at"))
    return s.join(top, ["candidate_id", "scored_at"]).select("candidate_id", "run_id", "weights_version", "category", "mgs")


def history_delta(spark, d):
    r = deltas(scores(spark, d), "candidate_id", [*ORDER, "category"], "mgs")
    return r.select("candidate_id", "n", "first_value", "last_value", F.round("delta", 6).alias("delta"))


def compare_versions(spark, d):
    """The newest score of each candidate under either version, side by side."""
    last = latest_per(scores(spark, d), ["candidate_id", "weights_version"], ["scored_at", "run_id", "category"])
    v = lambda x: F.max(F.when(F.col("weights_version") == x, F.col("mgs"))).alias(f"mgs_{x}")
    r = last.groupBy("candidate_id").agg(v("v1"), v("v2"))
    return r.withColumn("difference", F.round(F.col("mgs_v2") - F.col("mgs_v1"), 6))


def movers(spark, d):
    """Newest against previous snapshot of every candidate; no delta across versions, no previous for new ones."""
    r = moves(scores(spark, d).withColumn("ver", F.col("weights_version")), "candidate_id", ["scored_at", "run_id", "weights_version", "category"], "mgs", "ver")
    return r.select("candidate_id", "mgs", "previous", F.round("delta", 6).alias("delta"))


def category_momentum(spark, d):
    """Mean of the five best newest scores of each category, and its place."""
    w = Window.partitionBy("category").orderBy(F.desc("mgs"), "candidate_id")
    top = newest(spark, d).where("category is not null").select("category", "candidate_id", "mgs").withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    g = top.groupBy("category").agg(F.round(F.avg("mgs"), 6).alias("momentum"), F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("momentum"), "category")))  # one row a category


def label_histogram(spark, d):
    return newest(spark, d).groupBy("category", "fad_label").agg(F.count("*").alias("n"))


def scores_by_run(spark, d):
    s = scores(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("n_candidates"), F.max("scored_at").alias("newest"))
    r = table(spark, d, "runs").select(F.col("id").alias("run_id"), "status", "trigger_kind")
    return r.join(s, "run_id", "left").select("run_id", "status", "trigger_kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"))


def median_split(spark, d):
    """Newest scores of each category split at the upper median."""
    n = newest(spark, d).where("category is not null").select("category", "candidate_id", "mgs")
    ranked = group_running_total(n, ["category"], ["mgs", "candidate_id"], F.lit(1).cast("bigint"), "_k")
    sizes = n.groupBy("category").agg(F.count("*").alias("_n"))
    cut = ranked.join(sizes, "category").where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select("category", F.col("mgs").alias("threshold"), F.col("_n").alias("n"))
    above = n.join(cut, "category").groupBy("category").agg(F.count_if(F.col("mgs") >= F.col("threshold")).alias("n_keep"))
    return cut.join(above, "category")


def round_robin(spark, d):
    """Candidates interleaved across categories, best first, the first hundred."""
    n = newest(spark, d).where("category is not null")
    w = Window.partitionBy("category").orderBy(F.desc("mgs"), "candidate_id")
    turn = n.withColumn("turn", F.row_number().over(w)).where("turn <= 100")
    return turn.orderBy("turn", "category").limit(100).select("turn", "category", "candidate_id")


def _seen(s: DataFrame) -> DataFrame:
    return s.where("phrase is not null and category is not null").select("phrase", "category", F.coalesce("mentions", F.lit(0)).cast("bigint").alias("mentions"), F.col("scored_at").alias("first_seen"), F.col("scored_at").alias("last_seen"))


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """Snapshots before and from the middle of the covered time on."""
    s = scores(spark, d)
    a, b = s.agg(F.min("scored_at"), F.max("scored_at")).first()
    mid = F.lit(a + (b - a) / 2)
    return s.where(F.col("scored_at") < mid), s.where(F.col("scored_at") >= mid)


def merge_candidates(spark, d):
    old, new = _halves(spark, d)
    r = upsert_candidates(_seen(old), _seen(new))
    return r.select("phrase", "category", "mentions", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


def append_unseen(spark, d):
    """Candidates of the second half that the first half does not have."""
    old, new = _halves(spark, d)
    return append_new(old.select("candidate_id", "category"), new, ["candidate_id", "category"], ORDER).select("candidate_id", "category", "run_id", "weights_version")


def judged_runs(spark, d):
    """Runs that have scores, and the number that have none (semi and anti join)."""
    r, s = table(spark, d, "runs"), scores(spark, d)
    with_scores = r.join(s.select(F.col("run_id").alias("id")), "id", "left_semi").groupBy("trigger_kind").agg(F.count("*").alias("scored"))
    without = r.join(s.select(F.col("run_id").alias("id")), "id", "left_anti").groupBy("trigger_kind").agg(F.count("*").alias("unscored"))
    return with_scores.join(without, "trigger_kind", "full_outer").fillna(0)


def registry_sync(spark, d):
    """The registry, changed by rule, against the stored one."""
    s = table(spark, d, "sources").select("id", "ord", "budget_per_day", "rps", "enabled", "schedule")
    reg = s.where("ord % 5 <> 0").withColumn("budget_per_day", F.when(F.col("ord") % 3 == 0, F.col("budget_per_day") + 10).otherwise(F.col("budget_per_day"))).withColumn("schedule", F.when(F.col("ord") % 4 == 0, F.lit("weekly")).otherwise(F.col("schedule")))
    fresh = s.where("ord <= 2").withColumn("id", F.concat(F.lit("new_"), F.col("id")))
    return sync_diff(reg.unionByName(fresh), s, ["budget_per_day", "rps", "enabled", "schedule"])


def cursor_forward(spark, d):
    """Every source's cursor after its newest item that had one."""
    got = latest_per(table(spark, d, "raw_items").where("fetch_cursor is not null").select("source_id", "id", "fetch_cursor"), ["source_id"], ["id"])
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), "watermark").join(got, "source_id", "left")
    c = forward_cursor(F.col("watermark"), F.col("fetch_cursor"))
    return s.select("source_id", c.alias("cursor"), (~c.eqNullSafe(F.col("watermark"))).alias("moved"))


def registry_summary(spark, d):
    return registry.summary(table(spark, d, "sources"))


def registry_violations(spark, d):
    return registry.violations(table(spark, d, "sources"))


def registry_layer(spark, d):
    return registry.for_layer(table(spark, d, "sources"), "L0").select("id", "ord", "tier", F.size("domains").alias("n_domains"))


def run_status_fold(spark, d):
    """A run's status from its layers: none or mixed is degraded, all ok is ok, all failed is failed."""
    r = table(spark, d, "runs").select("id", F.map_values(F.from_json("layer_status", "map<string,string>")).alias("v"))
    all_ = lambda x: (F.size("v") > 0) & F.forall("v", lambda s: s == x)
    return r.select("id", F.when(all_("ok"), "ok").when(all_("failed"), "failed").otherwise("degraded").alias("folded"), F.size(F.filter("v", lambda s: s == "ok")).alias("n_ok"))


def outcome_histogram(spark, d):
    s = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return table(spark, d, "runs").groupBy("status", "trigger_kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(s), F.lit(0)).alias("secs"), F.count_if(F.col("finished_at").isNull()).alias("never_ended"))


def failure_streaks(spark, d):
    """How many runs had not succeeded in a row, at each run."""
    r = streaks(table(spark, d, "runs").select("id", "started_at", "status"), ["started_at", "id"], F.col("status") != "ok")
    return r.select("id", "streak")


def snapshot_hash(spark, d):
    """A digest of each run's scores in the order of phrase, category, candidate and version."""
    num = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("null"))
    s = scores(spark, d).where("run_id is not null")
    line = F.concat_ws("|", F.coalesce("phrase", F.lit("")), F.coalesce("category", F.lit("")), F.col("candidate_id").cast("string"), "weights_version", num("mgs"), F.coalesce("fad_label", F.lit("")))
    s = s.select("run_id", line.alias("line"), F.date_format("scored_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    s = group_running_total(s, ["run_id"], ["line", "at"], F.lit(1).cast("bigint"), "k").withColumn("k", F.col("k") - 1)
    return tree_hash(materialize(s, "lines"), ["run_id"], "k", "line")


QUERIES = {
    f.__name__: f
    for f in (
        ranked_table, latest_per_candidate, latest_ties, history_delta, compare_versions, movers, category_momentum, label_histogram, scores_by_run, median_split, round_robin,
        merge_candidates, append_unseen, judged_runs, registry_sync, cursor_forward, registry_summary, registry_violations, registry_layer, run_status_fold, outcome_histogram,
        failure_streaks, snapshot_hash,
    )
}
_S = """WITH sc AS (SELECT candidate_id, category, scored_at, run_id, weights_version, mgs, phrase, fad_label, mentions FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, category, scored_at, run_id, weights_version
    ORDER BY mgs DESC, phrase DESC NULLS LAST, fad_label DESC NULLS LAST, mentions DESC NULLS LAST) kk FROM ranked_scores WHERE mgs IS NOT NULL AND NOT isnan(mgs) AND candidate_id IS NOT NULL AND scored_at IS NOT NULL) WHERE kk = 1),
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at DESC, run_id DESC NULLS LAST, weights_version DESC NULLS LAST, category DESC NULLS LAST) k FROM sc) WHERE k = 1)"""
_HALF = _S + """, mi AS (SELECT min(scored_at) + to_microseconds(CAST(floor((epoch_us(max(scored_at)) - epoch_us(min(scored_at))) / 2) AS BIGINT)) t FROM sc)"""


def _canon(c: str) -> str:
    from nichelens.plans.signal_queries import _canon as canon

    return canon(c)


SQL = {
    "ranked_table": _S + " SELECT candidate_id, phrase, category, mgs, weights_version FROM nw ORDER BY mgs DESC, phrase, candidate_id LIMIT 50",
    "latest_per_candidate": _S + " SELECT candidate_id, run_id, weights_version, mgs FROM nw",
    "latest_ties": _S + " SELECT candidate_id, run_id, weights_version, category, mgs FROM (SELECT *, rank() OVER (PARTITION BY candidate_id ORDER BY scored_at DESC) r FROM sc) WHERE r = 1",
    "history_delta": _S + """, o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at, run_id NULLS FIRST, weights_version NULLS FIRST, category NULLS FIRST) k, count(*) OVER (PARTITION BY candidate_id) n FROM sc)
      SELECT candidate_id, n, max(mgs) FILTER (k = 1) first_value, max(mgs) FILTER (k = n) last_value, CASE WHEN n > 1 THEN round(max(mgs) FILTER (k = n) - max(mgs) FILTER (k = 1), 6) END delta FROM o GROUP BY candidate_id, n""",
    "compare_versions": _S + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, weights_version ORDER BY scored_at DESC, run_id DESC NULLS LAST, category DESC NULLS LAST) q FROM sc) WHERE q = 1),
      g AS (SELECT candidate_id, max(mgs) FILTER (weights_version = 'v1') mgs_v1, max(mgs) FILTER (weights_version = 'v2') mgs_v2 FROM l GROUP BY 1) SELECT *, round(mgs_v2 - mgs_v1, 6) difference FROM g""",
    "movers": _S + """, l AS (SELECT candidate_id, mgs, weights_version, lag(mgs) OVER w previous, lag(weights_version) OVER w pv, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at DESC, run_id DESC NULLS LAST, weights_version DESC NULLS LAST, category DESC NULLS LAST) k FROM sc
      WINDOW w AS (PARTITION BY candidate_id ORDER BY scored_at, run_id NULLS FIRST, weights_version NULLS FIRST, category NULLS FIRST)) SELECT candidate_id, mgs, previous, CASE WHEN weights_version = pv THEN round(mgs - previous, 6) END delta FROM l WHERE k = 1""",
    "category_momentum": _S + """, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY mgs DESC, candidate_id) r FROM nw WHERE category IS NOT NULL), g AS (SELECT category, round(avg(mgs), 6) momentum, count(*) n FROM t WHERE r <= 5 GROUP BY 1)
      SELECT *, CAST(row_number() OVER (ORDER BY momentum DESC, category) AS INT) place FROM g""",
    "label_histogram": _S + " SELECT category, fad_label, count(*) n FROM nw GROUP BY ALL",
    "scores_by_run": _S + ", g AS (SELECT run_id, count(*) n, count(DISTINCT candidate_id) n_candidates, max(scored_at) newest FROM sc GROUP BY 1) SELECT id AS run_id, status, trigger_kind, coalesce(n, 0) n, coalesce(n_candidates, 0) n_candidates, strftime(newest AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') newest FROM runs LEFT JOIN g ON g.run_id = runs.id",
    "median_split": _S + """, c AS (SELECT category, list_sort(list(mgs)) l, count(*) n FROM nw WHERE category IS NOT NULL GROUP BY 1), t AS (SELECT category, l[n // 2 + 1] threshold, n FROM c)
      SELECT t.category, threshold, n, count(*) FILTER (mgs >= threshold) n_keep FROM t JOIN nw ON nw.category = t.category GROUP BY ALL""",
    "round_robin": _S + ", t AS (SELECT category, candidate_id, CAST(row_number() OVER (PARTITION BY category ORDER BY mgs DESC, candidate_id) AS INT) turn FROM nw WHERE category IS NOT NULL) SELECT turn, category, candidate_id FROM t ORDER BY turn, category LIMIT 100",
    "merge_candidates": _HALF + f""", e AS (SELECT {_canon('phrase')} phrase, category, coalesce(mentions, 0) m, scored_at, scored_at >= (SELECT t FROM mi) late FROM sc WHERE phrase IS NOT NULL AND category IS NOT NULL)
      SELECT phrase, category, CAST(coalesce(sum(m) FILTER (late), sum(m)) AS BIGINT) mentions, strftime(min(scored_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') first_seen, strftime(max(scored_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') last_seen FROM e GROUP BY ALL""",
    "append_unseen": _HALF + """, n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, category ORDER BY scored_at, run_id NULLS FIRST, weights_version) q FROM sc WHERE scored_at >= (SELECT t FROM mi))
      SELECT candidate_id, category, run_id, weights_version FROM n WHERE q = 1 AND NOT EXISTS (SELECT 1 FROM sc o WHERE o.scored_at < (SELECT t FROM mi) AND o.candidate_id = n.candidate_id AND o.category IS NOT DISTINCT FROM n.category)""",
    "judged_runs": _S + " SELECT trigger_kind, count(*) FILTER (id IN (SELECT run_id FROM sc WHERE run_id IS NOT NULL)) scored, count(*) FILTER (id NOT IN (SELECT run_id FROM sc WHERE run_id IS NOT NULL)) unscored FROM runs GROUP BY 1",
    "registry_sync": """WITH s AS (SELECT id, ord, budget_per_day, rps, enabled, schedule FROM sources),
      r AS (SELECT id, CASE WHEN ord % 3 = 0 THEN budget_per_day + 10 ELSE budget_per_day END budget_per_day, rps, enabled, CASE WHEN ord % 4 = 0 THEN 'weekly' ELSE schedule END schedule FROM s WHERE ord % 5 <> 0 UNION ALL SELECT 'new_' || id, budget_per_day, rps, enabled, schedule FROM s WHERE ord <= 2),
      j AS (SELECT coalesce(r.id, s.id) id, s.id IS NULL ins, r.id IS NULL gone, s.enabled en, CASE WHEN r.id IS NULL OR s.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN r.budget_per_day IS DISTINCT FROM s.budget_per_day THEN 'budget_per_day' END, CASE WHEN r.rps IS DISTINCT FROM s.rps THEN 'rps' END, CASE WHEN r.enabled IS DISTINCT FROM s.enabled THEN 'enabled' END, CASE WHEN r.schedule IS DISTINCT FROM s.schedule THEN 'schedule' END) END changed FROM r FULL JOIN s ON r.id = s.id)
      SELECT id, CASE WHEN ins THEN 'insert' WHEN gone THEN CASE WHEN en THEN 'disable' ELSE 'already-disabled' END WHEN changed <> '' THEN 'update' ELSE 'unchanged' END action, changed FROM j""",
    "cursor_forward": """WITH g AS (SELECT source_id, arg_max(fetch_cursor, id) c FROM raw_items WHERE fetch_cursor IS NOT NULL GROUP BY 1)
      SELECT id AS source_id, coalesce(c, watermark) AS "cursor", coalesce(c, watermark) IS DISTINCT FROM watermark AS moved FROM sources LEFT JOIN g ON g.source_id = sources.id""",
    "registry_summary": "SELECT tier, count(*) n, count(*) FILTER (enabled) n_enabled, CAST(coalesce(sum(budget_per_day) FILTER (enabled), 0) AS BIGINT) budget FROM sources GROUP BY 1",
    "registry_layer": "SELECT id, ord, tier, CAST(len(domains) AS INT) n_domains FROM sources WHERE enabled AND list_contains(layers, 'L0') ORDER BY ord",
    "registry_violations": """SELECT id, unnest([x FOR x IN [CASE WHEN NOT regexp_matches(id, '^[a-z][a-z0-9_]*$') THEN 'id is not snake case' END, CASE WHEN budget_per_day <= 0 THEN 'budget is not positive' END, CASE WHEN rps <= 0 THEN 'rate is not positive' END,
      CASE WHEN len(layers) = 0 OR len(list_distinct(layers)) < len(layers) THEN 'layers are missing or repeated' END, CASE WHEN len(domains) = 0 THEN 'domains are missing or not bare hosts' END, CASE WHEN tier = 'A' AND list_contains(layers, 'L0') THEN 'tier A collects in L0' END] IF x IS NOT NULL]) "rule" FROM sources""",
    "run_status_fold": """WITH v AS (SELECT id, [json_extract_string(layer_status, '$.' || k) FOR k IN json_keys(layer_status)] v FROM runs)
      SELECT id, CASE WHEN len(v) > 0 AND len([x FOR x IN v IF x = 'ok']) = len(v) THEN 'ok' WHEN len(v) > 0 AND len([x FOR x IN v IF x = 'failed']) = len(v) THEN 'failed' ELSE 'degraded' END folded, CAST(len([x FOR x IN v IF x = 'ok']) AS INT) n_ok FROM v""",
    "outcome_histogram": "SELECT status, trigger_kind, count(*) n, CAST(coalesce(sum(floor(epoch(finished_at)) - floor(epoch(started_at))), 0) AS BIGINT) secs, count(*) FILTER (finished_at IS NULL) never_ended FROM runs GROUP BY ALL",
    "failure_streaks": """WITH a AS (SELECT id, started_at, status <> 'ok' f, sum(CASE WHEN status <> 'ok' THEN 0 ELSE 1 END) OVER (ORDER BY started_at, id) i FROM runs)
      SELECT id, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY started_at, id) AS BIGINT) streak FROM a""",
    "snapshot_hash": _S + """, l AS (SELECT run_id, concat_ws('|', coalesce(phrase, ''), coalesce(category, ''), candidate_id, weights_version, coalesce(printf('%.6f', mgs), 'null'), coalesce(fad_label, '')) line, strftime(scored_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f') tm FROM sc WHERE run_id IS NOT NULL),
      k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line, tm) - 1 k FROM l),
      n1 AS (SELECT run_id, k // 4096 q, sha256(string_agg(sha256(line), '' ORDER BY k)) h, count(*) n FROM k GROUP BY ALL), n2 AS (SELECT run_id, count(*) m, sum(n) n FROM n1 GROUP BY 1)
      SELECT n1.run_id, CAST(n2.n AS BIGINT) n, CASE WHEN (SELECT max(m) FROM n2) <= 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY q)) END digest FROM n1 JOIN n2 USING (run_id) GROUP BY n1.run_id, n2.n""",
}
