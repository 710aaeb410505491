"""Queries and SQL over the signals: percentiles, series, features and composite scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichelens.functions.constants import ALPHA, COMPLEXITY_MARKERS, ENGAGEMENT_KEYS, INTENT_MARKERS, PAIN_MARKERS, PENALTIES
from nichelens.functions.numbers import ewma_series
from nichelens.functions.text import canonical_phrase, collapse, engagement, has_marker, markers_in, normalize_phrase, penalty_terms, revenue_seed, tokens_of
from nichelens.operators import scoring
from nichelens.operators.ordering import group_stats, percentile_ranks, zscores
from nichelens.operators.scoring import attention_points, since
from nichelens.operators.series import daily_maps, dense, entity_features
from nichelens.operators.skew import broadcast_if_small
from nichelens.session import materialize, table


def lake(spark: SparkSession, d: str) -> DataFrame:
    """The valid signals, each once: values from 0 up, a time, an entity."""
    return table(spark, d, "signals").where("value >= 0 and ts is not null and trim(entity) <> ''").dropDuplicates(["id"])


def newest(df: DataFrame, ts: str = "ts") -> datetime:
    """The reference instant of a table: its latest time."""
    return df.agg(F.max(ts)).first()[0]


def points(spark: SparkSession, d: str) -> tuple[DataFrame, datetime]:
    """Signals with category and canonical entity, as (category, entity, ts, value, text, source_id)."""
    s = lake(spark, d)
    text = F.when(F.length("quote") > 0, F.concat_ws(" | ", "entity", "quote")).otherwise(F.col("entity"))
    p = s.where("category is not null").select("id", "category", canonical_phrase(F.col("entity")).alias("entity"), "ts", "value", text.alias("text"), "source_id")
    return p.where("entity <> ''"), newest(s)


def attention_percentile(spark, d):
    s = lake(spark, d)
    r = attention_points(s, newest(s))
    return r.select("id", "source_id", "metric", F.round("attention", 6).alias("attention"), "text")


def attention_by_entity(spark, d):
    """Attention summed per entity, a ranked top twenty: the smallest whole query."""
    s = lake(spark, d)
    r = attention_points(s, newest(s)).groupBy(canonical_phrase(F.col("entity")).alias("entity")).agg(F.sum(F.round("attention", 6).cast("decimal(18,6)")).cast("double").alias("attention"), F.count("*").alias("n"))
    return r.orderBy(F.desc("attention"), "entity").limit(20)


def percentile_ranks_by_category(spark, d):
    return percentile_ranks(lake(spark, d), ["category"], "value", "p").select("id", F.round("p", 6).alias("percentile"))


def zscore_by_category(spark, d):
    return zscores(lake(spark, d).where("category is not null"), ["category"], "value", "z").select("id", F.round("z", 5).alias("z"))


def summarize_population(spark, d):
    r = group_stats(lake(spark, d).where("category is not null"), ["category"], "value")
    return r.select("category", "n", *[F.round(c, 4).alias(c) for c in ("total", "mean", "median", "sd_sample", "sd_population", "low", "high")])


def daily_series_dense(spark, d):
    """Thirty days of each entity, silent days as 0, one row a day."""
    p, as_of = points(spark, d)
    m = daily_maps(p, ["category", "entity"], as_of.date(), 30, F.col("value"))
    return m.select("category", "entity", F.posexplode(dense(F.col("by_day"), as_of.date(), 30)).alias("i", "v")).select("category", "entity", "i", F.round("v", 4).alias("v"))


def ewma_running(spark, d):
    """Running exponential average of the thirty days of each entity."""
    p, as_of = points(spark, d)
    m = daily_maps(p, ["category", "entity"], as_of.date(), 30, F.col("value"))
    return m.select("category", "entity", F.posexplode(ewma_series(dense(F.col("by_day"), as_of.date(), 30), ALPHA)).alias("i", "v")).select("category", "entity", "i", F.round("v", 7).alias("level"))


def features(spark, d) -> tuple[DataFrame, DataFrame]:
    p, as_of = points(spark, d)
    p = materialize(p, "points")
    return entity_features(p, ["category", "entity"], as_of.date()), p


_ROUNDED = ["volume_30d", "volume_90d", "volume_365d", "volume_prior_60d", "growth", "ewma_30d", "slope_30d", "slope_90d", "slope_365d", "spike_ratio", "seasonality", "evergreen_ratio", "pain_ratio", "intent_ratio", "engagement"]
_WHOLE = ["n_points", "active_days_30d", "active_days_365d", "days_since_last", "pain_signals", "intent_signals", "source_count"]


def entity_feature_vectors(spark, d):
    f, _ = features(spark, d)
    return f.select("category", "entity", *[F.round(c, 4).alias(c) for c in _ROUNDED], *_WHOLE, F.array_join("source_ids", ",").alias("source_ids"))


def samples(p: DataFrame) -> DataFrame:
    """The first five texts of each entity, joined in lower case."""
    w = Window.partitionBy("category", "entity").orderBy("ts", "id")
    few = p.withColumn("_r", F.row_number().over(w)).where("_r <= 5")
    return few.groupBy("category", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: F.lower(x["text"])), " ").alias("sample"))


def _mgs(spark, d, version):
    f, p = features(spark, d)
    interest = None
    if version == "v2":
        s = lake(spark, d)
        interest = scoring.phrase_interest(s, f.select(normalize_phrase(F.col("entity")).alias("needle")), newest(s))
    r = scoring.mgs(f, table(spark, d, "categories").select("id", "price_low", "price_high", "feasibility_prior"), samples(p), interest, version)
    return r.select("category", "entity", *[F.round(c, 3).alias(c) for c in ("dv", "ss", "sp", "mp", "fe", "ci", "mgs")], "small_sample")


def mgs_v1(spark, d):
    return _mgs(spark, d, "v1")


def mgs_v2(spark, d):
    return _mgs(spark, d, "v2")


def fad_classify(spark, d):
    return scoring.fad(features(spark, d)[0]).select("category", "entity", F.round("fad_probability", 4).alias("fad_probability"), "fad_label")


def revenue_triple(spark, d):
    r = scoring.revenue(features(spark, d)[0], table(spark, d, "categories").select("id", "price_low", "price_high"))
    return r.select("category", "entity", "seed", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")])


def revenue_seeds(spark, d):
    p, _ = points(spark, d)
    return p.select("category", "entity").distinct().withColumn("seed", revenue_seed(F.col("entity"), F.col("category"), "rev1"))


def phrase_interest(spark, d):
    s = lake(spark, d)
    r = scoring.phrase_interest(s, s.select(normalize_phrase(F.col("entity")).alias("needle")), newest(s))
    return r.select("needle", "mentions", F.round("talk", 4).alias("talk"), F.round("interest", 4).alias("interest"))


def category_passion(spark, d):
    s = lake(spark, d)
    return scoring.category_passion(s, newest(s)).select("category", F.round("talk", 4).alias("talk"), F.round("passion", 4).alias("passion"))


def engagement_sum(spark, d):
    e = engagement(F.col("metric"), F.col("value"), F.col("metadata"))
    return lake(spark, d).groupBy("source_id", "metric").agg(F.round(F.sum(e), 4).alias("talk"), F.count("*").alias("n"))


def evidence_topk(spark, d):
    """The four newest signals that mention each entity, with how many there are."""
    s = lake(spark, d)
    rows = s.select(F.col("id").alias("text_id"), "ts", "source_id", normalize_phrase(F.concat_ws(" ", F.coalesce("entity", F.lit("")), F.coalesce("quote", F.lit("")))).alias("haystack"))
    hits = scoring.phrase_matches(rows, s.select(normalize_phrase(F.col("entity")).alias("needle"))).join(rows.select("text_id", "ts", "source_id"), "text_id")
    hits = materialize(hits, "hits")
    best = hits.withColumn("rank_no", F.row_number().over(Window.partitionBy("needle").orderBy(F.desc("ts"), "text_id"))).where("rank_no <= 4")
    counts = hits.groupBy("needle").agg(F.count("*").alias("mentions"), F.count_distinct("source_id").alias("n_sources"))
    return best.join(counts, "needle").select("needle", "rank_no", "text_id", "source_id", "mentions", "n_sources")


def pain_intent_markers(spark, d):
    t = F.col("text")
    r = table(spark, d, "documents").groupBy("source").agg(F.count_if(has_marker(t, PAIN_MARKERS)).alias("pain"), F.count_if(has_marker(t, INTENT_MARKERS)).alias("intent"), F.count("*").alias("n"))
    return r.select("*", F.round(F.col("pain") / F.col("n"), 6).alias("pain_ratio"), F.round(F.col("intent") / F.col("n"), 6).alias("intent_ratio"))


def complexity_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", markers_in(F.col("text"), COMPLEXITY_MARKERS).alias("n_markers"))


def phrases(spark, d):
    """Normalized and canonical form, words and penalty terms of every entity and phrase."""
    c = F.col("phrase")
    all_phrases = table(spark, d, "signals").select(F.col("entity").alias("phrase")).union(table(spark, d, "ranked_scores").select("phrase")).where("phrase is not null").distinct()
    return all_phrases.select("phrase", normalize_phrase(c).alias("norm"), canonical_phrase(c).alias("canon"), F.size(tokens_of(c)).alias("n_words"), F.size(penalty_terms(c)).alias("n_penalties"), collapse(c).alias("collapsed"))


def egress_allowed(spark, d):
    """Signals whose link lies on a registered host, or below one registered as '*.suffix', per source."""
    domains = broadcast_if_small(table(spark, d, "sources").select(F.explode("domains").alias("domain")).select(F.lower("domain").alias("domain")).distinct())
    links = lake(spark, d).select("source_id", "url", F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))).alias("h"))
    parts = F.split("h", "\\.")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))).otherwise(F.array().cast("array<string>"))
    hosts = links.select("h").where("h is not null").distinct().select(F.col("h").alias("host"), F.explode(F.concat(F.array("h"), above)).alias("domain")).join(domains, "domain", "left_semi").select("host").distinct()
    s = links.join(broadcast_if_small(hosts), F.col("h") == F.col("host"), "left")
    return s.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("url").isNotNull()).alias("linked"), F.count_if(F.col("host").isNotNull()).alias("allowed"))


_LAKE = """
s AS (SELECT DISTINCT ON (id) * FROM signals WHERE value >= 0 AND ts IS NOT NULL AND trim(entity) <> ''),
ref AS (SELECT max(ts) t FROM s)"""
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[''’ʼ′]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_SING = """CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
 WHEN regexp_matches(w, '(sses|xes|zes|ches|shes)$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '[^suiwae]s$') THEN left(w, length(w) - 1) ELSE w END"""


def _canon(c: str) -> str:
    return f"array_to_string([{_SING} FOR w IN string_split({_NORM.format(c)}, ' ') IF w <> ''], ' ')"


def _pct(v: str, by: str) -> str:
    p = f"PARTITION BY {by}" if by else ""
    return f"CASE WHEN count({v}) OVER ({p}) = 1 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE * (rank() OVER ({p} ORDER BY {v}) - 1 + (count({v}) OVER (PARTITION BY {by + ', ' if by else ''}{v}) - 1) / 2.0::DOUBLE) / (count({v}) OVER ({p}) - 1) END"


def _lits(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_TALK = f"""(CASE WHEN lower(metric) IN ({_lits(ENGAGEMENT_KEYS)}) THEN value ELSE 0 END
 + coalesce(list_sum([greatest(0::DOUBLE, coalesce(try_cast(e.value AS DOUBLE), 0)) FOR e IN map_entries(metadata) IF lower(e.key) IN ({_lits(ENGAGEMENT_KEYS)})]), 0))"""
_TEXT = "CASE WHEN length(quote) > 0 THEN entity || ' | ' || quote ELSE entity END"
_POINTS = f"""{_LAKE},
pt AS (SELECT id, category, {_canon('entity')} entity, ts, CAST(ts AT TIME ZONE 'UTC' AS DATE) d, value, {_TEXT} AS text, source_id, (SELECT CAST(t AT TIME ZONE 'UTC' AS DATE) FROM ref) a FROM s WHERE category IS NOT NULL),
p AS (SELECT *, a - d AS age FROM pt WHERE entity <> '')"""
_MARK = "regexp_matches(lower({0}), '{1}')"


def _re(words) -> str:
    return "|".join(w.replace("'", "''") for w in words)


def _slope(n: int) -> str:
    x = f"CASE WHEN age BETWEEN 0 AND {n - 1} THEN x ELSE 0 END"
    return f"CASE WHEN sum({x}) = 0 THEN 0 ELSE sum((({n} - 1 - age) - ({n} - 1) / 2.0::DOUBLE) * ({x})) / ({n} * ({n}::DOUBLE * {n} - 1) / 12) / abs(sum({x}) / {n}) END"


_FEATURES = f"""{_POINTS},
dd AS (SELECT category, entity, age, d, a, sum(value) x FROM p WHERE age BETWEEN 0 AND 364 GROUP BY ALL),
wk AS (SELECT count(*) FILTER (isodow(g) < 6) nw, count(*) FILTER (isodow(g) >= 6) ne FROM (SELECT CAST(unnest(generate_series(CAST(t AT TIME ZONE 'UTC' AS DATE) - 89, CAST(t AT TIME ZONE 'UTC' AS DATE), INTERVAL 1 DAY)) AS DATE) g FROM ref)),
se AS (SELECT category, entity,
  sum(CASE WHEN age < 30 THEN x ELSE 0 END) volume_30d, sum(CASE WHEN age < 90 THEN x ELSE 0 END) volume_90d, sum(x) volume_365d,
  sum(CASE WHEN age < 30 THEN x * (CASE WHEN age = 29 THEN power(0.7::DOUBLE, 29) ELSE 0.3::DOUBLE * power(0.7::DOUBLE, age) END) ELSE 0 END) ewma_30d,
  {_slope(30)} slope_30d, {_slope(90)} slope_90d, {_slope(365)} slope_365d,
  count(*) FILTER (x > 0 AND age < 30) active_days_30d, count(*) FILTER (x > 0) active_days_365d,
  coalesce(least(max(x) / median(x) FILTER (x > 0), 100), 0) spike_ratio,
  sum(CASE WHEN age < 90 AND isodow(d) < 6 THEN x ELSE 0 END) / (SELECT nw FROM wk) mw, sum(CASE WHEN age < 90 AND isodow(d) >= 6 THEN x ELSE 0 END) / (SELECT ne FROM wk) me
  FROM dd GROUP BY ALL),
fa AS (SELECT category, entity, count(*) n_points, min(age) days_since_last, count(*) FILTER ({_MARK.format('text', _re(PAIN_MARKERS))}) pain_signals,
  count(*) FILTER ({_MARK.format('text', _re(INTENT_MARKERS))}) intent_signals, array_to_string(list_sort(list_distinct(list(source_id) FILTER (source_id <> ''))), ',') source_ids,
  count(DISTINCT source_id) FILTER (source_id <> '') source_count, max(value) engagement FROM p GROUP BY ALL),
f0 AS (SELECT fa.*, coalesce(volume_30d, 0) volume_30d, coalesce(volume_90d, 0) volume_90d, coalesce(volume_365d, 0) volume_365d, coalesce(ewma_30d, 0) ewma_30d, coalesce(slope_30d, 0) slope_30d, coalesce(slope_90d, 0) slope_90d, coalesce(slope_365d, 0) slope_365d,
  coalesce(active_days_30d, 0) active_days_30d, coalesce(active_days_365d, 0) active_days_365d, coalesce(spike_ratio, 0) spike_ratio,
  CASE WHEN coalesce(mw, 0) + coalesce(me, 0) = 0 THEN 0 ELSE least(abs(mw - me) / ((mw + me) / 2), 5) END seasonality FROM fa LEFT JOIN se USING (category, entity)),
f AS (SELECT *, greatest(volume_90d - volume_30d, 0) volume_prior_60d, least(greatest((volume_30d - greatest(volume_90d - volume_30d, 0)) / greatest(greatest(volume_90d - volume_30d, 0), 1), -1), 9) growth,
  active_days_365d / 365.0::DOUBLE evergreen_ratio, pain_signals / n_points::DOUBLE pain_ratio, intent_signals / n_points::DOUBLE intent_ratio FROM f0)"""
_HAY = _NORM.format("coalesce(entity, '') || ' ' || coalesce(quote, '')")
_INTEREST = f"""
hay AS (SELECT id, ts, source_id, {_HAY} h, {_TALK} talk FROM s),
nd AS (SELECT DISTINCT {_NORM.format('entity')} needle FROM @of),
hit AS (SELECT needle, id, ts, source_id, talk FROM hay JOIN nd ON needle <> '' AND contains(h, needle)),
im AS (SELECT needle, count(*) mentions, sum(talk) talk FROM hit WHERE ts >= (SELECT t FROM ref) - INTERVAL 30 DAY GROUP BY needle),
inr AS (SELECT needle, mentions, talk, {_pct('v', '')} interest FROM (SELECT *, round(mentions + talk / 100.0::DOUBLE, 9) v FROM im))"""


def _score(version: str) -> str:
    w = {"v1": (0.30, 0.25, 0.20, 0.15, 0.10, 0.0), "v2": (0.20, 0.20, 0.15, 0.10, 0.10, 0.25)}[version]
    pen = " + ".join(f"CAST(regexp_matches({_NORM.format('entity')}, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INT)" for t in PENALTIES)
    cx = " + ".join(f"CAST(contains(sample, '{m}') AS INT)" for m in COMPLEXITY_MARKERS)
    pct = lambda c: _pct(c, "category")
    rounded = ", ".join(f"round({c}, 9) AS {c}" for c in ("ewma_30d", "growth", "volume_90d", "source_count", "pain_ratio", "pain_signals", "intent_ratio"))
    ci = "coalesce(interest, 0)" if version == "v2" else "0"
    join = f"LEFT JOIN inr ON inr.needle = {_NORM.format('r.entity')}" if version == "v2" else ""
    return f"""WITH {_FEATURES}, {_INTEREST.replace('@of', 'f') if version == 'v2' else 'one AS (SELECT 1)'},
    sm AS (SELECT category, entity, lower(string_agg(text, ' ' ORDER BY ts, id)) sample FROM (SELECT *, row_number() OVER (PARTITION BY category, entity ORDER BY ts, id) k FROM p) WHERE k <= 5 GROUP BY ALL),
    r AS (SELECT q.category, q.entity, price_low, price_high, feasibility_prior, {pct('ewma_30d')} a1, {pct('growth')} a2, {pct('volume_90d')} a3, {pct('source_count')} a4, {pct('pain_ratio')} a5, {pct('pain_signals')} a6, {pct('intent_ratio')} a7, count(*) OVER (PARTITION BY category) pop
      FROM (SELECT category, entity, {rounded} FROM f) q JOIN categories c ON c.id = q.category),
    u AS (SELECT r.category, r.entity, .6::DOUBLE * a1 + .4::DOUBLE * a2 dv, .7::DOUBLE * a3 + .3::DOUBLE * a4 ss, .6::DOUBLE * a5 + .4::DOUBLE * a6 sp,
      .5::DOUBLE * least(greatest(100 * ln((price_low + price_high) / 2 / 10) / ln(40), 0), 100) + .5::DOUBLE * a7 mp, greatest(feasibility_prior - 12 * ({pen.replace('entity', 'r.entity')}) - 6 * ({cx}), 5) fe, {ci}::DOUBLE ci, pop < 5 small_sample
      FROM r LEFT JOIN sm ON sm.category = r.category AND sm.entity = r.entity {join})
    SELECT category, entity, round(dv, 3) dv, round(ss, 3) ss, round(sp, 3) sp, round(mp, 3) mp, round(fe, 3) fe, round(ci, 3) ci,
      round({w[0]}::DOUBLE * dv + {w[1]}::DOUBLE * (100 - ss) + {w[2]}::DOUBLE * sp + {w[3]}::DOUBLE * mp + {w[4]}::DOUBLE * fe + {w[5]}::DOUBLE * ci, 3) mgs, small_sample FROM u"""


QUERIES = {
    f.__name__: f
    for f in (
        attention_percentile, attention_by_entity, percentile_ranks_by_category, zscore_by_category, summarize_population, daily_series_dense, ewma_running,
        entity_feature_vectors, mgs_v1, mgs_v2, fad_classify, revenue_triple, revenue_seeds, phrase_interest, category_passion, engagement_sum, evidence_topk,
        pain_intent_markers, complexity_markers, phrases, egress_allowed,
    )
}
_ATT = f"WITH {_LAKE}, w AS (SELECT *, round(value, 9) v FROM s WHERE ts >= (SELECT t FROM ref) - INTERVAL 365 DAY), r AS (SELECT *, {_pct('v', 'source_id, metric')} pct FROM w)"
SQL = {
    "attention_percentile": f"{_ATT} SELECT id, source_id, metric, round(pct, 6) attention, {_TEXT} AS text FROM r",
    "attention_by_entity": f"{_ATT} SELECT {_canon('entity')} AS entity, CAST(sum(CAST(round(pct, 6) AS DECIMAL(18, 6))) AS DOUBLE) attention, count(*) n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "percentile_ranks_by_category": f"WITH {_LAKE} SELECT id, round({_pct('v', 'category')}, 6) percentile FROM (SELECT *, round(value, 9) v FROM s)",
    "zscore_by_category": f"WITH {_LAKE} SELECT id, round(CASE WHEN min(value) OVER w = max(value) OVER w THEN 0 ELSE (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 5) z FROM s WHERE category IS NOT NULL WINDOW w AS (PARTITION BY category)",
    "summarize_population": f"WITH {_LAKE} SELECT category, count(*) n, round(sum(value), 4) total, round(avg(value), 4) mean, round(median(value), 4) median, round(coalesce(stddev_samp(value), 0), 4) sd_sample, round(stddev_pop(value), 4) sd_population, round(min(value), 4) low, round(max(value), 4) high FROM s WHERE category IS NOT NULL GROUP BY category",
    "daily_series_dense": f"""WITH {_POINTS}, dd AS (SELECT category, entity, 29 - age i, sum(value) x FROM p WHERE age BETWEEN 0 AND 29 GROUP BY ALL)
      SELECT k.category, k.entity, CAST(k.i AS INT) i, round(coalesce(x, 0), 4) v FROM (SELECT DISTINCT category, entity, unnest(range(30)) i FROM dd) k LEFT JOIN dd USING (category, entity, i)""",
    "ewma_running": f"""WITH {_POINTS}, dd AS (SELECT category, entity, 29 - age i, sum(value) x FROM p WHERE age BETWEEN 0 AND 29 GROUP BY ALL),
      k AS (SELECT DISTINCT category, entity, unnest(range(30)) i FROM dd)
      SELECT k.category, k.entity, CAST(k.i AS INT) i, round(coalesce(sum(x * (CASE WHEN dd.i = 0 THEN power(0.7::DOUBLE, k.i) ELSE 0.3::DOUBLE * power(0.7::DOUBLE, k.i - dd.i) END)), 0), 7) AS "level"
      FROM k LEFT JOIN dd ON dd.category = k.category AND dd.entity = k.entity AND dd.i <= k.i GROUP BY ALL""",
    "entity_feature_vectors": f"WITH {_FEATURES} SELECT category, entity, {', '.join(f'round({c}, 4) AS {c}' for c in _ROUNDED)}, {', '.join(_WHOLE)}, source_ids FROM f",
    "mgs_v1": _score("v1"),
    "mgs_v2": _score("v2"),
    "fad_classify": f"""WITH {_FEATURES}, g AS (SELECT *, least(greatest(slope_30d - slope_90d, -2), 2) dv FROM f),
      h AS (SELECT *, 1 / (1 + exp(-(-1 + 1.8::DOUBLE * dv + .8::DOUBLE * least(ln(1 + spike_ratio) / 2, 2) + .5::DOUBLE * least(seasonality / 2, 2) - 1.6::DOUBLE * least(evergreen_ratio, 1) - 1.2::DOUBLE * least(greatest(slope_365d, -2), 2)))) pr FROM g)
      SELECT category, entity, round(pr, 4) fad_probability, CASE WHEN evergreen_ratio >= .35 AND dv < .5 THEN 'evergreen' WHEN pr >= .6 THEN 'fad' ELSE 'trend' END fad_label FROM h""",
    "revenue_seeds": f"WITH {_POINTS} SELECT DISTINCT category, entity, CAST('0x' || left(sha256(entity || '|' || category || '|rev1'), 8) AS BIGINT) seed FROM p",
    "phrase_interest": f"WITH {_LAKE}, {_INTEREST.replace('@of', 's')} SELECT needle, mentions, round(talk, 4) talk, round(interest, 4) interest FROM inr",
    "category_passion": f"WITH {_LAKE}, t AS (SELECT category, sum({_TALK}) talk FROM s WHERE category <> '' AND ts >= (SELECT t FROM ref) - INTERVAL 90 DAY GROUP BY 1) SELECT category, round(talk, 4) talk, round(CASE WHEN max(talk) OVER () > 0 THEN 100 * talk / max(talk) OVER () ELSE 0 END, 4) passion FROM t",
    "engagement_sum": f"WITH {_LAKE} SELECT source_id, metric, round(sum({_TALK}), 4) talk, count(*) n FROM s GROUP BY ALL",
    "evidence_topk": f"""WITH {_LAKE}, {_INTEREST.replace('@of', 's')}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY needle ORDER BY ts DESC, id) AS INT) rank_no, count(*) OVER (PARTITION BY needle) mentions FROM hit),
      n AS (SELECT needle, count(DISTINCT source_id) n_sources FROM hit GROUP BY 1) SELECT needle, rank_no, id AS text_id, source_id, mentions, n_sources FROM k JOIN n USING (needle) WHERE rank_no <= 4""",
    "pain_intent_markers": f"""WITH c AS (SELECT source, count(*) FILTER ({_MARK.format('text', _re(PAIN_MARKERS))}) pain, count(*) FILTER ({_MARK.format('text', _re(INTENT_MARKERS))}) intent, count(*) n FROM documents GROUP BY 1)
      SELECT *, round(pain / n::DOUBLE, 6) pain_ratio, round(intent / n::DOUBLE, 6) intent_ratio FROM c""",
    "complexity_markers": "SELECT doc_id, " + " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{m}') AS INT)" for m in COMPLEXITY_MARKERS) + " AS n_markers FROM documents",
    "phrases": f"""WITH a AS (SELECT entity AS phrase FROM signals UNION SELECT phrase FROM ranked_scores), b AS (SELECT DISTINCT phrase FROM a WHERE phrase IS NOT NULL)
      SELECT phrase, {_NORM.format('phrase')} norm, {_canon('phrase')} canon, CAST(len([w FOR w IN string_split({_NORM.format('phrase')}, ' ') IF w <> '']) AS INT) n_words,
      {' + '.join(f"CAST(regexp_matches({_NORM.format('phrase')}, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INT)" for t in PENALTIES)} n_penalties, trim(regexp_replace(phrase, '[\\s\\p{{Z}}]+', ' ', 'g')) collapsed FROM b""",
    "egress_allowed": f"""WITH {_LAKE}, h AS (SELECT DISTINCT unnest(domains) host FROM sources)
      SELECT source_id, count(*) n, count(url) linked, count(h.host) allowed FROM s LEFT JOIN h ON lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) = h.host GROUP BY 1""",
}
