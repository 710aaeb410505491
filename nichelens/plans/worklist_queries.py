"""Queries and SQL of work queues, decisions, caches, retention and source reports.

The test tables hold no decisions of a judge: snapshots of version v1 stand in for them, keep from 50 points on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.functions.constants import PAIN_MARKERS, TRANSIENT_MARKERS
from nichelens.functions.text import canonical_phrase, content_hash, has_marker
from nichelens.operators import worklists as w
from nichelens.operators.flow import within_budget
from nichelens.operators.history import moves
from nichelens.operators.matching import phrase_matches
from nichelens.operators.ordering import first_per, latest_per
from nichelens.operators.skew import broadcast_if_small
from nichelens.plans.lake_queries import _HASH, _P, _T, products, texts
from nichelens.plans.score_queries import _S, ORDER, newest, scores
from nichelens.plans.signal_queries import _LAKE, _MARK, _canon, _re, lake
from nichelens.session import materialize, table, utc_day
from nichelens.sources.parsers import parse_items

KEEP_FROM = 50.0
_AT = ["scored_at", "run_id"]


def decisions(spark, d) -> DataFrame:
    s = scores(spark, d).where("weights_version = 'v1' and phrase is not null")
    return s.select("candidate_id", "phrase", "category", *_AT, F.when(F.col("mgs") >= KEEP_FROM, "keep").otherwise("drop").alias("decision"))


def pending_decisions(spark, d):
    """Candidates without a decision, best newest score first."""
    r = w.open_work(newest(spark, d).select("candidate_id", "phrase", "mgs"), decisions(spark, d), "candidate_id", [F.desc_nulls_last("mgs"), F.asc_nulls_first("phrase"), F.asc("candidate_id")])
    return r.select("place", "candidate_id", "phrase", "mgs")


def newest_decision(spark, d):
    """The newest decision about each phrase, with the one of each of its candidates' names."""
    r = latest_per(decisions(spark, d), ["phrase"], [*_AT, "candidate_id", "category"])
    return r.select("phrase", "candidate_id", "decision")


def top_kept(spark, d):
    """The thirty best of the candidates whose newest decision is keep."""
    r = w.with_decisions(newest(spark, d), decisions(spark, d).withColumn("at", F.col("scored_at")).withColumn("in_run", F.col("run_id")), "candidate_id", ["at", "in_run"])
    return r.where("status = 'kept'").orderBy(F.desc("mgs"), "phrase", "candidate_id").limit(30).select("candidate_id", "phrase", "mgs")


def candidate_status(spark, d):
    r = w.with_decisions(newest(spark, d), decisions(spark, d).withColumn("at", F.col("scored_at")).withColumn("in_run", F.col("run_id")), "candidate_id", ["at", "in_run"])
    return r.groupBy("category", "status", "label").agg(F.count("*").alias("n"))


def _calls(spark, d) -> DataFrame:
    """Answers as calls of a model: the run is the model, the category the gate."""
    p = products(spark, d).select("product_id", "run_id", "phrase", "category", F.length("record").cast("bigint").alias("tokens"))
    key = w.cache_key(F.lit("extractor"), F.coalesce("run_id", F.lit("")), phrase=F.col("phrase"), category=F.col("category"))
    return p.withColumn("key", key)


def cache_keys(spark, d):
    return _calls(spark, d).select("product_id", "key")


def cache_spend(spark, d):
    """Per category: calls, entries (the first write of each key), those still valid at the start of the newest run, and tokens spent on entries."""
    runs = table(spark, d, "runs").select(F.col("id").alias("run_id"), "started_at")
    now = runs.agg(F.max("started_at")).first()[0]
    calls = _calls(spark, d).join(broadcast_if_small(runs), "run_id")
    e = w.first_writes(calls, None, "key", ["product_id"], "started_at").groupBy("category").agg(F.count("*").alias("entries"), F.count_if(F.col("expires_at") > F.lit(now)).alias("valid"), F.sum("tokens").alias("tokens"))
    n = calls.groupBy("category").agg(F.count("*").alias("calls"))
    return n.join(e, n.category.eqNullSafe(e.category)).select(n.category, "calls", "entries", "valid", "tokens")


def ttl_retained(spark, d):
    """What a sweep of 30 days leaves of the raw items and, protected, of the runs."""
    i, r = table(spark, d, "raw_items"), table(spark, d, "runs")
    as_of = F.lit(i.agg(F.max("fetched_at")).first()[0])
    left = materialize(w.retained(i, "fetched_at", as_of, 30).select("id", "source_id"), "retained")
    a = left.groupBy("source_id").agg(F.count("*").alias("n"), F.min("id").cast("string").alias("least"))
    b = w.retained(r, "started_at", as_of, 30, protected=True).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return a.select(F.lit("raw_items").alias("tab"), "source_id", "n", "least").unionByName(b.select(F.lit("runs").alias("tab"), F.lit(None).cast("string").alias("source_id"), "n", "least"))


def source_outcomes(spark, d):
    """How each source fared in each run."""
    start = F.substring(F.ltrim("payload"), 1, 1)
    i = table(spark, d, "raw_items").select("id", "run_id", "source_id", content_hash(F.array("payload")).alias("own_hash"), F.coalesce(start.isin("{", "[", "<"), F.lit(False)).alias("parsed"))
    return w.outcomes(i, table(spark, d, "sources"))


def spend_daily(spark, d):
    """Items and bytes per source and day against the source's budget."""
    i = table(spark, d, "raw_items").where("fetched_at is not null")
    g = i.groupBy("source_id", utc_day(i, "fetched_at").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
    s = broadcast_if_small(table(spark, d, "sources").select(F.col("id").alias("source_id"), "budget_per_day"))
    return g.join(s, "source_id", "left").select("source_id", "day", "calls", "bytes", F.round(100.0 * F.col("calls") / F.col("budget_per_day"), 4).alias("burnt"), F.coalesce(F.col("calls") >= F.col("budget_per_day"), F.lit(False)).alias("exhausted"))


def budget_two_caps(spark, d):
    """Items within both a budget of calls and one of bytes (20,000 for each call) of their source and day."""
    i = table(spark, d, "raw_items").where("fetched_at is not null")
    i = i.select("id", "source_id", utc_day(i, "fetched_at").alias("day"), F.coalesce(F.col("byte_size").cast("bigint"), F.lit(0).cast("bigint")).alias("size"))
    cap = F.greatest(F.floor(F.col("budget_per_day") / 50), F.lit(1))
    s = broadcast_if_small(table(spark, d, "sources").select(F.col("id").alias("source_id"), cap.alias("cap"), (cap * 600).alias("byte_cap")))
    rows = materialize(i.join(s, "source_id"), "costs")
    calls = within_budget(rows, ["source_id", "day"], ["id"], F.lit(1).cast("bigint"), "cap").select("id", F.col("allowed").alias("a"))
    size = within_budget(rows, ["source_id", "day"], ["id"], F.col("size"), "byte_cap").select("id", "source_id", F.col("allowed").alias("b"))
    return size.join(calls, "id").groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("a") & F.col("b")).alias("n_allowed"), F.count_if(F.col("a") & ~F.col("b")).alias("n_by_bytes"))


def top_reason(spark, d):
    return w.commonest(products(spark, d), ["run_id"], "reason")


def source_rollup(spark, d):
    """Texts, languages, first and last time of each source, and its first five different texts."""
    t = texts(spark, d).where("source_id is not null")
    g = t.groupBy("source_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"))
    five = w.first_distinct(t.where("text <> ''"), ["source_id"], "text", [F.min(F.coalesce("ts", F.lit("9999-01-01").cast("timestamp"))), F.min("id")], 5, "texts")
    r = g.join(five, "source_id", "left")
    return r.select("source_id", "n", "langs", F.md5(F.array_join("texts", "|")).alias("digest"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


def evidence_caps(spark, d):
    """Of each entity's signals that say something and where: the six newest different quotes and the eight newest different links."""
    s = lake(spark, d).where(w.grounded(F.col("quote"), F.col("url"))).withColumn("name", canonical_phrase(F.col("entity"))).where("name <> ''")
    s = materialize(s.select("name", "quote", "url", (-F.unix_micros("ts")).alias("age"), "id"), "grounded")
    a = w.first_distinct(s, ["name"], "quote", [F.min("age")], 6, "quotes")
    b = w.first_distinct(s, ["name"], "url", [F.min("age")], 8, "urls")
    return a.join(b, "name").select("name", "n_quotes", "n_urls", F.md5(F.array_join("quotes", "|")).alias("quotes"), F.md5(F.array_join("urls", "|")).alias("urls"))


def movers_lists(spark, d):
    r = moves(scores(spark, d).withColumn("ver", F.col("weights_version")), "candidate_id", ["scored_at", "run_id", "weights_version", "category"], "mgs", "ver")
    return w.mover_lists(materialize(r.select("candidate_id", "mgs", F.round("delta", 6).alias("delta"), "previous"), "moves"), "candidate_id", "mgs")


def label_mentions(spark, d):
    """Documents that mention a category's label, whatever its case is."""
    docs = table(spark, d, "documents").groupBy("doc_id").agg(F.max("text").alias("text"))
    c = table(spark, d, "categories").select("id", F.lower("label").alias("needle"))
    hits = phrase_matches(docs.select(F.col("doc_id").alias("text_id"), F.lower("text").alias("haystack")), c.select("needle"))
    n = hits.groupBy("needle").agg(F.count("*").alias("n"))
    return c.join(n, "needle", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def transient_texts(spark, d):
    return texts(spark, d).groupBy("source_id").agg(F.count_if(w.transient(F.col("text"))).alias("n"))


def registry_gaps(spark, d):
    """Sources of signals that are not registered, registered ones without signals, and the rest."""
    return w.membership(table(spark, d, "signals").select("source_id"), table(spark, d, "sources").select(F.col("id").alias("source_id")), "source_id", ("unknown", "missing", "recorded"))


def cited_urls(spark, d):
    """Different links of a source, from its signals and from its items."""
    a = lake(spark, d).select("source_id", "url")
    b = parse_items(table(spark, d, "raw_items")).select("source_id", "url")
    return a.unionByName(b).where("url <> ''").distinct().groupBy("source_id").agg(F.count("*").alias("n"))


def candidate_keys(spark, d):
    """A candidate's key: its canonical phrase and its category, with a separator that neither holds."""
    return scores(spark, d).where("phrase is not null and category is not null").select("candidate_id", F.md5(F.concat_ws("\x1f", canonical_phrase(F.col("phrase")), "category")).alias("key")).distinct()


def cleaned_words(spark, d):
    """The first five words of each phrase, cut to eight characters."""
    return products(spark, d).where("phrase is not null").select("product_id", F.array_join(w.clean_list(F.split("phrase", " "), 5, 8), "|").alias("words"))


def source_cursors(spark, d):
    """The day of a source's newest item, and its greatest id as a text."""
    i = table(spark, d, "raw_items")
    return i.groupBy("source_id").agg(F.max(utc_day(i, "fetched_at")).cast("string").alias("day"), F.max(F.col("id").cast("string")).alias("last_id"))


def pain_bands(spark, d):
    p = table(spark, d, "documents").where("category is not null").groupBy("category").agg((100.0 * F.count_if(has_marker(F.col("text"), PAIN_MARKERS)) / F.count("*")).alias("pain"))
    c = table(spark, d, "categories").select(F.col("id").alias("category")).join(p, "category", "full_outer")
    return c.select("category", F.round("pain", 4).alias("pain"), w.band(F.col("pain"), ((51, "high"), (21, "mid")), "low").alias("band"))


def nightly_verdicts(spark, d):
    """A run is well if neither its first nor its second layer failed or is missing."""
    v = F.from_json("layer_status", "map<string,string>")
    fine = lambda k: F.coalesce(~F.try_element_at(v, F.lit(k)).isin("failed", ""), F.lit(False))
    return table(spark, d, "runs").select("id", F.when(fine("L0") & fine("L1"), "ok").otherwise("failed").alias("verdict"))


def snapshot_age(spark, d):
    """Seconds from each version's newest snapshot to the newest of all."""
    g = scores(spark, d).groupBy("weights_version").agg(F.max("scored_at").alias("t"))
    top = g.agg(F.max("t")).first()[0]
    return g.select("weights_version", F.round((F.unix_micros(F.lit(top)) - F.unix_micros("t")) / 1e6, 3).alias("age"))


def payload_routes(spark, d):
    """Which parser a payload goes to, by the field it holds."""
    has = lambda k: F.get_json_object("payload", f"$.{k}").isNotNull()
    js = F.ltrim("payload").startswith("{")
    route = F.when(F.ltrim("payload").startswith("<"), "feed").when(js & has("data"), "wrapped").when(js & has("title"), "titled").when(js & has("name"), "named").otherwise("other")
    return table(spark, d, "raw_items").groupBy("source_id", route.alias("route")).agg(F.count("*").alias("n"))


def relabelled_cases(spark, d):
    """Golden labels from each candidate's first snapshot, with the newest label and a note where it changed."""
    first = first_per(scores(spark, d), ["candidate_id"], [*ORDER, "category"]).select("candidate_id", F.col("fad_label").alias("old"))
    r = first.join(newest(spark, d).select("candidate_id", F.col("fad_label").alias("new")), "candidate_id")
    moved = ~F.col("old").eqNullSafe(F.col("new"))
    return r.select("candidate_id", F.coalesce("new", "old").alias("label"), F.concat_ws("; ", F.lit("golden"), F.when(moved, F.concat(F.lit("was "), F.coalesce("old", F.lit("unlabelled"))))).alias("note"))


def rerun_candidates(spark, d):
    """The candidates of the newest run that has scores, in the order of their ids, with their newest scores."""
    s = scores(spark, d).where("run_id is not null")
    last = s.agg(F.max(F.struct("scored_at", "run_id")).alias("m")).first()["m"]
    ids = s.where(F.col("run_id") == (last["run_id"] if last else "")).select("candidate_id").distinct()
    return newest(spark, d).join(ids, "candidate_id", "left_semi").select("candidate_id", "phrase", "mgs")


QUERIES = {
    f.__name__: f
    for f in (
        pending_decisions, newest_decision, top_kept, candidate_status, cache_keys, cache_spend, ttl_retained, source_outcomes, spend_daily, budget_two_caps, top_reason, source_rollup, evidence_caps, movers_lists,
        label_mentions, transient_texts, registry_gaps, cited_urls, candidate_keys, cleaned_words, source_cursors, pain_bands, nightly_verdicts, snapshot_age, payload_routes, relabelled_cases, rerun_candidates,
    )
}
_D = _S + f""", jd AS (SELECT candidate_id, phrase, category, scored_at, run_id, CASE WHEN mgs >= {KEEP_FROM} THEN 'keep' ELSE 'drop' END decision FROM sc WHERE weights_version = 'v1' AND phrase IS NOT NULL),
ld AS (SELECT candidate_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at DESC, run_id DESC NULLS LAST, decision DESC) q FROM jd) WHERE q = 1),
st AS (SELECT nw.*, decision, CASE decision WHEN 'keep' THEN 'kept' WHEN 'drop' THEN 'dropped' ELSE 'active' END status, coalesce('judge: ' || decision, 'unjudged') AS label FROM nw LEFT JOIN ld USING (candidate_id))"""
_COLL = "trim(regexp_replace({0}, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))"
_CALL = f"""{_P}, cl AS (SELECT product_id, run_id, category, length(record) tokens, sha256('extractor|' || coalesce(run_id, '') || '|' || CAST(json_object('category', {_COLL.format('category')}, 'phrase', {_COLL.format('phrase')}) AS VARCHAR)) AS key FROM p)"""
_DAY = "CAST(fetched_at AT TIME ZONE 'UTC' AS DATE)"
_MOVE = _S + """, mv AS (SELECT * FROM (SELECT candidate_id, mgs, lag(mgs) OVER g pm, lag(weights_version) OVER g pv, weights_version v, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at DESC, run_id DESC NULLS LAST, weights_version DESC NULLS LAST, category DESC NULLS LAST) q FROM sc
  WINDOW g AS (PARTITION BY candidate_id ORDER BY scored_at, run_id NULLS FIRST, weights_version NULLS FIRST, category NULLS FIRST)) WHERE q = 1), md AS (SELECT candidate_id, mgs, pm, CASE WHEN pv IS NOT DISTINCT FROM v THEN round(mgs - pm, 6) END delta FROM mv)"""
SQL = {
    "pending_decisions": _D + " SELECT row_number() OVER (ORDER BY mgs DESC NULLS LAST, phrase NULLS FIRST, candidate_id) place, candidate_id, phrase, mgs FROM nw WHERE candidate_id NOT IN (SELECT candidate_id FROM jd)",
    "newest_decision": _D + " SELECT phrase, candidate_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY scored_at DESC, run_id DESC NULLS LAST, candidate_id DESC, category DESC NULLS LAST) q FROM jd) WHERE q = 1",
    "top_kept": _D + " SELECT candidate_id, phrase, mgs FROM st WHERE status = 'kept' ORDER BY mgs DESC, phrase, candidate_id LIMIT 30",
    "candidate_status": _D + " SELECT category, status, label, count(*) n FROM st GROUP BY ALL",
    "cache_keys": f"WITH {_CALL} SELECT product_id, key FROM cl",
    "cache_spend": f"""WITH {_CALL}, c2 AS (SELECT cl.*, started_at FROM cl JOIN runs r ON r.id = cl.run_id), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY product_id) q FROM c2) WHERE q = 1),
      g AS (SELECT category, count(*) entries, count(*) FILTER (started_at + INTERVAL 30 DAY > (SELECT max(started_at) FROM runs)) valid, CAST(sum(tokens) AS BIGINT) tokens FROM e GROUP BY 1), n AS (SELECT category, count(*) calls FROM c2 GROUP BY 1)
      SELECT n.category, calls, entries, valid, tokens FROM n JOIN g ON n.category IS NOT DISTINCT FROM g.category""",
    "ttl_retained": """SELECT 'raw_items' tab, source_id, count(*) n, CAST(min(id) AS VARCHAR) "least" FROM raw_items WHERE NOT coalesce(fetched_at < (SELECT max(fetched_at) FROM raw_items) - INTERVAL 30 DAY, false) GROUP BY 2 UNION ALL SELECT 'runs', NULL, count(*), min(id) FROM runs""",
    "source_outcomes": f"""WITH i AS (SELECT id, run_id, source_id, {_HASH} h, coalesce(left(ltrim(payload), 1) IN ('{{', '[', '<'), false) ok FROM raw_items), f AS (SELECT *, min(id) OVER (PARTITION BY source_id, h) AS first FROM i),
      g AS (SELECT run_id, source_id, count(*) items, count(*) FILTER (NOT ok) unparsed, count(*) FILTER (id > first AND h IS NOT NULL AND source_id IS NOT NULL) repeated FROM f GROUP BY 1, 2)
      SELECT *, CASE WHEN unparsed = items THEN 'failed' WHEN repeated = items THEN 'identical' WHEN unparsed > 0 THEN 'degraded' ELSE 'ok' END status FROM g
      UNION ALL SELECT NULL, id, 0, 0, 0, CASE WHEN enabled THEN 'silent' ELSE 'skipped' END FROM sources WHERE id NOT IN (SELECT source_id FROM raw_items WHERE source_id IS NOT NULL)""",
    "spend_daily": f"""WITH g AS (SELECT source_id, CAST({_DAY} AS VARCHAR) AS day, count(*) calls, CAST(coalesce(sum(byte_size), 0) AS BIGINT) bytes FROM raw_items WHERE fetched_at IS NOT NULL GROUP BY ALL)
      SELECT source_id, day, calls, bytes, round(100.0::DOUBLE * calls / budget_per_day, 4) burnt, coalesce(calls >= budget_per_day, false) exhausted FROM g LEFT JOIN sources s ON s.id = g.source_id""",
    "budget_two_caps": f"""WITH i AS (SELECT r.source_id, row_number() OVER w - 1 c, sum(coalesce(byte_size, 0)) OVER w - coalesce(byte_size, 0) b, greatest(s.budget_per_day // 50, 1) cap FROM raw_items r JOIN sources s ON s.id = r.source_id WHERE fetched_at IS NOT NULL WINDOW w AS (PARTITION BY r.source_id, {_DAY} ORDER BY r.id ROWS UNBOUNDED PRECEDING))
      SELECT source_id, count(*) n, count(*) FILTER (c < cap AND b < cap * 600) n_allowed, count(*) FILTER (c < cap AND b >= cap * 600) n_by_bytes FROM i GROUP BY 1""",
    "top_reason": f"WITH {_P}, c AS (SELECT run_id, reason, count(*) n FROM p WHERE reason <> '' GROUP BY ALL) SELECT run_id, reason AS top, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, reason DESC) q FROM c) WHERE q = 1",
    "source_rollup": f"""WITH {_T}, u AS (SELECT source_id, text, min(coalesce(ts, TIMESTAMPTZ '9999-01-01 00:00:00+00')) t0, min(id) i0 FROM t WHERE source_id IS NOT NULL AND text <> '' GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t0, i0, encode(text)) q FROM u), f AS (SELECT source_id, md5(string_agg(text, '|' ORDER BY q) FILTER (q <= 5)) digest, count(*) n_texts FROM k GROUP BY 1)
      SELECT t.source_id, count(*) n, coalesce(array_to_string(list_sort(list_distinct(list(lang))), ','), '') langs, any_value(digest) digest, coalesce(any_value(n_texts), 0) n_texts FROM t LEFT JOIN f USING (source_id) WHERE t.source_id IS NOT NULL GROUP BY 1""",
    "evidence_caps": f"""WITH {_LAKE}, g AS (SELECT {_canon('entity')} AS name, quote, url, ts FROM s WHERE trim(quote) <> '' AND trim(url) <> ''), g2 AS (SELECT * FROM g WHERE name <> ''),
      q AS (SELECT name, quote, row_number() OVER (PARTITION BY name ORDER BY max(ts) DESC, encode(quote)) k FROM g2 GROUP BY 1, 2), u AS (SELECT name, url, row_number() OVER (PARTITION BY name ORDER BY max(ts) DESC, encode(url)) k FROM g2 GROUP BY 1, 2),
      a AS (SELECT name, count(*) n_quotes, md5(string_agg(quote, '|' ORDER BY k) FILTER (k <= 6)) quotes FROM q GROUP BY 1), b AS (SELECT name, count(*) n_urls, md5(string_agg(url, '|' ORDER BY k) FILTER (k <= 8)) urls FROM u GROUP BY 1)
      SELECT name, n_quotes, n_urls, quotes, urls FROM a JOIN b USING (name)""",
    "movers_lists": _MOVE + """ SELECT list, CAST(place AS INT) place, candidate_id FROM (SELECT 'risers' list, row_number() OVER (ORDER BY delta DESC, candidate_id) place, candidate_id FROM md WHERE delta > 0
      UNION ALL SELECT 'fallers', row_number() OVER (ORDER BY delta, candidate_id), candidate_id FROM md WHERE delta < 0 UNION ALL SELECT 'new', row_number() OVER (ORDER BY mgs DESC, candidate_id), candidate_id FROM md WHERE pm IS NULL) WHERE place <= CASE list WHEN 'new' THEN 30 ELSE 10 END""",
    "label_mentions": "WITH x AS (SELECT doc_id, max(text) t FROM documents GROUP BY 1) SELECT id, (SELECT count(*) FROM x WHERE contains(lower(t), lower(label))) n FROM categories",
    "transient_texts": f"WITH {_T} SELECT source_id, count(*) FILTER ({' OR '.join(f'''contains(lower(text), '{m}')''' for m in TRANSIENT_MARKERS)}) n FROM t GROUP BY 1",
    "registry_gaps": "WITH a AS (SELECT DISTINCT source_id FROM signals WHERE source_id IS NOT NULL) SELECT coalesce(source_id, id) source_id, CASE WHEN id IS NULL THEN 'unknown' WHEN source_id IS NULL THEN 'missing' ELSE 'recorded' END state FROM a FULL JOIN sources s ON s.id = a.source_id",
    "cited_urls": f"""WITH {_LAKE}, j AS (SELECT source_id, payload, CASE WHEN ltrim(payload) LIKE '{{%' THEN payload END p FROM raw_items), e AS (SELECT *, CASE WHEN json_exists(p, '$.data') THEN json_extract(p, '$.data') ELSE p END q FROM j),
      u AS (SELECT source_id, CASE WHEN p IS NOT NULL THEN coalesce(q->>'$.url', q->>'$.permalink') ELSE replace(regexp_extract(payload, '(?s)<link>(.*?)</link>', 1), '&amp;', '&') END url FROM e UNION ALL SELECT source_id, url FROM s)
      SELECT source_id, count(DISTINCT url) n FROM u WHERE url <> '' GROUP BY 1""",
    "candidate_keys": _S + f" SELECT DISTINCT candidate_id, md5({_canon('phrase')} || chr(31) || category) AS key FROM sc WHERE phrase IS NOT NULL AND category IS NOT NULL",
    "cleaned_words": f"WITH {_P} SELECT product_id, coalesce(array_to_string(([left(trim(x), 8) FOR x IN string_split(phrase, ' ') IF trim(x) <> ''])[1:5], '|'), '') words FROM p WHERE phrase IS NOT NULL",
    "source_cursors": f"SELECT source_id, CAST(max({_DAY}) AS VARCHAR) AS day, max(CAST(id AS VARCHAR)) last_id FROM raw_items GROUP BY 1",
    "pain_bands": f"""WITH p AS (SELECT category, 100.0::DOUBLE * count(*) FILTER ({_MARK.format('text', _re(PAIN_MARKERS))}) / count(*) pain FROM documents WHERE category IS NOT NULL GROUP BY 1)
      SELECT coalesce(category, id) category, round(pain, 4) pain, CASE WHEN pain IS NULL THEN 'na' WHEN pain >= 51 THEN 'high' WHEN pain >= 21 THEN 'mid' ELSE 'low' END band FROM p FULL JOIN categories c ON c.id = p.category""",
    "nightly_verdicts": """SELECT id, CASE WHEN coalesce(layer_status->>'$.L0' NOT IN ('failed', ''), false) AND coalesce(layer_status->>'$.L1' NOT IN ('failed', ''), false) THEN 'ok' ELSE 'failed' END verdict FROM runs""",
    "snapshot_age": _S + " SELECT weights_version, round((epoch_us((SELECT max(scored_at) FROM sc)) - epoch_us(max(scored_at))) / 1e6::DOUBLE, 3) age FROM sc GROUP BY 1",
    "payload_routes": """SELECT source_id, CASE WHEN ltrim(payload) LIKE '<%' THEN 'feed' WHEN p->>'$.data' IS NOT NULL THEN 'wrapped' WHEN p->>'$.title' IS NOT NULL THEN 'titled' WHEN p->>'$.name' IS NOT NULL THEN 'named' ELSE 'other' END route, count(*) n
      FROM (SELECT *, CASE WHEN ltrim(payload) LIKE '{%' THEN payload END p FROM raw_items) GROUP BY ALL""",
    "relabelled_cases": _S + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY scored_at, run_id NULLS FIRST, weights_version NULLS FIRST, category NULLS FIRST) q FROM sc) WHERE q = 1)
      SELECT candidate_id, coalesce(nw.fad_label, f.fad_label) AS label, 'golden' || CASE WHEN f.fad_label IS DISTINCT FROM nw.fad_label THEN '; was ' || coalesce(f.fad_label, 'unlabelled') ELSE '' END note FROM f JOIN nw USING (candidate_id)""",
    "rerun_candidates": _S + ", l AS (SELECT run_id FROM sc WHERE run_id IS NOT NULL ORDER BY scored_at DESC, run_id DESC LIMIT 1) SELECT candidate_id, phrase, mgs FROM nw WHERE candidate_id IN (SELECT candidate_id FROM sc WHERE run_id = (SELECT run_id FROM l))",
}
