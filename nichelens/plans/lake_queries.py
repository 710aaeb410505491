"""Queries and SQL over raw items, texts and extracted products, and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.functions.text import content_hash, record_field
from nichelens.operators import extraction
from nichelens.operators.flow import token_bucket, within_budget
from nichelens.operators.ordering import global_row_number
from nichelens.operators.skew import broadcast_if_small
from nichelens.operators.store import expired
from nichelens.session import materialize, scratch_dir, table, utc_day
from nichelens.sources.parsers import parse_items
from nichelens.streaming.ingest import ingest, read_files


def texts(spark, d) -> DataFrame:
    return table(spark, d, "chunk_texts").dropDuplicates(["id"])


def products(spark, d) -> DataFrame:
    """Products once each; where an answer was not taken apart, phrase and category come from ``record``."""
    p = table(spark, d, "extracted_products").dropDuplicates(["product_id"])
    return p.withColumns({c: F.coalesce(c, record_field(F.col("record"), c)) for c in ("phrase", "category")})


def text_dedup(spark, d):
    return extraction.dedup_texts(texts(spark, d)).select("id", "copies")


def chunk_assign(spark, d):
    return extraction.assign_chunks(texts(spark, d)).select("id", "text_no", "chunk_no")


def chunk_prompt_digest(spark, d):
    """Size and digest of each chunk's prompt."""
    r = extraction.chunk_prompts(extraction.assign_chunks(texts(spark, d)))
    return r.select("chunk_no", "n_texts", F.md5("prompt").alias("digest"))


def heuristic_extract(spark, d):
    r = extraction.stand_in_products(extraction.assign_chunks(texts(spark, d)), ["tools_diy", "home_office", "kitchen_dining"])
    return r.select("chunk_no", "phrase", "category", F.element_at("doc_ids", 1).alias("ref"))


def ref_grounding(spark, d):
    return extraction.invented_refs(products(spark, d), texts(spark, d))


def product_union(spark, d):
    return extraction.union_products(products(spark, d))


def rank_products_velocity(spark, d):
    t = texts(spark, d)
    p = products(spark, d).where("phrase is not null and category is not null")
    refs = extraction.ground_refs(p, t, table(spark, d, "categories"))
    r = extraction.rank_products(refs, t, t.agg(F.max("ts")).first()[0])
    return r.select("category", "phrase", "mentions", "n_sources", "stale", F.round("level", 7).alias("level"), F.round("z", 4).alias("z"), F.round("velocity", 4).alias("velocity"), F.coalesce("rank_no", F.lit(0)).alias("rank_no"), F.coalesce("kept", F.lit(False)).alias("kept"))


def content_hashes(spark, d):
    """Own hash of each payload, and whether the delivered one agrees whatever its case is."""
    h = content_hash(F.array("payload"))
    return table(spark, d, "raw_items").select("id", h.alias("own_hash"), (F.lower("content_hash") == h).alias("agrees"))


def payload_skip_last50(spark, d):
    """Items whose hash is among the fifty items of their source before them.

    Positions run through each source; an occurrence is looked for in its own and the previous block of fifty, so a hash with a third of all rows is split by position.
    """
    i = materialize(global_row_number(table(spark, d, "raw_items").where("source_id is not null").select("id", "source_id", content_hash(F.array("payload")).alias("h")), ["source_id", "id"], "n"), "numbered")
    b = F.floor(F.col("n") / 50)
    old = i.select(F.col("source_id").alias("s"), F.col("h").alias("oh"), F.col("n").alias("on"), F.explode(F.array(b, b + 1)).alias("ob"))
    hit = i.withColumn("b", b).join(old, (F.col("source_id") == F.col("s")) & (F.col("h") == F.col("oh")) & (F.col("b") == F.col("ob")) & (F.col("on") < F.col("n")) & (F.col("on") >= F.col("n") - 50), "left_semi")
    return hit.select("id")


def ttl_expire_counts(spark, d):
    i = table(spark, d, "raw_items")
    as_of = F.lit(i.agg(F.max("fetched_at")).first()[0])
    return i.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(expired(F.col("fetched_at"), as_of, 90)).alias("n_expired"))


def budget_wall_cutoff(spark, d):
    """Items beyond their source's daily budget, in order of arrival; budgets are cut to a fiftieth so that they bite."""
    i = table(spark, d, "raw_items").where("fetched_at is not null")
    i = i.select("id", "source_id", utc_day(i, "fetched_at").alias("day"))
    s = broadcast_if_small(table(spark, d, "sources").select(F.col("id").alias("source_id"), F.greatest(F.floor(F.col("budget_per_day") / 50), F.lit(1)).alias("cap")))
    return within_budget(i.join(s, "source_id"), ["source_id", "day"], ["id"], F.lit(1).cast("bigint"), "cap").groupBy("source_id").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


def token_bucket_decisions(spark, d):
    """Decisions of a bucket per source over the arrivals, at a hundredth of the source's rate."""
    i = table(spark, d, "raw_items").select("source_id", "fetched_at")
    s = broadcast_if_small(table(spark, d, "sources").select(F.col("id").alias("source_id"), (F.col("rps") / 100).alias("rate")))
    return token_bucket(i.join(s, "source_id"), "source_id", "fetched_at", "rate").groupBy("source_id", "decision").agg(F.count("*").alias("n"))


def parse_payloads(spark, d):
    """All stored payloads, flat."""
    r = parse_items(table(spark, d, "raw_items"))
    return r.select("id", "source_id", "title", F.md5("body").alias("body_md5"), "url", F.round("value", 4).alias("value"))


def volume_by_source_day(spark, d):
    i = table(spark, d, "raw_items")
    return i.where("fetched_at is not null").groupBy("source_id", utc_day(i, "fetched_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("byte_size").alias("bytes"))


def stream_ingest_dedup(spark, d):
    """The signals read as a stream and appended once per (source, entity, metric, time)."""
    src = f"{d}/signals.parquet"
    schema = spark.read.parquet(src).schema
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    path = src if spark.read.parquet(src).inputFiles()[0].rstrip("/").rsplit("/", 1)[0].endswith("signals.parquet") else f"{d}/signals.parquet*"
    ingest(read_files(spark, path, schema).where("ts is not null"), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/table").groupBy("source_id", "metric").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


QUERIES = {
    f.__name__: f
    for f in (
        text_dedup, chunk_assign, chunk_prompt_digest, heuristic_extract, ref_grounding, product_union, rank_products_velocity, content_hashes, payload_skip_last50, ttl_expire_counts,
        budget_wall_cutoff, token_bucket_decisions, parse_payloads, volume_by_source_day, stream_ingest_dedup,
    )
}
_T = "t AS (SELECT DISTINCT ON (id) * FROM chunk_texts)"
_FIELD = "coalesce({0}, CASE WHEN ltrim(record) LIKE '{{%' THEN json_extract_string(record, '$.{0}') ELSE nullif(trim(regexp_extract(record, '(?:^|[|])\\s*{0}: ([^|]*)', 1)), '') END)"
_P = f"p AS (SELECT DISTINCT ON (product_id) * REPLACE ({_FIELD.format('phrase')} AS phrase, {_FIELD.format('category')} AS category) FROM extracted_products)"
_COLL = "trim(regexp_replace({0}, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))"
_NO = f"WITH {_T}, c AS (SELECT *, row_number() OVER (ORDER BY ts NULLS FIRST, source_id NULLS FIRST, encode(text), id) - 1 text_no FROM t WHERE length(trim(text)) > 0)"
_HASH = "sha256(regexp_replace(replace(replace(payload, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') || chr(0))"


def _sql() -> dict[str, str]:
    from nichelens.plans.signal_queries import _canon, _pct

    return {
        "text_dedup": f"WITH {_T} SELECT min(id) id, count(*) copies FROM t WHERE text IS NOT NULL GROUP BY source_id, ts, {_COLL.format('text')}",
        "chunk_assign": f"{_NO} SELECT id, text_no, text_no // 100 AS chunk_no FROM c",
        "chunk_prompt_digest": f"""{_NO} SELECT text_no // 100 AS chunk_no, CAST(count(*) AS INT) n_texts, md5(string_agg('[' || text_no || '] (' || coalesce(source_id, '') || ', ' || coalesce(strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d'), '') || ') ' || left({_COLL.format('text')}, 500), chr(10) ORDER BY text_no)) digest FROM c GROUP BY 1""",
        "heuristic_extract": f"""{_NO}, r AS (SELECT text_no // 100 AS chunk_no, text_no, row_number() OVER (PARTITION BY text_no // 100 ORDER BY text_no) - 1 r FROM c)
          SELECT chunk_no, 'offline product ' || text_no AS phrase, (['tools_diy', 'home_office', 'kitchen_dining'])[r // 10 + 1] category, text_no AS ref FROM r WHERE r % 10 = 0 AND r < 30""",
        "ref_grounding": f"""WITH {_T}, {_P}, x AS (SELECT product_id, unnest(doc_ids) r FROM p), k AS (SELECT product_id, count(DISTINCT r) kept FROM x WHERE r IN (SELECT id FROM t) GROUP BY 1)
          SELECT product_id, CAST(len(doc_ids) AS INT) refs, coalesce(kept, 0) kept, len(doc_ids) - coalesce(kept, 0) invented FROM p LEFT JOIN k USING (product_id)""",
        "product_union": f"""WITH {_P}, q AS (SELECT *, {_canon('phrase')} canon FROM p WHERE phrase IS NOT NULL AND category IS NOT NULL), x AS (SELECT DISTINCT category, canon, unnest(doc_ids) r FROM q WHERE canon <> ''),
          n AS (SELECT category, canon, count(*) n_refs, min(r) first_ref, max(r) last_ref FROM x GROUP BY ALL), m AS (SELECT category, canon, arg_min(phrase, product_id) phrase, count(DISTINCT product_id) n_products FROM q WHERE canon <> '' GROUP BY ALL)
          SELECT category, canon, phrase, n_products, coalesce(n_refs, 0) n_refs, first_ref, last_ref FROM m LEFT JOIN n USING (category, canon)""",
        "rank_products_velocity": f"""WITH {_T}, {_P}, rf AS (SELECT DISTINCT category, {_canon('phrase')} phrase, unnest(doc_ids) r FROM p WHERE phrase IS NOT NULL AND category IN (SELECT id FROM categories)),
          m AS (SELECT rf.category, rf.phrase, source_id, ts, (SELECT CAST(max(ts) AT TIME ZONE 'UTC' AS DATE) FROM t) - CAST(ts AT TIME ZONE 'UTC' AS DATE) age FROM rf JOIN t ON t.id = r WHERE ts IS NOT NULL AND rf.phrase <> ''),
          s AS (SELECT category, phrase, count(*) mentions, count(DISTINCT source_id) n_sources, max(ts) < (SELECT max(ts) FROM t) - INTERVAL 90 DAY stale,
            round(sum(CASE WHEN age > 364 THEN 0 WHEN age = 364 THEN power(0.7::DOUBLE, 364) ELSE 0.3::DOUBLE * power(0.7::DOUBLE, age) END), 12) lv FROM m GROUP BY ALL),
          z AS (SELECT *, CASE WHEN min(lv) OVER w = max(lv) OVER w THEN 0 ELSE (lv - avg(lv) OVER w) / stddev_samp(lv) OVER w END z, round(lv, 9) v FROM s WHERE NOT stale WINDOW w AS (PARTITION BY category)),
          k AS (SELECT *, {_pct('v', 'category')} velocity FROM z),
          o AS (SELECT *, row_number() OVER (ORDER BY mentions >= 2 DESC, velocity DESC, mentions DESC, phrase, category) rank_no, count(*) OVER () n FROM k)
          SELECT category, phrase, mentions, n_sources, stale, round(lv, 7) AS "level", round(z, 4) z, round(velocity, 4) velocity, rank_no, rank_no <= least(greatest(ceil(n * .05::DOUBLE), 10), n) kept FROM o
          UNION ALL SELECT category, phrase, mentions, n_sources, stale, NULL, NULL, NULL, 0, false FROM s WHERE stale""",
        "content_hashes": f"SELECT id, {_HASH} own_hash, lower(content_hash) = {_HASH} agrees FROM raw_items",
        "payload_skip_last50": f"""WITH i AS (SELECT id, source_id, {_HASH} h, row_number() OVER (PARTITION BY source_id ORDER BY id) n FROM raw_items WHERE source_id IS NOT NULL), l AS (SELECT *, lag(n) OVER (PARTITION BY source_id, h ORDER BY n) before FROM i) SELECT id FROM l WHERE n - before <= 50""",
        "ttl_expire_counts": "SELECT source_id, count(*) n, count(*) FILTER (fetched_at < (SELECT max(fetched_at) FROM raw_items) - INTERVAL 90 DAY) n_expired FROM raw_items GROUP BY 1",
        "budget_wall_cutoff": """WITH i AS (SELECT source_id, row_number() OVER (PARTITION BY source_id, CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) ORDER BY r.id) - 1 spent, greatest(s.budget_per_day // 50, 1) cap FROM raw_items r JOIN sources s ON s.id = r.source_id WHERE fetched_at IS NOT NULL)
          SELECT source_id, count(*) n, count(*) FILTER (spent < cap) n_allowed FROM i GROUP BY 1""",
        "parse_payloads": """WITH j AS (SELECT id, source_id, payload, ltrim(payload) LIKE '{%' AS js, CASE WHEN ltrim(payload) LIKE '{%' THEN payload END p FROM raw_items),
          e AS (SELECT *, CASE WHEN json_exists(p, '$.data') THEN json_extract(p, '$.data') ELSE p END q, replace(replace(replace(replace(replace(regexp_extract(payload, '(?s)<description>(.*?)</description>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') xd FROM j)
          SELECT id, source_id, CASE WHEN js THEN coalesce(q->>'$.title', q->>'$.name') ELSE replace(regexp_extract(payload, '(?s)<title>(.*?)</title>', 1), '&amp;', '&') END title,
            md5(CASE WHEN js THEN coalesce(q->>'$.body', q->>'$.selftext', q->>'$.short_description') ELSE xd END) body_md5,
            CASE WHEN js THEN coalesce(q->>'$.url', q->>'$.permalink') ELSE replace(regexp_extract(payload, '(?s)<link>(.*?)</link>', 1), '&amp;', '&') END url,
            CASE WHEN js THEN round(CAST(coalesce(q->>'$.score', q->>'$.ups', q->>'$.rating') AS DOUBLE), 4) END AS "value" FROM e""",
        "volume_by_source_day": "SELECT source_id, CAST(CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS day, count(*) n, CAST(sum(byte_size) AS BIGINT) AS bytes FROM raw_items WHERE fetched_at IS NOT NULL GROUP BY ALL",
        "stream_ingest_dedup": "WITH k AS (SELECT source_id, entity, metric, ts, min(id) id FROM signals WHERE ts IS NOT NULL GROUP BY ALL) SELECT source_id, metric, count(*) n, min(id) first_id FROM k GROUP BY ALL",
    }


SQL = _sql()
