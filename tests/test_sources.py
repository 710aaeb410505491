import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from nichelens.sources import parsers as p
from nichelens.sources import registry as g
from nichelens.streaming.ingest import deduplicated, hourly_counts, ingest, read_files

NOW = datetime(2026, 9, 20, 12, tzinfo=timezone.utc)


def raw(spark, *parts, **extra):
    rows = [(x if isinstance(x, str) or x is None else json.dumps(x), NOW, *extra.values()) for x in parts]
    return spark.createDataFrame(rows, "part string, fetched_at timestamp" + "".join(f", {k} string" for k in extra))


def test_stories(spark):
    good = {"id": 1, "type": "story", "title": "A", "time": 1_700_000_000, "score": 5, "descendants": 2, "by": "u"}
    r = p.parse_stories(raw(spark, good, {**good, "type": "job"}, {**good, "title": " "}, {**good, "time": None}, "{broken", None)).collect()
    assert len(r) == 1 and r[0].value == 5 and r[0].metadata == {"hn_id": "1", "comments": "2", "author": "u"} and r[0].ts.timestamp() == 1_700_000_000


def test_pageviews_posts_articles(spark):
    w = p.parse_pageviews(raw(spark, {"items": [{"year": "2026", "month": "09", "day": "01", "articles": [{"article": "Main_Page", "views": 9}, {"article": "Sun_hat", "views": 7, "rank": 2}]}]})).collect()
    assert [(r.entity, r.value, r.ts.day) for r in w] == [("Sun hat", 7, 1)]
    post = {"title": "T", "selftext": "x" * 300, "score": 3, "created_utc": 1_700_000_000, "num_comments": 4}
    r = p.parse_posts(raw(spark, {"data": [post]}, [{**post, "selftext": ""}], "oops")).collect()
    assert sorted(len(x.quote) for x in r) == [1, 280]
    a = p.parse_articles(raw(spark, {"articles": [{"title": "T", "url": "https://x.example/", "seendate": "20260901T101112Z"}, {"title": "U", "url": "https://x.example/", "seendate": "bad"}, {"title": "V"}]})).orderBy("entity").collect()
    assert [x.entity for x in a] == ["T", "U"] and a[0].ts.minute == 11 and a[1].ts.hour == 12


def test_feed(spark):
    item = "<rss><channel><item><title>Game [free]</title><link>https://i.example/g</link><description>&lt;p&gt;Nice &amp;amp; small&lt;/p&gt;</description><pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate><price>$4.50</price></item><item><title>B</title><plainTitle>Plain</plainTitle></item></channel></rss>"
    r = p.parse_feed(raw(spark, item, "no feed")).orderBy("entity").collect()
    assert [(x.entity, x.value) for x in r] == [("Game", 4.5), ("Plain", 0)] and r[0].ts.day == 1 and r[0].quote == "Nice & small" and r[1].ts.day == 20


def test_two_signals_each(spark):
    a = p.parse_apps(raw(spark, {"results": [{"trackName": "App", "averageUserRating": 4.5, "userRatingCount": 10, "releaseDate": "2026-01-02T03:04:05Z"}]})).collect()
    assert {(x.metric, x.value) for x in a} == {("itunes_rating", 4.5), ("itunes_ratings", 10)} and a[0].ts.hour == 3
    w = p.parse_plugins(raw(spark, {"plugins": [{"name": "A &amp; B", "slug": "ab", "rating": 90, "active_installs": 100, "last_updated": "2026-09-01 3:04pm GMT"}]})).collect()
    assert {(x.metric, x.value, x.entity) for x in w} == {("wp_rating", 90, "A & B"), ("wp_installs", 100, "A & B")} and w[0].ts.day == 1


def test_statuses_works_shops(spark):
    s = p.parse_statuses(raw(spark, [{"content": "<p>Hi &amp; bye</p>", "spoiler_text": "cw", "created_at": "2026-09-01T10:00:00.000Z", "favourites_count": 1, "reblogs_count": 2}, {"content": "<p></p>", "created_at": "2026-09-01T10:00:00.000Z"}, {"content": "x", "created_at": "bad"}])).collect()
    assert [(x.entity, x.value) for x in s] == [("cw: Hi & bye", 3)]
    w = p.parse_works(raw(spark, {"results": [{"id": "https://w.example/1", "title": "T", "cited_by_count": -1, "publication_date": "2026-09-01", "abstract_inverted_index": {"world": [1], "hello": [0, 2], "late": [2]}}, {"title": "U", "publication_date": "2026-09-02"}]})).orderBy("entity").collect()
    assert w[0].quote == "hello world hello" and w[0].value == 0 and w[1].quote == "U"
    prod = lambda t, price: {"title": t, "handle": "h", "body_html": "<b>x</b>", "published_at": "2026-09-01T10:00:00+02:00", "variants": [{"price": price}] if price else []}
    r = p.parse_shops(raw(spark, {"products": [prod("A", "9.5"), prod("B", "-1"), prod("C", None)]}, None, host="shop.example")).collect()
    assert [(x.entity, x.value, x.url, x.ts.hour) for x in r] == [("A", 9.5, "https://shop.example/products/h", 8)]


def test_suggestions_listings_launches_shopping(spark):
    s = p.parse_suggestions(raw(spark, ["seed", [f"c{i}" for i in range(12)]], "[]")).collect()
    assert sorted(x.value for x in s) == [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    pages = [{"total": 7, "itemSummaries": [{"price": {"value": "5"}}, {"price": {"value": "9"}}]}, {"total": 8, "itemSummaries": [{"price": {"value": "7"}}, {}]}]
    e = p.parse_listings(raw(spark, *pages, phrase="mat")).collect()
    assert [(x.value, x.metadata["price_median"], x.metadata["priced"]) for x in e] == [(8, "7.00", "3")]
    assert p.parse_listings(raw(spark, {"total": 0}, phrase="none")).count() == 0
    l = p.parse_launches(raw(spark, {"data": {"posts": {"edges": [{"node": {"name": "N", "votesCount": -3, "createdAt": "2026-09-01T00:00:00Z"}}]}}})).collect()
    assert [(x.entity, x.value) for x in l] == [("N", 0)]
    o = p.parse_shopping(raw(spark, {"inline_shopping": [{"extracted_price": 4.0, "rating": 0, "seller": "a"}, {"price": "$1,200.50", "rating": 4, "seller": "b"}, {"seller": " "}]}, phrase="mat")).collect()
    assert [(x.value, x.metadata["price_max"], x.metadata["sellers"], x.metadata["avg_rating"]) for x in o] == [(3, "1200.50", "2", "4.00")]
    assert p.parse_shopping(raw(spark, {"inline_shopping": [{"seller": "a"}]}, phrase="x")).count() == 0


def test_registry(spark):
    s = spark.createDataFrame([("ok", 1, "S", ["L0"], 10, 1.0, True, ["a.example"]), ("Bad", 2, "A", ["L0", "L0"], 0, 0.0, False, ["https://x"])], "id string, ord int, tier string, layers array<string>, budget_per_day int, rps double, enabled boolean, domains array<string>")
    assert g.violations(s).where("id = 'Bad'").count() == 6 and g.violations(s).where("id = 'ok'").count() == 0
    assert [r.id for r in g.for_layer(s, "L0").collect()] == ["ok"] and g.allowed_domains(s).count() == 1
    rec = g.Recorded({"https://x/a?b=1&after=5": {"body": "old"}, "https://x/a?after=9&b=1": {"body": "new"}})
    assert rec.get("https://x/a?after=5&b=1")["body"] == "old" and rec.get("https://x/a?b=1&after=77")["body"] == "new" and rec.get("https://x/z") is None
    assert g.merged_settings({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    d = spark.createDataFrame([(date(2026, 9, 1),), (None,), (date(2026, 9, 19),)], "w date").select(g.days_to_fetch(F.col("w"), F.lit(date(2026, 9, 20))).alias("d")).collect()
    assert [len(r.d) for r in d] == [3, 1, 0]
    assert g.requests(spark, "s", ["a b"], "https://x/?q={}").first().url == "https://x/?q=a b"


def test_stream_is_idempotent(spark, tmp_path):
    row = "id long, source_id string, entity string, metric string, value double, ts timestamp, metadata map<string,string>"
    df = spark.createDataFrame([(1, "s", "e", "m", 1.0, NOW, {"a": "b"}), (2, "s", "e", "m", 1.0, NOW, None), (3, "s", "f", "m", 2.0, NOW, None)], row)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(src)
    for turn in range(2):
        ingest(read_files(spark, src, df.schema), out, str(tmp_path / f"c{turn}")).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]
    for name, plan, n in (("one", deduplicated(read_files(spark, src, df.schema)), 2), ("two", hourly_counts(read_files(spark, src, df.schema)), None)):
        q = plan.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        if n is not None:
            assert spark.table(name).count() == n
