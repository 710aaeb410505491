"""One query per parser over recorded payloads: what each must give is written out beside them, and the SQL is just that."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from nichelens.sources.parsers import PARSERS

FETCHED = datetime(2026, 9, 20, 12, tzinfo=timezone.utc)
_NOW, _DAY = "2026-09-20 12:00:00", "2026-09-01 00:00:00"
_FEED = (
    "<rss><channel><item><title>Game [free]</title><link>https://i.example/g</link><description>&lt;p&gt;Nice &amp;amp; small&lt;/p&gt;</description>"
    "<pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate><price>$4.50</price></item><item><title>B</title><plainTitle>Plain</plainTitle></item></channel></rss>"
)
_STORY = {"id": 1, "type": "story", "title": "A lamp", "time": 1_700_000_000, "score": 5, "url": "https://x.example/"}
_POST = {"title": "T", "selftext": "body", "score": 3, "created_utc": 1_700_000_000, "num_comments": 4, "permalink": "/r/x/1"}

#: Per source: recorded parts (a part may be malformed), further columns of the rows, and the signals they give: entity, metric, value, ts.
RECORDED: dict[str, tuple[list, dict[str, str], list[tuple[str, str, float, str]]]] = {
    "hn_firebase": ([_STORY, {**_STORY, "type": "job"}, {**_STORY, "title": " "}, {**_STORY, "time": None}, "{broken", None], {}, [("A lamp", "hn_score", 5, "2023-11-14 22:13:20")]),
    "wiki_pageviews": (
        [{"items": [{"year": "2026", "month": "09", "day": "01", "articles": [{"article": "Main_Page", "views": 9}, {"article": "Sun_hat", "views": 7, "rank": 2}]}]}, "[]"],
        {}, [("Sun hat", "wiki_pageviews_top", 7, _DAY)],
    ),
    "arctic_shift": ([{"data": [_POST]}, [{**_POST, "title": "U", "score": 8}], "oops"], {}, [("T", "reddit_score", 3, "2023-11-14 22:13:20"), ("U", "reddit_score", 8, "2023-11-14 22:13:20")]),
    "gdelt_doc": (
        [{"articles": [{"title": "T", "url": "https://x.example/", "seendate": "20260901T101112Z"}, {"title": "U", "url": "https://x.example/", "seendate": "bad"}, {"title": "V"}]}],
        {}, [("T", "gdelt_article", 1, "2026-09-01 10:11:12"), ("U", "gdelt_article", 1, _NOW)],
    ),
    "itch_io": ([_FEED, "no feed"], {}, [("Game", "itch_price", 4.5, "2026-09-01 10:00:00"), ("Plain", "itch_price", 0, _NOW)]),
    "itunes_search": (
        [{"results": [{"trackName": "App", "averageUserRating": 4.5, "userRatingCount": 10, "releaseDate": "2026-01-02T03:04:05Z"}, {"averageUserRating": 1}]}],
        {}, [("App", "itunes_rating", 4.5, "2026-01-02 03:04:05"), ("App", "itunes_ratings", 10, "2026-01-02 03:04:05")],
    ),
    "mastodon_trends": (
        [[{"content": "<p>Hi &amp; bye</p>", "spoiler_text": "cw", "created_at": "2026-09-01T10:00:00.000Z", "favourites_count": 1, "reblogs_count": 2}, {"content": "<p></p>", "created_at": "2026-09-01T10:00:00.000Z"}, {"content": "x", "created_at": "bad"}]],
        {}, [("cw: Hi & bye", "mastodon_engagement", 3, "2026-09-01 10:00:00")],
    ),
    "openalex_arxiv": (
        [{"results": [{"id": "https://w.example/1", "title": "T", "cited_by_count": -1, "publication_date": "2026-09-01"}, {"title": "U", "cited_by_count": 6, "publication_date": "2026-09-01"}]}],
        {}, [("T", "openalex_cited", 0, _DAY), ("U", "openalex_cited", 6, _DAY)],
    ),
    "shopify_public": (
        [{"products": [{"title": "A &amp; B", "handle": "h", "published_at": "2026-09-01T10:00:00+02:00", "variants": [{"price": "9.5"}]}, {"title": "C", "handle": "c", "variants": []}, {"title": "D", "handle": "d", "variants": [{"price": "-1"}]}]}, None],
        {"host": "shop.example"}, [("A & B", "shopify_price", 9.5, "2026-09-01 08:00:00")],
    ),
    "suggest_autocomplete": ([["seed", ["c0", " ", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9", "c10"]], "[]"], {}, [(f"c{i}", "google_suggest", max(1, 10 - i), _NOW) for i in range(11) if i != 1]),
    "wordpress_org": (
        [{"plugins": [{"name": "A &amp; B", "slug": "ab", "rating": 90, "active_installs": 100, "last_updated": "2026-09-01 3:04pm GMT"}]}],
        {}, [("A & B", "wp_rating", 90, _DAY), ("A & B", "wp_installs", 100, _DAY)],
    ),
    "ebay_browse": ([{"total": 7, "itemSummaries": [{"price": {"value": "5"}}]}, {"total": 8, "itemSummaries": [{"price": {"value": "7"}}, {}]}, {"total": 0}], {"phrase": "mat"}, [("mat", "ebay_listings", 8, _NOW)]),
    "producthunt_graphql": (
        [{"data": {"posts": {"edges": [{"node": {"name": "N", "votesCount": -3, "createdAt": "2026-09-01T00:00:00Z"}}, {"node": {"name": "M", "votesCount": 4, "createdAt": "2026-09-01T00:00:00Z"}}]}}}, {"errors": []}],
        {}, [("N", "ph_votes", 0, _DAY), ("M", "ph_votes", 4, _DAY)],
    ),
    "searchapi": ([{"inline_shopping": [{"extracted_price": 4.0, "seller": "a"}, {"price": "$1,200.50", "rating": 4, "seller": "b"}, {"seller": " "}]}], {"phrase": "mat"}, [("mat", "shopping_offers", 3, _NOW)]),
}


def _query(source: str):
    parts, more, _ = RECORDED[source]

    def run(spark, d):
        rows = [(x if x is None or isinstance(x, str) else json.dumps(x), FETCHED, *more.values()) for x in parts]
        raw = spark.createDataFrame(rows, "part string, fetched_at timestamp" + "".join(f", {k} string" for k in more))
        return PARSERS[source](raw).select("source_id", "entity", "metric", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))

    run.__doc__ = f"Signals of recorded payloads of {source}."
    return run


def _rows(source: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(source)}, {quote(e)}, {quote(m)}, {float(v)}::DOUBLE, {quote(t)})" for e, m, v, t in RECORDED[source][2])
    return f'SELECT * FROM (VALUES {values}) t(source_id, entity, metric, "value", ts)'


QUERIES = {f"parsed_{s}": _query(s) for s in RECORDED}
SQL = {f"parsed_{s}": _rows(s) for s in RECORDED}
