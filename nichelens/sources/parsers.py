"""Fetched payloads to signals, one function per kind of source.

Each takes rows (part string, fetched_at timestamp) and gives the signal columns. Malformed payloads and
incomplete records give no row.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIGNAL = ["source_id", "entity", "metric", "value", "ts", "url", "quote", "category", "metadata"]
#: Titles that are no topics.
IGNORED_TITLES = ("Main_Page", "Special:Search", "Wikipedia:Featured_pictures", "-")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


def _plain(c: Column) -> Column:
    """Text of markup: tags to spaces, entities decoded, single spaces."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]*>", " ")), r"\s+", " "))


def _meta(**items: Column) -> Column:
    pairs = [x for k, v in items.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _signals(rows: DataFrame, source: str, entity: Column, metric: Column | str, value: Column, ts: Column, url: Column | None = None, quote: Column | None = None, meta: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    d = rows.select(
        F.lit(source).alias("source_id"), F.trim(entity).alias("entity"), (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), value.cast("double").alias("value"), ts.alias("ts"),
        (none if url is None else url).alias("url"), (none if quote is None else quote).alias("quote"), none.alias("category"), (F.create_map().cast("map<string,string>") if meta is None else meta).alias("metadata"),
    )
    return d.where("entity <> '' and metric <> '' and value is not null and ts is not null and (url is null or url rlike '^https?://')")


def _time(c: Column, fallback: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], fallback)


def parse_stories(raw: DataFrame, source: str = "hn_firebase") -> DataFrame:
    """JSON stories: score, from the epoch second; only records of type story with id, title and time."""
    j = F.from_json("part", "id long, type string, title string, score double, descendants long, time long, by string, url string")
    r = raw.withColumn("j", j).where("j.type = 'story' and j.id is not null and trim(j.title) <> '' and j.time is not null")
    link = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("j.id").cast("string"))
    return _signals(r, source, F.col("j.title"), "hn_score", F.coalesce("j.score", F.lit(0.0)), F.timestamp_seconds("j.time"), link, F.col("j.title"), _meta(hn_id=F.col("j.id"), comments=F.col("j.descendants"), author=F.col("j.by"), outbound=F.col("j.url")))


def parse_pageviews(raw: DataFrame, source: str = "wiki_pageviews") -> DataFrame:
    """Items of articles with views; underscores to spaces, the day's midnight."""
    j = F.from_json("part", "items array<struct<year string, month string, day string, articles array<struct<article string, views double, rank int>>>>")
    r = raw.select(F.explode(j["items"]).alias("i")).select("i", F.explode("i.articles").alias("a")).where(~F.col("a.article").isin(*IGNORED_TITLES))
    ts = F.to_timestamp(F.try_to_timestamp(F.concat_ws("-", "i.year", "i.month", "i.day"), F.lit("yyyy-M-d")))
    return _signals(r, source, F.translate("a.article", "_", " "), "wiki_pageviews_top", F.col("a.views"), ts, F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("a.article")), None, _meta(rank=F.col("a.rank")))


def parse_posts(raw: DataFrame, source: str = "arctic_shift") -> DataFrame:
    """Posts under 'data' or as a bare list; the text's first 280 characters, or the title, as quote."""
    post = "array<struct<id string, title string, selftext string, score double, num_comments long, created_utc double, permalink string, subreddit string>>"
    posts = F.coalesce(F.from_json("part", f"data {post}")["data"], F.when(F.ltrim("part").startswith("["), F.from_json("part", post)))
    r = raw.select(F.explode(posts).alias("p")).where("trim(p.title) <> '' and p.created_utc is not null")
    quote = F.coalesce(F.substring(_filled(F.col("p.selftext")), 1, 280), F.col("p.title"))
    link = F.when(F.col("p.permalink").isNotNull(), F.concat(F.lit("https://www.reddit.com"), F.col("p.permalink")))
    return _signals(r, source, F.col("p.title"), "reddit_score", F.coalesce("p.score", F.lit(0.0)), F.timestamp_seconds(F.col("p.created_utc")), link, quote, _meta(num_comments=F.col("p.num_comments"), subreddit=F.col("p.subreddit")))


def parse_articles(raw: DataFrame, source: str = "gdelt_doc") -> DataFrame:
    """Articles with title and link, value 1 each; a time that can't be read is the fetch time."""
    r = raw.select("fetched_at", F.explode(F.from_json("part", "articles array<struct<title string, url string, seendate string, domain string, language string>>")["articles"]).alias("a"))
    r = r.where("trim(a.title) <> '' and trim(a.url) <> ''")
    return _signals(r, source, F.col("a.title"), "gdelt_article", F.lit(1.0), _time(F.col("a.seendate"), F.col("fetched_at"), "yyyyMMdd'T'HHmmss'Z'"), F.col("a.url"), F.col("a.title"), _meta(domain=F.col("a.domain"), language=F.col("a.language")))


def parse_feed(raw: DataFrame, source: str = "itch_io") -> DataFrame:
    """Items of an RSS feed: the plain title or what stands before '[', the price from 0 up, RFC 2822 dates."""
    items = F.regexp_extract_all("part", F.lit(r"(?s)(<item\b[^>]*>.*?</item>)"), 1)
    r = raw.select("fetched_at", F.explode(items).alias("x")).withColumn("i", F.from_xml("x", "title string, plainTitle string, link string, description string, pubDate string, price string"))
    title = F.coalesce(_filled(F.col("i.plainTitle")), F.split("i.title", r"\[").getItem(0))
    price = F.regexp_replace("i.price", r"^\$+", "").try_cast("double")
    date = F.regexp_replace("i.pubDate", r"^[A-Za-z]{3}, ", "")
    return _signals(r, source, title, "itch_price", F.greatest(F.coalesce(price, F.lit(0.0)), F.lit(0.0)), _time(F.regexp_replace(date, "GMT$", "+0000"), F.col("fetched_at"), "d MMM yyyy HH:mm:ss Z"), _filled(F.col("i.link")), F.substring(_plain(F.coalesce("i.description", F.lit(""))), 1, 280))


def _two(rows: DataFrame, pairs: dict[str, Column]) -> DataFrame:
    """A row per metric whose value is there."""
    both = F.array(*[F.struct(F.lit(m).alias("m"), v.cast("double").alias("v")) for m, v in pairs.items()])
    return rows.withColumn("_two", F.explode(both))


def parse_apps(raw: DataFrame, source: str = "itunes_search") -> DataFrame:
    """Two signals per app: rating and number of ratings."""
    r = raw.select("fetched_at", F.explode(F.from_json("part", "results array<struct<trackName string, averageUserRating double, userRatingCount double, currentVersionReleaseDate string, releaseDate string, trackViewUrl string, description string>>")["results"]).alias("a"))
    r = _two(r, {"itunes_rating": F.coalesce("a.averageUserRating", F.lit(0.0)), "itunes_ratings": F.coalesce("a.userRatingCount", F.lit(0.0))})
    ts = _time(F.coalesce("a.currentVersionReleaseDate", "a.releaseDate"), F.col("fetched_at"), "yyyy-MM-dd'T'HH:mm:ssX")
    return _signals(r, source, F.col("a.trackName"), F.col("_two.m"), F.col("_two.v"), ts, F.col("a.trackViewUrl"), F.substring("a.description", 1, 280))


def parse_statuses(raw: DataFrame, source: str = "mastodon_trends") -> DataFrame:
    """Posts of markup; favourites, reblogs and replies summed; a spoiler goes before the text."""
    r = raw.select(F.explode(F.from_json("part", "array<struct<id string, content string, spoiler_text string, created_at string, favourites_count double, reblogs_count double, replies_count double, url string>>")).alias("s"))
    body = _plain(F.col("s.content"))
    text = F.when(_filled(F.col("s.spoiler_text")).isNotNull(), F.concat(F.trim("s.spoiler_text"), F.lit(": "), body)).otherwise(body)
    r = r.withColumn("text", text).where("text <> ''")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    value = zero("s.favourites_count") + zero("s.reblogs_count") + zero("s.replies_count")
    ts = F.coalesce(F.try_to_timestamp("s.created_at", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")), F.try_to_timestamp("s.created_at", F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return _signals(r, source, F.substring("text", 1, 200), "mastodon_engagement", value, ts, F.col("s.url"), F.substring("text", 1, 280), _meta(favorites=F.col("s.favourites_count"), reblogs=F.col("s.reblogs_count"), replies=F.col("s.replies_count")))


def abstract(index: Column) -> Column:
    """A text from {word: [positions]}: words by position, of several at one position the first in the map."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    placed = F.array_sort(words)
    first = F.filter(placed, lambda x, k: (k == 0) | (x["p"] != F.get(placed, k - 1)["p"]))
    return F.array_join(F.transform(first, lambda x: x["w"]), " ")


def parse_works(raw: DataFrame, source: str = "openalex_arxiv") -> DataFrame:
    """Works with citations from 0 up; the abstract rebuilt from its inverted index, else the title, as quote."""
    r = raw.select("fetched_at", F.explode(F.from_json("part", "results array<struct<id string, title string, cited_by_count double, publication_date string, abstract_inverted_index map<string,array<int>>>>")["results"]).alias("w"))
    quote = F.coalesce(F.substring(_filled(abstract(F.coalesce("w.abstract_inverted_index", F.create_map().cast("map<string,array<int>>")))), 1, 280), F.col("w.title"))
    return _signals(r, source, F.col("w.title"), "openalex_cited", F.greatest(F.coalesce("w.cited_by_count", F.lit(0.0)), F.lit(0.0)), _time(F.col("w.publication_date"), F.col("fetched_at"), "yyyy-MM-dd"), F.col("w.id"), quote)


def parse_shops(raw: DataFrame, source: str = "shopify_public") -> DataFrame:
    """Products of shops: the first variant's price, from 0 up. The shop's host stands beside its part (column host)."""
    r = raw.select("fetched_at", "host", F.explode(F.from_json("part", "products array<struct<title string, handle string, body_html string, published_at string, product_type string, variants array<struct<price string>>>>")["products"]).alias("p"))
    price = F.get("p.variants", F.lit(0))["price"].try_cast("double")
    r = r.withColumn("price", price).where("trim(p.title) <> '' and trim(p.handle) <> '' and price >= 0")
    return _signals(r, source, unescape(F.col("p.title")), "shopify_price", F.col("price"), _time(F.col("p.published_at"), F.col("fetched_at"), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.concat(F.lit("https://"), F.col("host"), F.lit("/products/"), F.col("p.handle")), F.substring(_plain(F.coalesce("p.body_html", F.lit(""))), 1, 280), _meta(product_type=F.col("p.product_type")))


def parse_suggestions(raw: DataFrame, source: str = "suggest_autocomplete") -> DataFrame:
    """[seed, [completion, ...]]: 10 less the rank, at least 1, at the fetch time."""
    seed, list_ = F.get_json_object("part", "$[0]"), F.from_json(F.get_json_object("part", "$[1]"), "array<string>")
    r = raw.select("fetched_at", seed.alias("seed"), F.posexplode(list_).alias("pos", "c")).where("trim(c) <> ''")
    return _signals(r, source, F.col("c"), "google_suggest", F.greatest(F.lit(1), F.lit(10) - F.col("pos")), F.col("fetched_at"), F.concat(F.lit("https://www.google.com/search?q="), F.url_encode("c")), None, _meta(seed=F.col("seed"), rank=F.col("pos") + 1))


def parse_plugins(raw: DataFrame, source: str = "wordpress_org") -> DataFrame:
    """Two signals per plugin: rating and installs; the day of its last update."""
    r = raw.select("fetched_at", F.explode(F.from_json("part", "plugins array<struct<name string, slug string, rating double, active_installs double, last_updated string, short_description string>>")["plugins"]).alias("p"))
    r = _two(r, {"wp_rating": F.coalesce("p.rating", F.lit(0.0)), "wp_installs": F.coalesce("p.active_installs", F.lit(0.0))})
    return _signals(r, source, unescape(F.col("p.name")), F.col("_two.m"), F.col("_two.v"), _time(F.substring("p.last_updated", 1, 10), F.col("fetched_at"), "yyyy-MM-dd"), F.concat(F.lit("https://wordpress.org/plugins/"), F.col("p.slug"), F.lit("/")), F.substring(unescape(F.col("p.short_description")), 1, 280))


def _spread(g, price: Column) -> list[Column]:
    two = lambda c: F.format_string("%.2f", c)
    return [two(F.min(price)).alias("lo"), two(F.median(price)).alias("mid"), two(F.max(price)).alias("hi"), F.count(price).alias("n")]


def parse_listings(raw: DataFrame, source: str = "ebay_browse") -> DataFrame:
    """All pages of one phrase (column phrase) as one signal: the highest total, with the spread of prices. Nothing found, no row. A phrase has few pages."""
    j = F.from_json("part", "total double, itemSummaries array<struct<price struct<value string>>>")
    r = raw.select("phrase", "fetched_at", j.alias("j"), F.explode_outer(j["itemSummaries"]).alias("i"))
    price = F.when(F.col("i.price.value").try_cast("double") > 0, F.col("i.price.value").try_cast("double"))
    g = r.where("j is not null").groupBy("phrase").agg(F.max("j.total").alias("total"), F.max("fetched_at").alias("fetched_at"), *_spread(r, price)).where("total > 0 or n > 0")
    return _signals(g, source, F.col("phrase"), "ebay_listings", F.coalesce("total", F.lit(0.0)), F.col("fetched_at"), None, None, _meta(total=F.col("total").cast("long"), priced=F.col("n"), price_min=F.col("lo"), price_median=F.col("mid"), price_max=F.col("hi")))


def parse_launches(raw: DataFrame, source: str = "producthunt_graphql") -> DataFrame:
    """Launches with votes from 0 up."""
    j = F.from_json("part", "data struct<posts struct<edges array<struct<node struct<name string, tagline string, votesCount double, commentsCount long, createdAt string, url string>>>>>")
    r = raw.select("fetched_at", F.explode(j["data"]["posts"]["edges"]).alias("e")).select("fetched_at", "e.node")
    return _signals(r, source, F.col("node.name"), "ph_votes", F.greatest(F.coalesce("node.votesCount", F.lit(0.0)), F.lit(0.0)), _time(F.col("node.createdAt"), F.col("fetched_at"), "yyyy-MM-dd'T'HH:mm:ssX"), F.col("node.url"), F.col("node.tagline"), _meta(comments=F.col("node.commentsCount")))


def parse_shopping(raw: DataFrame, source: str = "searchapi") -> DataFrame:
    """Inline offers of one phrase (column phrase) as one signal: their number, spread of prices, mean rating, sellers. No priced offer, no row."""
    j = F.from_json("part", "inline_shopping array<struct<extracted_price double, price string, rating double, seller string>>")
    r = raw.select("phrase", "fetched_at", F.explode(j["inline_shopping"]).alias("i"))
    price = F.coalesce("i.extracted_price", F.regexp_replace("i.price", "[^0-9.]", "").try_cast("double"))
    g = r.withColumn("p", F.when(price > 0, price)).groupBy("phrase").agg(F.count("*").alias("all"), F.max("fetched_at").alias("fetched_at"), *_spread(r, F.col("p")), F.avg(F.when(F.col("i.rating") > 0, F.col("i.rating"))).alias("stars"), F.count_distinct(F.nullif(F.trim("i.seller"), F.lit(""))).alias("sellers"))
    return _signals(g.where("n > 0"), source, F.col("phrase"), "shopping_offers", F.col("all"), F.col("fetched_at"), None, None, _meta(price_min=F.col("lo"), price_median=F.col("mid"), price_max=F.col("hi"), avg_rating=F.format_string("%.2f", "stars"), sellers=F.col("sellers")))


PARSERS = {
    "hn_firebase": parse_stories, "wiki_pageviews": parse_pageviews, "arctic_shift": parse_posts, "gdelt_doc": parse_articles, "itch_io": parse_feed, "itunes_search": parse_apps,
    "mastodon_trends": parse_statuses, "openalex_arxiv": parse_works, "shopify_public": parse_shops, "suggest_autocomplete": parse_suggestions, "wordpress_org": parse_plugins,
    "ebay_browse": parse_listings, "producthunt_graphql": parse_launches, "searchapi": parse_shopping,
}

_ITEM = "title string, name string, body string, selftext string, short_description string, url string, permalink string, score double, ups double, rating double, installs double, price double, comments long, fetched string"


def parse_items(items: DataFrame) -> DataFrame:
    """Stored payloads of any of the kept shapes, flat: id, source_id, title, body, url, value. JSON flat or under 'data', or an RSS item."""
    j = F.from_json("payload", f"{_ITEM}, data struct<{', '.join(f'{n}: {t}' for n, t in (f.rsplit(' ', 1) for f in _ITEM.split(', ')))}>")
    x = F.from_xml("payload", "title string, link string, description string, pubDate string")
    r = items.select("id", "source_id", F.when(F.ltrim("payload").startswith("{"), j).alias("j"), F.when(F.ltrim("payload").startswith("<"), x).alias("x"))
    pick = lambda *names: F.coalesce(*[F.col(f"j.{n}") for n in names], *[F.col(f"j.data.{n}") for n in names])
    return r.select("id", "source_id", F.coalesce(pick("title", "name"), F.col("x.title")).alias("title"), F.coalesce(pick("body", "selftext", "short_description"), F.col("x.description")).alias("body"), F.coalesce(pick("url", "permalink"), F.col("x.link")).alias("url"), pick("score", "ups", "rating").alias("value"))
