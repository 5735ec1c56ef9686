"""The application's queries over the supplied tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import normalize
from tidewire.operators import catalogue, feed, insights, prices, stories, upserts
from tidewire.plans import bindings as b
from tidewire.plans import landed, lookups, reviews, sentiments

#: Queries take the time of asking as a parameter; here it is fixed.
AS_OF = datetime(2024, 1, 31)
SINCE = datetime(2024, 1, 17)
TODAY = date(2024, 1, 31)


def trending_news(spark: SparkSession, d: str) -> DataFrame:
    return feed.trending(b.news(spark, d), b.stocks(spark, d), since=SINCE).select("id", "short_name", "move_percent", "publish_time", "rn")


def feed_recent(spark, d):
    return feed.page(b.news(spark, d), since=SINCE, limit=50).select("id", "short_name", "title", "publish_time")


def feed_coverage_page2(spark, d):
    return feed.page(b.news(spark, d), sort="coverage", since=SINCE, limit=50, offset=50).select("id", "short_name", "coverage")


def feed_symbol(spark, d):
    return feed.page(b.news(spark, d), sort="symbol", symbols=["7", "12", "31"], limit=100).select("id", "short_name", "publish_time")


def feed_watchlist(spark, d):
    return feed.matching(b.news(spark, d), symbols=b.watchlist(spark, d), relevance="direct").select("id", "short_name", "relevance")


def feed_sentiment(spark, d):
    return feed.matching(b.news(spark, d), sentiment="neutral").select("id", "sentiment")


def feed_by_sentiment(spark, d):
    return feed.page(b.news(spark, d), sort="sentiment", limit=200).select("id", "sentiment")


def feed_impact(spark, d):
    return feed.matching(b.news(spark, d), impact="high", relevance="direct").select("id", "impact")


def feed_search(spark, d):
    return feed.matching(b.news(spark, d), query=" REPORT 1").select("id", "title")


def document_search(spark, d):
    rows = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"), F.col("source").alias("short_name"))
    return feed.matching(rows, query="100%_").select("id", "short_name").unionByName(feed.matching(rows, query="THE IN").select("id", "short_name"))


def fingerprints(spark, d):
    return feed.fingerprints(b.news(spark, d), SINCE)


def unscored(spark, d):
    return feed.unscored(b.news(spark, d))


def image_backlog(spark, d):
    return feed.image_backlog(b.news(spark, d))


def dedupe_by_url(spark, d):
    return feed.first_per(b.news(spark, d), ["url"], [F.asc("publish_time"), F.asc("id")]).select("id", "url")


def diversify(spark, d):
    top = feed.page(b.news(spark, d), since=SINCE, limit=40).select("id", "source", "short_name", "publish_time")
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("publish_time").cast("timestamp"))).alias("t"), (-F.col("id")).alias("n"), "id", "source", "short_name"))).alias("rows"))
    return feed.diversified(ranked.select(F.posexplode("rows").alias("pos", "r")).select("pos", "r.id", "r.source", "r.short_name"))


def count_by_stock(spark, d):
    return insights.count_by_stock(b.news(spark, d), SINCE, [])


def source_breakdown(spark, d):
    return insights.source_breakdown(b.news(spark, d), SINCE, None)


def sentiment_rollup(spark, d):
    return insights.rollup(b.news(spark, d))


def sentiment_deltas(spark, d):
    return insights.deltas(insights.rollup(b.news(spark, d)), TODAY)


def movers(spark, d):
    return insights.movers(b.stocks(spark, d), count_by_stock(spark, d), sentiment_deltas(spark, d), limit=30)


def insights_panels(spark, d):
    return insights.panels(count_by_stock(spark, d), sentiment_deltas(spark, d))


def popular(spark, d):
    return insights.popular(b.watchlist(spark, d), b.stocks(spark, d), count_by_stock(spark, d), limit=400).select("short_name", "name", "tier")


def catalogue_search(spark, d):
    parts = b.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("short_name"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, "STOCK").otherwise("ETF").alias("type"))
    return catalogue.search(parts, "1", limit=25)


def sectors(spark, d):
    return catalogue.sectors(b.stocks(spark, d))


def symbols_in_sector(spark, d):
    return catalogue.in_sector(b.stocks(spark, d), "ASIA")


def watchlist_quotes(spark, d):
    return catalogue.watched(b.watchlist(spark, d), b.stocks(spark, d))


def catalogue_best_listing(spark, d):
    items = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("company"), F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_linenumber").alias("ordinal"), F.floor(F.col("l_quantity") % 4).cast("int").alias("exchange_rank"), F.floor(F.col("l_discount") * 1000).cast("int").alias("name_score"))
    return catalogue.best_listing(items)


def price_series(spark, d):
    return prices.series(b.prices(spark, d))


def latest_price(spark, d):
    return prices.latest(b.prices(spark, d))


def price_changes(spark, d):
    return prices.changes(b.prices(spark, d))


def quotes(spark, d):
    return prices.quotes(b.prices(spark, d).where("interval = '1d'"))


def close_as_of(spark, d):
    asked = b.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("short_name"), (F.col("ts") - F.expr("INTERVAL '1500' DAY")).alias("ts"))
    return prices.as_of(asked, b.orders_as_prices(spark, d))


def upsert_latest(spark, d):
    rows = b.table(spark, d, "events").select(F.col("user_id").alias("key"), "event_type", "value", "event_id")
    old, new = rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'").withColumn("event_type", F.lit("view"))
    return upserts.upsert(old, new, ["key", "event_type"], "event_id")


def insert_absent(spark, d):
    rows = b.news(spark, d).select("id", "short_name", "source", "url")
    return upserts.insert_absent(rows.where("source = 'view'"), rows.withColumn("source", F.lit("view")).withColumn("url", F.regexp_replace("url", "www.click", "www.view")), ["short_name", "url"], "id")


def quote_patch(spark, d):
    patch = b.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("short_name")).agg(F.max("o_totalprice").alias("price"), F.max(F.when(F.col("o_orderstatus") == "F", "patched")).alias("name"))
    return upserts.patched(b.stocks(spark, d).select("short_name", "name", "price", "type"), patch, "short_name", overwrite=["price"], keep=["name"])


def retention(spark, d):
    return upserts.retained(b.news(spark, d).select("id", "publish_time"), "publish_time", SINCE)


def market_open(spark, d):
    ts = F.col("ts").cast("timestamp")
    return b.table(spark, d, "events").select("event_id", normalize.markets_open(ts).alias("open"), normalize.iso_utc(ts).alias("iso"))


def age_bucket(spark, d):
    return b.news(spark, d).select("id", normalize.age_bucket(F.col("publish_time").cast("timestamp"), F.lit(AS_OF).cast("timestamp")).alias("age"), normalize.sentiment_band(F.col("sentiment")).alias("band"))


def url_canonical(spark, d):
    return b.table(spark, d, "pages").select("page_id", normalize.canonical_url(F.col("url")).alias("canonical"), normalize.url_hash(F.col("url")).alias("url_hash"), normalize.domain_of(F.col("url")).alias("domain"))


def title_key(spark, d):
    title = F.substring_index("text", "\n", 1)
    return b.table(spark, d, "documents").select("doc_id", normalize.without_outlet(title).alias("title"), F.array_join(normalize.title_tokens(title), " ").alias("tokens"), normalize.title_key(title).alias("title_key"))


def raw_articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as scraped articles of ten days on twenty companies: the first line is the headline."""
    return b.table(spark, d, "documents").select(
        F.col("source").alias("short_name"),
        F.element_at(F.split("text", r"\s+"), 1).alias("company_name"),
        F.array("lang").alias("aliases"),
        F.col("doc_id").alias("arrival"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("https://www.example.com/a/"), F.substring(F.sha2("text", 256), 1, 16), F.lit("?utm_source=x")).alias("url"),
        (F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=F.pmod(F.col("doc_id"), F.lit(240)).cast("int"))).alias("published_at"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("image"),
        F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("source_domain"),
        F.lit("FINVIZ").alias("source_type"),
    )


def story_clusters(spark, d):
    return stories.clustered(stories.cleaned(raw_articles(spark, d), AS_OF)).select("short_name", "arrival", "winner")


def story_reasons(spark, d):
    articles = stories.cleaned(raw_articles(spark, d), AS_OF)
    return stories.reason_counts(articles, stories.clustered(articles))


QUERIES = {
    f.__name__: f
    for f in (
        trending_news, feed_recent, feed_coverage_page2, feed_symbol, feed_watchlist, feed_sentiment, feed_by_sentiment, feed_impact, feed_search, document_search, fingerprints, unscored, image_backlog, dedupe_by_url,
        diversify, count_by_stock, source_breakdown, sentiment_rollup, sentiment_deltas, movers, insights_panels, popular, catalogue_search, sectors, symbols_in_sector, watchlist_quotes, catalogue_best_listing,
        price_series, latest_price, price_changes, quotes, close_as_of, upsert_latest, insert_absent, quote_patch, retention, market_open, age_bucket, url_canonical, title_key, story_clusters, story_reasons,
    )
} | reviews.QUERIES | lookups.QUERIES | sentiments.QUERIES | landed.QUERIES
