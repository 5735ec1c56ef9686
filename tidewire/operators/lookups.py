"""What the application's pages and endpoints ask for: scopes, lookups, panels, pages and flags."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import normalize
from tidewire.operators import catalogue, feed

#: Symbols of one request at most, days of the feed and of the strip, rows of a panel.
MOST_SYMBOLS, FEED_DAYS, STRIP_DAYS, PANEL_ROWS = 50, 14, 3, 6
#: Flags and what they are until they are written.
FLAGS = {"llm_scraping": True, "ai_summaries": True}
#: Hits of a search shown at most, options of a completion.
SEARCH_LIMIT, OPTIONS = 25, 8


def symbol_list(raw: Column) -> Column:
    """Struct of the distinct symbols of a comma-separated list, in order, and the error: an invalid part, none, or too many."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), normalize.clean_symbol), lambda s: s != ""))
    bad = F.filter(parts, lambda s: ~normalize.valid_symbol(s))
    error = F.when(F.size(bad) > 0, F.concat(F.lit("invalid symbol: "), F.get(bad, F.lit(0)))).when(F.size(parts) == 0, "no valid symbols").when(F.size(parts) > MOST_SYMBOLS, f"at most {MOST_SYMBOLS} symbols")
    return F.struct(F.when(error.isNull(), parts).alias("symbols"), error.alias("error"))


def listed(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    """A request's symbols and their places."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(symbols)], "short_name string, pos int")


def scope(stocks: DataFrame, watchlist: DataFrame, *, symbols: Sequence[str] | None = None, query: str | None = None, sector: str | None = None) -> DataFrame | None:
    """The symbols asked for, else all (None) for a search, else the watchlist; then those of a sector or industry.

    A sector that names nothing leaves nothing.
    """
    wanted = listed(stocks.sparkSession, symbols).select("short_name") if symbols else None if query else watchlist.select("short_name")
    if not sector:
        return wanted
    found = catalogue.in_sector(stocks, sector)
    return found if wanted is None else found.join(wanted.distinct(), "short_name", "left_semi")


def feed_page(news: DataFrame, stocks: DataFrame, watchlist: DataFrame, as_of, *, symbols=None, query=None, sector=None, since=None, days: int = FEED_DAYS, **rest) -> DataFrame:
    """P07 with P01: one page of the feed in its scope."""
    return feed.page(news, symbols=scope(stocks, watchlist, symbols=symbols, query=query, sector=sector), query=query, since=since or as_of - timedelta(days=days), **rest)


def latest(news: DataFrame, watchlist: DataFrame, as_of, limit: int = 20) -> DataFrame:
    """P25: the newest direct articles of the watchlist."""
    return feed.page(news, symbols=watchlist, since=as_of - timedelta(days=STRIP_DAYS), relevance="direct", limit=limit)


def one(rows: DataFrame, column: str, value) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(column) == value).limit(1)


def in_order(rows: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """The rows of the symbols, with their ``pos`` in the request; unknown symbols are left out."""
    return rows.join(listed(rows.sparkSession, symbols), "short_name").orderBy("pos")


def quotes(stocks: DataFrame, symbols: Sequence[str], as_of) -> DataFrame:
    """A row for each symbol asked for, in order, known or not, and whether its quote is stale."""
    held = listed(stocks.sparkSession, symbols).join(stocks, "short_name", "left")
    return held.withColumn("stale", F.col("price").isNotNull() & normalize.stale(F.col("price_updated_at"), F.lit(as_of).cast("timestamp"))).orderBy("pos")


def unresolved(stocks: DataFrame) -> DataFrame:
    """P14."""
    return stocks.where("yahoo_symbol IS NULL").select("short_name", "name")


def needing_backfill(watchlist: DataFrame) -> DataFrame:
    """P14."""
    return watchlist.where("backfilled_at IS NULL").select("short_name")


def is_following(watchlist: DataFrame, symbol: str) -> DataFrame:
    """One row, true or false."""
    return watchlist.agg(F.count_if(F.col("short_name") == symbol).alias("n")).select((F.col("n") > 0).alias("following"))


def price_history(prices: DataFrame, symbol: str, since, interval: str | None = None) -> DataFrame:
    """Ascending."""
    found = prices.where((F.col("short_name") == symbol) & (F.col("ts") >= since))
    return (found if interval is None else found.where(F.col("interval") == interval)).orderBy("ts")


def sentiment_history(history: DataFrame, symbol: str, as_of, days: int = 30) -> DataFrame:
    """Ascending."""
    return history.where((F.col("short_name") == symbol) & (F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))).orderBy("date")


def events_page(events: DataFrame, symbols=None, since=None, limit: int = 50) -> DataFrame:
    """P20: newest first; None is every stock, an empty list none."""
    found = feed.in_scope(events, symbols)
    return (found if since is None else found.where(F.col("created_at") >= since)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def flags(config: DataFrame) -> DataFrame:
    """Every flag; what was never written has its default, what was is on if it is 1."""
    defaults = config.sparkSession.createDataFrame(list(FLAGS.items()), "key string, on boolean")
    return defaults.join(config.select("key", "value"), "key", "left").select("key", F.when(F.col("value").isNotNull(), F.col("value") == "1").otherwise(F.col("on")).alias("value"))


def effective(flags: DataFrame, keyed: bool) -> DataFrame:
    """A flag holds only with a usable key."""
    return flags.select("key", (F.col("value") & F.lit(keyed)).alias("value"))


def stock_rows(stocks: DataFrame) -> DataFrame:
    """An instrument as it is shown; the quote's currency counts before the catalogue's."""
    return stocks.select(F.col("short_name").alias("symbol"), "name", "type", "sector", "industry", F.coalesce(F.nullif("quote_currency", F.lit("")), "currency_code").alias("currencyCode"), "exchange", F.col("yahoo_symbol").alias("yahooSymbol"), "price", F.col("price_change").alias("change"), F.col("price_change_percent").alias("changePercent"), F.col("price_updated_at").alias("priceUpdatedAt"))


def news_rows(news: DataFrame) -> DataFrame:
    """An article as it is shown; without a relevance it is direct."""
    return news.withColumn("relevance", F.coalesce(F.nullif("relevance", F.lit("")), F.lit("direct")))


def event_rows(events: DataFrame) -> DataFrame:
    """An event as it is shown; without articles the list is empty."""
    return events.withColumn("news_ids", F.coalesce("news_ids", F.array().cast(events.schema["news_ids"].dataType))).drop("tokens_total")


def health(stocks: DataFrame, watchlist: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of the numbers of instruments, followed symbols and recent articles."""
    total = lambda df, c, name: df.agg(F.coalesce(c, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("name"), "n")
    three = total(stocks, F.count("*"), "stocks").unionByName(total(watchlist, F.count("*"), "watched")).unionByName(total(counts, F.sum("article_count"), "articles"))
    return three.agg(*(F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in ("stocks", "watched", "articles")))


def outcomes(results: DataFrame) -> DataFrame:
    """The symbols of a refresh by whether they were updated; a null outcome failed."""
    return results.groupBy(F.when(F.coalesce("ok", F.lit(False)), "updated").otherwise("failed").alias("outcome")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("short_name")).alias("symbols"))


def ticker_panels(movers: DataFrame, rows: int = PANEL_ROWS) -> DataFrame:
    """Gainers, losers, most positive and most negative, each a top-k by its own metric; ties by symbol."""

    def panel(name: str, metric: str, sign: int) -> DataFrame:
        value = F.col(metric)
        return movers.where(value * sign > 0).orderBy(F.desc(value * sign), "short_name").limit(rows).select(F.lit(name).alias("panel"), "short_name", value.cast("double").alias("value"))

    return panel("gainers", "price_change_percent", 1).unionByName(panel("losers", "price_change_percent", -1)).unionByName(panel("positive", "sentiment", 1)).unionByName(panel("negative", "sentiment", -1))


def by_impact(rows: DataFrame) -> DataFrame:
    """``place`` of the rows of each ``page`` by impact, then ``pos``; null ranks with low."""
    tier = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(tier, "pos")))


def laid_out(rows: DataFrame) -> DataFrame:
    """``slot`` of a page's rows (by ``pos``): the lead is the first with an image, else the first; the next two with one are featured."""
    pictured = F.col("image").isNotNull() & (F.col("image") != "")
    order = F.row_number().over(Window.partitionBy("page").orderBy(F.desc(F.coalesce(pictured, F.lit(False))), "pos"))
    slot = F.when(F.col("n") == 1, "lead").when((F.col("n") <= 3) & F.coalesce(pictured, F.lit(False)), "featured").otherwise("rest")
    return rows.withColumn("n", order).withColumn("slot", slot).drop("n")


def unseen(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows whose URL is not shown yet; a row without one is."""
    return rows.join(shown.select("url").distinct(), "url", "left_anti")


def metrics(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """A metric of each symbol, of the second source where it has one, else of the first."""
    known = first.select("short_name", F.col(column).alias("a")).join(second.select("short_name", F.col(column).alias("b")), "short_name", "full")
    return known.select("short_name", F.coalesce("b", "a").alias(column)).where(F.col(column).isNotNull())


def fetched(news: DataFrame, ids: DataFrame) -> DataFrame:
    """The articles of some ids, newest first."""
    return news.join(ids.select("id").distinct(), "id", "left_semi").orderBy(F.desc("publish_time"), F.desc("id"))


def completed(matches: DataFrame, pinned: Sequence[str]) -> DataFrame:
    """The first OPTIONS matches (by ``pos``) that are not pinned."""
    return (matches.where(~F.col("short_name").isin(*pinned)) if pinned else matches).orderBy("pos").limit(OPTIONS)


def found_first(found: DataFrame, stored: DataFrame, traded: DataFrame, query: str) -> DataFrame:
    """Stored hits of a search, and before them what a lookup found besides, unless the symbol itself is stored; SEARCH_LIMIT rows.

    found and stored: short_name and pos; traded: the stored hits' short_name and traded symbol.
    """
    exact = stored.where(F.col("short_name") == query.strip().upper()).limit(1).select(F.lit(True).alias("known"))
    new = catalogue.unlisted(traded, found).withColumn("known", F.lit(True)).join(exact, "known", "left_anti")
    both = new.select("short_name", F.lit(0).alias("tier"), "pos").unionByName(stored.select("short_name", F.lit(1).alias("tier"), "pos"))
    return both.orderBy("tier", "pos").limit(SEARCH_LIMIT)


def scored(news: DataFrame, score: Column, limit: int = 500) -> DataFrame:
    """Id and sentiment of the newest unscored articles, a patch for K03."""
    return feed.unscored(news, limit).select("id", score.alias("sentiment"))
