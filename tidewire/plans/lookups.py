"""Queries on scopes, lookups, panels and listings, and their DuckDB SQL."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import normalize
from tidewire.operators import feed, insights, listings, lookups, stories, upserts
from tidewire.plans import bindings as b
from tidewire.sources import payloads, requests

AS_OF, SINCE, TODAY = datetime(2024, 1, 31), datetime(2024, 1, 17), date(2024, 1, 31)
ASKED = ("31", "7", "nobody", "12")


def stocks(spark: SparkSession, d: str) -> DataFrame:
    """The instruments with the columns that quotes and resolution fill."""
    k = F.col("short_name").cast("int")
    return b.stocks(spark, d).select("*", F.when(k % 4 != 0, F.concat(F.lit("Y"), "short_name")).alias("yahoo_symbol"), F.when(k % 3 == 0, "USD").when(k % 3 == 1, "").alias("quote_currency"), F.lit("EUR").alias("currency_code"), F.element_at(F.array(*map(F.lit, ("NMS", "LSE", "XXX"))), k % 3 + 1).alias("exchange"), F.when(k % 5 != 0, F.lit(AS_OF) - F.make_dt_interval(mins=k % 30)).alias("price_updated_at"), (F.col("price") / 100).alias("price_change"))


STOCKS = f"""(SELECT *, CASE WHEN short_name::INT % 4 <> 0 THEN 'Y' || short_name END AS yahoo_symbol, CASE short_name::INT % 3 WHEN 0 THEN 'USD' WHEN 1 THEN '' END AS quote_currency, 'EUR' AS currency_code,
  ['NMS', 'LSE', 'XXX'][short_name::INT % 3 + 1] AS exchange, CASE WHEN short_name::INT % 5 <> 0 THEN TIMESTAMP '2024-01-31' - to_minutes(short_name::INT % 30) END AS price_updated_at, price / 100 AS price_change FROM {b.STOCKS})"""


def scoped_feed(spark, d):
    return lookups.feed_page(b.news(spark, d), b.stocks(spark, d), b.watchlist(spark, d), AS_OF, sector="EUROPE", limit=80).select("id", "short_name", "publish_time")


def scoped_search(spark, d):
    return lookups.feed_page(b.news(spark, d), b.stocks(spark, d), b.watchlist(spark, d), AS_OF, query="view report 2", sector="ASIA", limit=500).select("id", "short_name")


def latest_headlines(spark, d):
    return lookups.latest(b.news(spark, d), b.watchlist(spark, d), AS_OF).select("id", "short_name")


def symbol_lists(spark, d):
    raw = b.table(spark, d, "nation").select("n_nationkey", F.concat_ws(",", F.lower("n_name"), F.lit(" brk.b "), "n_name", F.substring("n_name", 1, 3)).alias("raw"))
    lists = raw.select("n_nationkey", lookups.symbol_list(F.col("raw")).alias("s"))
    return lists.select("n_nationkey", F.array_join("s.symbols", ",").alias("symbols"), "s.error")


def lookup_in_order(spark, d):
    return lookups.in_order(b.stocks(spark, d), ASKED).select("pos", "short_name", "name")


def requested_quotes(spark, d):
    return lookups.quotes(stocks(spark, d), ASKED, AS_OF).select("pos", "short_name", "price", "stale")


def unresolved(spark, d):
    return lookups.unresolved(stocks(spark, d))


def following(spark, d):
    return lookups.is_following(b.watchlist(spark, d), "NONE").unionByName(lookups.is_following(b.watchlist(spark, d), "nobody"))


def price_history(spark, d):
    return lookups.price_history(b.prices(spark, d), "7", SINCE, "snap")


def sentiment_history(spark, d):
    return lookups.sentiment_history(insights.rollup(b.news(spark, d)), "7", TODAY, 20).select("short_name", "date", "article_count")


def events_page(spark, d):
    rows = b.news(spark, d).where("impact = 'high'").select("short_name", "id", F.col("title").alias("headline"), F.col("publish_time").alias("created_at"))
    return lookups.events_page(rows, ["7", "12"], SINCE, 30)


def flags(spark, d):
    config = b.table(spark, d, "region").where("r_regionkey = 1").select(F.lit("ai_summaries").alias("key"), F.lit("0").alias("value"))
    return lookups.flags(config).join(lookups.effective(lookups.flags(config), False).withColumnRenamed("value", "holds"), "key")


def stock_rows(spark, d):
    return lookups.stock_rows(stocks(spark, d)).select("symbol", "currencyCode", "exchange", "yahooSymbol", "price", "change")


def health(spark, d):
    return lookups.health(b.stocks(spark, d), b.watchlist(spark, d), insights.count_by_stock(b.news(spark, d), SINCE))


def outcomes(spark, d):
    rows = b.table(spark, d, "nation").select(F.col("n_name").alias("short_name"), F.when(F.col("n_regionkey") < 3, F.col("n_nationkey") % 2 == 0).alias("ok"))
    return lookups.outcomes(rows).select("outcome", "n", F.array_join("symbols", ",").alias("symbols"))


def ticker_panels(spark, d):
    counts, shifts = insights.count_by_stock(b.news(spark, d), SINCE), insights.deltas(insights.rollup(b.news(spark, d)), TODAY)
    # the last digits of a mean of doubles follow the order in which its parts arrive
    return lookups.ticker_panels(insights.moves(b.stocks(spark, d), counts, shifts)).withColumn("value", F.round("value", 9))


def paged(spark: SparkSession, d: str) -> DataFrame:
    """The last articles of each kind, as pages."""
    rows = b.news(spark, d).where(F.col("publish_time") >= datetime(2024, 1, 30))
    return rows.select("id", F.col("source").alias("page"), "impact", "image", F.col("id").alias("pos"))


def page_by_impact(spark, d):
    return lookups.by_impact(paged(spark, d)).select("id", "page", "place")


def page_layout(spark, d):
    return lookups.laid_out(paged(spark, d)).select("id", "page", "slot")


def unseen(spark, d):
    rows = b.news(spark, d).select("id", "url", "source")
    return lookups.unseen(rows, rows.where("source = 'view' AND id < 2000"))


def merged_moves(spark, d):
    rows = b.stocks(spark, d).select("short_name", F.col("price_change_percent").alias("move"), "segment")
    return lookups.metrics(rows.where("segment <> 'BUILDING'"), rows.where("segment IN ('BUILDING', 'MACHINERY')").withColumn("move", F.col("move") + 1), "move")


def search_with_lookup(spark, d):
    rows = b.stocks(spark, d).select("short_name", F.col("short_name").cast("int").alias("pos"))
    held = rows.where("short_name LIKE '1_'")
    traded = held.select("short_name", F.concat(F.lit("1"), "short_name").alias("traded"))
    found = rows.where("short_name LIKE '11%'")
    return lookups.found_first(found, held, traded, "1").select("short_name", "tier", "pos")


def completion(spark, d):
    return lookups.completed(b.stocks(spark, d).select("short_name", F.col("short_name").cast("int").alias("pos")), ["2", "5"])


def display_formats(spark, d):
    k = F.col("c_custkey")
    shown = b.table(spark, d, "customer").select(k, F.when(k % 7 != 0, F.col("c_acctbal") / F.when(k % 2 == 0, 1e5).otherwise(1)).alias("v"), F.element_at(F.array(*map(F.lit, ("USD", "GBP", "CHF", ""))), (k % 4 + 1).cast("int")).alias("c"), (F.lit(AS_OF) - F.make_dt_interval(mins=(k * 37 % 6000).cast("int"))).alias("ts"))
    now = F.lit(AS_OF)
    return shown.select("c_custkey", normalize.shown_price(F.col("v"), F.col("c")).alias("price"), normalize.signed(F.col("v") / 1000, "%").alias("percent"), normalize.short_age(F.col("ts"), now).alias("age"), normalize.short_age(F.col("ts"), now, long=True).alias("long_age"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """What searches for the suppliers found among the parts' names."""
    k = F.col("l_suppkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    names = ("Apple Inc", "Alphabet Inc", "Shell plc", "Leveraged Apple 2x ETP", "Apple Incorporated")
    return b.table(spark, d, "lineitem").select(k.cast("string").alias("short_name"), pick(names, k).alias("catalogue_name"), (F.col("l_linenumber") % 2).alias("search"), F.col("l_orderkey").alias("place"), F.concat((F.col("l_partkey") % 40).cast("string"), pick(("", ".L", ".DE"), F.col("l_partkey"))).alias("symbol"), pick(("EQUITY", "etf", "OPTION", "INDEX"), F.col("l_partkey")).alias("quote_type"), pick(("NMS", "LSE", "GER", "XXX", "TOR"), F.col("l_orderkey")).alias("exchange"), pick(names, F.col("l_partkey")).alias("long_name"), F.lit(None).cast("string").alias("other_name"))


def listing_ranks(spark, d):
    rows = candidates(spark, d)
    return rows.select("short_name", "place", "search", "symbol", "exchange", listings.exchange_rank(F.col("exchange"), F.col("symbol")).alias("rank"), listings.is_us_listing(F.col("exchange")).alias("us"), listings.is_derivative(F.col("long_name")).alias("derivative"))


def first_candidates(spark, d):
    return listings.first_per_symbol(candidates(spark, d)).select("short_name", "symbol", "search", "place")


def looked_up(spark, d):
    return listings.looked_up(candidates(spark, d).withColumn("query", F.col("short_name")).withColumn("place", F.col("place") * 2 + F.col("search"))).select("query", "place", "short_name", "name", "type", "exchange")


def work_list(spark, d):
    rows = b.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("short_name"), F.when(F.col("p_partkey") % 6 == 0, F.concat("p_name", F.lit(" warrant"))).otherwise(F.col("p_name")).alias("name"))
    return listings.work_list(rows, rows.select("short_name", (F.col("short_name").cast("int") % 4 == 0).alias("resolved")))


def request_windows(spark, d):
    rows = b.table(spark, d, "nation").select(F.col("n_name").alias("short_name"), F.when(F.col("n_nationkey") % 3 > 0, F.initcap("n_name")).when(F.col("n_nationkey") % 2 == 0, "Co").alias("name"))
    return requests.windows(rows, TODAY, 30).unionByName(requests.windows(rows, TODAY, 2))


def source_list(spark, d):
    return requests.sources_of(stocks(spark, d).select("short_name", F.concat("yahoo_symbol", F.lit(".X")).alias("yahoo_symbol"), "exchange"))




def image_patch(spark, d):
    backlog = feed.image_backlog(b.news(spark, d), 500)
    pages = backlog.select("url").distinct().withColumn("html", F.when(F.substring("url", -1, 1) != "3", F.concat(F.lit("<meta content='/i.png?u=1' property='og:image'>"), F.lit(""))).otherwise("<p>"))
    return upserts.patched(b.news(spark, d).select("id", "image"), payloads.image_backfill(backlog, pages), "id", fill=["image"])


def catalogue_growth(spark, d):
    kept = b.stocks(spark, d).select("short_name", "name", "type", F.lit("USD").alias("currency_code"))
    batch = b.table(spark, d, "supplier").select((F.col("s_suppkey") * 40).cast("string").alias("short_name"), F.when(F.col("s_suppkey") % 9 > 0, F.col("s_name")).alias("name"), F.lit("ETF").alias("type"), F.when(F.col("s_suppkey") % 2 == 0, "GBP").alias("currency_code"), "s_suppkey")
    return upserts.catalogue_upsert(kept, batch, "s_suppkey")


def watch_changes(spark, d):
    return upserts.unfollowed(upserts.followed(upserts.followed(b.watchlist(spark, d), "X1"), "NONE"), "X2")


def stored_stories(spark, d):
    """The clusters of each source's articles against the first documents as stored ones, by what became of them."""
    raw = b.table(spark, d, "documents").select(F.col("source").alias("short_name"), F.lit(None).cast("string").alias("company_name"), F.lit(None).cast("array<string>").alias("aliases"), F.col("doc_id").alias("arrival"), F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("https://e.com/"), F.md5("text")).alias("url"), F.lit(AS_OF).alias("published_at"), *(F.lit(None).cast("string").alias(c) for c in ("description", "image", "source", "source_domain")), F.lit("FINVIZ").alias("source_type"))
    articles = stories.cleaned(raw, AS_OF)
    stored = articles.where("arrival % 10 = 0 AND title IS NOT NULL").select("short_name", F.col("arrival").alias("id"), "title", "title_key", "url_hash", F.col("when").alias("publish_time"), "image", "description")
    return stories.reason_counts(articles, stories.clustered(articles, stored.select("short_name", "id", "title", "title_key", "url_hash", "publish_time")))


QUERIES = {
    f.__name__: f
    for f in (
        scoped_feed, scoped_search, latest_headlines, symbol_lists, lookup_in_order, requested_quotes, unresolved, following, price_history, sentiment_history, events_page, flags, stock_rows, health, outcomes, ticker_panels,
        page_by_impact, page_layout, unseen, merged_moves, search_with_lookup, completion, display_formats, listing_ranks, first_candidates, looked_up, work_list, request_windows, source_list,
        image_patch, catalogue_growth, watch_changes, stored_stories,
    )
}

N, W, D31, D17 = b.NEWS, b.WATCHLIST, "TIMESTAMP '2024-01-31'", "TIMESTAMP '2024-01-17'"
CANDIDATES = """(SELECT l_suppkey::VARCHAR AS short_name, l_linenumber % 2 AS search, l_orderkey AS place, (l_partkey % 40) || ['', '.L', '.DE'][l_partkey % 3 + 1] AS symbol, ['EQUITY', 'etf', 'OPTION', 'INDEX'][l_partkey % 4 + 1] AS quote_type,
  ['NMS', 'LSE', 'GER', 'XXX', 'TOR'][l_orderkey % 5 + 1] AS exchange, ['Apple Inc', 'Alphabet Inc', 'Shell plc', 'Leveraged Apple 2x ETP', 'Apple Incorporated'][l_partkey % 5 + 1] AS long_name FROM lineitem)"""
COUNTS = f"(SELECT short_name, count(*) AS article_count, avg(sentiment) AS avg_sentiment FROM {N} WHERE publish_time >= {D17} GROUP BY 1)"
RECENT = f"(SELECT short_name, avg(m) AS recent FROM (SELECT short_name, publish_time::DATE AS day, avg(sentiment) AS m FROM {N} WHERE sentiment IS NOT NULL GROUP BY 1, 2) WHERE day >= DATE '2024-01-28' GROUP BY 1)"
PAGED = f"(SELECT id, source AS page, impact, image, id AS pos FROM {N} WHERE publish_time >= TIMESTAMP '2024-01-30')"
ORACLES = {
    "scoped_feed": f"SELECT id, short_name, publish_time FROM {N} WHERE publish_time >= {D17} AND short_name IN (SELECT w.short_name FROM {W} w JOIN {b.STOCKS} s USING (short_name) WHERE industry = 'EUROPE' OR sector = 'EUROPE') ORDER BY publish_time DESC, id DESC LIMIT 80",
    "scoped_search": f"SELECT id, short_name FROM {N} WHERE publish_time >= {D17} AND (title ILIKE '%view report 2%' OR description ILIKE '%view report 2%') AND short_name IN (SELECT short_name FROM {b.STOCKS} WHERE industry = 'ASIA' OR sector = 'ASIA') ORDER BY publish_time DESC, id DESC LIMIT 500",
    "latest_headlines": f"SELECT id, short_name FROM {N} WHERE publish_time >= TIMESTAMP '2024-01-28' AND relevance = 'direct' AND short_name IN (SELECT short_name FROM {W}) ORDER BY publish_time DESC, id DESC LIMIT 20",
    "symbol_lists": """SELECT n_nationkey, CASE WHEN n_name NOT LIKE '% %' AND length(n_name) <= 20 THEN upper(n_name) || ',BRK.B' || CASE WHEN n_name[1:3] <> n_name THEN ',' || n_name[1:3] ELSE '' END END AS symbols,
        CASE WHEN n_name LIKE '% %' THEN 'invalid symbol: ' || upper(n_name) END AS error FROM nation""",
    "lookup_in_order": f"SELECT pos::INT AS pos, short_name, name FROM (VALUES (0, '31'), (1, '7'), (3, '12')) v(pos, short_name) JOIN {b.STOCKS} USING (short_name)",
    "requested_quotes": f"SELECT pos::INT AS pos, short_name, price, price IS NOT NULL AND (price_updated_at IS NULL OR price_updated_at < {D31} - INTERVAL 15 MINUTE) AS stale FROM (VALUES (0, '31'), (1, '7'), (2, 'nobody'), (3, '12')) v(pos, short_name) LEFT JOIN {STOCKS} USING (short_name)",
    "unresolved": f"SELECT short_name, name FROM {STOCKS} WHERE yahoo_symbol IS NULL",
    "following": "SELECT * FROM (VALUES (true), (false)) v(following)",
    "price_history": f"SELECT * FROM {b.PRICES} WHERE short_name = '7' AND ts >= {D17} AND interval = 'snap'",
    "sentiment_history": f"SELECT short_name, publish_time::DATE AS date, count(*) AS article_count FROM {N} WHERE short_name = '7' AND sentiment IS NOT NULL AND publish_time >= TIMESTAMP '2024-01-11' GROUP BY 1, 2",
    "events_page": f"SELECT short_name, id, title AS headline, publish_time AS created_at FROM {N} WHERE impact = 'high' AND short_name IN ('7', '12') AND publish_time >= {D17} ORDER BY publish_time DESC, id DESC LIMIT 30",
    "flags": "SELECT key, value, holds FROM (VALUES ('llm_scraping', true, false), ('ai_summaries', false, false)) v(key, value, holds)",
    "stock_rows": f'SELECT short_name AS symbol, CASE WHEN quote_currency <> \'\' THEN quote_currency ELSE currency_code END AS "currencyCode", exchange, yahoo_symbol AS "yahooSymbol", price, price_change AS change FROM {STOCKS}',
    "health": f"SELECT (SELECT count(*) FROM customer) AS stocks, (SELECT count(*) FROM {W}) AS watched, (SELECT count(*) FROM {N} WHERE publish_time >= {D17}) AS articles",
    "outcomes": "SELECT CASE WHEN n_regionkey < 3 AND n_nationkey % 2 = 0 THEN 'updated' ELSE 'failed' END AS outcome, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS symbols FROM nation GROUP BY 1",
    "ticker_panels": f"""WITH m AS (SELECT short_name, price_change_percent::DOUBLE AS p, coalesce(recent, avg_sentiment) AS s FROM {b.STOCKS} LEFT JOIN {COUNTS} USING (short_name) LEFT JOIN {RECENT} USING (short_name) WHERE price IS NOT NULL)
        (SELECT 'gainers' AS panel, short_name, round(p, 9) AS value FROM m WHERE p > 0 ORDER BY p DESC, short_name LIMIT 6) UNION ALL (SELECT 'losers', short_name, round(p, 9) FROM m WHERE p < 0 ORDER BY p, short_name LIMIT 6)
        UNION ALL (SELECT 'positive', short_name, round(s, 9) FROM m WHERE s > 0 ORDER BY s DESC, short_name LIMIT 6) UNION ALL (SELECT 'negative', short_name, round(s, 9) FROM m WHERE s < 0 ORDER BY s, short_name LIMIT 6)""",
    "page_by_impact": f"SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos)::INT AS place FROM {PAGED}",
    "page_layout": f"""WITH p AS (SELECT *, first_value(id) OVER (PARTITION BY page ORDER BY image IS NULL, pos) AS lead FROM {PAGED}), q AS (SELECT *, CASE WHEN image IS NOT NULL AND id <> lead THEN row_number() OVER (PARTITION BY page, image IS NOT NULL AND id <> lead ORDER BY pos) END AS k FROM p)
        SELECT id, page, CASE WHEN id = lead THEN 'lead' WHEN k <= 2 THEN 'featured' ELSE 'rest' END AS slot FROM q""",
    "unseen": f"SELECT id, url, source FROM {N} n WHERE NOT EXISTS (SELECT 1 FROM {N} m WHERE m.source = 'view' AND m.id < 2000 AND m.url = n.url)",
    "merged_moves": f"SELECT short_name, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN price_change_percent + 1 ELSE price_change_percent END AS move FROM {b.STOCKS} WHERE price_change_percent IS NOT NULL",
    "search_with_lookup": f"""WITH s AS (SELECT short_name, short_name::INT AS pos FROM {b.STOCKS}), h AS (SELECT * FROM s WHERE short_name LIKE '1_')
        SELECT * FROM (SELECT short_name, 0::INT AS tier, pos FROM s WHERE short_name LIKE '11%' AND short_name NOT IN (SELECT short_name FROM h UNION SELECT '1' || short_name FROM h) UNION ALL SELECT short_name, 1, pos FROM h) ORDER BY tier, pos LIMIT 25""",
    "completion": f"SELECT short_name, short_name::INT AS pos FROM {b.STOCKS} WHERE short_name NOT IN ('2', '5') ORDER BY pos LIMIT 8",
    "display_formats": """WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / CASE WHEN c_custkey % 2 = 0 THEN 1e5::DOUBLE ELSE 1::DOUBLE END END AS v, ['$', '£', 'CHF ', ''][c_custkey % 4 + 1] AS c, c_custkey * 37 % 6000 AS m FROM customer),
        h AS (SELECT *, floor(m / 60 + 0.5)::BIGINT AS h FROM v), a AS (SELECT *, floor(h / 24 + 0.5)::BIGINT AS d FROM h)
        SELECT c_custkey, CASE WHEN v IS NULL THEN '—' WHEN abs(v) < 1 THEN c || format('{:,.4f}', v) ELSE c || format('{:,.2f}', v) END AS price, CASE WHEN v IS NULL THEN '—' ELSE CASE WHEN v >= 0 THEN '+' ELSE '' END || format('{:.2f}', v / 1000) || '%' END AS percent,
        CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN h < 24 THEN h || 'h' ELSE d || 'd' END AS age, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN h < 24 THEN h || ' hr ago' WHEN d = 1 THEN 'yesterday' ELSE d || ' days ago' END AS long_age FROM a""",
    "listing_ranks": f"SELECT short_name, place, search, symbol, exchange, CASE exchange WHEN 'NMS' THEN 0 WHEN 'LSE' THEN 8 WHEN 'GER' THEN 3 WHEN 'TOR' THEN 5 ELSE 12 END::INT AS rank, exchange = 'NMS' AS us, long_name LIKE 'Leveraged%' AS derivative FROM {CANDIDATES}",
    "first_candidates": f"SELECT DISTINCT ON (short_name, symbol) short_name, symbol, search, place FROM {CANDIDATES} ORDER BY short_name, symbol, search, place",
    "looked_up": f"SELECT short_name AS query, min(place * 2 + search) AS place, upper(symbol) AS short_name, arg_min(long_name, place * 2 + search) AS name, CASE arg_min(upper(quote_type), place * 2 + search) WHEN 'EQUITY' THEN 'STOCK' ELSE arg_min(upper(quote_type), place * 2 + search) END AS type, arg_min(exchange, place * 2 + search) AS exchange FROM {CANDIDATES} WHERE quote_type <> 'OPTION' GROUP BY short_name, symbol",
    "work_list": "SELECT p_partkey::VARCHAR AS short_name, p_name AS name FROM part WHERE p_partkey % 6 <> 0 AND p_partkey % 4 <> 0 AND NOT regexp_matches(lower(p_name), 'leverage|inverse|short |etp|etn|certificate|warrant|turbo|option')",
    "request_windows": """WITH s AS (SELECT n_name AS t, CASE WHEN n_nationkey % 3 > 0 THEN array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') WHEN n_nationkey % 2 = 0 THEN 'Co' ELSE '' END AS c FROM nation),
        q AS (SELECT t AS short_name, CASE WHEN lower(c) = lower(t) THEN '"' || c || '"' ELSE CASE WHEN c <> '' THEN '"' || c || '" OR ' ELSE '' END || '"' || t || ' stock" OR "' || t || ' shares"' END AS x FROM s)
        SELECT short_name, i::INT AS ordinal, x || ' after:' || strftime(DATE '2024-01-31' - least(i * 7 + 7, 30)::INT, '%Y-%m-%d') || ' before:' || strftime(DATE '2024-01-31' - (i * 7)::INT, '%Y-%m-%d') AS query, CASE WHEN i % 2 = 0 THEN 'US' ELSE 'GB' END AS edition FROM q, range(5) r(i)
        UNION ALL SELECT short_name, 0, x || ' when:2d', 'US' FROM q""",
    "source_list": f"""WITH s AS (SELECT short_name, CASE WHEN yahoo_symbol IS NULL THEN short_name ELSE yahoo_symbol || '.X' END AS t, coalesce(yahoo_symbol, short_name) AS u, exchange FROM {STOCKS})
        SELECT short_name, source, t AS ticker FROM s, (VALUES ('GOOGLE_NEWS'), ('YAHOO_SEARCH'), ('YAHOO_RSS'), ('BING_NEWS')) v(source) UNION ALL SELECT short_name, source, u FROM s, (VALUES ('FINVIZ'), ('NASDAQ_RSS'), ('SEC_EDGAR')) v(source) WHERE exchange = 'NMS'""",
    "image_patch": f"""SELECT n.id, coalesce(image, CASE WHEN p.id IS NOT NULL AND n.url NOT LIKE '%3' THEN regexp_extract(n.url, '^(https://[^/]*)', 1) || '/i.png?u=1' END) AS image FROM {N} n
        LEFT JOIN (SELECT id FROM {N} WHERE image IS NULL AND source_domain IS NOT NULL ORDER BY publish_time DESC, id DESC LIMIT 500) p ON p.id = n.id""",
    "catalogue_growth": f"""WITH p AS (SELECT (s_suppkey * 40)::VARCHAR AS short_name, s_name AS name, 'ETF' AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'GBP' END AS c FROM supplier WHERE s_suppkey % 9 > 0)
        SELECT coalesce(s.short_name, p.short_name) AS short_name, coalesce(p.name, s.name) AS name, coalesce(p.type, s.type) AS type, CASE WHEN s.short_name IS NULL THEN c ELSE coalesce(c, 'USD') END AS currency_code FROM {b.STOCKS} s FULL JOIN p ON p.short_name = s.short_name""",
    "watch_changes": f"SELECT short_name, position FROM {W} UNION ALL SELECT 'X1', max(position) + 1 FROM {W}",
}
