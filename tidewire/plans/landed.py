"""Queries on landed payloads, which the tables' own rows are rendered to and parsed back from, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.operators import listings, rollups
from tidewire.plans import bindings as b
from tidewire.shared import shared_dir
from tidewire.sources import html, payloads, requests

AS_OF = datetime(2024, 1, 31)


def gathered(rows: DataFrame, key: str, order: list[Column], item: Column, head: str, tail: str) -> DataFrame:
    """payload_id and payload: the items of each key in order, between head and tail."""
    held = rows.groupBy(F.col(key).cast("long").alias("payload_id")).agg(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), item.alias("item")))).alias("xs"))
    return held.select("payload_id", F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["item"]), ""), F.lit(tail)).alias("payload"))


def element(name: str, text: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), text, F.lit(f"</{name}>"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """Each user's articles as an RSS document with a namespace, marked sections, escaped markup and items that lack a link."""
    k = F.col("id")
    title = F.concat("title", F.lit(" & more"), F.when(k % 3 == 0, F.concat(F.lit(" - "), "source")).otherwise(""))
    shown = F.when(k % 2 == 0, F.concat(F.lit("<![CDATA["), title, F.lit("]]>"))).otherwise(escaped(title))
    link = F.when(k % 11 == 0, "").otherwise(element("link", escaped(F.concat("url", F.lit("?a=1&b=2")))))
    origin = F.concat(F.lit('<source url="https://www.'), "source", F.lit('.com/?x=>">'), "source", F.lit("</source>"))
    parts = [element("title", shown), link, element("pubDate", F.date_format("publish_time", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), element("description", escaped(F.concat(F.lit("<p>All <b>about</b> "), "source", F.lit("</p>")))), origin, F.lit('<media:thumbnail url="https://img.example/1.png"/>')]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- feed --><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>All</title>'
    return gathered(b.news(spark, d), "short_name", [k], element("item", F.concat(*parts)), head, "</channel></rss>")


def rss_articles(spark, d):
    rows = payloads.rss_items(feeds(spark, d))
    return rows.select("payload_id", "ordinal", "title", "url", "source", "source_domain", "description", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


FORMS = ("8-K/A", "4", "424B5", "S-4", "10-Q", "SC 13D/A")


def filings(spark, d):
    """Each customer's orders as an Atom document; every other entry has its fields inside its content."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    fields = F.concat(element("filing-type", form), F.when(k % 5 != 0, element("filing-href", F.concat(F.lit("https://sec.gov/"), k.cast("string")))).otherwise(""), element("filing-date", F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k % 4 != 0, element("form-name", escaped(F.concat(F.lit("Report & "), "o_orderpriority")))).otherwise(""))
    entry = element("entry", F.concat(F.when(k % 2 == 0, fields).otherwise(element("content", fields, ' type="text/xml"')), F.when(k % 10 != 0, F.concat(F.lit('<link rel="alternate" href="https://sec.gov/l/'), k.cast("string"), F.lit('"/>'))).otherwise("")))
    documents = gathered(b.table(spark, d, "orders"), "o_custkey", [k], entry, '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>")
    return payloads.filings(documents, F.concat(F.lit("Customer "), F.col("payload_id").cast("string"))).select("payload_id", "ordinal", "title", "url", "description", F.to_date("published_at").cast("string").alias("filed"))


def tables_of_news(spark: SparkSession, d: str) -> DataFrame:
    """Each user's articles, newest first, as a page with a table; only the first row of a day says the day."""
    at = F.from_utc_timestamp(F.col("publish_time").cast("timestamp"), "America/New_York")
    newest = Window.partitionBy("short_name").orderBy(F.desc("publish_time"), F.desc("id"))
    before = F.lag(F.to_date(at)).over(newest)
    rows = b.news(spark, d).withColumns({"day": at, "same": F.coalesce(before == F.to_date(at), F.lit(False)), "nth": F.row_number().over(newest)})
    stamp = F.when(F.col("same"), F.date_format("day", "hh:mma")).otherwise(F.date_format("day", "MMM-dd-yy hh:mma"))
    href = F.when(F.col("id") % 4 == 0, F.concat(F.lit("/news/"), F.col("id").cast("string"))).otherwise(F.concat("url", F.lit("?x=1&amp;y=2")))
    anchor = F.concat(F.lit("<a class='t' title=\"a > b\" HREF='"), href, F.lit("'>"), "title", F.lit(" &amp; more</a>"))
    row = element("tr", F.concat(F.lit("<!-- <td>no</td> -->"), element("td", stamp, " align=right"), element("td", F.concat(anchor, F.lit(" <span>("), "source", F.lit(")</span>")))))
    head = '<html><head><title>News</title><script>var t = "<table id=\'news-table\'><tr><td>";</script></head><body><table><tr><td>x</td><td><a href="/no">No</a></td></tr></table><table id="news-table">'
    return gathered(rows, "short_name", [F.col("nth")], row, head, "</table><p>end</p></body></html>")


def quote_rows(spark, d):
    rows = html.quote_table(tables_of_news(spark, d), AS_OF)
    return rows.select("payload_id", "title", "url", "source", "source_domain", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


def page_parts(spark, d):
    """What every page has: its title, image, number of links, and digests of the links and of the visible text."""
    rows = html.page_parts(b.table(spark, d, "pages"))
    return rows.select("page_id", "title", "image", F.size("links").cast("long").alias("n_links"), F.sha2(F.array_join("links", "\n"), 256).alias("links_sha256"), F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))


def quote_chain(spark, d):
    """A quote of each customer from the first of three sources that has one."""
    k = F.col("c_custkey")
    p = (k * 37 % 9000 + 100).cast("double")
    own = b.table(spark, d, "customer").select(k.alias("payload_id"), F.concat(F.lit("C"), k.cast("string")).alias("symbol"), p.alias("p"))
    key = F.col("payload_id")
    price = F.when(key % 7 != 0, F.col("p") + 0.5)
    meta = F.struct("symbol", F.when(key % 2 == 0, "GBp").otherwise("USD").alias("currency"), price.alias("regularMarketPrice"))
    closes = F.struct(F.array(F.struct(F.array(F.col("p") - 3, F.lit(None).cast("double"), F.col("p")).alias("close"))).alias("quote"))
    chart = F.to_json(F.struct(F.struct(F.array(F.struct(meta.alias("meta"), F.expr("array(1, 2, 3)").alias("timestamp"), closes.alias("indicators"))).alias("result")).alias("chart")))
    charts = payloads.chart_quotes(own.select("payload_id", F.when(key % 3 != 1, chart).otherwise("{}").alias("payload")))
    sale = F.struct(F.concat(F.lit("$"), F.format_number(F.col("p") / 100, 2)).alias("lastSalePrice"), F.lit("0.25").alias("netChange"), F.lit("2.44%").alias("percentageChange"))
    listed = F.to_json(F.struct(F.struct("symbol", F.lit("NMS").alias("exchange"), F.struct(F.lit("$1.00").alias("lastSalePrice")).alias("primaryData"), sale.alias("secondaryData")).alias("data")))
    nasdaq = requests.nasdaq_quotes(own.select("payload_id", F.concat("symbol", F.when(key % 10 == 0, ".L").otherwise("")).alias("requested"), F.when(key % 3 != 2, listed).otherwise("not JSON").alias("payload")))
    shown = F.struct("symbol", F.lit("LSE").alias("exchange"), F.format_number("p", 2).alias("last"), F.when(key % 2 == 0, "GBp").otherwise("EUR").alias("currencyCode"), F.format_number(F.col("p") - 3, 2).alias("previous_day_closing"), F.lit("UNCH").alias("change"), F.lit("0.71%").alias("change_pct"))
    cnbc = requests.cnbc_quotes(own.select("payload_id", F.to_json(F.struct(F.struct(F.array(shown).alias("FormattedQuote")).alias("FormattedQuoteResult"))).alias("payload")))
    return payloads.first_quote(*(q.select("symbol", "currency", "price", "previous_close", "change_percent") for q in (charts, nasdaq, cnbc)))


NAMES = ("Reuters", "The Motley Fool on MSN", "Barron's | Markets", "www.s{}.org", "Paper {}", "CNBC - News", None)
DOMAINS = ("reuters.com", "fool.com", "barrons.com", "s{}.org", "", "cnbc.com", "")


def publishers(spark, d):
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    return b.table(spark, d, "supplier").select(k, requests.publisher_domain(F.replace(name, F.lit("{}"), k.cast("string"))).alias("domain"))


def stored_rollup(spark, d):
    """The daily roll-up of all articles after two batches of changes: new articles, then late, changed and withdrawn scores."""
    path = f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}/rollup-{uuid.uuid4().hex}"
    k, rows = F.col("id"), b.news(spark, d).select("id", "short_name", "publish_time", "sentiment")
    early = F.when(k % 3 != 0, F.col("sentiment"))
    final = F.when(k % 5 == 0, -F.col("sentiment")).when(k % 7 != 0, F.col("sentiment"))
    rollups.applied(spark, path, rows.withColumns({"before": F.lit(None).cast("double"), "sentiment": early}))
    rollups.applied(spark, path, rows.withColumns({"before": early, "sentiment": final}).where(~F.col("before").eqNullSafe(F.col("sentiment"))))
    # sums that are taken back leave rounding behind
    return rollups.daily(rollups.stored(spark, path)).withColumn("avg_sentiment", F.round("avg_sentiment", 6))


def watch_refresh(spark, d):
    """The followed customers' quotes, and which of them have one."""
    k = F.col("short_name").cast("int")
    stocks = b.stocks(spark, d).select("short_name", F.when(k % 6 != 0, F.concat(F.lit("C"), "short_name")).alias("yahoo_symbol"), F.lit("USD").alias("quote_currency"), F.col("price").cast("double").alias("price"), F.lit(0.0).alias("price_change"), F.lit(0.0).alias("price_change_percent"), F.lit(None).cast("timestamp").alias("price_updated_at"))
    watched = b.stocks(spark, d).where(k % 4 == 0).select("short_name").unionByName(spark.createDataFrame([("none",)], "short_name string"))
    quotes = quote_chain(spark, d).withColumn("change", F.lit(0.25)).where("symbol NOT LIKE '%8'")
    kept, told = listings.refreshed(stocks, watched, quotes, AS_OF)
    return kept.join(told, "short_name", "full").select("short_name", "quote_currency", "price", "price_change", F.col("price_updated_at").isNotNull().alias("updated"), "ok")


QUERIES = {f.__name__: f for f in (rss_articles, filings, quote_rows, page_parts, quote_chain, publishers, stored_rollup, watch_refresh)}

LIST = lambda xs: "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in xs) + "]"
CHAIN = """WITH c AS (SELECT c_custkey AS k, (c_custkey * 37 % 9000 + 100)::DOUBLE AS p, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 1 END::DOUBLE AS unit FROM customer),
    q AS (SELECT k, CASE WHEN k % 3 <> 1 THEN CASE WHEN k % 2 = 0 THEN 'GBP' ELSE 'USD' END WHEN k % 10 <> 0 THEN 'USD' WHEN k % 2 = 0 THEN 'GBP' ELSE 'EUR' END AS currency,
      round(CASE WHEN k % 3 <> 1 THEN (p + CASE WHEN k % 7 <> 0 THEN 0.5::DOUBLE ELSE 0 END) / unit WHEN k % 10 <> 0 THEN p / 100 ELSE p / unit END, 6) AS price, round(CASE WHEN k % 3 <> 1 THEN (p - 3) / unit WHEN k % 10 <> 0 THEN p / 100 - 0.25::DOUBLE ELSE (p - 3) / unit END, 6) AS previous_close FROM c)
    SELECT 'C' || k AS symbol, currency, price, previous_close, CASE WHEN k % 3 <> 1 THEN round((price - previous_close) / previous_close * 100, 3) WHEN k % 10 <> 0 THEN 2.44::DOUBLE ELSE 0.71::DOUBLE END AS change_percent FROM q"""
ORACLES = {
    "rss_articles": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY short_name ORDER BY id) - 1 AS ordinal FROM {b.NEWS})
        SELECT short_name::BIGINT AS payload_id, ordinal::INT AS ordinal, title || ' & more' AS title, url || '?a=1&b=2' AS url, source, source || '.com' AS source_domain, 'All about ' || source AS description, strftime(publish_time, '%Y-%m-%d %H:%M:%S') AS published
        FROM n WHERE id % 11 <> 0 AND ordinal < 100""",
    "filings": f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal, {LIST(FORMS)}[o_orderkey % 6 + 1] AS form, CASE WHEN o_orderkey % 4 <> 0 THEN 'Report & ' || o_orderpriority END AS name FROM orders)
        SELECT o_custkey AS payload_id, ordinal::INT AS ordinal, 'Customer ' || o_custkey || ' filed ' || form || coalesce(': ' || name, '') AS title, CASE WHEN o_orderkey % 5 <> 0 THEN 'https://sec.gov/' || o_orderkey ELSE 'https://sec.gov/l/' || o_orderkey END AS url, name AS description, strftime(o_orderdate, '%Y-%m-%d') AS filed
        FROM n WHERE ordinal < 25 AND form NOT IN ('4', 'S-4') AND o_orderkey % 10 <> 0""",
    "quote_rows": f"""SELECT short_name::BIGINT AS payload_id, title || ' & more' AS title, CASE WHEN id % 4 = 0 THEN 'https://finviz.com/news/' || id ELSE url || '?x=1&y=2' END AS url, source, CASE WHEN id % 4 = 0 THEN 'finviz.com' ELSE source || '.com' END AS source_domain, strftime(publish_time, '%Y-%m-%d %H:%M') AS published FROM {b.NEWS}""",
    "quote_chain": CHAIN,
    "stored_rollup": f"""WITH n AS (SELECT short_name, publish_time::DATE AS date, CASE WHEN id % 5 = 0 THEN -sentiment WHEN id % 7 <> 0 THEN sentiment END AS s FROM {b.NEWS})
        SELECT short_name, date, round(avg(s), 6) AS avg_sentiment, count(*) AS article_count, count(*) FILTER (s > 0.2::DOUBLE) AS positive_count, count(*) FILTER (s < -0.2::DOUBLE) AS negative_count, count(*) FILTER (s BETWEEN -0.2::DOUBLE AND 0.2::DOUBLE) AS neutral_count FROM n WHERE s IS NOT NULL GROUP BY 1, 2""",
    "watch_refresh": f"""WITH q AS ({CHAIN}), s AS (SELECT short_name, CASE WHEN short_name::INT % 6 <> 0 THEN 'C' || short_name END AS y, price::DOUBLE AS price, short_name::INT % 4 = 0 AS watched FROM {b.STOCKS}),
        r AS (SELECT s.*, q.currency, q.price AS quoted FROM s LEFT JOIN q ON s.watched AND q.symbol = s.y AND q.symbol NOT LIKE '%8')
        SELECT short_name, coalesce(currency, 'USD') AS quote_currency, coalesce(quoted, price) AS price, CASE WHEN quoted IS NULL THEN 0 ELSE 0.25 END::DOUBLE AS price_change, quoted IS NOT NULL AS updated, CASE WHEN watched THEN quoted IS NOT NULL END AS ok FROM r
        UNION ALL SELECT 'none', NULL, NULL, NULL, false, false""",
    "publishers": f"SELECT s_suppkey, replace({LIST(DOMAINS)}[s_suppkey % {len(DOMAINS)} + 1], '{{}}', s_suppkey::VARCHAR) AS domain FROM supplier",
}
