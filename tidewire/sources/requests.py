"""What is asked of which source, and quotes and names from landed answers. Fetching is not the engine's business."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import normalize
from tidewire.operators.listings import is_us_listing

#: Days of a window of a backfill, days from which one is asked, editions in turn.
WINDOW_DAYS, BACKFILL_FROM, EDITIONS = 7, 3, ("US", "GB")
#: Sources of every listing, and of those in the United States only.
ALL_SOURCES, US_SOURCES = ("GOOGLE_NEWS", "YAHOO_SEARCH", "YAHOO_RSS", "BING_NEWS"), ("FINVIZ", "NASDAQ_RSS", "SEC_EDGAR")
#: Countries by suffix of a symbol.
COUNTRIES = {"L": "GB", "DE": "DE", "F": "DE", "PA": "FR", "AS": "NL", "BR": "BE", "MI": "IT", "MC": "ES", "SW": "CH", "ST": "SE", "CO": "DK", "OL": "NO", "HE": "FI", "VI": "AT", "LS": "PT", "TO": "CA", "HK": "HK", "T": "JP", "AX": "AU", "NZ": "NZ"}
#: Domains of publishers by name.
PUBLISHERS = {
    "reuters": "reuters.com", "bloomberg": "bloomberg.com", "bloomberg.com": "bloomberg.com", "financial times": "ft.com", "the wall street journal": "wsj.com", "wsj": "wsj.com",
    "wsj.com": "wsj.com", "the associated press": "apnews.com", "associated press": "apnews.com", "ap news": "apnews.com", "cnbc": "cnbc.com", "barron's": "barrons.com",
    "barrons.com": "barrons.com", "barrons": "barrons.com", "marketwatch": "marketwatch.com", "the economist": "economist.com", "the new york times": "nytimes.com",
    "the guardian": "theguardian.com", "bbc": "bbc.co.uk", "bbc news": "bbc.co.uk", "the telegraph": "telegraph.co.uk", "the times": "thetimes.co.uk", "sky news": "news.sky.com",
    "cnn": "cnn.com", "fortune": "fortune.com", "forbes": "forbes.com", "business insider": "businessinsider.com", "investor's business daily": "investors.com",
    "investors business daily": "investors.com", "yahoo finance": "finance.yahoo.com", "yahoo entertainment": "finance.yahoo.com", "seeking alpha": "seekingalpha.com",
    "morningstar": "morningstar.com", "the motley fool": "fool.com", "motley fool": "fool.com", "fool.com": "fool.com", "zacks investment research": "zacks.com", "zacks": "zacks.com",
    "benzinga": "benzinga.com", "investing.com": "investing.com", "thestreet": "thestreet.com", "simply wall st.": "simplywall.st", "simply wall st": "simplywall.st",
    "tipranks": "tipranks.com", "insider monkey": "insidermonkey.com", "stocktwits": "stocktwits.com", "quartz": "qz.com", "axios": "axios.com", "the verge": "theverge.com",
    "techcrunch": "techcrunch.com", "ars technica": "arstechnica.com", "engadget": "engadget.com", "cnet": "cnet.com", "wired": "wired.com", "space.com": "space.com",
    "spacenews": "spacenews.com", "ars technica uk": "arstechnica.com", "schaeffer's research": "schaeffersresearch.com", "gurufocus": "gurufocus.com",
    "24/7 wall st.": "247wallst.com", "proactive investors": "proactiveinvestors.co.uk", "city a.m.": "cityam.com", "this is money": "thisismoney.co.uk",
    "the motley fool uk": "fool.co.uk", "hargreaves lansdown": "hl.co.uk", "handelsblatt": "handelsblatt.com", "der spiegel": "spiegel.de", "boerse online": "boerse-online.de",
    "finanzen.net": "finanzen.net", "le monde": "lemonde.fr", "les echos": "lesechos.fr", "rttnews": "rttnews.com", "nasdaq": "nasdaq.com", "sec edgar": "sec.gov",
    "invezz": "invezz.com", "baystreet.ca": "baystreet.ca", "the globe and mail": "theglobeandmail.com", "financial post": "financialpost.com",
    "the economic times": "economictimes.indiatimes.com", "south china morning post": "scmp.com", "msn": "msn.com",
}
SESSION = "struct<lastSalePrice:string,netChange:string,percentageChange:string>"
NASDAQ = f"data struct<symbol:string,exchange:string,primaryData:{SESSION},secondaryData:{SESSION}>"
CNBC = "FormattedQuoteResult struct<FormattedQuote:array<struct<symbol:string,exchange:string,last:string,currencyCode:string,previous_day_closing:string,change:string,change_pct:string>>>"


def publisher_domain(name: Column) -> Column:
    """A known publisher's domain, that of the original of a republished story, a name that is a domain; else empty."""
    known = F.create_map(*(F.lit(x) for pair in PUBLISHERS.items() for x in pair))
    plain = F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"(?i)\s*[-–—|]\s*(news|online|finance|markets?)$", "")))
    original = F.trim(F.regexp_replace(plain, r"(?i)\s+on\s+(msn|yahoo|aol|flipboard)\b.*$", ""))
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, original), F.when(plain.contains(".") & ~plain.contains(" "), F.regexp_replace(plain, r"^www\.", "")), F.lit(""))


def query_text(short_name: Column, company: Column) -> Column:
    """The company as a phrase, or the symbol in phrases of stock and shares where it is another word."""
    name, ticker = F.trim(F.coalesce(company, F.lit(""))), F.trim(short_name)
    quoted = lambda *parts: F.concat(F.lit('"'), *parts, F.lit('"'))
    other = (ticker != "") & (F.lower(ticker) != F.lower(name))
    text = F.concat_ws(" OR ", F.when(name != "", quoted(name)), F.when(other, quoted(ticker, F.lit(" stock"))), F.when(other, quoted(ticker, F.lit(" shares"))))
    return F.when(text == "", quoted(ticker)).otherwise(text)


def windows(stocks: DataFrame, as_of, days: int) -> DataFrame:
    """Requests of each stock, ``ordinal`` from 0: weekly windows newest first for a backfill, else the last days."""
    text, today = query_text(F.col("short_name"), F.col("name")), F.lit(as_of).cast("date")
    if days <= BACKFILL_FROM:
        return stocks.select("short_name", F.lit(0).alias("ordinal"), F.concat(text, F.lit(f" when:{max(1, days)}d")).alias("query"), F.lit(EDITIONS[0]).alias("edition"))
    each = stocks.select("short_name", text.alias("text"), F.posexplode(F.sequence(F.lit(0), F.lit(days - 1), F.lit(WINDOW_DAYS))).alias("ordinal", "start"))
    before, after = F.date_sub(today, F.col("start")), F.date_sub(today, F.least(F.col("start") + WINDOW_DAYS, F.lit(days)))
    query = F.concat("text", F.lit(" after:"), after.cast("string"), F.lit(" before:"), before.cast("string"))
    return each.select("short_name", "ordinal", query.alias("query"), F.element_at(F.array(*map(F.lit, EDITIONS)), F.col("ordinal") % len(EDITIONS) + 1).alias("edition"))


def sources_of(stocks: DataFrame) -> DataFrame:
    """short_name, source and the ticker that it is asked for; three sources carry listings of the United States only."""
    ticker = F.coalesce(F.nullif("yahoo_symbol", F.lit("")), "short_name")
    every = F.array(*map(F.lit, ALL_SOURCES))
    names = F.when(is_us_listing(F.col("exchange")), F.concat(every, F.array(*map(F.lit, US_SOURCES)))).otherwise(every)
    each = stocks.select("short_name", ticker.alias("ticker"), F.explode(names).alias("source"))
    return each.select("short_name", "source", F.when(F.col("source").isin(*US_SOURCES), F.split_part("ticker", F.lit("."), F.lit(1))).otherwise(F.col("ticker")).alias("ticker"))


def united(*sources: DataFrame) -> DataFrame:
    """The bag union of what the sources gave; one that gave nothing adds nothing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def nasdaq_quotes(payloads: DataFrame) -> DataFrame:
    """payload_id, requested (the symbol) and payload to quotes in dollars; suffixed symbols and indices are refused, the regular session counts where it is there."""
    rows = payloads.where("requested NOT LIKE '%.%' AND requested NOT LIKE '%^%'").select("payload_id", "requested", F.from_json("payload", NASDAQ)["data"].alias("d"))
    session = F.when(F.coalesce("d.secondaryData.lastSalePrice", F.lit("")) != "", F.col("d.secondaryData")).otherwise(F.col("d.primaryData"))
    number = lambda name: normalize.shown_number(F.col(f"s.{name}"))
    held = rows.withColumn("s", session).select("payload_id", F.coalesce(F.nullif("d.symbol", F.lit("")), "requested").alias("symbol"), F.col("d.exchange").alias("exchange"), F.lit("USD").alias("currency"), number("lastSalePrice").alias("price"), number("netChange").alias("change"), number("percentageChange").alias("change_percent"))
    return held.where("price IS NOT NULL AND price <> 0").select("payload_id", "symbol", "exchange", "currency", F.round("price", 6).alias("price"), F.round(F.col("price") - F.col("change"), 6).alias("previous_close"), "change", "change_percent")


def cnbc_symbols(symbol: Column) -> Column:
    """The symbol itself, and its base with the country of its suffix."""
    base, suffix = F.regexp_extract(symbol, r"^(.*)\.[^.]*$", 1), F.upper(F.regexp_extract(symbol, r"\.([^.]*)$", 1))
    country = F.try_element_at(F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair)), suffix)
    return F.array_compact(F.array(symbol, F.concat(base, F.lit("-"), country)))


def cnbc_quotes(payloads: DataFrame) -> DataFrame:
    """payload_id and payload to quotes: display strings to numbers, minor units divided out, the change else from the previous close."""
    quote = F.get(F.from_json("payload", CNBC)["FormattedQuoteResult"]["FormattedQuote"], F.lit(0))
    number = lambda name: normalize.shown_number(F.col(f"q.{name}"))
    rows = payloads.select("payload_id", quote.alias("q")).select("payload_id", "q.symbol", "q.exchange", normalize.major_currency(F.col("q.currencyCode")).alias("unit"), number("last").alias("last"), number("previous_day_closing").alias("previous"), number("change").alias("moved"), number("change_pct").alias("change_percent"))
    divided = lambda c: F.round(c / F.col("unit.divisor"), 6)
    previous = F.when(F.col("previous") != 0, F.col("previous"))
    return rows.where("last IS NOT NULL AND last <> 0").select("payload_id", "symbol", "exchange", F.col("unit.code").alias("currency"), divided(F.col("last")).alias("price"), divided(previous).alias("previous_close"), divided(F.coalesce("moved", F.col("last") - previous)).alias("change"), "change_percent")


def seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of instruments; a blank currency is null."""
    rows = spark.read.schema("symbol string, name string, type string, currency string").json(path, multiLine=True)
    return rows.select(F.col("symbol").alias("short_name"), "name", "type", F.nullif("currency", F.lit("")).alias("currency_code"))


def imported(source: DataFrame, target: DataFrame) -> DataFrame:
    """The columns that both have, without regard to case, as the target's; its others are null."""
    names = {c.lower(): c for c in source.columns}
    return source.select(*((F.col(names[f.name.lower()]) if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema))
