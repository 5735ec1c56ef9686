"""Landed feed payloads to rows. Fetching is not the engine's business: payloads arrive as a column of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import normalize
from tidewire.sources.html import image_of, quote_table, tokens  # noqa: F401

#: Form types whose filings are news.
MATERIAL = ("8-K", "10-K", "10-Q", "6-K", "20-F", "40-F", "425", "DEF 14A", "DEFM14A", "SC 13D", "SC TO", "S-1", "S-3", "424B")
#: Entities of running text.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "pound": "£", "euro": "€", "amp": "&"}
CHART = "chart struct<result:array<struct<meta:struct<symbol:string,exchangeName:string,currency:string,regularMarketPrice:double,previousClose:double,chartPreviousClose:double>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>"
SEARCH = "news array<struct<title:string,link:string,publisher:string,providerPublishTime:bigint,thumbnail:struct<resolutions:array<struct<url:string,width:int>>>>>"


def stripped(html: Column, most: int | None = None) -> Column:
    """Text without tags and with single blanks."""
    text = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
    return F.substring(text, 1, most) if most else text


def unescaped(text: Column) -> Column:
    """Text with its entities, numeric ones too, as characters; others stay as they are."""
    point = lambda digits, base: F.decode(F.unhex(F.lpad(F.conv(digits, base, 16), 8, "0")), "UTF-32")
    marked = F.regexp_replace(text, r"&#(x[0-9a-fA-F]{1,5}|[0-9]{1,6});", "\x01$1\x02")
    number = lambda x: F.substring_index(x, "\x02", 1)
    read = lambda x: F.when(number(x).startswith("x"), point(F.substring(number(x), 2, 9), 16)).otherwise(point(number(x), 10))
    out = F.array_join(F.transform(F.split(marked, "\x01"), lambda x: F.when(x.contains("\x02"), F.concat(read(x), F.substring_index(x, "\x02", -1))).otherwise(x)), "")
    for name, said in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(said))
    return out


RSS = "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string,source:struct<_VALUE:string,_url:string>>>>"
ATOM_FIELDS = "`filing-type`:string,`filing-href`:string,`filing-date`:string,`form-name`:string"
ATOM = f"entry array<struct<{ATOM_FIELDS},link:struct<_href:string>,content:struct<{ATOM_FIELDS}>>>"


def parsed(payload: Column, schema: str) -> Column:
    """An XML payload by its schema: prefixes of names don't count, attributes begin with _; what is no XML has nulls."""
    return F.from_xml(payload, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def rss_items(payloads: DataFrame, *, most: int = 100, source_type: str = "GOOGLE_NEWS") -> DataFrame:
    """payload_id and payload (RSS) to articles, the first ``most`` items; items without title or link go.

    A trailing " - Publisher" that names the publisher is cut from the title. Payloads that are no XML give no rows.
    """
    items = F.slice(parsed(F.col("payload"), RSS)["channel"]["item"], 1, most)
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = payloads.select("payload_id", F.posexplode(items).alias("ordinal", "item")).select(
        "payload_id", "ordinal", plain(F.col("item.title")).alias("title"), plain(F.col("item.link")).alias("url"), plain(F.col("item.pubDate")).alias("published"), stripped(unescaped(plain(F.col("item.description"))), 600).alias("description"), plain(F.col("item.source._VALUE")).alias("source"), plain(F.col("item.source._url")).alias("source_url"),
    )
    ending = F.concat(F.lit(" - "), F.col("source"))
    title = F.when((F.col("source") != "") & F.endswith("title", ending), F.expr("left(title, length(title) - length(source) - 3)")).otherwise(F.col("title"))
    unwrapped = F.when(F.col("url").rlike("[?&]url=http"), F.url_decode(F.regexp_extract("url", "[?&]url=([^&]+)", 1))).otherwise(F.col("url"))
    known = rows.where("title <> '' AND url <> ''").withColumns({"title": title, "url": unwrapped})
    domain = F.coalesce(F.nullif(normalize.domain_of(F.col("source_url")), F.lit("")), normalize.domain_of(F.col("url")))
    return known.select("payload_id", "ordinal", "title", "url", normalize.parsed_time(F.col("published")).alias("published_at"), F.nullif("description", F.lit("")).alias("description"), F.lit(None).cast("string").alias("image"), F.coalesce(F.nullif("source", F.lit("")), domain).alias("source"), domain.alias("source_domain"), F.lit(source_type).alias("source_type"))


def search_news(payloads: DataFrame) -> DataFrame:
    """JSON search results with their widest thumbnail, the first of equals."""
    rows = payloads.select("payload_id", F.posexplode(F.from_json("payload", SEARCH)["news"]).alias("ordinal", "n"))
    widths = F.transform(F.col("n.thumbnail.resolutions"), lambda r, i: F.struct(F.coalesce(r["width"], F.lit(0)).alias("width"), (-i).alias("at"), r["url"].alias("url")))
    return rows.where("n.title <> '' AND n.link <> ''").select("payload_id", "ordinal", F.col("n.title").alias("title"), F.col("n.link").alias("url"), F.timestamp_seconds("n.providerPublishTime").alias("published_at"), F.array_max(widths)["url"].alias("image"), F.col("n.publisher").alias("source"), normalize.domain_of(F.col("n.link")).alias("source_domain"), F.lit("YAHOO_SEARCH").alias("source_type"))


def filings(payloads: DataFrame, company: Column, most: int = 25) -> DataFrame:
    """Atom entries whose form begins as a material one does; the title is company, filed, form and the form's name."""
    entries = F.slice(parsed(F.col("payload"), ATOM)["entry"], 1, most)
    inner = lambda name: F.trim(F.coalesce(F.col("entry")[name], F.col("entry.content")[name], F.lit("")))
    own = payloads.select("payload_id", company.alias("company"), F.posexplode(entries).alias("ordinal", "entry"))
    link = F.coalesce(F.nullif(inner("filing-href"), F.lit("")), F.col("entry.link._href"))
    rows = own.select("payload_id", "company", "ordinal", inner("filing-type").alias("form"), inner("form-name").alias("form_name"), link.alias("url"), normalize.parsed_time(inner("filing-date")).alias("published_at"))
    title = F.concat("company", F.lit(" filed "), "form", F.when(F.col("form_name") != "", F.concat(F.lit(": "), "form_name")).otherwise(""))
    kept = rows.where(F.upper("form").rlike("^(?:" + "|".join(MATERIAL) + ")") & (F.col("url") != ""))
    return kept.select("payload_id", "ordinal", title.alias("title"), "url", "published_at", F.nullif("form_name", F.lit("")).alias("description"), F.lit("SEC EDGAR").alias("source"), F.lit("sec.gov").alias("source_domain"), F.lit("SEC_EDGAR").alias("source_type"))


def chart_quotes(payloads: DataFrame) -> DataFrame:
    """Chart JSON to one quote each: minor units divided out, null closes skipped, the price else the last close,
    the previous close else the last close but one, else what the chart began from."""
    result = F.get(F.from_json("payload", CHART)["chart"]["result"], F.lit(0))
    rows = payloads.select("payload_id", result.alias("r")).where("r IS NOT NULL").withColumn("unit", normalize.major_currency(F.col("r.meta.currency")))
    closes = F.filter(F.get(F.col("r.indicators.quote"), F.lit(0))["close"], lambda c: c.isNotNull())
    divided = lambda c: F.round(c / F.col("unit.divisor"), 6)
    price = divided(F.coalesce("r.meta.regularMarketPrice", F.try_element_at(closes, F.lit(-1))))
    previous = divided(F.coalesce(F.col("r.meta.previousClose"), F.try_element_at(closes, F.lit(-2)), F.col("r.meta.chartPreviousClose")))
    shown = rows.select("payload_id", F.col("r.meta.symbol").alias("symbol"), F.col("r.meta.exchangeName").alias("exchange"), F.col("unit.code").alias("currency"), price.alias("price"), previous.alias("previous_close")).where("price IS NOT NULL")
    change = F.col("price") - F.col("previous_close")
    return shown.withColumns({"change": F.round(change, 6), "change_percent": F.when(F.col("previous_close") != 0, F.round(change / F.col("previous_close") * 100, 3))})


def first_quote(*sources: DataFrame) -> DataFrame:
    """Per symbol the quote of the first source that has one."""
    ranked = [s.withColumn("__tier", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for s in ranked[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("__tier")
    return out.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__tier")


def progress(lines: DataFrame, schema: str, key: str) -> DataFrame:
    """JSON lines (line_no, value); malformed ones are skipped, the last of a key wins."""
    rows = lines.select("line_no", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("__key")).agg(F.max_by("r", "line_no").alias("r")).select("r.*")


def joined_url(base: Column, url: Column) -> Column:
    """A URL as it is meant on a page of the base's: absolute, of its scheme, of its host, or of its folder."""
    origin, folder = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    under = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), url)).when(url.startswith("/"), F.concat(origin, url)).otherwise(F.concat(under, F.regexp_replace(url, r"^\./", "")))


def page_image(html: Column, base: Column) -> Column:
    """A page's image, absolute by the page's own URL ``base``."""
    return joined_url(base, image_of(tokens(html)))


def image_backfill(backlog: DataFrame, pages: DataFrame) -> DataFrame:
    """Id and image of the backlog's articles (id, url) whose landed page (url, html) has one."""
    met = backlog.select("id", "url").join(pages.select("url", "html"), "url")
    return met.select("id", page_image(F.col("html"), F.col("url")).alias("image")).where("image IS NOT NULL")
