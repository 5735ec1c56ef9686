"""Landed HTML pages to tokens, and tokens to titles, links, texts, images and table rows.

One tokenizer walks a page: tags with attributes between quotes of either kind or bare, comments, declarations, and elements
whose content is raw up to their own end tag. What is made of the tokens is array functions and windows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import normalize

#: Elements whose content has no tags, and of these the ones that have entities.
RAW, WITH_ENTITIES = ("script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"), ("textarea", "title")
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?|(>))""")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE | re.ASCII) for name in RAW}
TOKEN = "struct<kind:string,name:string,attributes:map<string,string>,text:string>"
KIND = pa.struct([("kind", pa.string()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

Token = tuple[str, str, dict[str, str], str]


def tag_at(page: str, at: int) -> tuple[Token | None, int]:
    """The tag that begins there and where it ends; one that the page's end cuts off is no token."""
    m = TAG.match(page, at)
    attributes: dict[str, str] = {}
    end = m.end()
    while (a := ATTRIBUTE.match(page, end)) and a.end() > end:
        end = a.end()
        if a[5]:
            return ("end" if m[1] else "start", m[2].lower(), attributes, ""), end
        value = next((v for v in a.group(2, 3, 4) if v is not None), "")
        attributes.setdefault(a[1].lower(), html.unescape(value))
    return None, len(page)


def tokens_of(page: str) -> Iterator[Token]:
    """start and end tags (name, attributes), text, raw text and title (name of their element), comments and declarations."""
    at, said = 0, 0
    while (at := page.find("<", at)) >= 0:
        follows = page[at + 1 : at + 4]
        if follows.startswith("!--"):
            close = page.find("-->", at + 2)  # <!--> is a whole comment
            token, end = ("comment", "", {}, page[at + 4 : max(close, at + 4) if close >= 0 else len(page)]), close + 3 if close >= 0 else len(page)
        elif follows[:1] in ("!", "?"):
            close = page.find(">", at)
            token, end = ("declaration", "", {}, page[at + 2 : close if close >= 0 else len(page)]), close + 1 if close >= 0 else len(page)
        elif TAG.match(page, at):
            token, end = tag_at(page, at)
        else:
            at += 1
            continue
        if at > said:
            yield "text", "", {}, html.unescape(page[said:at])
        if token is not None:
            yield token
        if token is not None and token[0] == "start" and token[1] in RAW:
            close = RAW_ENDS[token[1]].search(page, end)
            stop = close.start() if close else len(page)
            if stop > end:
                yield "raw", token[1], {}, html.unescape(page[end:stop]) if token[1] in WITH_ENTITIES else page[end:stop]
            end = stop
        at = said = end
    if said < len(page):
        yield "text", "", {}, html.unescape(page[said:])


#: Characters of pages, and tokens, that are in Python's hands at once; a longer page is alone.
MOST_CHARS, MOST_TOKENS = 1 << 20, 1 << 12


def told(token: Token) -> dict:
    kind, name, attributes, text = token
    return {"kind": kind, "name": name, "attributes": list(attributes.items()), "text": text}


def shares(batch: pa.Array) -> Iterator[pa.Array]:
    """Slices of pages with about MOST_CHARS bytes each, one page at least."""
    at, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
        if i > at and held + n > MOST_CHARS:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)


def found_in(pages: pa.Array) -> pa.Array:
    return pa.array([[told(t) for t in tokens_of(p.as_py() or "")] for p in pages], pa.list_(KIND))


def tokens(page: Column) -> Column:
    """The tokens of a page in order: kind, name, attributes and text; null and empty pages have none."""

    @F.arrow_udf(f"array<{TOKEN}>")
    def walked(pages: pa.Array) -> pa.Array:
        return pa.concat_arrays([found_in(x) for x in shares(pages)])

    return walked(page)


def tokenized(pages: DataFrame, key: str, column: str) -> DataFrame:
    """The key and ``found``, the tokens of each page, share by share, so a large batch of pages is never held as tokens."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for share in shares(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(share)), found_in(share)], [key, "found"])
                at += len(share)

    return pages.select(key, column).mapInArrow(walked, f"`{key}` {pages.schema[key].dataType.simpleString()}, found array<{TOKEN}>")


def token_rows(pages: DataFrame, key: str, column: str) -> DataFrame:
    """The key, ``at`` (from 0), kind, name, attributes and text of each token: a page of any length goes on token by token."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, dict]] = []
            for i, page in enumerate(batch.column(1)):
                for at, token in enumerate(tokens_of(page.as_py() or "")):
                    rows.append((i, at, told(token)))
                    if len(rows) == MOST_TOKENS:
                        yield flat(batch.column(0), rows)
                        rows = []
            if rows:
                yield flat(batch.column(0), rows)

    def flat(keys: pa.Array, rows: list[tuple[int, int, dict]]) -> pa.RecordBatch:
        found = pa.array([t for _, _, t in rows], KIND)
        return pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, _, _ in rows])), pa.array([at for _, at, _ in rows], pa.int32()), *found.flatten()], [key, "at", *(f.name for f in KIND)])

    return pages.select(key, column).mapInArrow(walked, f"`{key}` {pages.schema[key].dataType.simpleString()}, at int, kind string, name string, attributes map<string,string>, text string")


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def title_of(found: Column) -> Column:
    """The text of the first title element; null without one."""
    first = F.get(F.filter(found, lambda t: (t["kind"] == "raw") & (t["name"] == "title")), F.lit(0))
    return F.nullif(single_spaced(first["text"]), F.lit(""))


def text_of(found: Column) -> Column:
    """What a page says: its running text, without titles, scripts, styles and comments, with single blanks."""
    return single_spaced(F.array_join(F.transform(F.filter(found, lambda t: t["kind"] == "text"), lambda t: t["text"]), " "))


def starts(found: Column, name: str) -> Column:
    return F.filter(found, lambda t: (t["kind"] == "start") & (t["name"] == name))


def attribute(token: Column, name: str) -> Column:
    return F.try_element_at(token["attributes"], F.lit(name))


def links_of(found: Column) -> Column:
    """The targets of the page's links as they stand, in order."""
    return F.filter(F.transform(starts(found, "a"), lambda t: F.trim(attribute(t, "href"))), lambda u: u.isNotNull() & (u != ""))


#: Meta tags that name a page's image, in the order in which they count.
IMAGE_TAGS = (("property", "og:image"), ("property", "og:image:secure_url"), ("name", "twitter:image"), ("name", "twitter:image:src"), ("itemprop", "image"))
#: Pixels of the smallest inline image that counts, and inline images looked at.
SMALLEST_IMAGE, MOST_IMAGES = 200, 25


def image_of(found: Column) -> Column:
    """The first meta image, by IMAGE_TAGS, that is no SVG; else the first inline one of MOST_IMAGES that is neither SVG
    nor data nor stated to be too small."""
    fit = lambda url: F.when((F.trim(url) != "") & ~F.trim(url).endswith(".svg"), F.trim(url))
    tagged = lambda name, value: F.get(F.filter(starts(found, "meta"), lambda m: attribute(m, name) == value), F.lit(0))
    named = [fit(attribute(tagged(name, value), "content")) for name, value in IMAGE_TAGS]
    small = lambda i, name: F.coalesce(F.try_to_number(F.regexp_extract(F.trim(attribute(i, name)), r"^(\d{1,9})(?:px)*$", 1), F.lit("999999999")) < SMALLEST_IMAGE, F.lit(False))
    source = lambda i: F.coalesce(F.nullif(attribute(i, "src"), F.lit("")), attribute(i, "data-src"))
    large = F.filter(F.slice(starts(found, "img"), 1, MOST_IMAGES), lambda i: ~small(i, "width") & ~small(i, "height"))
    inline = F.get(F.filter(F.transform(large, source), lambda u: fit(u).isNotNull() & ~u.startswith("data:")), F.lit(0))
    return F.coalesce(*named, F.trim(inline))


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, title, image (as it stands), links and text of pages of page_id and html."""
    return tokenized(pages, "page_id", "html").select("page_id", title_of(F.col("found")).alias("title"), image_of(F.col("found")).alias("image"), links_of(F.col("found")).alias("links"), text_of(F.col("found")).alias("text"))


def table_rows(payloads: DataFrame, table_id: str) -> DataFrame:
    """payload_id, ordinal, first (the first cell's text), url and title (of the first link), aside (of the first span) and
    after (what the row says behind its link) of each table row of two cells or more with a titled link.

    Only rows of the table of that id count, where a payload has tables at all. Running sums over a payload's tokens number
    its rows, cells, links and spans; a payload is a page.
    """
    told = token_rows(payloads, "payload_id", "payload")
    page = Window.partitionBy("payload_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begins = lambda *names: (F.col("kind") == "start") & F.col("name").isin(*names)
    ends = lambda *names: (F.col("kind") == "end") & F.col("name").isin(*names)
    held = lambda opened, closed: F.sum(opened.cast("int") - closed.cast("int")).over(page)
    named = begins("table") & F.coalesce(F.try_element_at("attributes", F.lit("id")) == table_id, F.lit(False))
    numbered = told.select("*", F.sum(begins("tr").cast("int")).over(page).alias("row"), held(begins("table"), ends("table")).alias("depth"), named.alias("named"), F.max(begins("table").cast("int")).over(Window.partitionBy("payload_id")).alias("tables"))
    # from the named table's tag to the first place where as few tables are open as before it
    level = F.min(F.when(F.col("named"), F.col("depth"))).over(page)
    opened = numbered.withColumn("level", level)
    closed = F.max(F.coalesce((F.col("depth") < F.col("level")).cast("int"), F.lit(0))).over(page)
    kept = opened.withColumn("closed", closed).where("row > 0 AND (tables = 0 OR (level IS NOT NULL AND closed = 0))")
    row = Window.partitionBy("payload_id", "row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    nth = lambda *names: F.sum(begins(*names).cast("int")).over(row)
    shut = lambda *names: F.sum(ends(*names).cast("int")).over(row)
    placed = kept.select("*", nth("td").alias("cell"), nth("a").alias("link"), shut("a").alias("unlinked"), nth("span").alias("span"), shut("span").alias("unspanned"))
    said = lambda where: single_spaced(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "text") & where, F.struct("at", "text")))), lambda x: x["text"]), " "))
    href = F.min(F.when(begins("a") & (F.col("link") == 1), F.struct("at", F.try_element_at("attributes", F.lit("href")).alias("href"))))
    rows = placed.groupBy("payload_id", "row").agg(
        F.max("cell").alias("cells"), said(F.col("cell") == 1).alias("first"), href["href"].alias("url"), said((F.col("link") == 1) & (F.col("unlinked") == 0)).alias("title"),
        said((F.col("span") == 1) & (F.col("unspanned") == 0)).alias("aside"), said((F.col("link") >= 1) & (F.col("unlinked") >= 1)).alias("after"),
    )
    return rows.where("cells >= 2 AND url <> '' AND title <> ''").select("payload_id", (F.col("row") - 1).alias("ordinal"), "first", "url", "title", "aside", "after")


def quote_table(payloads: DataFrame, as_of, table_id: str = "news-table", base: str = "https://finviz.com") -> DataFrame:
    """Rows whose stamp is a date and time, Today and time, or a time that inherits the last date; New York time."""
    rows = table_rows(payloads, table_id)
    local = F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), "America/New_York")
    day_text, time_text = F.regexp_extract("first", r"^([A-Za-z]{3}-\d{2}-\d{2})", 1), F.regexp_extract("first", r"(\d{1,2}:\d{2}[AP]M)$", 1)
    day = F.when(day_text != "", F.to_date(F.try_to_timestamp(day_text, F.lit("MMM-dd-yy")))).when(F.col("first").startswith("Today"), F.to_date(local)).when(F.col("first").startswith("Yesterday"), F.date_sub(F.to_date(local), 1))
    carried = F.last(day, ignorenulls=True).over(Window.partitionBy("payload_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    at = F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", carried.cast("string"), time_text), F.lit("yyyy-MM-dd h:mma")), "America/New_York")
    url = F.when(F.col("url").startswith("/"), F.concat(F.lit(base), F.col("url"))).otherwise(F.col("url"))
    source = F.nullif(F.regexp_replace(F.coalesce(F.nullif("aside", F.lit("")), F.col("after")), r"^\(|\)$", ""), F.lit(""))
    return rows.select("payload_id", "ordinal", "title", url.alias("url"), at.alias("published_at"), source.alias("source")).withColumns({"source_domain": normalize.domain_of(F.col("url")), "source_type": F.lit("FINVIZ")})
