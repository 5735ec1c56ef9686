"""Normalisers of URLs, titles, symbols and times as Column functions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, as one pattern over a parameter's name.
TRACKING = (
    r"^(utm_|ic[Ii][Dd]$|icid_|cmp$|cmpid$|ns_|at_|fbclid$|gclid$|mc_|ref$|ref_src$|referrer$|source$|sh$|yptr$|guccounter$|_ga$|spm$|"
    r"__twitter_impression$|smid$|partner$|taid$|tsrc$|mod$|siteid$|link$|reflink$|mkt_tok$|CMP$)"
)
#: Words that carry no story identity.
STOP_WORDS = """
a an the and or but if then than that this these those of in on at to for from by with
about into over after before during under above via as is are was were be been being
am do does did doing have has had having will would shall should can could may might must
it its it's he she they them their his her our your my i you we us
s t d ll m re ve y new news says say said report reports reported update updates
amid ahead here what why how when who which more most just now today
""".split()
#: Minutes of the UTC day in which each group of exchanges trades, end excluded.
SESSIONS = ((0, 480), (420, 990), (810, 1260))
#: Trust in outlets, lower is better, and what others get.
SOURCE_RANKS = {
    "sec.gov": 0, "reuters.com": 0, "bloomberg.com": 0, "ft.com": 0, "wsj.com": 0,
    "apnews.com": 1, "cnbc.com": 1, "barrons.com": 1, "economist.com": 1,
    "marketwatch.com": 2, "nytimes.com": 2, "theguardian.com": 2, "bbc.co.uk": 2, "bbc.com": 2, "telegraph.co.uk": 2, "thetimes.co.uk": 2, "nasdaq.com": 2,
    "investors.com": 3, "seekingalpha.com": 3, "morningstar.com": 3, "finance.yahoo.com": 3, "yahoo.com": 3, "forbes.com": 3, "businessinsider.com": 3,
    "fool.com": 4, "zacks.com": 4, "benzinga.com": 4, "investing.com": 4, "thestreet.com": 4, "simplywall.st": 4, "tipranks.com": 4, "rttnews.com": 4, "proactiveinvestors.co.uk": 4,
    "insidermonkey.com": 5, "msn.com": 5, "news.google.com": 6, "bing.com": 6,
}
OTHER_RANK = 5
#: Currency codes of hundredths, the currency and the divisor.
MINOR_UNITS = {"GBp": ("GBP", 100.0), "GBX": ("GBP", 100.0), "ZAC": ("ZAR", 100.0), "ILA": ("ILS", 100.0)}
SYMBOL = r"^[\^A-Za-z0-9][A-Za-z0-9._-]{0,19}$"


def iso_utc(ts: Column) -> Column:
    """seconds are cut, not rounded."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_time(text: Column) -> Column:
    """seconds or milliseconds since 1970, ISO 8601, or RFC 822 without regard to the weekday; else null."""
    text = F.trim(text)
    number = F.try_to_number(F.regexp_extract(text, r"^(\d{1,15})$", 1), F.lit("999999999999999")).cast("double")
    epoch = F.timestamp_millis(F.when(number > 1e11, number).otherwise(number * 1000).cast("long"))
    plain = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    formats = ("dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss z", "MMM d, yyyy", "yyyyMMdd'T'HHmmss")
    return F.coalesce(epoch, F.try_to_timestamp(text), *(F.try_to_timestamp(plain, F.lit(f)) for f in formats))


def markets_open(ts: Column) -> Column:
    """a weekday within any session, in UTC."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    inside = F.lit(False)
    for start, end in SESSIONS:
        inside = inside | ((minute >= start) & (minute < end))
    return (F.weekday(ts) < 5) & inside


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def domain_of(url: Column) -> Column:
    """F07; empty without a host."""
    return F.coalesce(host_of(url), F.lit(""))


def canonical_url(url: Column) -> Column:
    """lower-case scheme and host, no www., default port, tracking parameters, empty
    values, fragment or trailing slash; parameters decoded, sorted by name and value, and encoded again."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pairs = F.transform(params, lambda p: F.struct(decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    shown_port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    joined = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host_of(url), shown_port, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(joined)


def url_hash(url: Column) -> Column:
    """16 bytes of the canonical URL's digest, in hex."""
    return F.substring(F.sha2(canonical_url(url), 256), 1, 32)


def without_outlet(title: Column) -> Column:
    """the title without a trailing outlet's name, unless under 12 characters stay."""
    title = F.trim(title)
    cut = F.trim(F.regexp_replace(title, r"\s+[-–—|]\s+[^-–—|]{2,40}$", ""))
    return F.when(F.length(cut) >= 12, cut).otherwise(title)


def title_tokens(title: Column) -> Column:
    """lower-case content words, digits kept."""
    text = F.replace(F.replace(F.lower(without_outlet(title)), F.lit("’"), F.lit("'")), F.lit("&"), F.lit(" and "))
    words = F.transform(F.split(F.regexp_replace(text, "[^a-z0-9$%. ]+", " "), " +"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def title_key(title: Column) -> Column:
    """the first 12 of the sorted distinct tokens; empty with fewer than 4."""
    unique = F.array_sort(F.array_distinct(title_tokens(title)))
    return F.when(F.size(unique) >= 4, F.array_join(F.slice(unique, 1, 12), " ")).otherwise("")


def meaningful(title: Column, least: int = 4) -> Column:
    """whether a headline has so many different content words."""
    return F.size(F.array_distinct(title_tokens(title))) >= least


def source_rank(domain: Column) -> Column:
    """an outlet's own rank, else that of the first outlet of the table whose subdomain it is."""
    exact = F.create_map(*(F.lit(x) for pair in SOURCE_RANKS.items() for x in pair))
    below = F.coalesce(*(F.when(domain.endswith("." + known), rank) for known, rank in SOURCE_RANKS.items()))
    return F.coalesce(F.try_element_at(exact, domain), below, F.lit(OTHER_RANK))


def clean_symbol(symbol: Column) -> Column:
    """F12."""
    return F.upper(F.trim(F.coalesce(symbol, F.lit(""))))


def valid_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(SYMBOL), F.lit(False))


def shown_number(text: Column) -> Column:
    """the first number of a display string."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(found != "", found).cast("double")


def major_currency(code: Column) -> Column:
    """struct of the currency and what to divide by."""
    held = F.create_map(*(x for k, (c, d) in MINOR_UNITS.items() for x in (F.lit(k), F.struct(F.lit(c).alias("code"), F.lit(d).alias("divisor")))))
    return F.coalesce(F.try_element_at(held, code), F.struct(F.upper(F.coalesce(code, F.lit(""))).alias("code"), F.lit(1.0).alias("divisor")))


def sentiment_band(score: Column, cut: float = 0.2) -> Column:
    """null counts as neutral."""
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def age_bucket(ts: Column, as_of: Column) -> Column:
    """whole minutes under an hour, hours under a day, else days."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    whole = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(whole(60), F.lit("m ago"))).when(seconds < 86400, F.concat(whole(3600), F.lit("h ago"))).otherwise(F.concat(whole(86400), F.lit("d ago")))


#: Signs of currencies.
CURRENCY_SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "CHF": "CHF ", "JPY": "¥", "CAD": "CA$", "AUD": "A$", "SEK": "kr ", "NOK": "kr ", "DKK": "kr "}
NOTHING = "—"


def shown_price(value: Column, currency: Column) -> Column:
    """sign or code, thousands apart, four digits under one, else two; a dash for null."""
    signs = F.create_map(*(F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair))
    prefix = F.coalesce(F.try_element_at(signs, currency), F.when(currency != "", F.concat(currency, F.lit(" "))), F.lit(""))
    return F.when(value.isNull(), NOTHING).otherwise(F.concat(prefix, F.when(F.abs(value) < 1, F.format_number(value, 4)).otherwise(F.format_number(value, 2))))


def signed(value: Column, unit: str = "") -> Column:
    """two digits behind the sign, for percents and scores; a dash for null. Rounded as the binary value is, like prices:
    0.845, which is a little less, is 0.84."""
    return F.when(value.isNull(), NOTHING).otherwise(F.concat(F.when(value >= 0, "+").otherwise(""), F.call_function("format_number", value, F.lit("0.00")), F.lit(unit)))


def short_age(ts: Column, as_of: Column, *, long: bool = False) -> Column:
    """5m, 3h, 2d, or 5 min ago, 3 hr ago, yesterday, 2 days ago; each unit rounded half up, the future is now, null is empty."""
    minutes = F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 60 + 0.5))
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    said = lambda n, short, words: F.concat(n.cast("string"), F.lit(words if long else short))
    last = F.when(days == 1, "yesterday").otherwise(said(days, "d", " days ago")) if long else said(days, "d", "")
    return F.when(ts.isNull(), "").when(minutes < 1, "just now" if long else "now").when(minutes < 60, said(minutes, "m", " min ago")).when(hours < 24, said(hours, "h", " hr ago")).otherwise(last)


def stale(ts: Column, as_of: Column, minutes: int = 15) -> Column:
    """Without a time, or older than so many minutes."""
    return F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp(ts) > minutes * 60, F.lit(True))
