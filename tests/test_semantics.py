import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewire.functions import normalize, sentiment, similarity
from tidewire.operators import feed, insights, prices, stories, upserts
from tidewire.sources import payloads
from tidewire.streaming import micro_batches

NOW = datetime(2026, 1, 10, 12)
ARTICLE = "short_name string, company_name string, aliases array<string>, arrival long, title string, url string, published_at timestamp, description string, image string, source string, source_domain string, source_type string"


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize("text", ["2026-01-10T09:30:00Z", "2026-01-10T09:30:00+00:00", "2026-01-10 09:30:00", "1768037400", "1768037400000", "Sat, 10 Jan 2026 09:30:00 GMT", "Sat, 10 Jan 2026 10:30:00 +0100"])
def test_encodings_of_one_instant(spark, text):
    assert one(spark, normalize.iso_utc(normalize.parsed_time(F.col("t"))), t=text) == "2026-01-10T09:30:00Z"


def test_unreadable_time_is_null(spark):
    assert one(spark, normalize.parsed_time(F.col("t")), t="yesterday-ish") is None


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.Example.com/a/?utm_source=x&b=2&a=1#f", "https://example.com/a?a=1&b=2"),
        ("http://example.com:8080", "http://example.com:8080/"),
        ("https://example.com:443/x/?empty=&ref=1", "https://example.com/x"),
        ("", ""),
        ("https://e.com/?a-b=2&a=1", "https://e.com/?a=1&a-b=2"),
        ("https://e.com/x?q=a%20b&z=%7e*", "https://e.com/x?q=a+b&z=~%2A"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, normalize.canonical_url(F.col("u")), u=url) == want


def test_titles(spark):
    assert one(spark, normalize.without_outlet(F.col("t")), t="Apple beats estimates - Reuters") == "Apple beats estimates"
    assert one(spark, normalize.without_outlet(F.col("t")), t="Up 2% - CNBC") == "Up 2% - CNBC"
    keys = {one(spark, normalize.title_key(F.col("t")), t=t) for t in ("Tesla recalls 200K vehicles over brakes", "Over brakes, Tesla recalls 200K vehicles | CNN")}
    assert len(keys) == 1 and keys != {""}
    assert one(spark, normalize.title_key(F.col("t")), t="Tesla falls today") == ""


def test_small_normalisers(spark):
    assert one(spark, normalize.source_rank(F.col("d")), d="uk.reuters.com") == 0 and one(spark, normalize.source_rank(F.col("d")), d="x.org") == 5
    assert one(spark, normalize.shown_number(F.col("d")), d="$1,234.50") == 1234.5
    assert tuple(one(spark, normalize.major_currency(F.col("d")), d="GBp")) == ("GBP", 100.0)
    assert one(spark, normalize.valid_symbol(F.col("d")), d="^GSPC") and not one(spark, normalize.valid_symbol(F.col("d")), d="a b")


def test_token_set_ratio():
    assert similarity.token_set_ratio("a b c", "c a") == 100 and similarity.token_set_ratio("", "x") == 0
    assert similarity.token_set_ratio("apple profit rises", "apple profit falls") < 100
    assert similarity.ratio("abcd", "abed") == 75


@pytest.mark.parametrize(("title", "sign"), [("Nvidia beats estimates, shares surge", 1), ("Boeing cuts full-year guidance", -1), ("Tesla plunges after recall", -1), ("Company to hold annual meeting", 0), ("Results were not a gain", -1), ("", 0)])
def test_sentiment_signs(spark, title, sign):
    score = one(spark, sentiment.article_score(F.col("t"), F.lit(None).cast("string")), t=title)
    assert (score > 0.15) - (score < -0.15) == sign


def articles(spark, *changes):
    base = dict(short_name="AAPL", company_name="Apple Inc.", aliases=None, title="Apple beats quarterly profit estimates again", url="https://x.com/1", published_at=NOW, description=None, image=None, source=None, source_domain="x.com", source_type="GOOGLE_NEWS")
    return spark.createDataFrame([tuple((base | {"arrival": i} | c)[f.split()[0]] for f in ARTICLE.split(", ")) for i, c in enumerate(changes)], ARTICLE)


def test_story_reasons_and_winner(spark):
    rows = articles(
        spark,
        {"url": "https://weak.com/1", "image": "i", "source_domain": "weak.com"},
        {"url": "https://reuters.com/1", "source_domain": "reuters.com"},
        {"url": "https://weak.com/1?utm_source=a"},
        {"url": "https://b.com/2", "title": ""},
        {"url": "https://b.com/3", "published_at": NOW + timedelta(days=3)},
        {"url": "https://b.com/4", "title": "Bananas are cheaper than they were"},
        {"url": "https://b.com/5", "title": "Apple: should you buy the stock now"},
        {"url": "https://b.com/6", "title": "Apple news"},
        {"url": "https://b.com/7", "title": "IBRX Stock extends its losing streak", "source_type": "FINVIZ"},
        {"url": "https://b.com/8", "published_at": NOW - timedelta(days=8)},
    )
    cleaned = stories.cleaned(rows, NOW)
    reasons = {r.arrival: r.drop_reason for r in cleaned.collect()}
    assert reasons == {0: None, 1: None, 2: "duplicate_url", 3: "malformed", 4: "malformed", 5: "off_topic", 6: "churn", 7: "spam", 8: "other_stock", 9: None}
    clusters = stories.clustered(cleaned)
    assert {(r.arrival, r.winner) for r in clusters.collect()} == {(0, 1), (1, 1), (9, 9)}
    assert {r.reason: r.n for r in stories.reason_counts(cleaned, clusters).collect()}["duplicate_story"] == 1


def test_rollup_of_three_scores(spark):
    rows = spark.createDataFrame([("A", NOW, 0.8), ("A", NOW, -0.6), ("A", NOW, 0.05), ("B", NOW, None)], "short_name string, publish_time timestamp, sentiment double")
    (row,) = insights.rollup(rows).collect()
    assert (row.article_count, row.positive_count, row.negative_count, row.neutral_count) == (3, 1, 1, 1) and row.avg_sentiment == pytest.approx(0.25 / 3)


def test_series_prefers_daily_bars(spark):
    rows = spark.createDataFrame([("A", NOW, "1d", 1.0), ("A", NOW + timedelta(hours=2), "snap", 2.0), ("A", NOW + timedelta(days=1), "snap", 3.0)], "short_name string, ts timestamp, interval string, close double")
    assert sorted(r.close for r in prices.series(rows).collect()) == [1.0, 3.0]


def test_pages_tile(spark):
    rows = spark.createDataFrame([(i, f"S{i % 3}", NOW, None, None) for i in range(20)], "id long, short_name string, publish_time timestamp, sentiment double, title string")
    for sort in feed.sorts():
        ids = [r.id for k in range(4) for r in feed.page(rows, sort=sort, limit=5, offset=5 * k).collect()]
        assert sorted(ids) == list(range(20))
    assert feed.matching(rows, symbols=[]).count() == 0 and feed.matching(rows, symbols=None).count() == 20


def test_diversified_caps_interact(spark):
    rows = spark.createDataFrame([(i, i, "wire" if i < 20 else "other", f"S{i % 5}") for i in range(21)], "pos int, id long, source string, short_name string")
    assert [r.id for r in feed.diversified(rows).orderBy("pos").collect()] == [0, 1, 20]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "k int, x string, y string")
    patch = spark.createDataFrame([(1, None, "new"), (3, "c", "z")], "k int, x string, y string")
    assert sorted(map(tuple, upserts.patched(old, patch, "k", overwrite=["x"], fill=["y"]).collect())) == [(1, None, "new"), (2, "b", "y")]
    assert upserts.patched(old, patch, "k", keep=["x"]).where("k = 1").first().x == "a"
    batch = spark.createDataFrame([(2, "q", "r"), (4, "s", "t"), (4, "u", "v")], "k int, x string, y string")
    assert sorted(map(tuple, upserts.upsert(old, batch, ["k"], "x").collect())) == [(1, "a", None), (2, "q", "r"), (4, "u", "v")]
    assert [tuple(r) for r in upserts.insert_absent(old, batch, ["k"], "x").collect()] == [(4, "s", "t")]


def test_rss(spark):
    xml = """<rss><channel><item><title>Apple &amp; co - Reuters</title><link>https://www.reuters.com/a</link><pubDate>Sat, 10 Jan 2026 09:30:00 GMT</pubDate><source url="https://www.reuters.com">Reuters</source></item>
    <item><title>No link</title></item><item><title><![CDATA[Bing hit]]></title><link>http://bing.com/r?url=https%3a%2f%2fa.com%2fx&amp;q=1</link></item></channel></rss>"""
    rows = payloads.rss_items(spark.createDataFrame([(1, xml), (2, "nonsense"), (3, None)], "payload_id int, payload string")).orderBy("ordinal").collect()
    assert [(r.title, r.url, r.source_domain) for r in rows] == [("Apple & co", "https://www.reuters.com/a", "reuters.com"), ("Bing hit", "https://a.com/x", "a.com")]
    assert rows[0].published_at == datetime(2026, 1, 10, 9, 30)


def test_stamps_inherit_the_date(spark):
    html = '<tr><td>Jan-09-26 08:00PM</td><td><a href="https://a.com/1">One</a> (A)</td></tr><tr><td>07:30PM</td><td><a href="/n/2">Two</a></td></tr><tr><td>Today 06:00AM</td><td><a href="https://a.com/3">Three</a></td></tr>'
    rows = payloads.quote_table(spark.createDataFrame([(1, html)], "payload_id int, payload string"), NOW).orderBy("ordinal").collect()
    assert [r.published_at for r in rows] == [datetime(2026, 1, 10, 1), datetime(2026, 1, 10, 0, 30), datetime(2026, 1, 10, 11)]
    assert rows[1].url == "https://finviz.com/n/2" and rows[0].source == "A"


def test_chart_in_pence(spark):
    chart = '{"chart":{"result":[{"meta":{"symbol":"X.L","currency":"GBp","regularMarketPrice":3323.5},"timestamp":[1,2,3],"indicators":{"quote":[{"close":[3300.0,null,3323.5]}]}}]}}'
    (row,) = payloads.chart_quotes(spark.createDataFrame([(1, chart), (2, "x"), (3, None)], "payload_id int, payload string")).collect()
    assert (row.currency, row.price, row.previous_close, row.change_percent) == ("GBP", 33.235, 33.0, 0.712)


def test_other_sources(spark):
    entry = "<entry><filing-type>{}</filing-type><filing-href>https://sec.gov/{}</filing-href><filing-date>2026-01-09</filing-date>{}</entry>"
    atom = "<feed>" + entry.format("8-K/A", 1, "<form-name>Current report &amp;#8217;x</form-name>") + entry.format("4", 2, "") + entry.format("424B5", 3, "") + entry.format("S-4", 4, "") + "</feed>"
    rows = payloads.filings(spark.createDataFrame([(1, atom)], "payload_id int, payload string"), F.lit("Apple")).orderBy("ordinal").collect()
    assert [(r.title, r.url, r.published_at) for r in rows] == [("Apple filed 8-K/A: Current report &#8217;x", "https://sec.gov/1", datetime(2026, 1, 9)), ("Apple filed 424B5", "https://sec.gov/3", datetime(2026, 1, 9))]
    found = '{"news":[{"title":"t","link":"https://a.com","thumbnail":{"resolutions":[{"url":"s","width":1},{"url":"w","width":9},{"url":"v","width":9}]}},{"title":null,"link":"x"}]}'
    assert [r.image for r in payloads.search_news(spark.createDataFrame([(1, found)], "payload_id int, payload string")).collect()] == ["w"]
    lines = spark.createDataFrame([(1, '{"k":"a","v":1}'), (2, "{bad"), (3, '{"k":"a","v":2}')], "line_no int, value string")
    assert [tuple(r) for r in payloads.progress(lines, "k string, v int", "k").collect()] == [("a", 2)]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<img src="a.svg"><img width="50" src="b.png"><img src="c.png" width="400">', "https://e.com/news/c.png"),
        ('<meta property="og:image" content="o.png"><img src="c.png">', "https://e.com/news/o.png"),
        ("<meta content='/i/o.png?a=1&amp;b=2' name='twitter:image'>", "https://e.com/i/o.png?a=1&b=2"),
        ('<meta property="og:image" content="x.svg"><meta property=og:image:secure_url content=//cdn.com/y.jpg>', "https://cdn.com/y.jpg"),
        ('<meta itemprop="image" content="https://a.com/z.png">', "https://a.com/z.png"),
        ('<img src="data:image/gif;base64,x"><img data-src="late.png" height="150px"><img data-src="later.png">', "https://e.com/news/later.png"),
        ("<p>none</p>", None),
    ],
)
def test_page_image(spark, html, want):
    assert one(spark, payloads.page_image(F.col("h"), F.col("b")), h=html, b="https://e.com/news/story?x=1") == want


def test_entities(spark):
    assert one(spark, payloads.unescaped(F.col("t")), t="Shell&#8217;s &#x1F600; &quot;win&quot;&nbsp;&amp;lt;") == "Shell’s 😀 \"win\" &lt;"


def test_patch_rows_of_one_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    patch = spark.createDataFrame([(1, "p", 2), (1, "q", 1), (None, "n", 3)], "k int, x string, at int")
    assert sorted(map(tuple, upserts.patched(old, patch, "k", overwrite=["x"], order="at").collect())) == [(1, "p"), (2, "b")]


def test_catalogue_grows(spark):
    old = spark.createDataFrame([("A", "old", "STOCK", "USD")], "short_name string, name string, type string, currency_code string")
    new = spark.createDataFrame([("A", "new", "ETF", None, 1), ("B", "b", "STOCK", None, 2), ("B", "c", "STOCK", "GBP", 3), ("C", "", "STOCK", None, 4)], "short_name string, name string, type string, currency_code string, at int")
    assert sorted(map(tuple, upserts.catalogue_upsert(old, new, "at").collect())) == [("A", "new", "ETF", "USD"), ("B", "c", "STOCK", "GBP")]
    watch = spark.createDataFrame([("A", 3)], "short_name string, position int")
    assert sorted(map(tuple, upserts.followed(upserts.followed(watch, "B"), "A").collect())) == [("A", 3), ("B", 4)]
    assert [tuple(r) for r in upserts.followed(watch.limit(0), "B").collect()] == [("B", 0)]


@pytest.mark.parametrize(("text", "token"), [("Shell cuts its full-year dividend", "cuts_dividend"), ("hit 52-week low", "52_week_low"), ("Analyst Cuts price  target on X", "cuts_price_target"), ("beats analyst estimates", "beats_estimates"), ("an all-time high", "all_time_high")])
def test_phrases_collapse(spark, text, token):
    assert token in one(spark, sentiment.collapsed(F.col("t")), t=text)


@pytest.mark.parametrize(("text", "weight"), [("Top picks today", 0.0), ("52-week high for Acme", 2.4), ("all-time low", -3.2), ("Shares open higher!", 1.8 + 0.292), ("price target cut", -2.8), ("beating, missing", 0.4), ("is not up", -0.74 * 1.4)])
def test_weights(spark, text, weight):
    assert one(spark, sentiment.compound(F.col("t")), t=text) == pytest.approx(weight / math.sqrt(weight * weight + 15), abs=6e-4)


def test_base_lexicon(spark):
    assert one(spark, sentiment.compound(F.col("t"), {"great": 3.0, "calm": 1.5}), t="great calm") == pytest.approx(1.5 / math.sqrt(1.5**2 + 15), abs=6e-4)


def plain_clusters(rows, stored):
    """Every article against all stored ones and all winners before it."""
    rank = lambda r: (r["relevance"] != "direct", r["rank"], r["image"] is None, r["description"] is None, len(r["title"]), r["arrival"])

    def same(a, b):
        if a["url_hash"] and a["url_hash"] == b["url_hash"]:
            return True
        if abs((a["when"] - b["when"]).total_seconds()) > 72 * 3600:
            return False
        return bool(a["title_key"]) and a["title_key"] == b["title_key"] or similarity.token_set_ratio(a["title"], b["title"]) >= 88

    out, winners = {}, []
    for r in sorted(rows, key=rank):
        copy = next((s for s in stored if same(r, s)), None)
        match = None if copy else next((w for w in winners if same(r, w)), None)
        if not copy and not match:
            winners.append(r)
        out[r["arrival"]] = (None, copy["id"]) if copy else ((match or r)["arrival"], None)
    return out


def test_clusters_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["Apple", "Inc", "profit", "profits", "rise", "rises", "falls", "amid", "strong", "demand", "in", "China", "for", "phones", "tablets", "again", "quarter", "record", "sales"]
    title = lambda: "Apple " + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 9)))
    titles = [title() for _ in range(25)]
    edited = lambda t: t if rng.random() < 0.3 else t.replace(rng.choice(t.split()), rng.choice(words), 1) if rng.random() < 0.7 else t + "s"
    changes = [{"title": edited(rng.choice(titles)), "url": f"https://x.com/{rng.randrange(150)}", "published_at": NOW - timedelta(hours=rng.randrange(200)), "image": rng.choice([None, "i"]), "description": rng.choice([None, "Apple did"])} for _ in range(160)]
    judged = stories.cleaned(articles(spark, *changes), NOW)
    known = spark.createDataFrame([("AAPL", i, edited(t), "", "", NOW - timedelta(hours=5 * i)) for i, t in enumerate(titles[:6])], stories.STORED)
    known = known.withColumns({"title_key": normalize.title_key(F.col("title"))})
    fit = [r.asDict() for r in judged.where("drop_reason IS NULL").withColumn("rank", normalize.source_rank(F.col("source_domain"))).collect()]
    past = [r.asDict() | {"when": r.publish_time} for r in known.orderBy(F.desc("publish_time"), F.desc("id")).collect()]
    for stored, pool in ((None, []), (known, past)):
        want = plain_clusters(fit, pool)
        got = {r.arrival: (r.winner, r.stored_id) for r in stories.clustered(judged, stored).collect()}
        assert got == want and len({w for w, _ in got.values()}) < len(got)


def test_ingest_pipeline(spark):
    raw = articles(spark, {}, {"url": "https://x.com/2", "image": "i", "description": "Apple text"}, {"title": "Apple opens an entirely different office in Oslo", "url": "https://x.com/3"})
    known = spark.createDataFrame([("AAPL", 7, "Apple beats quarterly profit estimates again!", "", "", NOW, None, "kept")], stories.STORED + ", image string, description string")
    rows, more = stories.ingested(raw, known, NOW)
    (row,) = rows.collect()
    assert (row.arrival, row.source_url, row.lang, row.relevance) == (2, "https://x.com", "en", "direct")
    assert [(r.id, r.image, r.description) for r in more.collect()] == [(7, "i", None)]


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([("A", NOW + timedelta(minutes=i), 0.1 * i, f"u{i % 3}", float(i // 4)) for i in range(12)], "short_name string, publish_time timestamp, sentiment double, url_hash string, close double")
    rows.repartition(1).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def drained(stream, mode, name):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    (day,) = drained(micro_batches.daily_rollup(source()), "complete", "rollup")
    (want,) = insights.rollup(rows).collect()
    assert (day.short_name, day.date, day.article_count) == (want.short_name, want.date, want.article_count) and day.avg_sentiment == pytest.approx(want.avg_sentiment)
    assert len(drained(micro_batches.first_by_url(source()), "append", "urls")) == 3
    quotes = micro_batches.changed_quotes(source().select("short_name", F.col("publish_time").alias("ts"), "close"))
    assert sorted(r.close for r in drained(quotes, "append", "quotes")) == [0.0, 1.0, 2.0]
    seen = []
    micro_batches.ingest(source(), lambda df, i: seen.append(df.count()), f"{tmp_path}/c-ingest").awaitTermination(60)
    assert sum(seen) == 12


def test_signed_rounds_the_binary_value(spark):
    """0.845, 2.985 and 7.975 are a little less than they read; thousands are not set apart."""
    rows = spark.createDataFrame([(0.845,), (2.985,), (7.975,), (0.125,), (-0.845,), (12345.678,), (0.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(normalize.signed(F.col("v"), "%")).collect()] == ["+0.84%", "+2.98%", "+7.97%", "+0.12%", "-0.84%", "+12345.68%", "+0.00%", "—"]
