"""DuckDB SQL of the application's queries."""

from __future__ import annotations

from tidewire.functions.normalize import STOP_WORDS, TRACKING
from tidewire.plans import landed, lookups, reviews, sentiments
from tidewire.plans.bindings import NEWS, PRICES, STOCKS, WATCHLIST

SINCE, TODAY = "TIMESTAMP '2024-01-17'", "DATE '2024-01-31'"
COUNTS = f"(SELECT short_name, count(*) AS article_count, avg(sentiment) AS avg_sentiment FROM {NEWS} WHERE publish_time >= {SINCE} GROUP BY 1)"
ROLLUP = f"""(SELECT short_name, publish_time::DATE AS date, avg(sentiment) AS avg_sentiment, count(*) AS article_count, count(*) FILTER (sentiment > 0.2) AS positive_count,
  count(*) FILTER (sentiment < -0.2) AS negative_count, count(*) FILTER (sentiment BETWEEN -0.2 AND 0.2) AS neutral_count FROM {NEWS} WHERE sentiment IS NOT NULL GROUP BY 1, 2)"""
DELTAS = f"""(SELECT short_name, avg(avg_sentiment) FILTER (date >= {TODAY} - 3) AS recent, avg(avg_sentiment) FILTER (date < {TODAY} - 3) AS baseline,
  sum(CASE WHEN date >= {TODAY} - 3 THEN article_count ELSE 0 END)::BIGINT AS recent_count FROM {ROLLUP} WHERE date >= {TODAY} - 14 GROUP BY 1)"""
HOST = r"regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
CANONICAL = rf"""(SELECT page_id, {HOST} AS domain, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || {HOST}
  || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*:(\d+)', 1) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(url, '^[a-z]+://[^/?#]*:(\d+)', 1) END
  || CASE WHEN rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') END
  || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical
  FROM (SELECT page_id, trim(url) AS url, array_to_string(list_transform(list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.')),
    lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(p[length(split_part(p, '=', 1)) + 2:], '+', ' '))}}), lambda x: NOT regexp_matches(x.k, '{TRACKING}'))),
    lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS q FROM pages))"""
TITLES = rf"""(SELECT doc_id, CASE WHEN length(trim(c)) >= 12 THEN trim(c) ELSE t END AS title FROM (SELECT doc_id, t, regexp_replace(t, '\s+[-–—|]\s+[^-–—|]{{2,40}}$', '') AS c
  FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS t FROM documents)))"""
TOKENS = rf"""(SELECT doc_id, title, list_filter(list_transform(string_split_regex(regexp_replace(replace(replace(lower(title), '’', ''''), '&', ' and '), '[^a-z0-9$%. ]+', ' ', 'g'), ' +'), lambda w: trim(w, '.')),
  lambda w: w <> '' AND NOT list_contains([{STOPS}], w)) AS k FROM {TITLES})"""

ORACLES = {
    "trending_news": f"""SELECT id, short_name, move_percent, publish_time, rn FROM (SELECT n.*, s.price_change_percent AS move_percent, row_number() OVER (PARTITION BY n.short_name ORDER BY publish_time DESC, id DESC)::INT AS rn
        FROM {NEWS} n JOIN {STOCKS} s USING (short_name) WHERE s.price_change_percent IS NOT NULL AND publish_time >= {SINCE}) WHERE rn <= 3 ORDER BY abs(move_percent) DESC, publish_time DESC, id DESC LIMIT 12""",
    "feed_recent": f"SELECT id, short_name, title, publish_time FROM {NEWS} WHERE publish_time >= {SINCE} ORDER BY publish_time DESC, id DESC LIMIT 50",
    "feed_coverage_page2": f"SELECT id, short_name, count(*) OVER (PARTITION BY short_name) AS coverage FROM {NEWS} WHERE publish_time >= {SINCE} ORDER BY coverage DESC, short_name, publish_time DESC, id DESC LIMIT 50 OFFSET 50",
    "feed_symbol": f"SELECT id, short_name, publish_time FROM {NEWS} WHERE short_name IN ('7', '12', '31') ORDER BY short_name, publish_time DESC, id DESC LIMIT 100",
    "feed_watchlist": f"SELECT id, short_name, relevance FROM {NEWS} WHERE relevance = 'direct' AND short_name IN (SELECT short_name FROM {WATCHLIST})",
    "feed_sentiment": f"SELECT id, sentiment FROM {NEWS} WHERE sentiment IS NULL OR sentiment BETWEEN -0.2 AND 0.2",
    "feed_by_sentiment": f"SELECT id, sentiment FROM {NEWS} ORDER BY sentiment DESC NULLS LAST, publish_time DESC, id DESC LIMIT 200",
    "feed_impact": f"SELECT id, impact FROM {NEWS} WHERE impact = 'high' AND relevance = 'direct'",
    "feed_search": f"SELECT id, title FROM {NEWS} WHERE title ILIKE '%REPORT 1%' OR description ILIKE '%REPORT 1%' OR short_name ILIKE '%REPORT 1%'",
    "document_search": r"""SELECT doc_id AS id, source AS short_name FROM documents WHERE contains(text, '100%_') OR contains(source, '100%_')
        UNION ALL SELECT doc_id, source FROM documents WHERE text ILIKE '%THE IN%' OR source ILIKE '%THE IN%'""",
    "fingerprints": f"SELECT id, short_name, url, title, publish_time, source_domain, description IS NOT NULL AS has_description, image IS NOT NULL AS has_image FROM {NEWS} WHERE publish_time >= {SINCE}",
    "unscored": f"SELECT id, title, description, publish_time FROM {NEWS} WHERE sentiment IS NULL ORDER BY publish_time DESC, id DESC LIMIT 500",
    "image_backlog": f"SELECT id, url, publish_time FROM {NEWS} WHERE image IS NULL AND source_domain IS NOT NULL AND source_domain NOT IN ('news.google.com', '') ORDER BY publish_time DESC, id DESC LIMIT 12",
    "dedupe_by_url": f"SELECT id, url FROM {NEWS} QUALIFY row_number() OVER (PARTITION BY url ORDER BY publish_time, id) = 1",
    "count_by_stock": f"SELECT * FROM {COUNTS}",
    "source_breakdown": f"SELECT coalesce(source_domain, source) AS source, count(*) AS article_count FROM {NEWS} WHERE publish_time >= {SINCE} GROUP BY 1",
    "sentiment_rollup": f"SELECT * FROM {ROLLUP}",
    "sentiment_deltas": f"SELECT * FROM {DELTAS}",
    "movers": f"""SELECT short_name, name, price, price_change_percent, coalesce(article_count, 0) AS article_count, coalesce(recent, avg_sentiment) AS sentiment FROM {STOCKS} LEFT JOIN {COUNTS} c USING (short_name) LEFT JOIN {DELTAS} d USING (short_name)
        WHERE price IS NOT NULL ORDER BY abs(coalesce(price_change_percent, 0)) DESC, short_name LIMIT 30""",
    "insights_panels": f"""WITH j AS (SELECT *, round(coalesce(recent, avg_sentiment), 3) AS m, recent - coalesce(baseline, 0) AS s FROM {COUNTS} c LEFT JOIN {DELTAS} d USING (short_name))
        (SELECT 'covered' AS panel, short_name, article_count::DOUBLE AS value FROM j ORDER BY article_count DESC, short_name LIMIT 6)
        UNION ALL (SELECT 'positive', short_name, m FROM j WHERE m > 0 ORDER BY m DESC, article_count DESC, short_name LIMIT 6)
        UNION ALL (SELECT 'negative', short_name, round(s, 3) FROM j WHERE recent < -0.05 AND s < 0 ORDER BY round(s, 3), short_name LIMIT 6)""",
    "popular": f"""SELECT short_name, name, tier FROM (SELECT short_name, name, 0::INT AS tier, position AS place FROM {WATCHLIST} JOIN {STOCKS} USING (short_name)
        UNION ALL SELECT short_name, name, 1, -article_count FROM {COUNTS} JOIN {STOCKS} USING (short_name) WHERE short_name NOT IN (SELECT short_name FROM {WATCHLIST})) ORDER BY tier, place, short_name LIMIT 400""",
    "catalogue_search": """WITH s AS (SELECT p_partkey::VARCHAR AS short_name, p_name AS name, CASE WHEN p_size > 25 THEN 'STOCK' ELSE 'ETF' END AS type FROM part) SELECT * FROM s WHERE short_name ILIKE '1%' OR name ILIKE '%1%'
        ORDER BY CASE WHEN short_name = '1' THEN 0 WHEN short_name ILIKE '1%' THEN 1 WHEN name ILIKE '1%' THEN 2 ELSE 3 END, CASE WHEN type = 'STOCK' THEN 0 ELSE 1 END, length(name), length(short_name) DESC, short_name LIMIT 25""",
    "sectors": f"""SELECT sector, 'group' AS level, NULL::VARCHAR AS group_name, count(*) AS stock_count FROM {STOCKS} WHERE sector <> '' GROUP BY 1
        UNION ALL SELECT industry, 'industry', min(sector), count(*) FROM {STOCKS} WHERE industry <> '' GROUP BY 1""",
    "symbols_in_sector": f"SELECT short_name FROM {STOCKS} WHERE industry = 'ASIA' OR sector = 'ASIA'",
    "watchlist_quotes": f"SELECT short_name, position, coalesce(name, short_name) AS name, price, price_change_percent FROM {WATCHLIST} LEFT JOIN {STOCKS} USING (short_name)",
    "catalogue_best_listing": """SELECT l_orderkey AS company, l_suppkey::VARCHAR AS symbol, l_linenumber AS ordinal, floor(l_quantity % 4)::INT AS exchange_rank, floor(l_discount * 1000)::INT AS name_score FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity % 4)::INT, floor(l_discount * 1000)::INT DESC, length(l_suppkey::VARCHAR), l_linenumber, l_suppkey::VARCHAR) = 1""",
    "price_series": f"SELECT p.* FROM {PRICES} p LEFT JOIN (SELECT DISTINCT short_name, ts::DATE AS day FROM {PRICES} WHERE interval = '1d') b ON b.short_name = p.short_name AND b.day = p.ts::DATE WHERE interval = '1d' OR b.day IS NULL",
    "latest_price": f"SELECT short_name, ts, close FROM {PRICES} QUALIFY row_number() OVER (PARTITION BY short_name ORDER BY ts DESC, interval) = 1",
    "price_changes": f"SELECT * FROM (SELECT short_name, ts, close, lag(close) OVER (PARTITION BY short_name ORDER BY ts) AS before FROM {PRICES} WHERE interval = 'snap') WHERE before IS NULL OR abs(close - before) > 1e-9",
    "quotes": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY short_name ORDER BY ts DESC) AS n FROM {PRICES} WHERE interval = '1d'), q AS (SELECT short_name, max(close) FILTER (n = 1) AS price, max(close) FILTER (n = 2) AS previous_close FROM r GROUP BY 1)
        SELECT *, price - previous_close AS change, CASE WHEN previous_close <> 0 THEN (price - previous_close) / previous_close * 100 END AS change_percent FROM q""",
    "close_as_of": """WITH a AS (SELECT event_id AS request_id, user_id AS k, ts - INTERVAL 1500 DAY AS ts FROM events),
        p AS (SELECT o_custkey AS k, o_orderdate AS ts, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY ALL)
        SELECT request_id, a.k::VARCHAR AS short_name, a.ts, close FROM a ASOF LEFT JOIN p ON a.k = p.k AND a.ts >= p.ts""",
    "upsert_latest": """SELECT key, event_type, value, event_id FROM (SELECT user_id AS key, CASE WHEN event_type = 'purchase' THEN 'view' ELSE event_type END AS event_type, value, event_id, event_type = 'purchase' AS fresh FROM events)
        QUALIFY row_number() OVER (PARTITION BY key, event_type ORDER BY fresh DESC, event_id DESC) = 1""",
    "insert_absent": f"""WITH s AS (SELECT short_name, url FROM {NEWS} WHERE source = 'view'), i AS (SELECT id, short_name, 'view' AS source, replace(url, 'www.click', 'www.view') AS url FROM {NEWS})
        SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.short_name = i.short_name AND s.url = i.url) QUALIFY row_number() OVER (PARTITION BY short_name, url ORDER BY id) = 1""",
    "quote_patch": f"""WITH p AS (SELECT o_custkey::VARCHAR AS short_name, max(o_totalprice) AS price, max(CASE WHEN o_orderstatus = 'F' THEN 'patched' END) AS name FROM orders GROUP BY 1)
        SELECT s.short_name, coalesce(p.name, s.name) AS name, CASE WHEN p.short_name IS NOT NULL THEN p.price ELSE s.price END AS price, type FROM {STOCKS} s LEFT JOIN p ON p.short_name = s.short_name""",
    "retention": f"SELECT id, publish_time FROM {NEWS} WHERE publish_time >= {SINCE}",
    "market_open": """SELECT event_id, isodow(ts) < 6 AND (m < 480 OR m BETWEEN 420 AND 989 OR m BETWEEN 810 AND 1259) AS open, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events)""",
    "age_bucket": f"""SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age,
        CASE WHEN sentiment > 0.2 THEN 'positive' WHEN sentiment < -0.2 THEN 'negative' ELSE 'neutral' END AS band FROM (SELECT *, date_diff('second', date_trunc('second', publish_time), TIMESTAMP '2024-01-31') AS s FROM {NEWS})""",
    "url_canonical": f"SELECT page_id, canonical, sha256(canonical)[1:32] AS url_hash, domain FROM {CANONICAL}",
    "title_key": f"SELECT doc_id, title, array_to_string(k, ' ') AS tokens, CASE WHEN len(list_distinct(k)) >= 4 THEN array_to_string(list_sort(list_distinct(k))[1:12], ' ') ELSE '' END AS title_key FROM {TOKENS}",
} | reviews.ORACLES | lookups.ORACLES | sentiments.ORACLES | landed.ORACLES
