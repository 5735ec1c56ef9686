"""Queries on events, summaries and catalogue sweeps, and their DuckDB SQL."""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import events, sweeps
from tidewire.plans import bindings as b

#: The time of asking, the start of the batch, and the misses that end a sweep here.
AS_OF, BATCH, MISSES = datetime(2024, 1, 31), datetime(2024, 1, 29), 8


def desks(spark: SparkSession, d: str) -> DataFrame:
    """Articles by kind of event, so that a desk has several pages."""
    return b.news(spark, d).withColumn("short_name", F.col("source"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    rows = desks(spark, d)
    known = rows.where("impact = 'high'").select("short_name", "id", F.concat(F.lit("E: "), "title").alias("headline"), F.col("publish_time").alias("created_at"))
    return events.prompts(rows.where(F.col("publish_time") >= BATCH), rows, known, AS_OF)


def stand_in(prompt: str) -> tuple[str, int] | None:
    """In place of a model: every seventh article is of high impact and every fifth of medium; short pages get no answer."""
    n = int(re.search(r"NEW ARTICLES \((\d+)\)", prompt)[1])
    if n < 10:
        return None
    found = [{"headline": impact, "why_it_matters": "fixed", "impact": impact, "article_numbers": [*range(step, n + 1, step)]} for impact, step in (("high", 7), ("medium", 5))]
    return json.dumps({"events": found}), 100 + n


def event_prompts(spark, d):
    return pages(spark, d).select("short_name", "page", F.size("ids").cast("long").alias("n_articles"), "prompt")


def event_tiers(spark, d):
    return events.tiers_of(events.judged(events.answered(pages(spark, d), stand_in)))


def events_found(spark, d):
    found = events.events_of(events.judged(events.answered(pages(spark, d), stand_in)))
    return found.select("short_name", "page", "ordinal", "impact", F.size("news_ids").cast("long").alias("n_articles"), F.get("news_ids", F.lit(0)).alias("first_id"), "tokens_total")


def digest_cache(spark, d):
    rows = b.news(spark, d)
    summaries = rows.where("source = 'purchase'").select("short_name", "id", F.col("title").alias("ai_summary"), F.col("publish_time").alias("created_at"))
    return events.digests(b.stocks(spark, d), summaries, rows.where("source <> 'purchase'"), AS_OF)


def article_summaries(spark, d):
    return events.article_prompts(b.news(spark, d).withColumn("ai_summary", F.when(F.col("impact") == "low", F.col("title"))))


def miss_runs(spark, d):
    rows = b.table(spark, d, "events").select(F.col("user_id").alias("sweep"), F.col("event_id").alias("ordinal"), (F.col("event_type") == "purchase").alias("resolved"))
    return sweeps.swept(rows, misses=MISSES)


def catalogue_seed(spark, d):
    kind = "CASE p_type WHEN 'ECONOMY' THEN 'equity' WHEN 'SMALL' THEN 'etf' WHEN 'STANDARD' THEN 'MutualFund' ELSE p_type END AS quote_type"
    rows = b.table(spark, d, "part").selectExpr("CASE WHEN p_partkey % 11 <> 0 THEN p_brand || '.' || p_size END AS symbol", "p_name AS name", kind, "CASE WHEN p_partkey % 3 <> 0 THEN 'GBP' END AS currency", "p_partkey % 5 = 0 AS exact_symbol", "p_partkey % 101 AS name_score", "p_partkey % 4 AS rank", "p_partkey AS ordinal")
    return sweeps.publishable(rows)


QUERIES = {f.__name__: f for f in (event_prompts, event_tiers, events_found, digest_cache, article_summaries, miss_runs, catalogue_seed)}

WEEK, LAST = "TIMESTAMP '2024-01-24'", "TIMESTAMP '2024-01-29'"
NEWEST = "row_number() OVER (PARTITION BY short_name ORDER BY publish_time DESC, id DESC)"
DESKS = f"s AS (SELECT * REPLACE (source AS short_name) FROM {b.NEWS}), b AS (SELECT *, {NEWEST} - 1 AS place FROM s WHERE publish_time >= {LAST})"
PAGED = f"{DESKS}, p AS (SELECT short_name, id, place // 60 AS page, place % 60 + 1 AS num, count(*) OVER (PARTITION BY short_name, place // 60) AS n FROM b)"
ORACLES = {
    "event_prompts": f"""WITH {DESKS},
        a AS (SELECT short_name, place // 60 AS page, count(*) AS n, string_agg((place % 60 + 1) || '. [' || strftime(publish_time, '%Y-%m-%d') || ' · ' || source || '] ' || title || coalesce(chr(10) || '   ' || description[1:200], ''), chr(10) ORDER BY place) AS lines FROM b GROUP BY 1, 2),
        q AS (SELECT short_name, string_agg('- ' || title, chr(10) ORDER BY publish_time DESC, id DESC) AS prior FROM (SELECT * FROM s WHERE publish_time >= {WEEK} AND publish_time < {LAST} QUALIFY {NEWEST} <= 60) GROUP BY 1),
        e AS (SELECT short_name, string_agg('- E: ' || title, chr(10) ORDER BY publish_time DESC, id DESC) AS known FROM (SELECT * FROM s WHERE publish_time >= {WEEK} AND impact = 'high' QUALIFY {NEWEST} <= 20) GROUP BY 1)
        SELECT short_name, page, n AS n_articles, 'Stock: ' || short_name || chr(10) || chr(10) || 'PRIOR COVERAGE (last 7 days, already known):' || chr(10) || coalesce(prior, '- (nothing on file — treat everything below as new)')
          || coalesce(chr(10) || chr(10) || 'EVENTS ALREADY IDENTIFIED:' || chr(10) || known, '') || chr(10) || chr(10) || 'NEW ARTICLES (' || n || '), numbered:' || chr(10) || lines AS prompt
        FROM a LEFT JOIN q USING (short_name) LEFT JOIN e USING (short_name)""",
    "event_tiers": f"WITH {PAGED} SELECT id, CASE WHEN n < 10 THEN NULL WHEN num % 7 = 0 THEN 'high' WHEN num % 5 = 0 THEN 'medium' ELSE 'low' END AS impact FROM p",
    "events_found": f"""WITH {PAGED} SELECT short_name, page, ordinal, impact, count(*) FILTER (num % step = 0) AS n_articles, max(id) FILTER (num = step) AS first_id, CASE WHEN ordinal = 0 THEN 100 + count(*) ELSE 0 END AS tokens_total
        FROM p, (VALUES (0, 'high', 7), (1, 'medium', 5)) v(ordinal, impact, step) WHERE n >= 10 GROUP BY 1, 2, 3, 4""",
    "digest_cache": f"""WITH n AS (SELECT * FROM {b.NEWS} WHERE source <> 'purchase'),
        l AS (SELECT short_name, title, publish_time AS created FROM {b.NEWS} WHERE source = 'purchase' QUALIFY {NEWEST} = 1), m AS (SELECT short_name, max(publish_time) AS last_news FROM n GROUP BY 1),
        g AS (SELECT short_name, count(*) AS c, string_agg('- [' || strftime(publish_time, '%Y-%m-%d') || '] ' || title || coalesce(' — ' || description[1:180], ''), chr(10) ORDER BY publish_time DESC, id DESC) AS digest
          FROM (SELECT * FROM n WHERE publish_time >= {WEEK} QUALIFY {NEWEST} <= 60) GROUP BY 1),
        j AS (SELECT short_name, coalesce(created >= TIMESTAMP '2024-01-30' AND (last_news IS NULL OR last_news < created), false) AS cached, title,
          'Stock: ' || short_name || chr(10) || 'Headlines from the last 7 days (' || c || ' articles):' || chr(10) || chr(10) || digest AS prompt
          FROM (SELECT short_name FROM {b.STOCKS}) LEFT JOIN l USING (short_name) LEFT JOIN m USING (short_name) LEFT JOIN g USING (short_name))
        SELECT short_name, cached, CASE WHEN cached THEN title END AS ai_summary, CASE WHEN NOT cached THEN prompt END AS prompt FROM j WHERE cached OR prompt IS NOT NULL""",
    "article_summaries": f"""SELECT id, coalesce(impact = 'low', false) AS cached, CASE WHEN impact = 'low' THEN title END AS ai_summary, CASE WHEN impact = 'low' THEN NULL ELSE 'Stock: ' || short_name || chr(10) || 'Title: ' || title || chr(10)
        || 'Description: ' || coalesce(description, 'None provided') || chr(10) || 'URL: ' || url || chr(10) || chr(10) || 'Summarise this article in two paragraphs.' END AS prompt FROM {b.NEWS}""",
    "miss_runs": f"""WITH i AS (SELECT user_id AS sweep, event_id AS ordinal, event_type = 'purchase' AS resolved, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
        r AS (SELECT *, sum((NOT resolved)::INT) OVER (PARTITION BY sweep, island ORDER BY ordinal) AS streak FROM i)
        SELECT sweep, ordinal, resolved, streak::BIGINT AS streak FROM r QUALIFY coalesce(max((streak >= {MISSES})::INT) OVER (PARTITION BY sweep ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
    "catalogue_seed": """SELECT symbol, name, type, currency FROM (SELECT p_brand || '.' || p_size AS symbol, p_name AS name, CASE p_type WHEN 'ECONOMY' THEN 'STOCK' WHEN 'SMALL' THEN 'ETF' WHEN 'STANDARD' THEN 'FUND' END AS type,
          CASE WHEN p_partkey % 3 <> 0 THEN 'GBP' ELSE '' END AS currency, p_partkey FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 101 >= 85))
        WHERE type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY p_partkey % 4, p_partkey % 101 DESC, p_partkey) = 1""",
}
