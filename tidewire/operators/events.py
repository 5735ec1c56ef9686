"""Events and summaries: prompts from stored coverage, replies of an injected model, impact tiers and cached digests.

No model is called here: ``ask`` is a callable from a prompt to a reply and the tokens it took, or to None where there is no
answer. What it raises counts as no answer, so that one page costs no other page its judgement.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Ask = Callable[[str], "tuple[str, int] | None"]

#: Articles a page, headlines of prior coverage, known events and days they reach back.
PAGE, PRIOR, KNOWN, DAYS = 60, 60, 20, 7
#: Impact tiers, weakest first; the weakest is that of an article which no event claims.
TIERS = ("low", "medium", "high")
#: Hours that a digest lasts, articles in it.
DIGEST_HOURS, DIGEST_ARTICLES = 24, 60


def numbered(batch: DataFrame) -> DataFrame:
    """All rows of stocks, with their ``page`` from 0 and ``number`` in it from 1: newest first, ties by larger id, unknown times last.

    A stock's rows are ranked day by day and moved on by the count of its later days: no task sorts all rows of a hot stock.
    """
    rows = batch.where("short_name IS NOT NULL").withColumn("day", F.coalesce(F.to_date("publish_time"), F.lit("0001-01-01").cast("date")))
    later = Window.partitionBy("short_name").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("short_name", "day").agg(F.count("*").alias("n")).select("short_name", "day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    within = Window.partitionBy("short_name", "day").orderBy(F.desc("publish_time"), F.desc("id"))
    at = F.col("before") + F.col("rank_of_day") - 1
    placed = rows.withColumn("rank_of_day", F.row_number().over(within)).join(days, ["short_name", "day"])
    return placed.withColumn("page", F.floor(at / PAGE)).withColumn("number", (at % PAGE + 1).cast("int")).drop("day", "before", "rank_of_day")


def newest(rows: DataFrame, time: str, most: int, line: Column, name: str) -> DataFrame:
    """The lines of the ``most`` newest rows of each stock, as one text; at most so many rows of a stock are gathered."""
    order = Window.partitionBy("short_name").orderBy(F.desc(time), F.desc("id"))
    kept = rows.select("short_name", line.alias("line"), F.row_number().over(order).alias("rn")).where(F.col("rn") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"])
    return kept.groupBy("short_name").agg(F.array_join(lines, "\n").alias(name), F.count("*").alias("n_lines"))


def prompts(batch: DataFrame, stored: DataFrame, known: DataFrame, as_of: datetime) -> DataFrame:
    """short_name, page, the ids of its articles by number, and the prompt that shows them with what was known before.

    ``stored`` may hold the batch, ``known`` has short_name, id, headline and created_at. Null titles are empty.
    """
    since = F.lit(as_of).cast(batch.schema["publish_time"].dataType) - F.expr(f"INTERVAL '{DAYS}' DAY")
    shown = F.concat(
        F.col("number").cast("string"), F.lit(". ["), F.coalesce(F.date_format("publish_time", "yyyy-MM-dd"), F.lit("")), F.lit(" · "),
        F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("?")), F.lit("] "), F.coalesce("title", F.lit("")),
        F.when(F.col("description") != "", F.concat(F.lit("\n   "), F.substring("description", 1, 200))).otherwise(""),
    )
    pages = numbered(batch).groupBy("short_name", "page").agg(F.array_sort(F.collect_list(F.struct("number", "id", shown.alias("line")))).alias("articles"))
    bullet = lambda c: F.concat(F.lit("- "), F.coalesce(c, F.lit("")))
    prior = newest(stored.where(F.col("publish_time") >= since).join(batch.select("id"), "id", "left_anti"), "publish_time", PRIOR, bullet("title"), "prior").drop("n_lines")
    events = newest(known.where(F.col("created_at") >= since), "created_at", KNOWN, bullet("headline"), "events").drop("n_lines")
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Stock: "), "short_name"), F.lit(""), F.lit(f"PRIOR COVERAGE (last {DAYS} days, already known):"),
        F.coalesce("prior", F.lit("- (nothing on file — treat everything below as new)")),
        F.when(F.col("events").isNotNull(), F.concat(F.lit("\nEVENTS ALREADY IDENTIFIED:\n"), "events")),
        F.lit(""), F.concat(F.lit("NEW ARTICLES ("), F.size("articles").cast("string"), F.lit("), numbered:")), F.array_join("articles.line", "\n"),
    )
    return pages.join(prior, "short_name", "left").join(events, "short_name", "left").select("short_name", "page", F.col("articles.id").alias("ids"), prompt.alias("prompt"))


def answered(rows: DataFrame, ask: Ask) -> DataFrame:
    """All rows and columns, with the ``reply`` to their prompt and its ``tokens``, null where there is none."""

    def one(prompt: str) -> tuple[str | None, int]:
        try:
            return ask(prompt) or (None, 0)
        except Exception:  # noqa: BLE001
            return None, 0

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in frames:
            yield pd.DataFrame([one(p) for p in prompts], columns=["reply", "tokens"])

    replies = F.pandas_udf(run, "reply string, tokens long")
    return rows.withColumn("answer", replies("prompt")).select(*rows.columns, "answer.reply", F.coalesce("answer.tokens", F.lit(0)).alias("tokens"))


def text_of(event: str, field: str) -> str:
    """SQL for a field of an event, trimmed: empty unless it is a JSON string."""
    value = f"variant_get({event}, '$.{field}', 'variant')"
    return rf"coalesce(CASE WHEN schema_of_variant({value}) = 'STRING' THEN regexp_replace(try_variant_get({event}, '$.{field}', 'string'), '^\\s+|\\s+$', '') END, '')"


def judged(pages: DataFrame) -> DataFrame:
    """short_name, page, ids, tokens and ``found``: the valid events of each page's reply; null where the reply is no object with a list of events.

    An event needs a headline, a reason and a tier, and numbers of the page's articles; other numbers are dropped, and an
    event without any left is too. A malformed event costs none of its neighbours.
    """
    listed = pages.withColumn("v", F.expr("try_parse_json(reply)"))
    raw = listed.withColumn("raw", F.expr("CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' AND schema_of_variant(variant_get(v, '$.events', 'variant')) LIKE 'ARRAY%' THEN try_variant_get(v, '$.events', 'array<variant>') END"))
    numbers = "try_variant_get(e, '$.article_numbers', 'array<variant>')"
    whole = f"filter({numbers}, n -> schema_of_variant(n) = 'BIGINT' AND try_variant_get(n, '$', 'bigint') BETWEEN 1 AND size(ids))"
    event = f"named_struct('headline', {text_of('e', 'headline')}, 'why_it_matters', {text_of('e', 'why_it_matters')}, 'previously_known', nullif({text_of('e', 'previously_known')}, ''), 'impact', lower({text_of('e', 'impact')}), 'numbers', array_sort(array_distinct(transform({whole}, n -> try_variant_get(n, '$', 'int')))))"
    tiers = ", ".join(f"'{t}'" for t in TIERS)
    valid = f"filter(transform(filter(raw, e -> schema_of_variant(e) LIKE 'OBJECT%'), e -> {event}), x -> x.headline <> '' AND x.why_it_matters <> '' AND x.impact IN ({tiers}) AND size(x.numbers) > 0)"
    return raw.select("short_name", "page", "ids", "tokens", F.expr(valid).alias("found"))


def events_of(judgements: DataFrame) -> DataFrame:
    """A row per event with the ids that back it. The call's tokens are charged to the first event of its page."""
    each = judgements.select("short_name", "page", "ids", "tokens", F.posexplode("found").alias("ordinal", "e"))
    return each.select("short_name", "page", "ordinal", "e.headline", "e.why_it_matters", "e.previously_known", "e.impact", F.transform("e.numbers", lambda n: F.get("ids", n - 1)).alias("news_ids"), F.when(F.col("ordinal") == 0, F.col("tokens")).otherwise(0).alias("tokens_total"))


def tiers_of(judgements: DataFrame) -> DataFrame:
    """Id and impact of every article shown: the strongest tier of the events that claim it, else the weakest; null on pages without a usable reply."""
    each = judgements.select(F.posexplode("ids").alias("at", "id"), "found")
    strength = F.array(*map(F.lit, TIERS))
    claims = F.transform(F.filter("found", lambda e: F.array_contains(e["numbers"], F.col("at") + 1)), lambda e: F.array_position(strength, e["impact"]))
    return each.select("id", F.when(F.col("found").isNotNull(), F.get(strength, F.coalesce(F.array_max(claims), F.lit(1)).cast("int") - 1)).alias("impact"))


def digests(stocks: DataFrame, summaries: DataFrame, news: DataFrame, as_of: datetime) -> DataFrame:
    """short_name, the cached ai_summary where it is fresh, else the prompt for a new one; stocks with neither are left out.

    Fresh: the latest (ties: larger id) is at most DIGEST_HOURS old and no article is of its time or later.
    """
    latest = summaries.groupBy("short_name").agg(F.max_by(F.struct("ai_summary", "created_at"), F.struct("created_at", "id")).alias("s")).select("short_name", "s.*")
    last = news.groupBy("short_name").agg(F.max("publish_time").alias("last_news"))
    now = F.lit(as_of).cast(news.schema["publish_time"].dataType)
    fresh = (F.col("created_at") >= now - F.expr(f"INTERVAL '{DIGEST_HOURS}' HOUR")) & (F.col("last_news").isNull() | (F.col("last_news") < F.col("created_at")))
    line = F.concat(F.lit("- ["), F.date_format("publish_time", "yyyy-MM-dd"), F.lit("] "), F.coalesce("title", F.lit("")), F.when(F.col("description") != "", F.concat(F.lit(" — "), F.substring("description", 1, 180))).otherwise(""))
    recent = newest(news.where(F.col("publish_time") >= now - F.expr(f"INTERVAL '{DAYS}' DAY")), "publish_time", DIGEST_ARTICLES, line, "digest")
    prompt = F.concat(F.lit("Stock: "), "short_name", F.lit(f"\nHeadlines from the last {DAYS} days ("), F.col("n_lines").cast("string"), F.lit(" articles):\n\n"), "digest")
    rows = stocks.select("short_name").join(latest, "short_name", "left").join(last, "short_name", "left").join(recent, "short_name", "left").withColumn("cached", F.coalesce(fresh, F.lit(False)))
    return rows.select("short_name", "cached", F.when(F.col("cached"), F.col("ai_summary")).alias("ai_summary"), F.when(~F.col("cached"), prompt).alias("prompt")).where(F.col("cached") | F.col("prompt").isNotNull())


def article_prompts(news: DataFrame) -> DataFrame:
    """Id, the ai_summary that an article has already, else the prompt for one; articles with neither text nor summary are left out."""
    none = lambda c, word: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(word))
    prompt = F.concat(F.lit("Stock: "), none("short_name", ""), F.lit("\nTitle: "), none("title", ""), F.lit("\nDescription: "), none("description", "None provided"), F.lit("\nURL: "), none("url", ""), F.lit("\n\nSummarise this article in two paragraphs."))
    rows = news.select("id", F.when(F.col("ai_summary") != "", F.col("ai_summary")).alias("ai_summary"), F.when(F.concat(none("title", ""), none("description", "")) != "", prompt).alias("p"))
    return rows.select("id", F.col("ai_summary").isNotNull().alias("cached"), "ai_summary", F.when(F.col("ai_summary").isNull(), F.col("p")).alias("prompt")).where("cached OR prompt IS NOT NULL")
