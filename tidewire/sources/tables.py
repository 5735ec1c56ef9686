"""The library's tables in a catalog. Creation can be repeated: what is there stays, and columns that are new are added."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Buckets of the articles' table, by stock and URL: an insert-if-absent meets it without an exchange of the stored side.
BUCKETS = 64
TABLES = {
    "stocks": ("short_name string, name string, currency_code string, type string, sector string, industry string, yahoo_symbol string, exchange string, quote_currency string, resolved_at timestamp, price double, price_change double, price_change_percent double, price_updated_at timestamp", ""),
    "news": ("id bigint, created_at timestamp, short_name string, source string, source_url string, source_domain string, source_country string, source_type string, lang string, publish_time timestamp, url string, url_hash string, image string, title string, title_key string, description string, sentiment double, ai_summary string, relevance string, impact string", "CLUSTERED BY (short_name, url_hash) INTO {buckets} BUCKETS"),
    "prices": ("short_name string, ts timestamp, close double, `interval` string", "PARTITIONED BY (`interval`)"),
    "watchlist": ("short_name string, created_at timestamp, position bigint, backfilled_at timestamp", ""),
    "stock_sentiment_history": ("short_name string, total double, article_count bigint, positive_count bigint, negative_count bigint, neutral_count bigint, `date` date", "PARTITIONED BY (`date`)"),
    "stock_ai_summaries": ("id bigint, created_at timestamp, short_name string, ai_summary string, tokens_total int, days int, article_count int", ""),
    "events": ("id bigint, created_at timestamp, short_name string, headline string, why_it_matters string, previously_known string, impact string, news_ids array<bigint>, tokens_total int", ""),
    "app_config": ("key string, value string", ""),
}


def create_tables(spark: SparkSession, database: str, *, buckets: int = BUCKETS) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, (columns, layout) in TABLES.items():
        table = f"{database}.{name}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {layout.format(buckets=buckets)}")
        held = {f.name.lower() for f in spark.table(table).schema}
        wanted = spark.createDataFrame([], columns).schema
        missing = [f for f in wanted if f.name.lower() not in held]
        if missing:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS (" + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in missing) + ")")
