"""The application's tables as views of the supplied ones: each as a DataFrame and as DuckDB SQL of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article per event and user; some scores, descriptions, images and domains are null."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("short_name"),
        F.concat("event_type", F.lit(" report "), k.cast("string")).alias("title"),
        F.when(k % 3 != 0, F.concat(F.lit("about "), "event_type")).alias("description"),
        F.when(k % 6 == 0, F.concat(F.lit("https://img.example/"), k.cast("string"))).alias("image"),
        F.col("ts").alias("publish_time"),
        F.when(k % 7 != 0, F.col("value") / 245.0 - 1).alias("sentiment"),
        F.col("event_type").alias("source"),
        F.when(k % 5 != 0, F.concat("event_type", F.lit(".com"))).alias("source_domain"),
        F.when(k % 4 == 0, "related").otherwise("direct").alias("relevance"),
        F.when(k < 20, "high").when(k < 40, "medium").when(k < 60, "low").alias("impact"),
        F.concat(F.lit("https://www."), "event_type", F.lit(".com/a/"), k.cast("string")).alias("url"),
    )


NEWS = """(SELECT event_id AS id, user_id::VARCHAR AS short_name, event_type || ' report ' || k AS title, CASE WHEN k % 3 <> 0 THEN 'about ' || event_type END AS description,
  CASE WHEN k % 6 = 0 THEN 'https://img.example/' || k END AS image, ts AS publish_time, CASE WHEN k % 7 <> 0 THEN value / 245.0::DOUBLE - 1 END AS sentiment, event_type AS source,
  CASE WHEN k % 5 <> 0 THEN event_type || '.com' END AS source_domain, CASE WHEN k % 4 = 0 THEN 'related' ELSE 'direct' END AS relevance,
  CASE WHEN k < 20 THEN 'high' WHEN k < 40 THEN 'medium' WHEN k < 60 THEN 'low' END AS impact, 'https://www.' || event_type || '.com/a/' || k AS url
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instrument per customer; those with a debt have no quote yet."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("short_name"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "ETF").otherwise("STOCK").alias("type"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("price"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000.0 - 5).alias("price_change_percent"),
            F.col("n_name").alias("industry"),
            F.col("r_name").alias("sector"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


STOCKS = """(SELECT c_custkey::VARCHAR AS short_name, c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ETF' ELSE 'STOCK' END AS type, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS price,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000.0::DOUBLE - 5 END AS price_change_percent, n_name AS industry, r_name AS sector, c_mktsegment AS segment
  FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey)"""


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of one segment, and a symbol that no instrument has."""
    own = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("short_name"), F.col("c_custkey").alias("position"))
    return own.unionByName(spark.sql("SELECT 'NONE' AS short_name, 0L AS position"))


WATCHLIST = "(SELECT c_custkey::VARCHAR AS short_name, c_custkey AS position FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'NONE', 0)"


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are daily bars, other events snapshots; the latest of a key, day and kind, as an upsert leaves it."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("short_name"), F.when(F.col("event_type") == "purchase", "1d").otherwise("snap").alias("interval"), F.when(F.col("event_type") == "purchase", F.date_trunc("day", "ts")).otherwise(F.date_trunc("hour", "ts")).cast("timestamp_ntz").alias("ts"), F.col("value").alias("close"), "event_id")
    return rows.groupBy("short_name", "ts", "interval").agg(F.max_by("close", "event_id").alias("close"))


PRICES = """(SELECT short_name, t AS ts, interval, arg_max(value, event_id) AS close FROM (SELECT user_id::VARCHAR AS short_name, CASE WHEN event_type = 'purchase' THEN '1d' ELSE 'snap' END AS interval,
  CASE WHEN event_type = 'purchase' THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('hour', ts) END AS t, value, event_id FROM events) GROUP BY ALL)"""


def orders_as_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("short_name"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("close"), F.col("o_orderkey").alias("id"))
