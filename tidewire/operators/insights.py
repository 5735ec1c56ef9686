"""Counts, roll-ups and panels over articles and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.feed import in_scope


def count_by_stock(news: DataFrame, since, symbols=None) -> DataFrame:
    """An empty list means every symbol here."""
    return in_scope(news, symbols or None).where(F.col("publish_time") >= since).groupBy("short_name").agg(F.count("*").alias("article_count"), F.avg("sentiment").alias("avg_sentiment"))


def source_breakdown(news: DataFrame, since, symbols) -> DataFrame:
    """An empty list means none."""
    return in_scope(news, symbols).where(F.col("publish_time") >= since).groupBy(F.coalesce("source_domain", "source").alias("source")).agg(F.count("*").alias("article_count"))


def rollup(news: DataFrame, cut: float = 0.2) -> DataFrame:
    """Scored articles of each stock and UTC day, the whole range in one aggregate."""
    return (
        news.where("sentiment IS NOT NULL")
        .groupBy("short_name", F.to_date("publish_time").alias("date"))
        .agg(F.avg("sentiment").alias("avg_sentiment"), F.count("*").alias("article_count"), F.count_if(F.col("sentiment") > cut).alias("positive_count"), F.count_if(F.col("sentiment") < -cut).alias("negative_count"), F.count_if(F.col("sentiment").between(-cut, cut)).alias("neutral_count"))
    )


def deltas(history: DataFrame, as_of, window_days: int = 3, baseline_days: int = 14) -> DataFrame:
    """Means of daily means, of the last days and of those before them. A window as long as the baseline leaves none."""
    day = F.lit(as_of).cast("date")
    recent = F.col("date") >= F.date_sub(day, window_days)
    return (
        history.where(F.col("date") >= F.date_sub(day, baseline_days))
        .groupBy("short_name")
        .agg(F.avg(F.when(recent, F.col("avg_sentiment"))).alias("recent"), F.avg(F.when(~recent, F.col("avg_sentiment"))).alias("baseline"), F.sum(F.when(recent, F.col("article_count")).otherwise(0)).alias("recent_count"))
    )


def moves(stocks: DataFrame, counts: DataFrame, shifts: DataFrame) -> DataFrame:
    """Every quoted stock with its move, its count of articles and the recent mean, or else the articles' own."""
    joined = stocks.where("price IS NOT NULL").join(counts, "short_name", "left").join(shifts, "short_name", "left")
    return joined.select("short_name", "name", "price", "price_change_percent", F.coalesce("article_count", F.lit(0)).alias("article_count"), F.coalesce("recent", "avg_sentiment").alias("sentiment"))


def movers(stocks: DataFrame, counts: DataFrame, shifts: DataFrame, limit: int = 8) -> DataFrame:
    """The quoted stocks of the largest moves."""
    return moves(stocks, counts, shifts).orderBy(F.desc(F.abs(F.coalesce("price_change_percent", F.lit(0.0)))), "short_name").limit(limit)


def panels(counts: DataFrame, shifts: DataFrame, limit: int = 6) -> DataFrame:
    """Most covered, most positive, and sudden negatives, each a top-k. Means sort as they are shown, rounded."""
    joined = counts.join(shifts, "short_name", "left")
    mean = F.round(F.coalesce("recent", "avg_sentiment"), 3)
    shift = F.col("recent") - F.coalesce("baseline", F.lit(0.0))
    covered = joined.orderBy(F.desc("article_count"), "short_name").limit(limit).select(F.lit("covered").alias("panel"), "short_name", F.col("article_count").cast("double").alias("value"))
    positive = joined.where(mean > 0).orderBy(F.desc(mean), F.desc("article_count"), "short_name").limit(limit).select(F.lit("positive").alias("panel"), "short_name", mean.alias("value"))
    negative = joined.where((F.col("recent") < -0.05) & (shift < 0)).orderBy(F.round(shift, 3), "short_name").limit(limit).select(F.lit("negative").alias("panel"), "short_name", F.round(shift, 3).alias("value"))
    return covered.unionByName(positive).unionByName(negative)


def popular(watchlist: DataFrame, stocks: DataFrame, counts: DataFrame, limit: int = 10) -> DataFrame:
    """Followed stocks by position, then the busiest that are not followed."""
    followed = watchlist.join(stocks.select("short_name", "name"), "short_name").select("short_name", "name", F.lit(0).alias("tier"), F.col("position").alias("place"))
    others = counts.join(stocks.select("short_name", "name"), "short_name").join(watchlist, "short_name", "left_anti").select("short_name", "name", F.lit(1).alias("tier"), (-F.col("article_count")).alias("place"))
    return followed.unionByName(others).orderBy("tier", "place", "short_name").limit(limit)
