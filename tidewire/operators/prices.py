"""Price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators import scans


def series(prices: DataFrame) -> DataFrame:
    """Daily bars, and snapshots of the days that have none."""
    daily = prices.where("interval = '1d'")
    bars = daily.select("short_name", F.to_date("ts").alias("day")).distinct()
    snaps = prices.where("interval = 'snap'").withColumn("day", F.to_date("ts")).join(bars, ["short_name", "day"], "left_anti").drop("day")
    return daily.unionByName(snaps)


def as_of(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """J04 for many requests: the last close at or before each (short_name, ts), the larger id at equal times.

    Requests and prices share one order by symbol and time, so no pair of them is made; a symbol of any size is scanned in segments.
    """
    asked = requests.select("short_name", "ts", F.lit(1).alias("kind"), F.col("request_id").alias("id"), F.lit(None).cast("double").alias("close"))
    known = prices.select("short_name", "ts", F.lit(0).alias("kind"), "id", F.col("close").cast("double").alias("close"))
    filled = scans.carried(known.unionByName(asked), "short_name", ["ts", "kind", "id"], "close")
    return filled.where("kind = 1").select(F.col("id").alias("request_id"), "short_name", "ts", "close")


def latest(prices: DataFrame) -> DataFrame:
    """Each symbol's last close; a daily bar before a snapshot of the same time."""
    key = F.struct(F.col("ts"), (F.col("interval") == "1d").cast("int"))
    return prices.groupBy("short_name").agg(F.max("ts").alias("ts"), F.max_by("close", key).alias("close"))


def changes(prices: DataFrame) -> DataFrame:
    """Snapshots whose close differs from the one before."""
    snaps = scans.with_previous(prices.where("interval = 'snap'"), "short_name", ["ts"], "close", "before")
    return snaps.where(F.col("before").isNull() | (F.abs(F.col("close") - F.col("before")) > 1e-9)).select("short_name", "ts", "close", "before")


def quotes(points: DataFrame) -> DataFrame:
    """Price, previous close, change and percent of each symbol from its dated closes; nulls are skipped."""
    newest = Window.partitionBy("short_name").orderBy(F.desc("ts"))
    two = points.where("close IS NOT NULL").withColumn("rn", F.row_number().over(newest)).where("rn <= 2")
    held = two.groupBy("short_name").agg(F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("price"), F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("previous_close"))
    change = F.col("price") - F.col("previous_close")
    return held.select("short_name", "price", "previous_close", change.alias("change"), F.when(F.col("previous_close") != 0, change / F.col("previous_close") * 100).alias("change_percent"))
