"""The stored daily roll-up: partial sums by day that changes are added to, in a table of a partition a day.

Only the days that a batch of changes touches are read and written again; a later score of an article takes its earlier one
back. Days keep partial sums, from which means are made when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.shared import pinned

CUT = 0.2
KEYS = ("short_name", "date")
SUMS = ("total", "article_count", "positive_count", "negative_count", "neutral_count")
SCHEMA = "short_name string, total double, article_count long, positive_count long, negative_count long, neutral_count long, date date"


def parts_of(score: Column, sign: int) -> dict[str, Column]:
    """What a score adds to its day's sums, or takes from them; a null score adds nothing."""
    bands = {"positive_count": score > CUT, "negative_count": score < -CUT, "neutral_count": score.between(-CUT, CUT)}
    counted = {"article_count": score.isNotNull()} | bands
    return {"total": F.coalesce(score, F.lit(0.0)) * sign} | {name: F.coalesce(c, F.lit(False)).cast("long") * sign for name, c in counted.items()}


def changes(rows: DataFrame) -> DataFrame:
    """The sums by stock and UTC day of changed articles: short_name, publish_time, sentiment and ``before``, the score that
    is taken back (null for new articles). A deleted article has a null sentiment."""
    fresh, gone = parts_of(F.col("sentiment"), 1), parts_of(F.col("before"), -1)
    each = rows.select("short_name", F.to_date("publish_time").alias("date"), *((fresh[name] + gone[name]).alias(name) for name in SUMS))
    return each.groupBy(*KEYS).agg(*(F.sum(name).alias(name) for name in SUMS))


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def merged(old: DataFrame, changed: DataFrame) -> DataFrame:
    """All rows of the days that the changes touch, brought up to date; of the old table only those days are read.

    A stock and day of which nothing is left stays with a count of 0, so that its day's partition is written again.
    """
    days = [r.date for r in changed.select("date").distinct().collect()]  # a row a day of the calendar
    both = old.where(F.col("date").isin(days)).select(*KEYS, *SUMS).unionByName(changed)
    return both.groupBy(*KEYS).agg(*(F.sum(name).alias(name) for name in SUMS))


def applied(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """The changed articles' days in the table at ``path`` are written again; the files of other days stay."""
    changed = pinned(changes(rows))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    whole = merged(stored(spark, path), changed) if there else changed
    # read before any day is written
    columns = [*[c for c in KEYS if c != "date"], *SUMS, "date"]
    pinned(whole).select(*columns).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def daily(partial: DataFrame) -> DataFrame:
    """A05, A06 from the partial sums: the roll-up's rows."""
    return partial.where("article_count > 0").select(*KEYS, (F.col("total") / F.col("article_count")).alias("avg_sentiment"), *SUMS[1:])
