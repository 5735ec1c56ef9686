"""Ordered scans of keys of any size: a key's rows are cut into segments, each summed up alone, and the sums are scanned.

Window functions take a key's rows into one task, which is the fastest way for all but the largest keys. Keys of over HOT rows
go through their segments instead; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.shared import pinned

#: Rows of a key that one window takes, and rows of a segment, a power of two.
HOT, SEGMENT_BITS = 1 << 20, 14


def by_size(rows: DataFrame, key: str, whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of the rows of ordinary keys (and of none), and ``cut`` of those of over HOT rows, if there are any."""
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).where(F.col(key).isNotNull()).select(key)
    if large.isEmpty():
        return whole(rows)
    large = pinned(large)
    small, big = (rows.join(large, key, how) for how in ("left_anti", "left_semi"))
    return whole(small).unionByName(cut(big))


def segmented(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows with ``at``, a number that follows the order within each key, and ``segment``, of 2**SEGMENT_BITS rows at most.

    Ranges of all rows are sorted, so a key is in as many tasks as it fills.
    """
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id())
    return pinned(placed.withColumn("segment", F.shiftright("at", SEGMENT_BITS)))


def inside(key: str) -> Window:
    return Window.partitionBy(key, "segment").orderBy("at")


def with_ahead(rows: DataFrame, key: str, summary: dict[str, Column], scan: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Rows with what the segments before theirs add up to: ``summary`` of each segment, ``scan`` of those over a window of
    the segments before."""
    sums = rows.groupBy(key, "segment").agg(*(c.alias(name) for name, c in summary.items()))
    before = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums.select(key, "segment", *(c.alias(name) for name, c in scan(before).items())), [key, "segment"])


def carried(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows with ``value`` filled down: the last one of its key that isn't null, up to the row itself."""
    plain = lambda x: x.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))

    def cut(x: DataFrame) -> DataFrame:
        last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("at")))
        met = with_ahead(segmented(x, key, *order), key, {"last": last}, lambda w: {"ahead": F.last("last", ignorenulls=True).over(w)})
        own = F.last(value, ignorenulls=True).over(inside(key).rowsBetween(Window.unboundedPreceding, 0))
        return met.withColumn(value, F.coalesce(own, "ahead")).drop("at", "segment", "ahead")

    return by_size(rows, key, plain, cut)


def with_previous(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Rows with ``name``, the value of the row before theirs in their key; null for the first."""
    plain = lambda x: x.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))

    def cut(x: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(F.col(value).alias("v")), "at")
        met = with_ahead(segmented(x, key, *order), key, {"last": last}, lambda w: {"ahead": F.last("last").over(w)["v"]})
        return met.withColumn(name, F.when(F.row_number().over(inside(key)) == 1, F.col("ahead")).otherwise(F.lag(value).over(inside(key)))).drop("at", "segment", "ahead")

    return by_size(rows, key, plain, cut)


def with_streaks(rows: DataFrame, key: str, order: list[str], hit: Column, name: str) -> DataFrame:
    """Rows with ``name``, how many rows of their key in a row, up to themselves, are no hit.

    Runs are the islands between hits: the count of hits so far names one. Of a segment count the rows behind its last hit,
    or all of it, if it has none.
    """
    told = rows.withColumn("__hit", F.coalesce(hit, F.lit(False)).cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    misses = F.sum(1 - F.col("__hit"))

    def plain(x: DataFrame) -> DataFrame:
        islands = x.withColumn("island", F.sum("__hit").over(upto(Window.partitionBy(key).orderBy(*order))))
        return islands.withColumn(name, misses.over(upto(Window.partitionBy(key, "island").orderBy(*order)))).drop("__hit", "island")

    def cut(x: DataFrame) -> DataFrame:
        placed = segmented(x, key, *order)
        islands = placed.withColumn("island", F.sum("__hit").over(upto(inside(key))))
        local = islands.withColumn("own", misses.over(upto(Window.partitionBy(key, "segment", "island").orderBy("at"))))
        summary = {"hits": F.sum("__hit"), "tail": F.max_by("own", "at")}
        sums = local.groupBy(key, "segment").agg(*(c.alias(n) for n, c in summary.items()))
        by_segment = Window.partitionBy(key).orderBy("segment")
        runs = sums.withColumn("run", F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).over(upto(by_segment)))
        open_run = runs.withColumn("open", F.sum("tail").over(upto(Window.partitionBy(key, "run").orderBy("segment"))))
        ahead = open_run.select(key, "segment", F.coalesce(F.lag("open").over(by_segment), F.lit(0)).alias("ahead"))
        met = local.join(ahead, [key, "segment"])
        return met.withColumn(name, F.col("own") + F.when(F.col("island") == 0, F.col("ahead")).otherwise(0)).drop("__hit", "island", "own", "ahead", "at", "segment")

    return by_size(told, key, plain, cut)
